"""Body text of the evidence outline: every character of every page once, by the section that is active there.

Pages are cut where accepted headings begin and end and where an open candidate begins; all else are windows over the cuts of a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outline_jobs.functions import slices
from outline_jobs.functions import text as tx
from outline_jobs.operators.blocks import present


def _in_order():
    return Window.partitionBy("doc_id").orderBy("page", "start")


def body_segments(pages: DataFrame, candidates: DataFrame, decisions: DataFrame, nodes: DataFrame) -> DataFrame:
    """doc_id, page, start, end, heading, open, gap: segments between cuts. heading: the accepted heading here, open: the open candidate that begins here, gap: pages before are missing.

    Segments of no length, which carry what begins at the end of a page or on an empty one, are kept for the windows that follow.
    """
    c = candidates.select("doc_id", "candidate_id", "page", "start", "end")
    made = c.join(nodes.select("doc_id", F.col("node_id").alias("candidate_id")), ["doc_id", "candidate_id"], "left_semi")
    open_ = c.join(decisions.where("status = 'AMBIGUOUS'").select("doc_id", "candidate_id"), ["doc_id", "candidate_id"], "left_semi")
    none = F.lit(None).cast("string")
    p = pages.select("doc_id", "page", F.length(F.coalesce("markdown", F.lit(""))).alias("_len"))
    p = p.withColumn("gap", F.coalesce(F.col("page") > F.lag("page").over(Window.partitionBy("doc_id").orderBy("page")) + 1, F.lit(False)))
    row = lambda d, at, heading, open_, gap: d.select("doc_id", "page", at.cast("int").alias("start"), heading.alias("heading"), open_.alias("open"), gap.alias("gap"))
    no = F.lit(False)
    cuts = row(p, F.lit(0), none, none, F.col("gap"))
    for more in (row(p, F.col("_len"), none, none, no), row(made, F.col("start"), F.col("candidate_id"), none, no), row(made, F.col("end"), none, none, no), row(open_, F.col("start"), none, F.col("candidate_id"), no)):
        cuts = cuts.unionByName(more)
    cuts = cuts.groupBy("doc_id", "page", "start").agg(F.max("heading").alias("heading"), F.max("open").alias("open"), F.max("gap").alias("gap"))
    end = F.lead("start").over(Window.partitionBy("doc_id", "page").orderBy("start"))
    return cuts.withColumn("end", F.coalesce(end, F.col("start")))


def segment_owner(segments: DataFrame) -> DataFrame:
    """With owner: the last accepted heading that began here or before, across pages; opened_by: the same, null before the first; island: how many began so far."""
    w = _in_order().rowsBetween(Window.unboundedPreceding, 0)
    d = segments.withColumns({"opened_by": F.last("heading", ignorenulls=True).over(w), "island": F.count("heading").over(w)})
    return d.withColumn("owner", F.coalesce("opened_by", F.lit("root"))).withColumn("status", F.when(F.col("heading").isNotNull(), "HEADING").otherwise("ASSIGNED"))


def segment_uncertainty(owned: DataFrame) -> DataFrame:
    """With n_uncertain, ownership_reasons and ownership: what is open from an open candidate, or from a page after missing ones, to the next accepted heading.

    n_uncertain counts the open candidates so far in the island: the first so many of its list (`island_boundaries`) are the boundaries in
    doubt. The lists themselves would be as long together as the square of the candidates.
    """
    w = Window.partitionBy("doc_id", "island").orderBy("page", "start").rowsBetween(Window.unboundedPreceding, 0)
    gap = F.max(F.col("gap") & F.col("heading").isNull()).over(w)
    d = owned.withColumn("n_uncertain", F.count("open").over(w).cast("int"))
    d = d.withColumn("ownership_reasons", present(F.when(F.col("n_uncertain") > 0, "AMBIGUOUS_HEADING_BOUNDARY"), F.when(gap, "UNSELECTED_PAGE_GAP")))
    return d.withColumn("ownership", F.when(F.size("ownership_reasons") > 0, "provisional").otherwise("source_sliced"))


def island_boundaries(owned: DataFrame) -> DataFrame:
    """doc_id, island, boundaries: the open candidates of each island that has any, in order."""
    d = owned.where("open is not null").groupBy("doc_id", "island").agg(F.sort_array(F.collect_list(F.struct("page", "start", "open"))).alias("_open"))
    return d.select("doc_id", "island", F.transform("_open", lambda x: x["open"]).alias("boundaries"))


def with_boundaries(segments: DataFrame, islands: DataFrame) -> DataFrame:
    """segments with uncertain_boundaries, each its own list; for the segments that are looked at, not for whole corpora."""
    d = segments.join(islands, ["doc_id", "island"], "left")
    none = F.array().cast("array<string>")
    return d.withColumn("uncertain_boundaries", F.when(F.col("n_uncertain") > 0, F.slice("boundaries", 1, F.col("n_uncertain"))).otherwise(none)).drop("boundaries")


def scope_events(d: DataFrame, nodes: DataFrame) -> DataFrame:
    """With scope_path (ids from the root to the owner) and, for headings, closed (innermost first) and opened sections."""
    path = nodes.select("doc_id", F.col("node_id").alias("owner"), F.col("node_path").alias("scope_path"))
    d = d.join(path, ["doc_id", "owner"], "left")
    before = F.coalesce(F.lag("scope_path").over(_in_order()), F.array(F.lit("root")))
    d = d.withColumn("_before", before)
    heading = F.col("heading").isNotNull()
    return d.withColumns({
        "closed": F.when(heading, F.reverse(F.array_except("_before", "scope_path"))), "opened": F.when(heading, F.array_except("scope_path", "_before")),
        "boundary": F.when(heading, "SUPPORTED_HEADING"),
    }).drop("_before")


def signs(segments: DataFrame) -> DataFrame:
    """With the first and the last character of the text, which is all that separators depend on."""
    return segments.withColumns({"first_sign": F.left("text", F.lit(1)), "last_sign": F.right("text", F.lit(1))})


def page_separators(segments: DataFrame) -> DataFrame:
    """segments with signs -> with separator_before: a line end where an owner's text goes on on another page and no white space is on either side of the joint."""
    w = Window.partitionBy("doc_id", "owner", "status").orderBy("page", "start")
    blank = lambda c: c.rlike(f"^[{tx.WS}]$")
    last = F.lag(F.struct("page", F.col("last_sign").alias("sign"))).over(w)
    d = segments.withColumn("_last", last)
    joint = (F.col("status") == "ASSIGNED") & (F.col("_last.page") != F.col("page")) & ~blank(F.col("_last.sign")) & ~blank(F.col("first_sign"))
    d = d.withColumn("separator_before", F.when(F.coalesce(joint, F.lit(False)), "\n").otherwise("")).drop("_last", "first_sign", "last_sign")
    return d.withColumn("separator_reason", F.when(F.col("separator_before") != "", "PAGE_BOUNDARY_SEPARATOR"))


#: What is assumed of every segment's scope.
SCOPE_ASSUMPTION, ANCESTOR_RESUMPTION = "Active section continues until a supported heading changes scope", "not_inferred"


def attach_body(pages: DataFrame, candidates: DataFrame, decisions: DataFrame, nodes: DataFrame, revisions: DataFrame) -> DataFrame:
    """Segments of all pages with owner, status, ownership, scope, boundary, separator and revision; their texts stay in the pages (`with_texts`)."""
    owned = segment_owner(body_segments(pages, candidates, decisions, nodes))
    d = scope_events(segment_uncertainty(owned), nodes).where(F.col("end") > F.col("start"))
    d = page_separators(signs(slices.cut(d, pages, "text")).drop("text", "page_length")).join(revisions, "doc_id")
    return d.select(
        "doc_id", "page", "start", "end", "owner", "status", "ownership", "island", "n_uncertain", "ownership_reasons", "scope_path", "opened_by",
        F.lit(SCOPE_ASSUMPTION).alias("scope_assumption"), F.lit(ANCESTOR_RESUMPTION).alias("ancestor_resumption"),
        "boundary", "closed", "opened", "separator_before", "separator_reason", "revision",
    )


def with_texts(segments: DataFrame, pages: DataFrame) -> DataFrame:
    """segments with their texts, cut from the pages: for whoever reads texts, so that they are not stored again beside the pages."""
    return slices.cut(segments, pages, "text").drop("page_length")


def _joined(kind: Column) -> Column:
    """Texts of the rows where kind holds, with their separators, in order."""
    rows = F.sort_array(F.collect_list(F.when(kind, F.struct("page", "start", F.concat("separator_before", "text").alias("text")))))
    return F.array_join(F.transform(rows, lambda r: r["text"]), "")


def own_text(segments: DataFrame) -> DataFrame:
    """doc_id, owner, own_text: assigned text alone, without that of sections below."""
    return segments.groupBy("doc_id", "owner").agg(_joined(F.col("status") == "ASSIGNED").alias("own_text"))


def with_text(nodes: DataFrame, segments: DataFrame) -> DataFrame:
    """The tree's nodes with their own text, '' without any."""
    t = own_text(segments).select("doc_id", F.col("owner").alias("node_id"), F.col("own_text").alias("text"))
    return nodes.join(t, ["doc_id", "node_id"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def body_index(nodes: DataFrame, segments: DataFrame) -> DataFrame:
    """One row for each node: own and heading ranges, characters of source and of text, separators, whether any of it is provisional."""
    own = F.col("status") == "ASSIGNED"
    span = lambda kind: F.sort_array(F.collect_list(F.when(kind, F.struct("page", "start", "end"))))
    d = segments.groupBy("doc_id", F.col("owner").alias("node_id")).agg(
        span(own).alias("own_ranges"), span(~own).alias("heading_ranges"), F.sum(F.when(own, F.length("text"))).alias("source_characters"),
        F.sum(F.when(own, F.length("separator_before"))).alias("generated_page_separators"), F.max(own & (F.col("ownership") == "provisional")).alias("_open"),
    )
    none = F.array().cast("array<struct<page:int,start:int,end:int>>")
    return nodes.select("doc_id", "node_id", "label", "title", "text").join(d, ["doc_id", "node_id"], "left").select(
        "doc_id", "node_id", "label", "title", F.coalesce("own_ranges", none).alias("own_ranges"), F.coalesce("heading_ranges", none).alias("heading_ranges"),
        F.coalesce("source_characters", F.lit(0)).alias("source_characters"), F.length("text").alias("export_characters"), F.coalesce("generated_page_separators", F.lit(0)).alias("generated_page_separators"),
        F.when(F.col("_open"), "provisional").otherwise("source_sliced").alias("ownership"), F.col("text").alias("own_text"), F.lit(False).alias("verified"),
    )
