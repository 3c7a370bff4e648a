"""Comparing two runs, texts line by line, and a run with a reference tree.

A reference heading counts as found only where an alignment confirms it; labels and titles alone give suggestions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outline_jobs.functions import text as tx
from outline_jobs.operators import quality

FIELDS = ("label", "title", "depth", "parent", "own_text")


def _keyed(nodes: DataFrame) -> DataFrame:
    """Nodes by page, label and title (the root by itself), with what is compared; texts as hashes until a difference is known."""
    n = nodes.select("doc_id", "node_id", "parent_id", "page", "label", "title", "depth", F.sha2(F.encode("text", "UTF-8"), 256).alias("own_text"))
    up = nodes.select("doc_id", F.col("node_id").alias("parent_id"), F.to_json(F.struct("label", "title")).alias("parent"))
    root = F.col("parent_id").isNull()
    key = F.when(root, "root").otherwise(F.to_json(F.struct(F.col("page"), F.col("label"), F.col("title"))))
    keyed = n.join(up, ["doc_id", "parent_id"], "left").withColumn("identity", key)
    return keyed.groupBy("doc_id", "identity").agg(F.count(F.lit(1)).alias("n"), *[F.min(f).alias(f) for f in FIELDS])


def compare_runs(left: DataFrame, right: DataFrame) -> DataFrame:
    """doc_id, identity, status ('changed' or 'unmatched'), fields: an identity must be unique on both sides to be compared.

    left, right: doc_id, node_id, parent_id, page, label, title, depth, text. Equal nodes are left out.
    """
    a, b = _keyed(left), _keyed(right)
    both = a.select("doc_id", "identity", F.col("n").alias("a_n"), *[F.col(f).alias(f"a_{f}") for f in FIELDS]).join(
        b.select("doc_id", "identity", F.col("n").alias("b_n"), *[F.col(f).alias(f"b_{f}") for f in FIELDS]), ["doc_id", "identity"], "full"
    )
    fields = F.filter(F.array(*[F.when(~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}")), f) for f in FIELDS]), lambda x: x.isNotNull())
    unique = (F.coalesce("a_n", F.lit(0)) == 1) & (F.coalesce("b_n", F.lit(0)) == 1)
    out = both.select("doc_id", "identity", F.when(unique, "changed").otherwise("unmatched").alias("status"), F.when(unique, fields).otherwise(F.array().cast("array<string>")).alias("fields"))
    return out.where("status = 'unmatched' or size(fields) > 0")


def body_line_diff(texts: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """keys, line, missing (lines of a beyond b), added: the multiset form of a line difference."""
    one = lambda c, sign: texts.select(*keys, F.explode(F.split(F.coalesce(c, F.lit("")), "\n", -1)).alias("line"), F.lit(sign).alias("n"))
    d = one(a, 1).unionByName(one(b, -1)).groupBy(*keys, "line").agg(F.sum("n").alias("n")).where("n <> 0")
    return d.select(*keys, "line", F.greatest("n", F.lit(0)).alias("missing"), F.greatest(-F.col("n"), F.lit(0)).alias("added"))


def text_consistency(nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """doc_id, token, missing (in the source, not in the tree), added: tokens of labels, titles and texts against those of sources (doc_id, text)."""
    own = nodes.select("doc_id", F.lit(None).cast("string").alias("source"), F.concat_ws(" ", "label", "title", "text").alias("tree"))
    return quality.token_diff(sources.select("doc_id", F.col("text").alias("source"), F.lit(None).cast("string").alias("tree")).unionByName(own), ["doc_id"], "source", "tree")


def comparable_runs(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id of runs with one source hash and one list of pages, doc_id and error of the others); left, right: doc_id, document_hash, page."""
    pages = lambda d, c: d.groupBy("doc_id").agg(F.struct(F.max("document_hash").alias("hash"), F.sort_array(F.collect_list("page")).alias("pages")).alias(c))
    d = pages(left, "a").join(pages(right, "b"), "doc_id", "full")
    same = F.col("a").eqNullSafe(F.col("b"))
    return d.where(same).select("doc_id"), d.where(~same).select("doc_id", F.lit("runs must have one source hash and the same pages").alias("error"))


def page_changes(left: DataFrame, right: DataFrame) -> DataFrame:
    """doc_id, page, automatic, manual: Markdown that differs between two runs."""
    d = left.select("doc_id", "page", F.col("markdown").alias("automatic")).join(right.select("doc_id", "page", F.col("markdown").alias("manual")), ["doc_id", "page"])
    return d.where(~F.col("automatic").eqNullSafe(F.col("manual")))


def match_runs_to_references(runs: DataFrame, references: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(run_id, reference_id, doc_id pairs, references without a run). Both have document_hash and selected_pages; only equal pairs compare."""
    r = runs.select("run_id", "document_hash", "selected_pages")
    pairs = r.join(references.select("reference_id", "document_hash", "selected_pages"), ["document_hash", "selected_pages"]).select("run_id", "reference_id")
    return pairs, references.join(pairs.select("reference_id").distinct(), "reference_id", "left_anti").select("reference_id", F.lit("no run of this source and these pages").alias("error"))


def _key() -> list[Column]:
    return [F.coalesce("label", F.lit("")).alias("label"), tx.strip(F.coalesce("title", F.lit(""))).alias("title")]


def _linked(references: DataFrame, candidates: DataFrame, alignment: DataFrame, revisions: DataFrame) -> DataFrame:
    """Reference headings (not roots) with their link and the candidates it allows: n_eligible, and eligible_id where that is the only one."""
    refs = references.where("parent_id is not null").select("doc_id", F.col("node_id").alias("reference_id"), "ord", "parent_id", *_key())
    d = refs.join(alignment, ["doc_id", "reference_id"], "left").join(revisions.select("doc_id", "revision"), "doc_id", "left")
    at = d.where("pages is not null").select("doc_id", "reference_id", "canonical_revision", "revision", F.col("start").alias("_start"), F.explode(F.array_distinct("pages")).alias("page"), F.col("heading_text").alias("raw"))
    c = candidates.select("doc_id", "candidate_id", "page", "raw", "start")
    allowed = at.join(c, ["doc_id", "page", "raw"]).where("canonical_revision is null or (canonical_revision = revision and start <=> _start)")
    allowed = allowed.groupBy("doc_id", "reference_id").agg(F.count(F.lit(1)).alias("n_eligible"), F.min("candidate_id").alias("_only"))
    d = d.join(allowed, ["doc_id", "reference_id"], "left").withColumn("n_eligible", F.coalesce("n_eligible", F.lit(0)))
    sure = F.coalesce("confirmed", F.lit(False))
    return d.withColumns({"confirmed": sure, "eligible_id": F.when(sure & (F.col("n_eligible") == 1), F.col("_only"))}).drop("_only")


def align_headings(references: DataFrame, nodes: DataFrame, candidates: DataFrame, alignment: DataFrame, revisions: DataFrame) -> DataFrame:
    """doc_id, reference_id, ord, prediction_id, status: in the references' order, a confirmed link takes its node, else a label and title that is unique on both sides takes it; a node is taken once.

    In closed form: a node that a link claims counts as taken for every later reference; so a key's node must have no earlier claim,
    and a link's claim fails after an earlier link or an earlier key that holds the node.
    """
    refs = _linked(references, candidates, alignment, revisions)
    preds = nodes.where("parent_id is not null").select("doc_id", F.col("node_id").alias("prediction_id"), *_key())
    claims = refs.join(preds.select("doc_id", F.col("prediction_id").alias("eligible_id"), F.lit(True).alias("_node")), ["doc_id", "eligible_id"], "left")
    first = claims.where("_node").groupBy("doc_id", F.col("eligible_id").alias("prediction_id")).agg(F.min("ord").alias("_first"))
    alone = F.count(F.lit(1)).over(Window.partitionBy("doc_id", "label", "title")) == 1
    keyed = refs.withColumn("_alone", alone).where("_alone and eligible_id is null").select("doc_id", "reference_id", "ord", "label", "title")
    free = keyed.join(preds.join(first, ["doc_id", "prediction_id"], "left"), ["doc_id", "label", "title"]).where("_first is null or _first >= ord")
    by_key = free.groupBy("doc_id", "reference_id", "ord").agg(F.count(F.lit(1)).alias("_n"), F.min("prediction_id").alias("_key_id")).where("_n = 1")
    held = by_key.select("doc_id", F.col("_key_id").alias("eligible_id"), F.col("ord").alias("_held"))
    by_link = claims.where("_node").join(first.withColumnRenamed("prediction_id", "eligible_id"), ["doc_id", "eligible_id"]).join(held, ["doc_id", "eligible_id"], "left")
    by_link = by_link.where("ord = _first and (_held is null or _held > ord)").select("doc_id", "reference_id", F.col("eligible_id").alias("_link_id"))
    d = refs.join(by_key.select("doc_id", "reference_id", "_key_id"), ["doc_id", "reference_id"], "left").join(by_link, ["doc_id", "reference_id"], "left")
    status = F.when(F.col("_link_id").isNotNull(), "confirmed").otherwise("needs_manual_alignment")
    return d.select("doc_id", "reference_id", "ord", F.coalesce("_link_id", "_key_id").alias("prediction_id"), status.alias("status"))


def candidate_capture(references: DataFrame, candidates: DataFrame, alignment: DataFrame, revisions: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, reference_id, ord, suggested (label and title occur among the candidates), candidate_id (confirmed, each once), miss ('extraction', 'candidate_generation'), uncertain."""
    refs = _linked(references, candidates, alignment, revisions)
    own = candidates.select("doc_id", *_key()).distinct().withColumn("suggested", F.lit(True))
    listed = pages.groupBy("doc_id").agg(F.collect_set("page").alias("_pages"))
    d = refs.join(own, ["doc_id", "label", "title"], "left").join(listed, "doc_id", "left")
    first = F.row_number().over(Window.partitionBy("doc_id", "eligible_id").orderBy("ord")) == 1
    d = d.withColumn("candidate_id", F.when(F.col("eligible_id").isNotNull() & first, F.col("eligible_id")))
    known = F.coalesce("markdown_presence_confirmed", F.lit(False)) & F.col("markdown_presence").isin("present", "absent")
    here = F.coalesce((F.size("pages") > 0) & (F.size(F.array_except("pages", "_pages")) == 0), F.lit(False)) & F.coalesce(F.col("canonical_revision") == F.col("revision"), F.lit(True))
    miss = F.when(F.col("candidate_id").isNull() & (F.col("n_eligible") == 0) & F.col("confirmed") & known & here, F.when(F.col("markdown_presence") == "present", "candidate_generation").otherwise("extraction"))
    d = d.withColumn("miss", miss)
    present = F.coalesce("markdown_presence", F.lit("present")) == "present"
    return d.select(
        "doc_id", "reference_id", "ord", F.coalesce("suggested", F.lit(False)).alias("suggested"), "candidate_id", "miss", (F.col("candidate_id").isNull() & F.col("miss").isNull()).alias("uncertain"),
        F.coalesce("markdown_presence_confirmed", F.lit(False)).alias("presence_known"), (F.coalesce("markdown_presence_confirmed", F.lit(False)) & present).alias("present"),
    )


def attribute_misses(matches: DataFrame, capture: DataFrame) -> DataFrame:
    """doc_id, reference_id, stage that lost a reference heading without a confirmed match."""
    d = capture.join(matches.where("status = 'confirmed'").select("doc_id", "reference_id"), ["doc_id", "reference_id"], "left_anti")
    return d.select("doc_id", "reference_id", F.coalesce("miss", F.when(F.col("candidate_id").isNotNull(), "resolver"), F.lit("unclassified")).alias("stage"))


def parent_accuracy(matches: DataFrame, references: DataFrame, nodes: DataFrame) -> DataFrame:
    """doc_id, reference_id, correct: confirmed matches whose reference parent is the root or matched itself."""
    sure = matches.where("status = 'confirmed'").select("doc_id", "reference_id", "prediction_id")
    up = references.select("doc_id", F.col("node_id").alias("reference_id"), F.col("parent_id").alias("_up"))
    tops = references.where("parent_id is null").select("doc_id", F.col("node_id").alias("_up"), F.lit("root").alias("_root"))
    mapped = sure.select("doc_id", F.col("reference_id").alias("_up"), F.col("prediction_id").alias("_mapped"))
    d = sure.join(up, ["doc_id", "reference_id"]).join(tops, ["doc_id", "_up"], "left").join(mapped, ["doc_id", "_up"], "left")
    d = d.join(nodes.select("doc_id", F.col("node_id").alias("prediction_id"), F.col("parent_id").alias("_got")), ["doc_id", "prediction_id"], "left").withColumn("_want", F.coalesce("_root", "_mapped"))
    return d.where("_want is not null").select("doc_id", "reference_id", F.coalesce(F.col("_got") == F.col("_want"), F.lit(False)).alias("correct"))


def own_text_accuracy(matches: DataFrame, references: DataFrame, nodes: DataFrame, segments: DataFrame, alignment: DataFrame) -> DataFrame:
    """doc_id, reference_id, exact, normalized: confirmed matches with a confirmed own text and no provisional segment."""
    m = matches.where("status = 'confirmed'").join(alignment.where("own_text_confirmed").select("doc_id", "reference_id"), ["doc_id", "reference_id"], "left_semi")
    open_ = segments.where("status = 'ASSIGNED' and ownership = 'provisional'").select("doc_id", F.col("owner").alias("prediction_id")).distinct()
    m = m.join(open_, ["doc_id", "prediction_id"], "left_anti").join(references.select("doc_id", F.col("node_id").alias("reference_id"), F.col("text").alias("_a")), ["doc_id", "reference_id"])
    m = m.join(nodes.select("doc_id", F.col("node_id").alias("prediction_id"), F.col("text").alias("_b")), ["doc_id", "prediction_id"])
    even = lambda c: tx.strip(tx.squeeze(F.coalesce(c, F.lit(""))))
    return m.select("doc_id", "reference_id", F.col("_a").eqNullSafe(F.col("_b")).alias("exact"), (even("_a") == even("_b")).alias("normalized"))


STATUS_WORDS = {"ai_unreviewed": "against AI draft reference", "synthetic": "against synthetic reference", "reviewed": "against reviewed golden"}


def evaluation_scores(matches: DataFrame, capture: DataFrame, parents: DataFrame, own_texts: DataFrame, candidates: DataFrame, nodes: DataFrame, metadata: DataFrame) -> DataFrame:
    """One row for each document: counts always, ratios only where every reference heading is aligned, null where there is nothing to divide by."""
    n = lambda d, **c: d.groupBy("doc_id").agg(*[F.sum(v.cast("long")).alias(k) for k, v in c.items()])
    one = F.lit(1)
    d = n(capture, refs=one, suggested=F.col("suggested"), captured=F.col("candidate_id").isNotNull(), uncertain=F.col("uncertain"), unknown=~F.col("presence_known"), present=F.col("present"), captured_present=F.col("present") & F.col("candidate_id").isNotNull())
    for part in (
        n(matches, confirmed=F.col("status") == "confirmed"), n(parents, parents_right=F.col("correct"), parents_seen=one), n(own_texts, exact=F.col("exact"), normalized=F.col("normalized"), texts_seen=one),
        n(candidates, candidates=one), n(nodes.where("parent_id is not null"), sections=one),
    ):
        d = d.join(part, "doc_id", "left")
    d = d.join(metadata.select("doc_id", "annotation_status"), "doc_id", "left").na.fill(0)
    words = F.create_map(*[F.lit(x) for kv in STATUS_WORDS.items() for x in kv])
    aligned = (F.col("uncertain") == 0) & (F.col("refs") > 0)
    ratio = lambda a, b: F.when(aligned, F.col(a) / F.nullif(F.col(b), F.lit(0)))
    return d.select(
        "doc_id", F.coalesce(words[F.coalesce("annotation_status", F.lit(""))], F.lit("against unreviewed reference")).alias("comparison"), "refs", "suggested", "captured", "confirmed", "candidates", "sections",
        "parents_right", "parents_seen", (F.col("refs") - F.col("confirmed")).alias("missing_sections"), ratio("captured", "refs").alias("candidate_recall"), ratio("captured", "candidates").alias("candidate_precision"),
        F.when(F.col("unknown") == 0, ratio("captured_present", "present")).alias("generator_recall"), ratio("confirmed", "refs").alias("section_recall"), ratio("confirmed", "sections").alias("section_precision"),
        ratio("parents_right", "parents_seen").alias("parent_accuracy"), (F.col("exact") / F.nullif(F.col("texts_seen"), F.lit(0))).alias("own_text_exact"), (F.col("normalized") / F.nullif(F.col("texts_seen"), F.lit(0))).alias("own_text_normalized"), "texts_seen",
    )


def corpus_summary(pages: DataFrame, candidates: DataFrame, sections: DataFrame, decisions: DataFrame, regions: DataFrame, assessments: DataFrame, source_errors: DataFrame, metadata: DataFrame) -> DataFrame:
    """One row for each document: how many pages, candidates, accepted sections, open candidates, regions and source errors; page statuses in order."""
    count = lambda d, name: d.groupBy("doc_id").agg(F.count(F.lit(1)).alias(name))
    statuses = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "status"))), lambda x: x["status"]), ",")
    d = count(pages, "pages")
    for part in (count(candidates, "candidates"), count(sections, "accepted_sections"), count(decisions.where("status = 'AMBIGUOUS'"), "ambiguous_candidates"), count(regions, "regions"), count(source_errors, "source_errors")):
        d = d.join(part, "doc_id", "left")
    d = d.na.fill(0).join(assessments.groupBy("doc_id").agg(statuses.alias("page_statuses")), "doc_id", "left")
    return d.join(metadata.select("doc_id", "annotation_status"), "doc_id", "left")
