"""The line outline: numbered lines, marked noise, heading candidates, levels, tree and flags.

Every function takes and gives DataFrames keyed by doc_id. Lines are only marked, never removed, and keep their numbers. All windows are by
document, so one exchange by doc_id serves the whole chain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outline_jobs.functions import text as tx
from outline_jobs.functions.tables import once

SCANNED_BELOW, HEADER_SHARE, BATCH, MAX_DEPTH, TOC_RUN = 50, 0.6, 60, 6, 3
#: Fixed values.
PAGE_NUMBER = rf"(?i)^(page[{tx.WS}]+)?{tx.DIGIT}+([{tx.WS}]*/[{tx.WS}]*{tx.DIGIT}+)?$"
TOC_LINE = rf"\.{{3,}}[{tx.WS}]*{tx.DIGIT}+[{tx.WS}]*$|[^{tx.WS}][{tx.WS}]{{2,}}{tx.DIGIT}{{1,4}}[{tx.WS}]*$"
TOC_TITLE = rf"(?i)^(table of contents|contents|目[{tx.WS}]*录)[{tx.WS}]*$"
HEADING = rf"^(#{{1,6}})[{tx.WS}]+(.*)$"
BOLD_LINE = rf"^\*\*(.+?)\*\*[{tx.WS}:：]*$"


def by_line():
    return Window.partitionBy("doc_id").orderBy("line_idx")


def before():
    return by_line().rowsBetween(Window.unboundedPreceding, -1)


def flag_scanned_pages(pages: DataFrame) -> DataFrame:
    return pages.withColumn("scanned", F.length(tx.strip(F.coalesce("plain_text", F.lit("")))) < SCANNED_BELOW)


def merge_page_text(pages: DataFrame, ocr: DataFrame) -> DataFrame:
    """doc_id, page, text, from_ocr: recognised text for scanned pages, Markdown for others."""
    o = ocr.select("doc_id", "page", F.col("text").alias("_ocr"))
    text = F.when(F.col("scanned"), F.col("_ocr")).otherwise(F.col("markdown"))
    return flag_scanned_pages(pages).join(o, ["doc_id", "page"], "left").select("doc_id", "page", F.coalesce(text, F.lit("")).alias("text"), F.col("scanned").alias("from_ocr"))


def build_lines(pages: DataFrame) -> DataFrame:
    """Stripped non-empty lines, numbered through each document."""
    line = pages.select("doc_id", "page", "from_ocr", F.posexplode(F.split("text", "\n", -1)).alias("_pos", "_raw"))
    line = once(line, "text", tx.strip(F.col("_raw"))).where("text <> ''")
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "_pos")) - 1
    return line.select("doc_id", n.alias("line_idx"), "text", "page", "from_ocr")


def mark_page_numbers(lines: DataFrame) -> DataFrame:
    return lines.withColumn("noise", F.when(F.col("text").rlike(PAGE_NUMBER), "pageno"))


def _header_counts(lines: DataFrame, page_counts: DataFrame) -> DataFrame:
    """lines with key and _hit: the line, page numbers aside, is on most pages of a document with three pages or more.

    Pages of a key are counted by their rank within it, over rows that lie by doc_id; only the counts of pages are joined, by doc_id.
    """
    d = once(lines, "key", F.when(F.col("noise").isNull(), tx.repeat_key(F.col("text"))))
    same = Window.partitionBy("doc_id", "key")
    d = d.withColumn("_rank", F.dense_rank().over(same.orderBy("page"))).withColumn("_on", F.max("_rank").over(same))
    least = F.greatest(F.lit(2), F.floor(F.col("n_pages") * F.lit(HEADER_SHARE)))
    d = d.join(page_counts, "doc_id", "left")
    hit = F.col("key").isNotNull() & (F.col("n_pages") >= 3) & (F.col("_on") >= least)
    return d.withColumn("_hit", F.coalesce(hit, F.lit(False)))


def repeated_headers(lines: DataFrame, page_counts: DataFrame) -> DataFrame:
    """doc_id and key of lines found on most pages of documents with three pages or more."""
    return _header_counts(lines, page_counts).where("_hit").select("doc_id", "key").distinct()


def mark_repeated_headers(lines: DataFrame, page_counts: DataFrame) -> DataFrame:
    out = _header_counts(lines, page_counts)
    return out.withColumn("noise", F.coalesce("noise", F.when(F.col("_hit"), "header"))).select(*lines.columns)


def looks_like_toc(c: Column) -> Column:
    return c.rlike(TOC_LINE)


def mark_toc(lines: DataFrame) -> DataFrame:
    """Runs of three or more neighbouring lines with page numbers at their ends, and the title just before."""
    toc = F.col("noise").isNull() & looks_like_toc(F.col("text"))
    d = lines.withColumn("_toc", toc).withColumn("_island", F.sum((~F.col("_toc")).cast("int")).over(by_line()))
    run = F.sum(F.col("_toc").cast("int")).over(Window.partitionBy("doc_id", "_island"))
    d = d.withColumn("_in", F.col("_toc") & (run >= TOC_RUN))
    d = d.withColumn("noise", F.when(F.col("_in"), "toc").otherwise(F.col("noise"))).withColumn("_starts", F.col("_in") & ~F.coalesce(F.lag("_in").over(by_line()), F.lit(False)))
    # A title: a run starts one to three lines below it, and all lines between are noise.
    clear = lambda k: F.lead("noise", k).over(by_line()).isNotNull()
    start = lambda k: F.coalesce(F.lead("_starts", k).over(by_line()), F.lit(False))
    near = start(1) | (start(2) & clear(1)) | (start(3) & clear(1) & clear(2))
    title = F.col("noise").isNull() & near & tx.strip_markdown(F.col("text")).rlike(TOC_TITLE)
    return d.withColumn("noise", F.when(title, "toc").otherwise(F.col("noise"))).select(*lines.columns)


def mark_noise(lines: DataFrame, page_counts: DataFrame) -> DataFrame:
    """Page numbers first, which don't count as headers; then running headers; then tables of contents."""
    return mark_toc(mark_repeated_headers(mark_page_numbers(lines), page_counts))


def find_line_candidates(lines: DataFrame) -> DataFrame:
    """doc_id, line_idx, text (the title), label, level, source."""
    d = once(once(lines.where("noise is null"), "_bare", tx.strip_markdown(F.col("text"))), "_l", tx.line_label(F.col("_bare")))
    hashes, labelled = F.length(F.regexp_extract("text", HEADING, 1)), F.col("_l.label") != ""
    md = F.col("text").rlike(HEADING)
    bold = F.col("text").rlike(BOLD_LINE) & (F.length("_bare") <= 80) & ~F.col("_bare").rlike("[.。]$")
    title = F.when(md & (F.col("_l.title") == ""), tx.strip_markdown(F.regexp_extract("text", HEADING, 2))).when(md | labelled, F.col("_l.title")).otherwise(F.col("_bare"))
    level = F.when(labelled, F.col("_l.level")).when(md, hashes)
    source = F.when(md, "md").when(labelled, "number").when(bold, "bold")
    return once(d, "source", source).select("doc_id", "line_idx", title.alias("text"), F.col("_l.label").alias("label"), level.alias("level"), "source").where("source is not null")


def level_request_batches(candidates: DataFrame, size: int = BATCH) -> DataFrame:
    """doc_id, batch, n_lines, items: what a model is asked, `size` candidates without a level at a time."""
    open_ = candidates.where("level is null").withColumn("batch", F.floor((F.row_number().over(by_line()) - 1) / size).cast("int"))
    item = F.concat(F.col("line_idx").cast("string"), F.lit(": "), F.when(F.col("label") != "", F.concat("label", F.lit(" "))).otherwise(""), F.col("text"))
    rows = F.sort_array(F.collect_list(F.struct("line_idx", item.alias("item"))))
    return open_.groupBy("doc_id", "batch").agg(F.count(F.lit(1)).alias("n_lines"), F.array_join(F.transform(rows, lambda r: r["item"]), "\n").alias("items"))


def parse_level_decisions(replies: DataFrame) -> DataFrame:
    """Replies (doc_id, batch, content) -> doc_id, line_idx, level (null: not a heading). A later decision on a line counts."""
    kind = "struct<decisions:array<struct<line:int,is_heading:boolean,level:int>>>"
    json = F.from_json(F.regexp_extract("content", r"(?s)(\{.*\})", 1), kind)
    d = replies.select("doc_id", "batch", F.posexplode(json["decisions"]).alias("_pos", "d")).where("d.line is not null")
    last = F.row_number().over(Window.partitionBy("doc_id", "d.line").orderBy(F.desc("batch"), F.desc("_pos")))
    level = F.when(F.coalesce("d.is_heading", F.lit(False)), F.col("d.level"))
    return d.withColumn("_n", last).where("_n = 1").select("doc_id", F.col("d.line").alias("line_idx"), level.alias("level"))


def resolve_line_levels(candidates: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """Rule first, then the model, then one below the last decimal label; bold lines need a model. Levels end up in 1..MAX_DEPTH."""
    d = candidates
    if decisions is not None:
        d = d.join(decisions.select("doc_id", "line_idx", F.col("level").alias("_model"), F.lit(True).alias("_asked")), ["doc_id", "line_idx"], "left")
    else:
        d = d.withColumns({"_model": F.lit(None).cast("int"), "_asked": F.lit(None).cast("boolean")})
    known = F.coalesce("level", "_model")
    d = d.withColumn("_known", known).where("not (level is null and coalesce(_asked, false) and _model is null)").where("_known is not null or label <> '' or source <> 'bold'")
    anchor = F.last(F.when(F.col("label").rlike(tx.DECIMAL), F.greatest(F.lit(1), F.least(F.lit(MAX_DEPTH), F.col("_known")))), ignorenulls=True).over(before())
    level = F.greatest(F.lit(1), F.least(F.lit(MAX_DEPTH), F.coalesce("_known", F.coalesce(anchor, F.lit(0)) + 1)))
    return d.withColumn("level", level).select(*candidates.columns)


def clamp_level_jumps(candidates: DataFrame) -> DataFrame:
    """No level is more than one below the heading before it: min(i, i + least (level - i) so far), i counting from 1."""
    i = F.row_number().over(by_line())
    d = candidates.withColumn("_i", i)
    return d.withColumn("level", F.least(F.col("_i"), F.col("_i") + F.min(F.col("level") - F.col("_i")).over(by_line().rowsBetween(Window.unboundedPreceding, 0)))).select(*candidates.columns)


def pick_title(lines: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(titles, lines, candidates): the first line without noise names the document; if it is the first candidate and has no label it is one no more."""
    first = lines.where("noise is null").groupBy("doc_id").agg(F.min(F.struct("line_idx", "text")).alias("_l"))
    head = candidates.groupBy("doc_id").agg(F.min(F.struct("line_idx", "text", "label")).alias("_c"))
    same = (F.col("_c.line_idx") == F.col("_l.line_idx")) & (F.col("_c.label") == "")
    docs = lines.select("doc_id").distinct().join(first, "doc_id", "left").join(head, "doc_id", "left")
    titles = docs.select("doc_id", F.when(same, F.col("_c.text")).otherwise(tx.strip_markdown(F.col("_l.text"))).alias("title"), F.when(same, F.col("_l.line_idx")).alias("title_line"))
    # One row for each document: joined by doc_id alone, so that lines and candidates stay where they lie.
    taken = titles.select("doc_id", F.col("title_line").alias("_t"))
    is_title = F.coalesce(F.col("line_idx") == F.col("_t"), F.lit(False))
    marked = lines.join(taken, "doc_id", "left").withColumn("noise", F.when(is_title, "title").otherwise(F.col("noise"))).select(*lines.columns)
    return titles, marked, candidates.join(taken, "doc_id", "left").where(~is_title).select(*candidates.columns)


def line_parents(headings: DataFrame) -> DataFrame:
    """With parent_line: the nearest heading above of a lower level, null for the root. Six running maxima instead of a self-join."""
    above = F.greatest(*[F.when(F.col("level") > k, F.max(F.when(F.col("level") == k, F.col("line_idx"))).over(before())) for k in range(1, MAX_DEPTH)], F.lit(-1))
    return headings.withColumn("parent_line", F.when(above >= 0, above))


def line_node_ids(headings: DataFrame) -> DataFrame:
    """With depth, path and node_id. The headings above are found level by level, so depth is bounded and nothing recurses."""
    label = F.regexp_replace(F.regexp_replace("label", r"^\.+|\.+$", ""), rf"^[{tx.WS}]+|[{tx.WS}]+$", "")
    d = headings.withColumn("_own", F.when(label == "", F.concat(F.lit("n"), F.row_number().over(by_line()).cast("string"))).otherwise(label)).withColumn("_dot", F.col("_own").contains(".") & (F.col("label") != ""))
    d = d.withColumn("_me", F.struct("line_idx", "_own", "_dot"))
    for k in range(1, MAX_DEPTH + 1):
        d = d.withColumn(f"_at{k}", F.max(F.when(F.col("level") == k, F.col("_me"))).over(before()))
    # An entry of level k counts if no heading of a lower level came after it: then it is open.
    open_ = []
    for k in range(1, MAX_DEPTH):
        later = [F.coalesce(F.col(f"_at{j}.line_idx"), F.lit(-1)) < F.col(f"_at{k}.line_idx") for j in range(1, k)]
        good = (F.col("level") > k) & F.col(f"_at{k}").isNotNull()
        for x in later:
            good = good & x
        open_.append(F.when(good, F.col(f"_at{k}")))
    chain = F.concat(F.filter(F.array(*open_), lambda x: x.isNotNull()), F.array("_me"))
    d = d.withColumn("_chain", chain)
    step = lambda acc, x: F.when(x["_dot"] | (acc == ""), x["_own"]).otherwise(F.concat(acc, F.lit("."), x["_own"]))
    path = F.aggregate("_chain", F.lit(""), step)
    title = F.lower(tx.strip(tx.squeeze(F.col("text"))))
    d = d.withColumns({"depth": F.size("_chain"), "path": path})
    return d.withColumn("node_id", F.concat("path", F.lit("-"), F.substring(F.sha1(F.encode(title, "UTF-8")), 1, 6))).drop("_own", "_dot", "_me", "_chain", *[f"_at{k}" for k in range(1, MAX_DEPTH + 1)])


def assign_lines(lines: DataFrame, headings: DataFrame) -> DataFrame:
    """Every line without noise that is no heading, with owner_line: the last heading before it, null for the root."""
    h = headings.select("doc_id", "line_idx", F.col("line_idx").alias("_h"))
    d = lines.where("noise is null").join(h, ["doc_id", "line_idx"], "left").withColumn("owner_line", F.last("_h", ignorenulls=True).over(by_line()))
    return d.where("_h is null").drop("_h")


def assemble_line_nodes(owned: DataFrame, headings: DataFrame, titles: DataFrame) -> DataFrame:
    """One row for each node, the root (node_id 'root', ord 0; titled by the document's id, which is its file's name, where no line is left) first: own text, pages of the body, lines, OCR."""
    rows = F.sort_array(F.collect_list(F.struct("line_idx", "text")))
    body = owned.groupBy("doc_id", F.coalesce("owner_line", F.lit(-1)).alias("_k")).agg(
        tx.strip(F.array_join(F.transform(rows, lambda r: r["text"]), "\n")).alias("_text"), F.min("page").alias("page_start"), F.max("page").alias("page_end"), F.max("line_idx").alias("_last"), F.max("from_ocr").alias("_ocr")
    )
    node = headings.select("doc_id", "node_id", "label", F.col("text").alias("title"), "depth", "line_idx", F.col("line_idx").alias("_k"), F.coalesce("parent_line", F.lit(-1)).alias("_p"))
    root = titles.select("doc_id", F.lit("root").alias("node_id"), F.lit("").alias("label"), F.coalesce("title", F.col("doc_id").cast("string")).alias("title"), F.lit(0).alias("depth"), F.lit(0).alias("line_idx"), F.lit(-1).alias("_k"), F.lit(None).cast("int").alias("_p"))
    every = node.unionByName(root)
    names = every.select("doc_id", F.col("_k").alias("_p"), F.col("node_id").alias("parent_id"))
    out = every.join(body, ["doc_id", "_k"], "left").join(names, ["doc_id", "_p"], "left")
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("_k")) - 1
    return out.select(
        "doc_id", "node_id", "parent_id", order.alias("ord"), "label", "title", F.coalesce("_text", F.lit("")).alias("text"), "depth", "page_start", "page_end",
        F.col("line_idx").alias("line_start"), F.greatest("line_idx", F.coalesce("_last", F.lit(0))).alias("line_end"), F.coalesce("_ocr", F.lit(False)).alias("from_ocr"), F.col("_k").alias("node_key"), F.col("_p").alias("parent_key"),
    )


FLAG = ["doc_id", "rule", "severity", "node_id", "detail"]


def _flag(rows: DataFrame, rule: str, severity: str, node: Column, detail: Column) -> DataFrame:
    return rows.select("doc_id", F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), node.cast("string").alias("node_id"), detail.cast("string").alias("detail"))


def flag_document(nodes: DataFrame) -> DataFrame:
    d = nodes.groupBy("doc_id").agg(F.count(F.when(F.col("node_key") >= 0, 1)).alias("n"), F.max(F.when(F.col("node_key") < 0, F.length("text"))).alias("orphan"))
    return _flag(d.where("n = 0"), "no_headings", "error", F.lit(None), F.lit("no heading was found")).unionByName(
        _flag(d.where("orphan > 0"), "orphan_body", "warning", F.lit("root"), F.concat(F.col("orphan").cast("string"), F.lit(" characters before the first heading")))
    )


def flag_numbering_gaps(nodes: DataFrame) -> DataFrame:
    d = nodes.where(F.col("label").rlike(tx.DECIMAL) & (F.col("node_key") >= 0)).withColumn("_n", F.element_at(F.split("label", r"\."), -1).cast("long"))
    d = d.withColumn("_last", F.lag("_n").over(Window.partitionBy("doc_id", "parent_key").orderBy("node_key"))).where("_n <> _last + 1")
    return _flag(d, "numbering_gap", "error", F.col("parent_id"), F.concat(F.col("_last").cast("string"), F.lit(" to "), F.col("_n").cast("string")))


def flag_duplicate_labels(nodes: DataFrame) -> DataFrame:
    d = nodes.where("label <> ''").groupBy("doc_id", "parent_key", "parent_id", "label").count().where("count > 1")
    return _flag(d, "duplicate_label", "warning", F.col("parent_id"), F.concat("label", F.lit(" occurs "), F.col("count").cast("string"), F.lit(" times")))


def flag_empty_sections(nodes: DataFrame) -> DataFrame:
    parents = nodes.where("parent_key >= 0").select("doc_id", F.col("parent_key").alias("node_key")).distinct()
    d = nodes.where("node_key >= 0 and text = ''").join(parents, ["doc_id", "node_key"], "left_anti")
    return _flag(d, "empty_section", "warning", F.col("node_id"), F.concat("label", F.lit(" "), "title"))


def flag_ocr_nodes(nodes: DataFrame) -> DataFrame:
    return _flag(nodes.where("node_key >= 0 and from_ocr"), "ocr_derived", "warning", F.col("node_id"), F.lit("recognised text"))


def line_flags(nodes: DataFrame) -> DataFrame:
    out = flag_document(nodes)
    for f in (flag_numbering_gaps, flag_duplicate_labels, flag_empty_sections, flag_ocr_nodes):
        out = out.unionByName(f(nodes))
    return out


def line_dump(lines: DataFrame) -> DataFrame:
    """The lines as numbered text, in order of doc_id and line_idx."""
    text = F.format_string("%5d p%d %s| %s", F.col("line_idx"), F.col("page"), F.when(F.col("from_ocr"), "OCR ").otherwise(""), F.col("text"))
    return lines.select("doc_id", "line_idx", text.alias("dump"))


def outline_listing(nodes: DataFrame) -> DataFrame:
    """Nodes as an indented list, in order of doc_id and ord."""
    head = F.trim(F.concat("label", F.lit(" "), "title"))
    page = F.coalesce(F.concat(F.lit("p"), F.col("page_start").cast("string")), F.lit("-"))
    line = F.concat(F.repeat(F.lit("  "), F.col("depth")), head, F.lit("  [d"), F.col("depth").cast("string"), F.lit(", "), F.length("text").cast("string"), F.lit("字, "), page, F.lit("]"), F.when(F.col("from_ocr"), " [OCR]").otherwise(""))
    return nodes.select("doc_id", "ord", line.alias("listing"))
