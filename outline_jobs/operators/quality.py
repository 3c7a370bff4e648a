"""Page quality: token accounting between two texts of a page, repair proposals, assessments, revisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outline_jobs.functions import text as tx
from outline_jobs.functions.tables import once, written

MISSING_LEAST, MISSING_SHARE, BACKWARD = 20, 5, 20
PROPOSAL, OVERRIDE = "doc_id long, page int, kind string, fingerprint string, markdown string, order_only boolean", "doc_id long, page int, markdown string"


def fingerprint(*fields: str) -> Column:
    """A hash of the named columns as JSON with their nulls: equal exactly if the requests are."""
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)


def document_hash(files: DataFrame) -> DataFrame:
    """Rows of the binaryFile source -> path, document_hash."""
    return files.select("path", F.sha2("content", 256).alias("document_hash"))


def canonical_revision(pages: DataFrame) -> DataFrame:
    """doc_id, revision: changes exactly if the source hash, a page number or a page's Markdown does. Texts are hashed before they are gathered."""
    page = F.struct("page", F.sha2(F.encode(F.coalesce("markdown", F.lit("")), "UTF-8"), 256).alias("hash"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(page)), lambda p: F.concat(p["page"].cast("string"), F.lit(":"), p["hash"])), "|")
    return pages.groupBy("doc_id").agg(F.sha2(F.concat(F.coalesce(F.min("document_hash"), F.lit("")), F.lit("|"), joined), 256).alias("revision"))


def unlike_lines(a: Column, b: Column) -> tuple[Column, Column]:
    """Texts whose tokens differ as those of a and b do: without the lines that both have, where no line of either repeats. No token goes across lines."""
    lines = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), "\n", -1), lambda x: x != "")
    once_each = lambda x: F.size(F.array_distinct(x)) == F.size(x)
    x, y = lines(a), lines(b)
    alone = once_each(x) & once_each(y)
    rest = lambda own, other, text: F.when(alone, F.array_join(F.array_except(own, other), "\n")).otherwise(F.coalesce(text, F.lit("")))
    return rest(x, y, a), rest(y, x, b)


def token_diff(texts: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """keys, token, missing (in a beyond b), added (in b beyond a): multisets compared by signed counts, summed before any shuffle."""
    signed = lambda c, sign: F.transform(tx.tokens(F.col(c)), lambda t: F.struct(t.alias("token"), F.lit(sign).alias("n")))
    d = texts.select(*keys, F.explode(F.concat(signed(a, 1), signed(b, -1))).alias("_t")).select(*keys, "_t.token", "_t.n")
    d = d.groupBy(*keys, "token").agg(F.sum("n").alias("n")).where("n <> 0")
    return d.select(*keys, "token", F.greatest("n", F.lit(0)).alias("missing"), F.greatest(-F.col("n"), F.lit(0)).alias("added"))


def reconcile_pages(proposals: DataFrame, keys: list[str]) -> DataFrame:
    """(markdown, proposed, order_only) -> omissions, additions, order_changed, adopted: only a proposal that may and does change nothing but the order is adopted."""
    # Texts are exchanged by their keys, not token by token.
    d = token_diff(proposals.select(*keys, "markdown", "proposed").repartition(*keys), keys, "markdown", "proposed").groupBy(*keys).agg(F.sum("missing").alias("omissions"), F.sum("added").alias("additions"))
    out = proposals.join(d, keys, "left").withColumns({"omissions": F.coalesce("omissions", F.lit(0)), "additions": F.coalesce("additions", F.lit(0))})
    out = out.withColumn("order_changed", tx.tokens(F.col("markdown")) != tx.tokens(F.col("proposed")))
    return out.withColumn("adopted", F.coalesce("order_only", F.lit(False)) & (F.col("omissions") == 0) & (F.col("additions") == 0))


def assess_pages(pages: DataFrame) -> DataFrame:
    """doc_id, page, status, reasons, coverage_missing: what the available checks find, in a fixed order."""
    keys = ["doc_id", "page"]
    # Only lines that the other text lacks are exchanged, by page and not token by token; all else is found out where the page lies.
    p = pages.select(*keys, "blocks", "extraction_status", "table_count", "markdown", "plain_text")
    p = once(p, "_rest", F.struct(*[c.alias(n) for n, c in zip(("a", "b"), unlike_lines(F.col("plain_text"), F.col("markdown")))]))
    most = F.size(tx.tokens(F.col("_rest.a")))
    plain = F.when(~F.coalesce("plain_text", F.lit("")).rlike(f"[^{tx.WS}]"), 0).when(most > MISSING_LEAST, F.size(tx.tokens(F.col("plain_text")))).otherwise(1)
    marks = [F.col("markdown").contains("�").alias("_undecodable"), F.col("markdown").contains("|").alias("_ruled"), plain.alias("_plain")]
    p = p.select(*keys, *marks, "blocks", "extraction_status", "table_count", "_rest.a", "_rest.b")
    p = written(p, "page-marks").repartition(*keys)
    lost = token_diff(p.where("a <> ''"), keys, "a", "b").groupBy(*keys).agg(F.sum("missing").alias("coverage_missing"))
    d = p.drop("a", "b").join(lost, keys, "left").withColumn("coverage_missing", F.coalesce("coverage_missing", F.lit(0)))
    back = F.exists(F.arrays_zip(F.col("blocks").alias("a"), F.slice("blocks", 2, F.greatest(F.size("blocks"), F.lit(1))).alias("b")), lambda z: z["a"][1] > z["b"][1] + BACKWARD)
    risks = F.array(
        F.when(F.col("_undecodable"), "UNDECODABLE_CHARACTERS"),
        F.when(F.col("extraction_status") == "failed", "EXTRACTION_FAILED"),
        F.when((F.col("_plain") > 0) & (F.col("coverage_missing") > F.greatest(F.lit(MISSING_LEAST), F.floor(F.col("_plain") / MISSING_SHARE))), "BROAD_TEXT_COVERAGE_DISAGREEMENT"),
        F.when(F.coalesce(back, F.lit(False)), "READING_ORDER_RISK"),
        F.when((F.col("table_count") > 0) & ~F.col("_ruled"), "TABLE_STRUCTURE_RISK"),
        F.when((F.col("_plain") == 0) | F.col("blocks").isNull() | F.col("table_count").isNull(), "CHECK_EVIDENCE_UNAVAILABLE"),
    )
    d = d.withColumn("reasons", F.filter(risks, lambda x: x.isNotNull()))
    status = F.when(F.array_contains("reasons", "CHECK_EVIDENCE_UNAVAILABLE"), "UNVERIFIABLE").when(F.size("reasons") > 0, "NEEDS_VISUAL").otherwise("ACCEPT")
    return d.select("doc_id", "page", status.alias("status"), "reasons", "coverage_missing")


def select_pages(pages: DataFrame, first: int | None = None, selection: DataFrame | None = None) -> DataFrame:
    """The first pages of each document, or those of a table (doc_id, page); all without either."""
    if selection is not None:
        return pages.join(selection.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_semi")
    return pages if first is None else pages.where(F.col("page") <= first)


def selection_errors(selection: DataFrame, page_counts: DataFrame) -> DataFrame:
    """Documents whose selection (doc_id, pages array) repeats, is unsorted or out of range."""
    p = F.col("pages")
    bad = (F.size(F.array_distinct(p)) != F.size(p)) | (F.sort_array(p) != p) | (F.array_min(p) < 1) | (F.array_max(p) > F.col("n_pages"))
    return selection.join(page_counts, "doc_id").where(bad).select("doc_id", F.lit("pages must be unique, ascending and within the document").alias("error"))


def page_request(pages: DataFrame, revisions: DataFrame) -> DataFrame:
    """doc_id, page, fingerprint: what a proposal must name to be for exactly this page of this revision."""
    return pages.join(revisions, "doc_id").select("doc_id", "page", fingerprint("document_hash", "page", "revision", "markdown").alias("fingerprint"))


def unrepaired(assessments: DataFrame) -> DataFrame:
    """The repairs of pages without any proposal."""
    fine, none = F.col("status") == "ACCEPT", F.lit(None).cast("long")
    return assessments.select(
        "doc_id", "page", F.when(fine, "skipped").otherwise("unavailable").alias("status"), F.when(fine, "ACCEPT").otherwise("no proposal").alias("reason"), none.alias("omissions"), none.alias("additions"),
        none.cast("boolean").alias("order_changed"), F.lit(False).alias("adopted"), F.lit("extraction").alias("adopted_source"))


def route_pages(pages: DataFrame, proposals: DataFrame | None, overrides: DataFrame | None) -> dict[str, DataFrame]:
    """pages (as repaired), assessments, repairs, overrides (what they change), revisions (doc_id, original_revision, revision).

    proposals: doc_id, page, kind, fingerprint, markdown, order_only; a proposal counts for pages that aren't accepted, if bound to them, and only
    where it reorders and may. overrides (doc_id, page, markdown) always replace what is there then. Without either (both None) pages and revisions stay, and nothing is compared.
    """
    keys = ["doc_id", "page"]
    first = canonical_revision(pages)
    assessments = assess_pages(pages)
    if proposals is None and overrides is None:
        none = F.lit(None).cast("long")
        changed = assessments.where(F.lit(False)).select(*keys, none.alias("omissions"), none.alias("additions"), none.cast("boolean").alias("order_changed"))
        return {"pages": pages, "assessments": assessments, "repairs": unrepaired(assessments), "overrides": changed, "revisions": first.select("doc_id", F.col("revision").alias("original_revision"), "revision")}
    spark = pages.sparkSession
    proposals = proposals if proposals is not None else spark.createDataFrame([], PROPOSAL)
    overrides = overrides if overrides is not None else spark.createDataFrame([], OVERRIDE)
    p = proposals.select(*keys, "kind", F.col("fingerprint").alias("_given"), F.col("markdown").alias("proposed"), "order_only", F.lit(True).alias("_found"))
    d = pages.select(*keys, "markdown").join(assessments.select(*keys, F.col("status").alias("_status")), keys).join(page_request(pages, first), keys).join(p, keys, "left")
    status = F.when(F.col("_status") == "ACCEPT", "skipped").when(F.col("_found").isNull(), "unavailable")
    bound = F.coalesce((F.col("kind") == "visual") & (F.col("_given") == F.col("fingerprint")), F.lit(False))
    status = status.when(~bound | F.col("proposed").isNull(), "rejected").otherwise("returned")
    reason = F.when(F.col("_status") == "ACCEPT", "ACCEPT").when(F.col("_found").isNull(), "no proposal").when(~bound, "REPLAY_FINGERPRINT_MISMATCH").when(F.col("proposed").isNull(), "invalid repair response")
    d = d.select(*keys, "markdown", "proposed", "order_only", status.alias("status"), reason.alias("reason"))
    r = reconcile_pages(d.where("status = 'returned'").select(*keys, "markdown", "proposed", "order_only"), keys).select(*keys, "omissions", "additions", "order_changed", "adopted")
    d = d.join(r, keys, "left").withColumn("adopted", F.coalesce("adopted", F.lit(False)))
    repairs = d.select(*keys, "status", "reason", "omissions", "additions", "order_changed", "adopted", F.when(F.col("adopted"), "replay").otherwise("extraction").alias("adopted_source"))
    mended = pages.join(d.where("adopted").select(*keys, F.col("proposed").alias("_new")), keys, "left").withColumn("markdown", F.coalesce("_new", "markdown")).drop("_new")
    o = overrides.select(*keys, F.col("markdown").alias("proposed"))
    changed = reconcile_pages(mended.select(*keys, "markdown").join(o, keys).withColumn("order_only", F.lit(False)), keys).select(*keys, "omissions", "additions", "order_changed")
    final = mended.join(o, keys, "left").withColumn("markdown", F.coalesce("proposed", "markdown")).select(*pages.columns)
    revisions = first.withColumnRenamed("revision", "original_revision").join(canonical_revision(final), "doc_id")
    return {"pages": final, "assessments": assessments, "repairs": repairs, "overrides": changed, "revisions": revisions}
