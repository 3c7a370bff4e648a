"""Checks of a run: spans against their pages, own texts, coverage, completeness; intake of reference trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outline_jobs.functions import slices
from outline_jobs.functions import text as tx
from outline_jobs.operators import body, evaluation
from outline_jobs.operators.blocks import present

ERROR = ["doc_id", "reason", "id", "page", "start"]
PACKET_PAGES = 6


def _errors(d: DataFrame, reason: str | Column, ident: str | None = None) -> DataFrame:
    at = [F.col(c).cast("int") if c in d.columns else F.lit(None).cast("int") for c in ("page", "start")]
    return d.select("doc_id", (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"), (F.col(ident) if ident else F.lit(None)).cast("string").alias("id"), at[0].alias("page"), at[1].alias("start"))


def validate_spans(segments: DataFrame, pages: DataFrame, nodes: DataFrame, revisions: DataFrame) -> DataFrame:
    """ERROR rows: unknown owners, spans outside their page, spans of another revision, texts other than the page's."""
    d = slices.cut(segments.select("doc_id", "page", "start", "end", "owner", "revision", "text"), pages, "_cut")
    d = d.join(nodes.select("doc_id", F.col("node_id").alias("owner"), F.lit(True).alias("_owner")), ["doc_id", "owner"], "left")
    d = d.join(revisions.select("doc_id", F.col("revision").alias("_now")), "doc_id", "left")
    inside = F.coalesce((F.col("start") < F.col("end")) & F.col("_cut").isNotNull(), F.lit(False))
    found = present(
        F.when(F.col("_owner").isNull(), "UNKNOWN_BODY_OWNER"), F.when(~inside, "INVALID_SOURCE_SPAN"),
        F.when(inside & ~F.col("revision").eqNullSafe(F.col("_now")), "STALE_SOURCE_REVISION"), F.when(inside & ~F.col("text").eqNullSafe(F.col("_cut")), "SOURCE_TEXT_MISMATCH"),
    )
    return _errors(d.withColumn("_r", F.explode(found)), F.col("_r"), "owner")


def validate_own_text(segments: DataFrame, nodes: DataFrame) -> DataFrame:
    """ERROR rows: separators that no page joint explains, nodes (with text) whose text isn't that of their segments."""
    w = Window.partitionBy("doc_id", "owner", "status").orderBy("page", "start")
    d = segments.withColumn("_last", F.lag(F.struct("page", F.right("text", F.lit(1)).alias("sign"))).over(w)).where("separator_before <> ''")
    blank = lambda c: c.rlike(f"^[{tx.WS}]?$")
    good = (F.col("separator_before") == "\n") & (F.col("status") == "ASSIGNED") & (F.col("_last.page") != F.col("page")) & ~blank(F.col("_last.sign")) & ~blank(F.left("text", F.lit(1)))
    t = body.own_text(segments).select("doc_id", F.col("owner").alias("node_id"), "own_text")
    wrong = nodes.join(t, ["doc_id", "node_id"], "left").where(F.coalesce("own_text", F.lit("")) != F.col("text")).select("doc_id", "node_id")
    return _errors(d.where(~F.coalesce(good, F.lit(False))), "INVALID_GENERATED_SEPARATOR", "owner").unionByName(_errors(wrong, "OWN_TEXT_MISMATCH", "node_id"))


def source_accounting(segments: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, page, covered, canonical, breaks: characters up to the last segment's end and of the page, and segments that don't begin where the one before ends."""
    w = Window.partitionBy("doc_id", "page").orderBy("start", "end")
    d = segments.select("doc_id", "page", "start", "end", (F.col("start") != F.coalesce(F.lag("end").over(w), F.lit(0))).cast("long").alias("_break"))
    d = d.groupBy("doc_id", "page").agg(F.max_by("end", F.struct("start", "end")).alias("_end"), F.sum("_break").alias("_breaks"))
    p = pages.select("doc_id", "page", F.length(F.coalesce("markdown", F.lit(""))).alias("canonical"))
    return p.join(d, ["doc_id", "page"], "left").select("doc_id", "page", F.coalesce("_end", F.lit(0)).alias("covered"), "canonical", F.coalesce("_breaks", F.lit(0)).alias("breaks"))


def accounting_errors(accounting: DataFrame) -> DataFrame:
    gap = F.when(F.col("breaks") > 0, F.array_repeat(F.lit("GAP_OR_DUPLICATE_ASSIGNMENT"), F.col("breaks").cast("int"))).otherwise(F.array().cast("array<string>"))
    found = F.concat(gap, present(F.when(F.col("covered") != F.col("canonical"), "UNCOVERED_TEXT")))
    return _errors(accounting.withColumn("_r", F.explode(found)), F.col("_r"))


def document_status(pages: DataFrame, segments: DataFrame, decisions: DataFrame, source_errors: DataFrame, assessments: DataFrame, repairs: DataFrame) -> DataFrame:
    """doc_id, pending, outstanding_ownership, extraction_failures, generated_page_separators, source_errors, unresolved_extraction, structural_complete, complete."""
    n = lambda d, c, name: d.groupBy("doc_id").agg(F.sum(c.cast("long")).alias(name))
    kept = assessments.join(repairs.select("doc_id", "page", "adopted_source"), ["doc_id", "page"], "left")
    parts = [
        n(decisions, F.col("status") == "AMBIGUOUS", "pending"), n(segments, F.col("ownership") == "provisional", "outstanding_ownership"), n(segments, F.length("separator_before"), "generated_page_separators"),
        n(source_errors, F.lit(1), "source_errors"), n(kept, (F.col("status") != "ACCEPT") & (F.coalesce("adopted_source", F.lit("extraction")) == "extraction"), "unresolved_extraction"),
    ]
    out = n(pages, F.coalesce(F.col("extraction_status") == "failed", F.lit(False)), "extraction_failures")
    for part in parts:
        out = out.join(part, "doc_id", "left")
    names = ["pending", "outstanding_ownership", "extraction_failures", "generated_page_separators", "source_errors", "unresolved_extraction"]
    out = out.select("doc_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in names])
    whole = (F.col("pending") == 0) & (F.col("outstanding_ownership") == 0) & (F.col("extraction_failures") == 0) & (F.col("source_errors") == 0)
    return out.withColumn("structural_complete", whole).withColumn("complete", whole & (F.col("unresolved_extraction") == 0))


def reference_intake(drafts: DataFrame, metadata: DataFrame, sources: DataFrame, tree_errors: DataFrame, nodes: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(accepted metadata, refused doc_id and errors, token differences of the accepted).

    drafts: doc_id, model, notes; metadata with source_sha256, selected_pages; sources: doc_id, document_hash, text; tree_errors and nodes of the drafts; existing: doc_id taken in before.
    """
    bad, old = tree_errors.select("doc_id").distinct().withColumn("_bad", F.lit(True)), existing.select("doc_id").distinct().withColumn("_old", F.lit(True))
    d = drafts.select("doc_id", F.col("model").alias("_model"), F.col("notes").alias("_notes")).join(metadata, "doc_id", "left").join(sources.select("doc_id", "document_hash"), "doc_id", "left").join(bad, "doc_id", "left").join(old, "doc_id", "left")
    pages = F.col("selected_pages")
    first = F.coalesce((F.size(pages) <= PACKET_PAGES) & (pages == F.when(F.size(pages) > 0, F.sequence(F.lit(1), F.greatest(F.size(pages), F.lit(1)))).otherwise(pages)), F.lit(False))
    errors = present(
        F.when(F.col("_bad"), "tree schema"), F.when(~F.col("document_hash").eqNullSafe(F.col("source_sha256")) | F.col("document_hash").isNull(), "source hash changed"), F.when(~first, "only the first six pages"),
        F.when(F.col("_old"), "taken in before"), F.when(F.coalesce("_model", F.lit("")) == "", "model missing"), F.when(F.col("_notes").isNull(), "notes missing"),
    )
    d = d.withColumn("errors", errors)
    good = d.where(F.size("errors") == 0)
    accepted = good.select("doc_id", *[c for c in metadata.columns if c not in ("doc_id", "annotation_status", "model", "generation_method")], F.lit("ai_unreviewed").alias("annotation_status"), F.col("_model").alias("model"), F.lit("external draft").alias("generation_method"))
    own = good.select("doc_id")
    tokens = evaluation.text_consistency(nodes.join(own, "doc_id", "left_semi"), sources.join(own, "doc_id", "left_semi"))
    return accepted, d.where(F.size("errors") > 0).select("doc_id", "errors"), tokens
