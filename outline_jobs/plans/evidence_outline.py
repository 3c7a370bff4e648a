"""The whole evidence outline over a corpus: assessed and repaired pages, candidates, decisions, regions and replies, tree, body, checks."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outline_jobs.functions.tables import dropped, kept_together, together, written
from outline_jobs.operators import blocks, body, checks, decisions, evaluation, quality


class EvidenceOutline:
    """Stages by name, each made when it is asked for. Stages that several later ones read are tables of their own, whose rows lie by document.

    proposals and overrides repair pages, responses answer regions; all may be missing. Page texts are stored once, in pages: segments and
    nodes take theirs from there when they are read (`cuts` and `tree` are the same rows without text). What is only assessed (plain_text, blocks) stays in given.
    """

    def __init__(self, pages: DataFrame, proposals: DataFrame | None = None, overrides: DataFrame | None = None, responses: DataFrame | None = None, limit: int = decisions.REQUEST_MOST):
        self.given, self.limit = pages, limit
        self.proposals, self.overrides, self.responses = proposals, overrides, responses

    def __getitem__(self, stage: str) -> DataFrame:
        return getattr(self, stage)

    @cached_property
    def _routed(self) -> dict[str, DataFrame]:
        given = self.given if self.proposals is None and self.overrides is None else written(self.given, "pages-given")
        return quality.route_pages(given, self.proposals, self.overrides)

    @cached_property
    def pages(self) -> DataFrame:
        """The only exchange of page texts: all later stages read tables that lie by doc_id."""
        n = int(self.given.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        found = self.given if self.proposals is None and self.overrides is None else self._routed["pages"]
        return kept_together(found.drop("plain_text", "blocks").repartition(n, "doc_id"), "pages")

    @cached_property
    def revisions(self) -> DataFrame:
        if self.proposals is None and self.overrides is None:
            now = quality.canonical_revision(self.pages)
            return kept_together(now.select("doc_id", F.col("revision").alias("original_revision"), "revision"), "revisions")
        return kept_together(self._routed["revisions"], "revisions")

    @cached_property
    def assessments(self) -> DataFrame:
        return kept_together(self._routed["assessments"], "assessments")

    @property
    def repairs(self) -> DataFrame:
        return quality.unrepaired(self.assessments) if self.proposals is None and self.overrides is None else self._routed["repairs"]

    @cached_property
    def candidates(self) -> DataFrame:
        spans = kept_together(blocks.block_spans(self.pages), "spans")
        out = kept_together(blocks.block_candidates(self.pages, self.revisions.select("doc_id", "revision"), spans), "candidates")
        dropped(spans)
        return out

    @cached_property
    def evidence(self) -> DataFrame:
        return kept_together(blocks.build_evidence(self.candidates), "evidence")

    @cached_property
    def decided(self) -> DataFrame:
        return kept_together(decisions.decide(self.evidence), "decided")

    @cached_property
    def regions(self) -> DataFrame:
        found = kept_together(decisions.dependency_regions(self.decided, self.candidates), "regions")
        return kept_together(self.budget(found, self.limit), "requests")

    def budget(self, regions: DataFrame, limit: int) -> DataFrame:
        """regions with their requests, measured against limit."""
        hashes = self.pages.groupBy("doc_id").agg(F.min("document_hash").alias("document_hash"))
        known = self.revisions.select("doc_id", "revision").join(hashes, "doc_id")
        context = decisions.region_context(regions, self.candidates, self.pages)
        return decisions.region_budget(regions, self.candidates, self.evidence, self.decided, context, known, limit)

    @cached_property
    def _applied(self) -> tuple[DataFrame, DataFrame]:
        return decisions.apply_responses(self.decided, self.regions, self.responses)

    @property
    def decisions(self) -> DataFrame:
        return self._applied[0]

    @property
    def replies(self) -> DataFrame:
        return self._applied[1]

    @cached_property
    def _hierarchy(self) -> tuple[DataFrame, DataFrame]:
        return decisions.assemble_hierarchy(self.candidates, self.decisions, self.pages)

    @property
    def hierarchy_errors(self) -> DataFrame:
        return self._hierarchy[1]

    @property
    def islands(self) -> DataFrame:
        """The open candidates that the segments of an island count."""
        owned = body.segment_owner(body.body_segments(self.pages, self.candidates, self.decisions, self.tree))
        return body.island_boundaries(owned)

    @property
    def tree(self) -> DataFrame:
        """The nodes without their own text."""
        return self._hierarchy[0]

    @cached_property
    def cuts(self) -> DataFrame:
        """The segments without their text."""
        return kept_together(body.attach_body(self.pages, self.candidates, self.decisions, self.tree, self.revisions), "segments")

    @property
    def segments(self) -> DataFrame:
        return body.with_texts(self.cuts, self.pages)

    @property
    def nodes(self) -> DataFrame:
        return body.with_text(self.tree, self.segments)

    @property
    def section_index(self) -> DataFrame:
        return decisions.section_index(self.decisions, self.tree)

    @property
    def body_index(self) -> DataFrame:
        return body.body_index(self.nodes, self.segments)

    @property
    def accounting(self) -> DataFrame:
        return checks.source_accounting(self.cuts, self.pages)

    @cached_property
    def source_errors(self) -> DataFrame:
        out = self.hierarchy_errors.select("doc_id", "reason", F.col("node_id").alias("id"), F.lit(None).cast("int").alias("page"), F.lit(None).cast("int").alias("start"))
        for part in (checks.validate_spans(self.segments, self.pages, self.tree, self.revisions), checks.validate_own_text(self.segments, self.nodes), checks.accounting_errors(self.accounting)):
            out = out.unionByName(part)
        with together(self.given.sparkSession):
            return written(out, "source-errors")

    @property
    def status(self) -> DataFrame:
        return checks.document_status(self.pages, self.cuts, self.decisions, self.source_errors, self.assessments, self.repairs)

    def summary(self, metadata: DataFrame) -> DataFrame:
        return evaluation.corpus_summary(self.pages, self.candidates, self.section_index, self.decisions, self.regions, self.assessments, self.source_errors, metadata)
