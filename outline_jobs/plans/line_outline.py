"""The whole line outline over a corpus."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outline_jobs.functions.tables import kept_together
from outline_jobs.operators import lines as op


class LineOutline:
    """Stages by name, each made when it is asked for. Stages that several later ones read are tables of their own."""

    def __init__(self, pages: DataFrame, ocr: DataFrame, decisions: DataFrame | None = None, candidates: DataFrame | None = None):
        self.pages, self.ocr, self.decisions = pages, ocr, decisions
        if candidates is not None:
            self.candidates = candidates

    def __getitem__(self, stage: str) -> DataFrame:
        return getattr(self, stage)

    @cached_property
    def page_text(self) -> DataFrame:
        """The only exchange by document: all later stages read tables that lie by doc_id."""
        return kept_together(op.merge_page_text(self.pages, self.ocr), "line-pages")

    @cached_property
    def lines(self) -> DataFrame:
        return op.build_lines(self.page_text)

    @cached_property
    def noise(self) -> DataFrame:
        counts = self.page_text.groupBy("doc_id").agg(F.count_distinct("page").alias("n_pages"))
        return kept_together(op.mark_noise(self.lines, counts), "line-noise")

    @cached_property
    def candidates(self) -> DataFrame:
        return kept_together(op.find_line_candidates(self.noise), "line-candidates")

    @cached_property
    def levels(self) -> DataFrame:
        return kept_together(op.clamp_level_jumps(op.resolve_line_levels(self.candidates, self.decisions)), "line-levels")

    @cached_property
    def _picked(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return op.pick_title(self.noise, self.levels)

    @cached_property
    def titles(self) -> DataFrame:
        return self._picked[0]

    @cached_property
    def headings(self) -> DataFrame:
        return kept_together(op.line_node_ids(op.line_parents(self._picked[2])), "line-headings")

    @cached_property
    def owned(self) -> DataFrame:
        return op.assign_lines(self._picked[1], self.headings)

    @cached_property
    def nodes(self) -> DataFrame:
        return kept_together(op.assemble_line_nodes(self.owned, self.headings, self.titles), "line-nodes")

    @cached_property
    def flags(self) -> DataFrame:
        return op.line_flags(self.nodes)

    @cached_property
    def errors(self) -> DataFrame:
        """Documents without any line."""
        return self.page_text.select("doc_id").distinct().join(self.lines.select("doc_id").distinct(), "doc_id", "left_anti").withColumn("error", F.lit("no text"))
