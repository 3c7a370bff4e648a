"""The evidence outline's blocks: spans of page text, signals, candidates, and what speaks for each label.

Offsets are half-open, in characters of the page's Markdown. Only the cutting of a page into spans is Python; all else are expressions and windows by document.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from outline_jobs.functions import text as tx
from outline_jobs.functions.tables import once

#: Lengths in characters, words and pages; fixed values.
HEADING_MOST, SHORT, MARGIN_MOST, MARGIN_PAGES, PROSE_WORDS = 180, 100, 180, 3, 12
HEADING = re.compile(r"#{1,6}\s+[^\n]+")
#: What marks body text, rules of a table, items of a list, ends of lines as str.splitlines() has them.
BODY_START = r"^(>|[-*+] |```|~~~)"
TABLE_RULE = r"^[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)+\|?[ \t]*$"
LIST_ITEM = rf"^[{tx.WS}]*{tx.DIGIT}+[.)][{tx.WS}]+[^{tx.WS}]"
LINE_ENDS = r"\r\n|[\n\x0B\x0C\r\x1C-\x1E\x{85}\x{2028}\x{2029}]"
FOOTNOTE = rf"(?is)(?:[{tx.WS}]*<sup\b[^>]*>.*?</sup>)+[{tx.WS}]*$"
NOT_PROSE = r"^(#|>|- |\* |\*\*)"


def page_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, end, end of its block) of each span: blocks lie between blank lines; in them, headings outside closed code fences stand alone.

    A heading whose bold text isn't closed on its line takes the next line up to its last **, if both have HEADING_MOST characters at most.
    """
    text, lines, at = text or "", [], 0
    for line in text.split("\n"):
        lines.append((at, at + len(line)))
        at += len(line) + 1
    blank = [not text[a:b].strip() for a, b in lines]
    fenced, k = set(), 0
    marks = {m: [i for i, (a, _) in enumerate(lines) if text.startswith(m, a)] for m in ("```", "~~~")}
    while k < len(lines):
        own = marks.get(text[lines[k][0] : lines[k][0] + 3], [])
        close = bisect_right(own, k)
        if k in own[close - 1 : close] and close < len(own):
            fenced.update(range(k, own[close] + 1))
            k = own[close]
        k += 1
    out, k = [], 0
    while k < len(lines):
        if blank[k]:
            k += 1
            continue
        first = k
        while k < len(lines) and not blank[k]:
            k += 1
        cursor, stop = lines[first][0], lines[k - 1][1]
        stop -= len(text[cursor:stop]) - len(text[cursor:stop].rstrip())
        cuts, i = [], first
        while i < k:
            begin = lines[i][0] + (len(text[lines[i][0] : lines[i][1]]) - len(text[lines[i][0] : lines[i][1]].lstrip()) if i == first else 0)
            found = HEADING.match(text, begin, lines[k - 1][1])
            if found:
                end, here = found.end(), i
                i += text.count("\n", begin, end)
                if here not in fenced:
                    if text.count("**", begin, end) % 2 and i + 1 < k and not text.startswith("#", lines[i + 1][0]):
                        last = text.rfind("**", *lines[i + 1])
                        end = last + 2 if last >= 0 and last + 2 - begin <= HEADING_MOST else end
                    cuts += [begin, end]
            i += 1
        for a, b in zip([cursor, *cuts], [*cuts, max([stop, *cuts[-1:]])]):
            part = text[a:b]
            if part.strip():
                out.append((a + len(part) - len(part.lstrip()), b - len(part) + len(part.rstrip()), stop))
    return out


SPANS = ArrayType(StructType([StructField(c, IntegerType()) for c in ("start", "end", "block_end")]))


@F.pandas_udf(SPANS)
def _spans(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [{"start": a, "end": b, "block_end": c} for a, b, c in page_spans(t)])


def block_spans(pages: DataFrame) -> DataFrame:
    """doc_id, page, pos, n, start, end, raw, prose: every span in order; a page without any has one row of nulls.

    prose: the text from here to the block's end is running text. Every sign that is no white space belongs to one span, so that is what follows the span before.
    """
    d = pages.select("doc_id", "page", "markdown", _spans("markdown").alias("_s"))
    d = d.select("doc_id", "page", "markdown", F.size("_s").alias("n"), F.posexplode_outer("_s").alias("pos", "s"))
    rest = F.substring("markdown", F.col("s.start") + 1, F.col("s.block_end") - F.col("s.start"))
    d = once(d.withColumn("_rest", rest), "prose", tx.has_words(F.col("_rest"), PROSE_WORDS) & ~F.col("_rest").rlike(NOT_PROSE) & ~F.col("_rest").rlike(tx.BLOCK_LABEL))
    return d.select("doc_id", "page", "pos", "n", "s.start", "s.end", F.substring("markdown", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("raw"), F.coalesce("prose", F.lit(False)).alias("prose"))


def page_margins(spans: DataFrame) -> DataFrame:
    """doc_id, edge, raw of short texts that are the first or the last span of MARGIN_PAGES pages or more; an only span counts as both."""
    edge = F.filter(F.array(F.when(F.col("pos") == 0, "first"), F.when(F.col("pos") == F.col("n") - 1, "last")), lambda x: x.isNotNull())
    d = spans.where(F.length("raw") <= MARGIN_MOST).select("doc_id", "page", "raw", F.explode(edge).alias("edge"))
    return d.groupBy("doc_id", "edge", "raw").agg(F.count_distinct("page").alias("_n")).where(F.col("_n") >= MARGIN_PAGES).select("doc_id", "edge", "raw")


def clean_block(raw: Column) -> Column:
    """struct(clean, bold): a block's visible text, without heading marks, a heading's footnote marks at its end, and bold marks around the whole."""
    bare = F.regexp_replace(raw, rf"^#{{1,6}}[{tx.WS}]+", "")
    bare = F.when(raw.startswith("#"), F.when(bare.rlike("(?i)</sup>"), F.regexp_replace(bare, FOOTNOTE, "")).otherwise(bare)).otherwise(raw)
    bold = bare.startswith("**") & bare.endswith("**")
    inner = F.substring(bare, F.lit(3), F.greatest(F.length(bare) - 4, F.lit(0)))
    return F.struct(tx.strip(F.when(bold, inner).otherwise(bare)).alias("clean"), bold.alias("bold"))


def present(*flags: Column) -> Column:
    return F.filter(F.array(*flags), lambda x: x.isNotNull())


def block_signals(spans: DataFrame) -> DataFrame:
    """Spans with level, clean, bold, label, title and signals, in a fixed order; spans without any of the first five signals are no candidates and left out."""
    by_doc = Window.partitionBy("doc_id").orderBy("page", "pos")
    d = spans.withColumn("following_prose", F.coalesce(F.lead("prose").over(by_doc), F.lit(False))).where("raw is not null")
    d = once(d, "_c", clean_block(F.col("raw"))).withColumns({"clean": F.col("_c.clean"), "bold": F.col("_c.bold")})
    d = d.withColumn("markdown_level", F.when(F.col("raw").startswith("#"), F.length(F.regexp_extract("raw", "^(#+)", 1))))
    d = once(d, "label", F.regexp_extract("clean", tx.BLOCK_LABEL, 1))
    d = d.withColumn("title", F.when(F.col("label") != "", F.regexp_extract("clean", tx.BLOCK_LABEL, 2)).otherwise(F.col("clean")))
    size, clean, plain, labelled = F.length("clean"), F.col("clean"), F.col("markdown_level").isNull(), F.col("label") != ""
    upper = (size < SHORT) & (F.upper(clean) == clean) & (F.lower(clean) != clean)
    isolated = (size < SHORT) & (F.regexp_count(clean, F.lit(LINE_ENDS)) <= 1) & ~clean.rlike("[.:;]$")
    first = [
        F.when(~plain, "markdown_heading"), F.when(labelled & (size < HEADING_MOST), "numbered_title_like"), F.when(F.col("bold") & (size < HEADING_MOST), "standalone_bold"),
        F.when(upper, "uppercase"), F.when(isolated, "isolated_short_block"),
    ]
    # Most spans end here, before anything is looked for in their whole text or joined.
    d = once(d, "_first", present(*first)).where(F.size("_first") > 0)
    edge = F.when(F.col("pos") == 0, "first").when(F.col("pos") == F.col("n") - 1, "last")
    d = d.withColumn("edge", edge).join(page_margins(spans).withColumn("_margin", F.lit(True)), ["doc_id", "edge", "raw"], "left")
    body = F.col("raw").rlike(BODY_START) | (F.col("raw").contains("---") & F.col("raw").rlike(f"(?md){TABLE_RULE}"))
    listed = plain & ~F.col("bold") & F.col("raw").contains("\n") & (F.regexp_count("raw", F.lit(f"(?md){LIST_ITEM}")) >= 2)
    more = [
        F.when(body, "body_markup"), F.when(listed, "body_markup"), F.when(plain & ~labelled & clean.rlike(rf"^{tx.DIGIT}+$"), "bare_number"),
        F.when(plain & ~labelled & ~F.col("bold") & F.coalesce("_margin", F.lit(False)), "repeated_page_margin"), F.when(F.col("following_prose"), "following_prose"),
    ]
    d = d.withColumn("signals", F.concat("_first", present(*more)))
    return d.select("doc_id", "page", "start", "end", "raw", "clean", "bold", "label", "title", "markdown_level", "signals")


def block_candidates(pages: DataFrame, revisions: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    """doc_id, ord, candidate_id, page, start, end, raw, label, title, markdown_level, signals, label_grammar; ids change with the revision (doc_id, revision). spans: those of pages, if they are at hand."""
    d = block_signals(spans if spans is not None else block_spans(pages)).join(revisions, "doc_id")
    ident = F.concat(F.lit("c-"), F.substring(F.sha2(F.concat_ws(":", "revision", F.col("page").cast("string"), F.col("start").cast("string"), F.col("end").cast("string")), 256), 1, 16))
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "start")) - 1
    return d.select("doc_id", order.alias("ord"), ident.alias("candidate_id"), "page", "start", "end", "raw", "label", "title", "markdown_level", "signals", tx.label_grammar(F.col("label")).alias("label_grammar"))


def sequence_peers(candidates: DataFrame) -> DataFrame:
    """doc_id, ord, series, peers: the neighbours in a label's series that count one less or one more and have the same heading level. Readings without peers are left out."""
    has = lambda s: F.array_contains("signals", s)
    d = candidates.where(~has("body_markup") & (F.col("markdown_level").isNotNull() | has("standalone_bold") | has("isolated_short_block")))
    d = d.select("doc_id", "ord", "candidate_id", "markdown_level", "signals", F.explode(tx.label_readings(F.col("label"))).alias("r"))
    d = d.where((F.col("r.family") != "numeric") | F.col("markdown_level").isNotNull() | (has("standalone_bold") & has("following_prose")))
    d = d.select("doc_id", "ord", "candidate_id", F.col("r.series").alias("series"), F.struct(F.col("r.value").alias("value"), F.col("markdown_level").alias("level"), "candidate_id").alias("m"))
    w = Window.partitionBy("doc_id", "series").orderBy("ord")
    d = d.withColumns({"_a": F.lag("m").over(w), "_b": F.lead("m").over(w)})
    near = lambda a, b: (F.col(f"{b}.value") == F.col(f"{a}.value") + 1) & F.col(f"{a}.level").eqNullSafe(F.col(f"{b}.level"))
    peers = present(F.when(near("_a", "m"), F.col("_a.candidate_id")), F.when(near("m", "_b"), F.col("_b.candidate_id")))
    return d.withColumn("peers", peers).where(F.size("peers") > 0).select("doc_id", "ord", "series", "peers")


def heading_styles(candidates: DataFrame) -> DataFrame:
    """doc_id, ord of unlabelled headings before prose whose level at least one other such heading of the document has."""
    d = candidates.where(F.col("markdown_level").isNotNull() & F.array_contains("signals", "following_prose") & (F.col("label") == ""))
    return d.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "markdown_level"))).where("_n >= 2").select("doc_id", "ord")


def build_evidence(candidates: DataFrame) -> DataFrame:
    """doc_id, ord, candidate_id, signals, numeric_level, markdown_level, readings, selected, support, conflicts, sequence_peers, context_anchor."""
    has = lambda s: F.array_contains("signals", s)
    peers = sequence_peers(candidates).groupBy("doc_id", "ord").agg(F.map_from_entries(F.collect_list(F.struct("series", "peers"))).alias("_peers"))
    d = candidates.select("doc_id", "ord", "candidate_id", "signals", "markdown_level", "label", tx.numeric_depth(F.col("label")).alias("numeric_level"))
    d = once(d, "readings", tx.label_readings(F.col("label"))).join(peers, ["doc_id", "ord"], "left")
    d = d.join(heading_styles(candidates).withColumn("_style", F.lit(True)), ["doc_id", "ord"], "left")
    d = once(d, "_found", F.filter("readings", lambda r: F.coalesce(F.map_contains_key(F.col("_peers"), r["series"]), F.lit(False))))
    both = F.col("numeric_level").isNotNull() & F.col("markdown_level").isNotNull()
    conflicts = present(F.when(F.size("_found") > 1, "LABEL_INTERPRETATION_CONFLICT"), F.when(both & (F.col("numeric_level") != F.col("markdown_level")), "EVIDENCE_CONFLICT"))
    d = once(d, "conflicts", conflicts)
    clear, one = F.size("conflicts") == 0, F.size("_found") == 1
    d = d.withColumn("_chosen", F.when(both & clear, F.get("readings", F.lit(0))).when(one, F.get("_found", F.lit(0))))
    support = F.when(both & clear, "CONSISTENT_MARKDOWN_NUMBERING").when(one & clear, "CONSISTENT_LABEL_SEQUENCE").when(F.col("_style"), "REPEATED_HEADING_STYLE_WITH_PROSE")
    body, margin = has("body_markup") | has("bare_number"), has("repeated_page_margin")
    listed = (F.col("_chosen.family") == "numeric") & F.col("markdown_level").isNull() & ~(has("standalone_bold") & has("following_prose"))
    listed = F.coalesce(listed, F.lit(False))
    d = d.withColumn("_support", F.when(body, "EXPLICIT_BODY_SYNTAX").when(margin, "REPEATED_PAGE_MARGIN").when(~listed, support)).withColumn("_chosen", F.when(~body & ~margin & ~listed, F.col("_chosen")))
    d = d.withColumn("sequence_peers", F.coalesce(F.element_at("_peers", F.col("_chosen.series")), F.array().cast("array<string>")))
    return roman_context(d)


def roman_context(d: DataFrame) -> DataFrame:
    """A first letter under a supported Roman heading: the latest such heading carries on until a supported number. Rows changed here neither set nor end it."""
    supported = F.col("_support").isNotNull()
    event = F.when((F.col("_chosen.family") == "roman") & supported & (F.size("conflicts") == 0), F.struct(F.col("candidate_id").alias("id")))
    event = event.when((F.col("_chosen.family") == "numeric") & supported, F.struct(F.lit(None).cast("string").alias("id")))
    d = d.withColumn("_roman", F.last(event, ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)))
    first = ~supported & (F.size("conflicts") == 0) & F.col("_roman.id").isNotNull() & F.col("markdown_level").isNotNull() & F.array_contains("signals", "following_prose") & ~F.array_contains("signals", "body_markup")
    first = F.coalesce(first & (F.size("readings") == 1) & (F.get("readings", F.lit(0))["family"] == "alpha") & (F.get("readings", F.lit(0))["value"] == 1), F.lit(False))
    support = F.when(first, "FIRST_ALPHA_HEADING_IN_ROMAN_CONTEXT").otherwise(F.col("_support"))
    return d.select(
        "doc_id", "ord", "candidate_id", "signals", "numeric_level", "markdown_level", "readings", F.when(first, F.get("readings", F.lit(0))).otherwise(F.col("_chosen")).alias("selected"),
        present(support).alias("support"), "conflicts", "sequence_peers", F.when(first, F.col("_roman.id")).alias("context_anchor"),
    )
