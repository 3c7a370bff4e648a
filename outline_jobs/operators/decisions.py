"""Decisions on candidates, regions of open ones, replies to them, and the tree of accepted sections.

The decision on a candidate depends on those before it, so a document's candidates go through one fold in their order, without any page text; regions and
replies are small graphs within a document. All else are joins and windows.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outline_jobs.functions import canonical, documents, slices
from outline_jobs.operators import trees

#: Characters of a region's request and of source text round its candidates; ids of active sections and of open candidates offered as parents. Fixed values.
REQUEST_MOST, CONTEXT, NEAREST = 20_000, 200, 3

DECISION = (
    "doc_id long, ord long, candidate_id string, role string, parent_id string, status string, role_uncertain boolean, parent_uncertain boolean, "
    "reasons array<string>, origin string, possible_parents array<string>, support array<string>, conflicts array<string>, series string"
)


class _Fold:
    """The state of one document: active sections from the outermost in, open candidates, numbers met so far."""

    def __init__(self):
        self.active, self.open, self.met, self.progress, self.n = [], [], set(), {}, 0

    def nearest(self, field, value):
        return next((s for s in reversed(self.active) if s[field] == value), None)

    def in_scope(self, c):
        """Step 2: a numbered heading that its active scope explains -> (level, support), or None."""
        out, heading = None, c.markdown_level
        if len(c.number) > 1:
            scope = self.nearest("path", c.number[:-1])
        else:
            scope = self.active[-1] if self.active and self.active[-1]["family"] == "alpha" and c.number == ("1",) else None
            same = self.nearest("series", c.number_series)
            if same and heading in (same["level"], same["heading"]):
                out = same["level"], "ACTIVE_NUMERIC_SERIES"
        if scope and heading in (scope["level"] + 1, scope["heading"], (scope["heading"] or 0) + 1):
            out = scope["level"] + 1, "ACTIVE_NUMERIC_PREFIX" if len(c.number) > 1 else "NUMERIC_RESTART_UNDER_ALPHA_SECTION"
        return out

    def level_of(self, c, level, reasons):
        """Steps 4 and 5: (level of a strong candidate, whether its place is supported)."""
        top, family = self.active[-1] if self.active else None, c.family
        if family == "numeric" and len(c.path) > 1:
            above = self.nearest("path", c.path[:-1]) if c.number else None
            return (above["level"] + 1 if above else level or 1), True
        if not family:
            return level or 1, True
        same = self.nearest("series", c.series)
        if same:
            return same["level"], True
        alpha = top is not None and top["family"] == "alpha"
        if family == "numeric":
            if c.value == 1 and alpha and c.markdown_level:
                reasons.append("NUMERIC_RESTART_UNDER_ALPHA_SECTION")
                return top["level"] + 1, True
            if alpha:
                reasons.append("NUMERIC_START_UNANCHORED")
            return c.markdown_level or 1, not alpha
        if c.value != 1:
            reasons.append("SEQUENCE_START_UNANCHORED")
            return level or 1, False
        if top and top["series"] and top["series"] != c.series:
            reasons.append("LABEL_FAMILY_RESTART_UNDER_ACTIVE_SECTION")
            return top["level"] + 1, True
        return level or 1, True

    def parent_of(self, c, level, blocked, supported, above, reasons):
        """Step 7: (the parent or None, the sections still active)."""
        left = list(self.active)
        while left and left[-1]["level"] >= level:
            left.pop()
        top = left[-1]["id"] if left else "root"
        faults, parent = [], top
        if c.context_anchor and top != c.context_anchor:
            faults.append("CONTEXT_PARENT_NOT_ACTIVE")
        if c.family == "numeric" and len(c.path) > 1:
            # The numbered parent counts from here on, whatever came before.
            parent, faults_before = (above["id"] if above else None), list(faults)
            if above is None:
                faults = [*faults_before, "NUMBERED_SCOPE_CONFLICT" if c.path[:-1] in self.met else "NUMBERED_PARENT_MISSING"]
            elif top != parent:
                faults = [*faults_before, "NUMBERED_SCOPE_CONFLICT"]
            lost = parent is None or top != parent
        else:
            lost = bool(faults)
        if blocked:
            faults.append("PARENT_UNCERTAIN")
        elif level > (left[-1]["level"] + 1 if left else 1):
            faults.append("SEQUENCE_ANOMALY")
        lost = lost or blocked or faults[-1:] == ["SEQUENCE_ANOMALY"] or not supported
        if not supported:
            faults.append("PARENT_UNCERTAIN")
        if not lost and c.family == "numeric" and c.value is not None and c.value <= self.progress.get((parent, c.series), -1):
            faults.append("NUMERIC_RESTART_WITHOUT_NEW_SCOPE")
            lost = True
        reasons += faults
        return (None if lost else parent), left

    def step(self, c):
        """The decision on the next candidate: (role, parent, reasons, possible parents)."""
        place, self.n = self.n, self.n + 1
        level = c.numeric_level or c.markdown_level
        if c.number and c.markdown_level and not c.body_markup and (found := self.in_scope(c)):
            level, c.support = found
            c.conflicts = [x for x in c.conflicts if x != "EVIDENCE_CONFLICT"]
            c.family, c.series, c.path, c.value = "numeric", c.number_series, c.number, c.number_value
        if c.support in ("EXPLICIT_BODY_SYNTAX", "REPEATED_PAGE_MARGIN"):
            return "body", None, [c.support], []
        strong, reasons = bool(c.support) and not c.conflicts, list(c.conflicts)
        supported = True
        above = self.nearest("path", c.number[:-1]) if len(c.number) > 1 else None
        if strong:
            level, supported = self.level_of(c, level, reasons)
        else:
            reasons.append("ROLE_UNCERTAIN")
        since = self.active[-1]["place"] if self.active else -1
        blocking = []
        for u in reversed(self.open):  # in order, so those before the innermost active section end the search
            if u["place"] <= since or (strong and level == 1):
                break
            if u["level"] is None or level is None or u["level"] < level:
                blocking.insert(0, u)
                if len(blocking) == NEAREST:  # no more are told
                    break
        possible = ["root", *(s["id"] for s in self.active[-NEAREST:]), *(u["id"] for u in blocking[-NEAREST:])]
        parent = None
        if strong:
            parent, left = self.parent_of(c, level, bool(blocking), supported, above, reasons)
        if parent is None:
            self.open.append({"id": c.candidate_id, "level": level, "place": place})
            return ("section" if strong else "unknown"), None, reasons, possible
        self.active = [*left, {"id": c.candidate_id, "level": level, "place": place, "series": c.series, "family": c.family, "path": c.path, "heading": c.markdown_level}]
        if c.family == "numeric":
            self.met.add(c.path)
            self.progress[parent, c.series] = -1 if c.value is None else c.value
        return "section", parent, [*reasons, c.support], possible


class _Candidate:
    """A row of evidence as the fold reads it; number is the path of a label that has no other reading."""

    def __init__(self, r):
        self.candidate_id, self.body_markup, self.context_anchor = r.candidate_id, r.body_markup, r.context_anchor
        self.numeric_level, self.markdown_level = r.numeric_level, r.markdown_level
        self.support, self.conflicts = r.support, list(r.conflicts)
        self.number, self.number_series, self.number_value = tuple(r.number.split(".")) if r.number else (), r.number_series, r.number_value
        self.family, self.series, self.value, self.path = r.family, r.series, r.value, tuple(r.path.split(".")) if r.path else ()


def decide(evidence: DataFrame) -> DataFrame:
    """Evidence -> DECISION: role and parent of each candidate, what else could be its parent, and support and conflicts as its scope has changed them."""
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ".")
    only = F.when((F.size("readings") == 1) & (F.get("readings", F.lit(0))["family"] == "numeric"), F.get("readings", F.lit(0)))
    d = evidence.withColumn("_only", only).select(
        "doc_id", F.col("ord").cast("long").alias("ord"), "candidate_id", F.array_contains("signals", "body_markup").alias("body_markup"), "numeric_level",
        "markdown_level", F.array_join("support", "").alias("support"), "conflicts", "context_anchor",
        text(F.col("_only.path")).alias("number"), F.col("_only.series").alias("number_series"), F.col("_only.value").alias("number_value"),
        F.col("selected.family").alias("family"), F.col("selected.series").alias("series"), F.col("selected.value").alias("value"), text(F.col("selected.path")).alias("path"),
    )

    def fold(doc, rows):
        state, out = _Fold(), []
        for r in rows:
            c = _Candidate(r)
            role, parent, reasons, possible = state.step(c)
            resolved = role == "body" or parent is not None
            out.append((doc, r.ord, c.candidate_id, role, parent, "RESOLVED" if resolved else "AMBIGUOUS", role == "unknown", role != "body" and parent is None,
                        reasons, "deterministic", possible, [c.support] if c.support else [], c.conflicts, c.series))
        return out

    return documents.folded(d, fold, DECISION)


def dependency_edges(decisions: DataFrame) -> DataFrame:
    """doc_id, candidate_id, depends_on: open candidates that an open candidate may be below of."""
    d = decisions.where("status = 'AMBIGUOUS'")
    up = d.select("doc_id", "ord", "candidate_id", F.explode("possible_parents").alias("depends_on")).where("depends_on <> candidate_id")
    return up.join(d.select("doc_id", F.col("candidate_id").alias("depends_on")), ["doc_id", "depends_on"], "left_semi").select("doc_id", "ord", "candidate_id", "depends_on")


REGION = (
    "doc_id long, region int, region_id string, candidate_ids array<string>, anchors array<string>, "
    "outline array<struct<id:string,parent_id:string,label:string,title:string,context_only:boolean>>, reason string, "
    "dependencies array<struct<candidate_id:string,neighbours:array<string>>>, dependency_edges array<struct<candidate_id:string,depends_on:string,reason:string>>"
)


def dependency_regions(decisions: DataFrame, candidates: DataFrame) -> DataFrame:
    """REGION rows: open candidates that depend on each other, the sections that may be their parents (anchors), and those around them, with label and title of candidates.

    Anchors are the confirmed possible parents, the confirmed section before the region, and all above these; the section after it is context only.
    """
    d = decisions.select("doc_id", F.col("ord").cast("long").alias("ord"), "candidate_id", "role", "parent_id", "status", "possible_parents")
    d = d.join(candidates.select("doc_id", "candidate_id", "label", "title"), ["doc_id", "candidate_id"], "left")

    def group(doc, rows):
        place = {r.candidate_id: k for k, r in enumerate(rows)}
        sure = {r.candidate_id: r.parent_id for r in rows if r.status == "RESOLVED" and r.role == "section"}
        open_ = {r.candidate_id: list(r.possible_parents) for r in rows if r.status == "AMBIGUOUS"}
        root = {x: x for x in open_}

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        named = {r.candidate_id: (r.label, r.title) for r in rows}
        near, edges = {x: set() for x in open_}, defaultdict(list)
        for x, parents in open_.items():
            for p in parents:
                if p in open_ and p != x:
                    a, b = sorted((find(x), find(p)), key=place.get)
                    root[b] = a
                    near[x].add(p)
                    near[p].add(x)
                    edges[x].append({"candidate_id": x, "depends_on": p, "reason": "POSSIBLE_UNRESOLVED_PARENT"})
        groups = defaultdict(list)
        for x in open_:
            groups[find(x)].append(x)
        # For each place the nearest confirmed section before and after it.
        before, after, last = [None] * len(rows), [None] * len(rows), None
        for k, r in enumerate(rows):
            before[k] = last
            last = r.candidate_id if r.candidate_id in sure else last
        last = None
        for k in range(len(rows) - 1, -1, -1):
            after[k] = last
            last = rows[k].candidate_id if rows[k].candidate_id in sure else last
        out = []
        for k, own in enumerate(groups.values()):
            end = place[own[-1]]
            outline = {p for x in own for p in open_[x] if p in sure} | {x for x in (before[place[own[0]]], after[end]) if x}
            anchors = {p for p in outline if p != after[end]}
            todo = list(outline)
            while todo:
                up = sure[todo.pop()]
                if up in sure and up not in outline:
                    outline.add(up)
                    todo.append(up)
            anchors |= {x for x in outline if place[x] < end}
            listed = [{"id": x, "parent_id": sure[x], "label": named[x][0], "title": named[x][1], "context_only": x not in anchors} for x in sorted(outline, key=place.get)]
            ties = [e for x in own for e in edges[x]]
            reason = "EXPLICIT_POSSIBLE_PARENT_DEPENDENCIES" if ties else "ISOLATED_AMBIGUITY"
            neighbours = [{"candidate_id": x, "neighbours": sorted(near[x], key=place.get)} for x in own]
            out.append((doc, k + 1, f"region-{k + 1}", own, sorted(anchors, key=place.get), listed, reason, neighbours, ties))
        return out

    return documents.folded(d, group, REGION)


def region_context(regions: DataFrame, candidates: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, region, page, start, end, text: source round a region's candidates, intervals that overlap or touch as one."""
    c = regions.select("doc_id", "region", F.explode("candidate_ids").alias("candidate_id")).join(candidates.select("doc_id", "candidate_id", "page", "start", "end"), ["doc_id", "candidate_id"])
    c = c.join(pages.select("doc_id", "page", F.length("markdown").alias("_len")), ["doc_id", "page"])
    c = c.select("doc_id", "region", "page", F.greatest(F.lit(0), F.col("start") - CONTEXT).alias("_a"), F.least("_len", F.col("end") + CONTEXT).alias("_b"))
    w = Window.partitionBy("doc_id", "region", "page").orderBy("_a", "_b")
    c = c.withColumn("_new", (F.col("_a") > F.coalesce(F.max("_b").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))).cast("int")).withColumn("_k", F.sum("_new").over(w))
    c = c.groupBy("doc_id", "region", "page", "_k").agg(F.min("_a").alias("start"), F.max("_b").alias("end"))
    return slices.cut(c.select("doc_id", "region", "page", "start", "end"), pages, "text").select("doc_id", "region", "page", "start", "end", "text")


def _label_json(r, style) -> Column:
    """A reading of a label; only numbers have a path."""
    q = canonical.quoted
    fields = {"family": q(r["family"]), "path": canonical.strings(r["path"], style), "series": q(r["series"]), "value": q(r["value"])}
    return canonical.object_of(fields, style, {"path": r["path"].isNotNull()})


def _candidate_json(style) -> Column:
    q = canonical.quoted
    span = canonical.object_of({"end": q(F.col("end")), "page": q(F.col("page")), "revision": q(F.col("revision")), "start": q(F.col("start"))}, style)
    return canonical.object_of({
        "id": q(F.col("candidate_id")), "original_text": q(F.col("raw")), "label": q(F.col("label")), "title": q(F.col("title")), "markdown_level": q(F.col("markdown_level")),
        "page": q(F.col("page")), "ranges": canonical.array_of(F.array(span), style), "signals": canonical.strings(F.col("signals"), style), "label_grammar": q(F.col("label_grammar")),
    }, style)


def _evidence_json(style) -> Column:
    """What is known of a candidate after the decisions: support, conflicts and the chosen reading as its scope has changed them."""
    q, many = canonical.quoted, canonical.strings
    chosen = F.get(F.filter("readings", lambda r: r["series"] == F.col("series")), F.lit(0))
    fields = {
        "candidate_id": q(F.col("candidate_id")), "signals": many(F.col("signals"), style), "numeric_level": q(F.col("numeric_level")), "markdown_level": q(F.col("markdown_level")),
        "possible_parents": many(F.col("possible_parents"), style), "support": many(F.col("support"), style), "conflicts": many(F.col("conflicts"), style),
        "label_interpretations": canonical.array_of(F.transform("readings", lambda r: _label_json(r, style)), style),
        "selected_label": F.when(chosen.isNotNull(), _label_json(chosen, style)).otherwise("null"), "sequence_peers": many(F.col("sequence_peers"), style), "context_anchor": q(F.col("context_anchor")),
    }
    return canonical.object_of(fields, style, {"context_anchor": F.col("context_anchor").isNotNull()})


def _span_json(x, style) -> Column:
    q = canonical.quoted
    return canonical.object_of({"end": q(x["end"]), "page": q(x["page"]), "start": q(x["start"]), "text": q(x["text"])}, style)


def _outline_json(x, style) -> Column:
    q = canonical.quoted
    return canonical.object_of({"context_only": q(x["context_only"]), "id": q(x["id"]), "label": q(x["label"]), "parent_id": q(x["parent_id"]), "title": q(x["title"])}, style)


def region_budget(
    regions: DataFrame, candidates: DataFrame, evidence: DataFrame, decisions: DataFrame, context: DataFrame, revisions: DataFrame, limit: int = REQUEST_MOST
) -> DataFrame:
    """Regions with request, fingerprint, actual, pages, coverage, budget_status and split_status. Too large a region is kept whole; it isn't asked about.

    The request is JSON with sorted keys and no spaces; actual counts its code points. The fingerprint is the SHA-256 of the same
    JSON with a space after every comma and colon. revisions: doc_id, revision, document_hash.
    """
    if type(limit) is not int or limit <= 0:
        raise ValueError("a region's budget must be a positive number of characters")
    styles = {"tight": canonical.COMPACT, "wide": canonical.SPACED}
    known = revisions.select("doc_id", "revision", "document_hash")
    one = candidates.select("doc_id", "ord", "candidate_id", "page", "start", "end", "raw", "label", "title", "markdown_level", "signals", "label_grammar").join(known, "doc_id")
    one = one.join(evidence.select("doc_id", "candidate_id", "numeric_level", "readings", "sequence_peers", "context_anchor"), ["doc_id", "candidate_id"])
    one = one.join(decisions.select("doc_id", "candidate_id", "possible_parents", "support", "conflicts", "series"), ["doc_id", "candidate_id"])
    own = regions.select("doc_id", "region", F.explode("candidate_ids").alias("candidate_id")).join(one, ["doc_id", "candidate_id"])
    texts = [f(s).alias(f"{kind}_{k}") for k, s in styles.items() for kind, f in (("c", _candidate_json), ("e", _evidence_json))]
    own = own.select("doc_id", "region", F.struct("ord", "page", *texts).alias("_i")).groupBy("doc_id", "region").agg(F.sort_array(F.collect_list("_i")).alias("_own"))
    spans = F.sort_array(F.collect_list(F.struct("page", "start", "end", "text")))
    around = context.groupBy("doc_id", "region").agg(spans.alias("_context"))
    d = regions.join(own, ["doc_id", "region"]).join(around, ["doc_id", "region"]).join(known, "doc_id")

    def payload(k, style):
        own_of = lambda kind: canonical.array_of(F.transform("_own", lambda x: x[f"{kind}_{k}"]), style)
        return canonical.object_of({
            "candidate_ids": canonical.strings(F.col("candidate_ids"), style), "candidates": own_of("c"), "evidence": own_of("e"), "anchors": canonical.strings(F.col("anchors"), style),
            "context": canonical.array_of(F.transform("_context", lambda x: _span_json(x, style)), style),
            "compressed_outline": canonical.array_of(F.transform("outline", lambda x: _outline_json(x, style)), style),
            "document_hash": canonical.quoted(F.col("document_hash")), "revision": canonical.quoted(F.col("revision")),
        }, style)

    coverage = F.struct(
        F.size("candidate_ids").alias("candidate_count"), F.aggregate("_context", F.lit(0), lambda n, x: n + F.length(x["text"])).alias("context_characters"),
        F.lit(True).alias("all_candidates_included"), F.lit(False).alias("truncated"),
    )
    d = d.withColumns({"request": payload("tight", styles["tight"]), "fingerprint": F.sha2(payload("wide", styles["wide"]), 256), "coverage": coverage})
    d = d.withColumns({"actual": F.length("request"), "pages": F.array_sort(F.array_distinct(F.transform("_own", lambda x: x["page"])))})
    over = F.col("actual") > limit
    return d.select(
        "doc_id", "region", "region_id", "candidate_ids", "pages", "dependencies", "dependency_edges", "anchors", "outline", "reason", "request", "fingerprint", "actual", F.lit(limit).alias("limit"),
        F.when(over, "oversized").otherwise("within_budget").alias("budget_status"), "coverage", F.when(over, "indivisible_dependency_component").otherwise("not_needed").alias("split_status"),
    )


def response_errors(response, allowed, anchors, existing) -> list[str]:
    """What is wrong with a reply: a list of decisions on the allowed ids, with parents among these, the anchors and the root, that make no cycle."""
    if response is None:
        return ["not an array of decisions"]
    errors, seen, up, allowed = set(), set(), dict(existing), set(allowed)
    for x in response:
        if x is None or not isinstance(x["candidate_id"], str):
            errors.add("invalid decision")
            continue
        ident, parent = x["candidate_id"], x["parent_id"]
        if ident in seen or ident not in allowed:
            errors.add("unknown or duplicate candidate")
        seen.add(ident)
        if x["role"] not in ("section", "body", "abstain"):
            errors.add("invalid role")
        if x["role"] == "section":
            if parent != "root" and parent not in allowed and parent not in anchors:
                errors.add("inadmissible parent")
            up[ident] = parent
    # From every id upwards; ids that lead out of the edges are done for good.
    done: set = set()
    for ident in up:
        trail = []
        while ident in up and ident not in done and ident not in trail:
            trail.append(ident)
            ident = up[ident]
        if ident in trail:
            errors.add("cycle")
            break
        done.update(trail)
    return sorted(errors)


REPLY = "doc_id long, region int, region_id string, status string, reason string, errors array<string>, missing array<string>, abstained array<string>"
RESPONSE = "doc_id long, region_id string, kind string, fingerprint string, response array<struct<candidate_id:string,role:string,parent_id:string>>"
_APPLIED = f"{DECISION}, _reply struct<{', '.join(x.replace(' ', ':', 1) for x in REPLY.split(', '))}>"


def apply_responses(decisions: DataFrame, regions: DataFrame, responses: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(decisions, REPLY rows): a region's reply counts as a whole or not at all; later regions see what earlier ones settled.

    regions as region_budget gives them, responses as RESPONSE, None without any. Left out or abstained candidates stay open. Only documents with a
    reply go through the fold: in others every decision stays, and a region is skipped or without reply.
    """
    names = [x.split()[0] for x in DECISION.split(", ")]
    over, none = F.col("budget_status") == "oversized", F.lit(None).cast("array<string>")
    silent = lambda d: d.select(
        "doc_id", "region", "region_id", F.when(over, "skipped").otherwise("unavailable").alias("status"), F.when(over, "INPUT_BUDGET_EXCEEDED").otherwise("no reply").alias("reason"),
        F.array().cast("array<string>").alias("errors"), none.alias("missing"), none.alias("abstained"))
    if responses is None:
        return decisions.select(*names), silent(regions)
    asked = regions.select("doc_id", "region", "region_id", "candidate_ids", "anchors", "fingerprint", "budget_status")
    r = responses.select("doc_id", "region_id", "kind", F.col("fingerprint").alias("_fingerprint"), "response", F.lit(True).alias("_answered"))
    asked = asked.join(r, ["doc_id", "region_id"], "left").select("doc_id", F.struct(
        "region", "region_id", "candidate_ids", "anchors", F.col("budget_status").alias("budget"), "_answered", "response", ((F.col("kind") == "structure") & (F.col("_fingerprint") == F.col("fingerprint"))).alias("_bound")).alias("q"))
    asked = asked.groupBy("doc_id").agg(F.sort_array(F.collect_list("q")).alias("q")).where(F.exists("q", lambda q: F.coalesce(q["_answered"], F.lit(False))))
    asked = trees.written(asked, "asked")
    # One row of a document has its questions.
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")) == 1
    d = decisions.select(*names).join(asked, "doc_id").withColumn("q", F.when(first, F.col("q")))

    def run(doc, given):
        questions = next((r.q for r in given if r.q is not None), [])
        rows, place = [{**r._asdict(), "doc_id": doc} for r in given], {r.candidate_id: k for k, r in enumerate(given)}
        replies = []
        for q in questions:
            own, found, status, reason, errors = list(q["candidate_ids"]), q["response"], "returned", None, []
            if q["budget"] == "oversized":
                status, reason = "skipped", "INPUT_BUDGET_EXCEEDED"
            elif not q["_answered"]:
                status, reason = "unavailable", "no reply"
            elif not q["_bound"]:
                status, reason = "rejected", "REPLAY_FINGERPRINT_MISMATCH"
            missing, abstained = None, None
            if status == "returned":
                found = None if found is None else list(found)
                sure = {x["candidate_id"]: x["parent_id"] for x in rows if x["status"] == "RESOLVED" and x["role"] == "section"}
                errors = response_errors(found, own, list(q["anchors"]), sure)
                told = {} if errors else {x["candidate_id"]: x for x in found}
                sections = [x for x in told.values() if x["role"] == "section"]
                if any(x["parent_id"] != "root" and x["parent_id"] not in sure and told.get(x["parent_id"], {"role": None})["role"] != "section" for x in sections):
                    errors.append("unresolved parent")
                if any(x["parent_id"] in place and place[x["parent_id"]] >= place[x["candidate_id"]] for x in sections):
                    errors.append("parent must come before its child")
                if errors:
                    status = "rejected"
                else:
                    for ident, x in told.items():
                        if x["role"] != "abstain":
                            rows[place[ident]].update(role=x["role"], parent_id=x["parent_id"], status="RESOLVED", role_uncertain=False, parent_uncertain=False, origin="fixture_replay", reasons=["SYNTHETIC_REPLAY"])
                    missing, abstained = [x for x in own if x not in told], [x for x, v in told.items() if v["role"] == "abstain"]
            replies.append({"doc_id": rows[0]["doc_id"], "region": q["region"], "region_id": q["region_id"], "status": status, "reason": reason, "errors": errors, "missing": missing, "abstained": abstained})
        return [(*[x[c] for c in names], None) for x in rows] + [(doc, *[None] * (len(names) - 1), x) for x in replies]

    both, told = trees.written(documents.folded(d, run, _APPLIED), "applied"), asked.select("doc_id")
    same = lambda d: d.join(told, "doc_id", "left_anti")
    return both.where("_reply is null").drop("_reply").unionByName(same(decisions.select(*names))), both.where("_reply is not null").select("_reply.*").unionByName(silent(same(regions)))


def assemble_hierarchy(candidates: DataFrame, decisions: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, with a root for each of docs, errors doc_id, node_id, reason): accepted sections whose parents, all earlier, lead to the root. The others stay out, with all below them."""
    d = decisions.where("status = 'RESOLVED' and role = 'section'").select("doc_id", F.col("ord").alias("_d"), F.col("candidate_id").alias("node_id"), "parent_id")
    d = d.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id", "node_id").orderBy("_d")))
    c = candidates.select("doc_id", F.col("candidate_id").alias("node_id"), "ord", "label", "title", F.lit(True).alias("_known"))
    d = trees.kept_together(d.join(c, ["doc_id", "node_id"], "left"), "accepted")
    first = d.where("_n = 1")
    # Ids of a cycle or below one never leave the edges, of whatever order; the last edge given for an id counts.
    edges = d.withColumn("_m", F.max("_n").over(Window.partitionBy("doc_id", "node_id"))).where("_n = _m")
    parents = edges.select("doc_id", F.col("node_id").alias("parent_id"))
    tops = edges.join(parents, ["doc_id", "parent_id"], "left_anti").select("doc_id", "node_id")
    out_of_edges = trees.chains(edges.select("doc_id", "node_id", "parent_id").join(tops.withColumn("_top", F.lit(True)), ["doc_id", "node_id"], "left").select("doc_id", "node_id", F.when(F.col("_top").isNull(), F.col("parent_id")).alias("parent_id")))
    loops = edges.join(out_of_edges, ["doc_id", "node_id"], "left_anti").select("doc_id", "node_id").withColumn("_loop", F.lit(True))
    ok = first.where("_known and node_id <> 'root'").join(loops, ["doc_id", "node_id"], "left_anti")
    order = ok.select("doc_id", F.col("node_id").alias("parent_id"), F.col("_d").alias("_p"))
    ok = ok.join(order, ["doc_id", "parent_id"], "left").where("parent_id = 'root' or _p < _d")
    root = docs.select("doc_id").distinct().select("doc_id", F.lit("root").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit(-1).cast("long").alias("ord"), F.lit("").alias("label"), F.lit("").alias("title"))
    nodes = root.unionByName(ok.select("doc_id", "node_id", "parent_id", F.col("ord").cast("long").alias("ord"), "label", "title"))
    found = trees.chains(nodes.select("doc_id", "node_id", "parent_id"))
    nodes = nodes.join(found.select("doc_id", "node_id", (F.size("node_path") - 1).alias("depth"), "node_path"), ["doc_id", "node_id"])
    place = F.row_number().over(Window.partitionBy("doc_id", "parent_id").orderBy("ord")) - 1
    nodes = trees.kept_together(nodes.withColumn("sibling_pos", place), "sections")
    lost = d.join(loops, ["doc_id", "node_id"], "left").join(nodes.select("doc_id", "node_id", F.lit(True).alias("_made")), ["doc_id", "node_id"], "left")
    reason = F.when(F.col("_loop"), "CYCLE").when((F.col("_n") > 1) | F.col("_known").isNull() | (F.col("node_id") == "root"), "UNKNOWN_OR_DUPLICATE_SECTION_ID").when(F.col("_made").isNull(), "MISSING_OR_LATER_PARENT")
    return nodes, lost.withColumn("reason", reason).where("reason is not null").select("doc_id", "node_id", "reason")


def section_index(decisions: DataFrame, nodes: DataFrame) -> DataFrame:
    """The decisions behind the tree's sections."""
    return decisions.where("status = 'RESOLVED' and role = 'section'").join(nodes.select("doc_id", F.col("node_id").alias("candidate_id")), ["doc_id", "candidate_id"], "left_semi")


def ambiguity_summary(decisions: DataFrame, regions: DataFrame) -> DataFrame:
    """doc_id, role_uncertain, parent_uncertain, regions, region_sizes."""
    d = decisions.groupBy("doc_id").agg(F.sum(F.col("role_uncertain").cast("long")).alias("role_uncertain"), F.sum(F.col("parent_uncertain").cast("long")).alias("parent_uncertain"))
    r = regions.groupBy("doc_id").agg(F.count(F.lit(1)).alias("regions"), F.transform(F.sort_array(F.collect_list(F.struct("region", F.size("candidate_ids").alias("n")))), lambda x: x["n"]).alias("region_sizes"))
    return d.join(r, "doc_id", "left").select("doc_id", "role_uncertain", "parent_uncertain", F.coalesce("regions", F.lit(0)).alias("regions"), F.coalesce("region_sizes", F.array().cast("array<int>")).alias("region_sizes"))
