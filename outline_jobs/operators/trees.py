"""Node tables of outline trees: depths and paths, labels, patches, pruning, moving, statistics, nested JSON at the edges.

A node table has doc_id, node_id, parent_id (null for the root), sibling_pos, label, title, text. Depth and path come from a join that doubles
its reach each round; each round is written, so plans stay short. Nodes that no path from the root reaches (cycles, lost parents) are left out.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outline_jobs.functions import text as tx
from outline_jobs.functions.tables import dropped, kept_together, written


def chains(nodes: DataFrame, item: Column | None = None) -> DataFrame:
    """doc_id, node_id, node_path: the ids from the root (parent_id null) down to the node; items: what item is along it.

    Every round doubles how far up each node sees, so rounds are the logarithm of the depth. Nodes of cycles, with lost parents, and all below them are left out.
    """
    one = F.struct(F.col("node_id").alias("id"), (F.lit(None).cast("string") if item is None else item).alias("item"))
    reach = kept_together(nodes.select("doc_id", "node_id", F.col("parent_id").alias("_up"), F.array(one).alias("_chain")), "tree-chains")
    while reach.where("_up is not null").take(1):
        above = reach.select("doc_id", F.col("node_id").alias("_up"), F.col("_up").alias("_next"), F.col("_chain").alias("_before"))
        more = reach.where("_up is not null").join(above, ["doc_id", "_up"]).where(~F.exists("_before", lambda x: x["id"] == F.col("node_id")))
        more = more.select("doc_id", "node_id", F.col("_next").alias("_up"), F.concat("_before", "_chain").alias("_chain"))
        last, reach = reach, kept_together(reach.where("_up is null").unionByName(more), "tree-chains")
        dropped(last)
    return reach.select("doc_id", "node_id", F.transform("_chain", lambda x: x["id"]).alias("node_path"), F.transform("_chain", lambda x: x["item"]).alias("items"))


def recompute_depths(nodes: DataFrame) -> DataFrame:
    found = chains(nodes).select("doc_id", "node_id", (F.size("node_path") - 1).alias("depth"), "node_path")
    return nodes.drop("depth", "node_path").join(found, ["doc_id", "node_id"])


def renumber_nodes(nodes: DataFrame) -> DataFrame:
    """Labels 1, 1.1, 1.2, 2 … from the order of siblings; the root keeps its own."""
    place = F.row_number().over(Window.partitionBy("doc_id", "parent_id").orderBy("sibling_pos", "node_id")).cast("string")
    found = chains(nodes.withColumn("_place", place), F.col("_place")).select("doc_id", "node_id", (F.size("node_path") - 1).alias("depth"), "node_path", "items")
    out = nodes.drop("depth", "node_path").join(found, ["doc_id", "node_id"])
    number = F.array_join(F.slice("items", 2, F.greatest(F.size("items") - 1, F.lit(0))), ".")
    return out.withColumn("label", F.when(F.col("depth") == 0, F.col("label")).otherwise(number)).drop("items")


def patch_nodes(nodes: DataFrame, patches: DataFrame) -> DataFrame:
    """Fields of patches (doc_id, node_id, any of label, title, text) that aren't null replace those of nodes."""
    fields = [c for c in ("label", "title", "text") if c in patches.columns]
    p = patches.select("doc_id", "node_id", *[F.col(c).alias(f"_{c}") for c in fields])
    return nodes.join(p, ["doc_id", "node_id"], "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in fields else c for c in nodes.columns])


def prune_subtrees(nodes: DataFrame, doomed: DataFrame) -> DataFrame:
    """nodes (with node_path) without the doomed (doc_id, node_id) and all below them; the root stays."""
    d = doomed.join(nodes.where("parent_id is null").select("doc_id", "node_id"), ["doc_id", "node_id"], "left_anti")
    below = nodes.select("doc_id", F.explode("node_path").alias("_up"), "node_id").join(d.select("doc_id", F.col("node_id").alias("_up")), ["doc_id", "_up"], "left_semi")
    return nodes.join(below.select("doc_id", "node_id").distinct(), ["doc_id", "node_id"], "left_anti")


def reparent_subtrees(nodes: DataFrame, moves: DataFrame) -> DataFrame:
    """One move for each document: (doc_id, node_id, target_id, position inside, before or after). Moves of the root, onto itself, below itself or to
    nowhere change nothing. nodes need node_path; depths are recomputed."""
    at = nodes.select("doc_id", F.col("node_id").alias("target_id"), F.col("parent_id").alias("_tp"), F.col("sibling_pos").alias("_ts"), F.col("node_path").alias("_tpath"))
    own = nodes.select("doc_id", "node_id", F.col("parent_id").alias("_own"))
    m = moves.join(at, ["doc_id", "target_id"]).join(own, ["doc_id", "node_id"]).where(F.col("_own").isNotNull() & ~F.array_contains("_tpath", F.col("node_id")))
    into = (F.col("position") == "inside") | F.col("_tp").isNull()
    m = m.select("doc_id", "node_id", F.when(into, F.col("target_id")).otherwise(F.col("_tp")).alias("_p"),
                 F.when(into & (F.col("position") == "before"), -1e18).when(into, 1e18).otherwise(F.col("_ts") + F.when(F.col("position") == "before", -0.5).otherwise(0.5)).alias("_s"))
    d = nodes.join(m, ["doc_id", "node_id"], "left")
    d = d.withColumns({"parent_id": F.coalesce("_p", "parent_id"), "_key": F.coalesce("_s", F.col("sibling_pos").cast("double"))})
    order = F.row_number().over(Window.partitionBy("doc_id", "parent_id").orderBy("_key", "node_id")) - 1
    return recompute_depths(d.withColumn("sibling_pos", order).select(*nodes.columns))


def tree_stats(nodes: DataFrame) -> DataFrame:
    """One row for each document: nodes, depth, words (those of the root count twice), empty titles, repeated ids, wrong depths. nodes: with given depth and true_depth."""
    again = F.row_number().over(Window.partitionBy("doc_id", "node_id").orderBy("ord")) > 1
    d = nodes.withColumn("_again", again).withColumn("_words", tx.word_count(F.col("text")))
    root = F.col("true_depth") == 0
    return d.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("total_nodes"), F.max("depth").alias("max_depth"), F.sum(F.when(root, 2 * F.col("_words")).otherwise(F.col("_words"))).alias("word_count"),
        F.sum((~root & (tx.strip(F.col("title")) == "")).cast("int")).alias("empty_titles"), F.sum(F.col("_again").cast("int")).alias("duplicate_ids"), F.sum((F.col("depth") != F.col("true_depth")).cast("int")).alias("depth_issues"),
    )


def tree_issues(nodes: DataFrame) -> DataFrame:
    """doc_id, ord, node_id, issue, path: repeated ids, empty titles but for the root's, and wrong depths, with the labels (or titles) that lead to the parent.

    nodes as for tree_stats, with node_key and parent_key that are unique in a document.
    """
    again = F.row_number().over(Window.partitionBy("doc_id", "node_id").orderBy("ord")) > 1
    name = F.when(F.col("parent_key").isNull(), "Root").when(F.coalesce("label", F.lit("")) != "", F.col("label")).otherwise(F.coalesce("title", F.lit("")))
    found = chains(nodes.select("doc_id", F.col("node_key").alias("node_id"), F.col("parent_key").alias("parent_id"), name.alias("_name")), F.col("_name"))
    above = F.array_join(F.slice("items", 1, F.greatest(F.size("items") - 1, F.lit(0))), " > ")
    d = nodes.withColumn("_again", again).join(found.select("doc_id", F.col("node_id").alias("node_key"), above.alias("path")), ["doc_id", "node_key"], "left")
    issue = F.array(
        F.when(F.col("_again"), "duplicate_id"), F.when((tx.strip(F.coalesce("title", F.lit(""))) == "") & (F.col("node_id") != "root"), "empty_title"),
        F.when(~F.col("depth").eqNullSafe(F.col("true_depth")), "depth_mismatch"),
    )
    return d.select("doc_id", "ord", "node_id", F.explode(F.filter(issue, lambda x: x.isNotNull())).alias("issue"), "path")


_FLAT = "doc_id long, node_id string, parent_id string, ord long, sibling_pos long, label string, title string, text string, depth long, true_depth long"
_FIELDS = ("id", "label", "title", "text", "depth", "children")


def _root(raw: str | None):
    """The root of a tree's JSON text, None where there is none or it is nested too deep to be read."""
    try:
        return json.loads(raw or "")["root"]
    except (ValueError, KeyError, TypeError, RecursionError):
        return None


def _walk(root) -> Iterator[tuple]:
    """(node, parent's id, place among its siblings, depth) in preorder."""
    todo = [(root, None, 0, 0)]
    while todo:
        node, parent, place, depth = todo.pop()
        yield node, parent, place, depth
        if isinstance(node, dict) and isinstance(node.get("children"), list):
            todo += [(c, node.get("id"), k, depth + 1) for k, c in reversed(list(enumerate(node["children"])))]


def flatten_trees(trees: DataFrame) -> DataFrame:
    """(doc_id, tree: JSON text with a root) -> node rows in preorder; depth as given, true_depth as found. Texts that aren't trees give no rows (validate_trees tells them)."""
    text = lambda x: x if x is None or isinstance(x, str) else json.dumps(x)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, raw in zip(batch["doc_id"], batch["tree"]):
                nodes = [x for x in _walk(_root(raw)) if isinstance(x[0], dict)]
                for n, (node, parent, place, depth) in enumerate(nodes):
                    given = node.get("depth") if type(node.get("depth")) is int else None
                    rows.append((doc, text(node.get("id")), text(parent), n, place, text(node.get("label")), text(node.get("title")), text(node.get("text")), given, depth))
            out = pd.DataFrame(rows, columns=[x.split()[0] for x in _FLAT.split(", ")])
            yield out.astype({"depth": "Int64"})

    return trees.select("doc_id", "tree").mapInPandas(run, _FLAT)


def validate_trees(trees: DataFrame) -> DataFrame:
    """doc_id, ord (null for the whole), node_id, error: what keeps a JSON text from being a tree of nodes with exactly the six fields, texts, unique ids and true depths."""
    kind = "doc_id long, ord long, node_id string, errors array<string>"

    def faults(node, depth: int) -> list[str]:
        if not isinstance(node, dict):
            return ["node must be an object"]
        out = [] if set(node) == set(_FIELDS) else ["unexpected or missing fields"]
        out += [f"{f} must be a string" for f in _FIELDS[:4] if not isinstance(node.get(f), str)]
        out += [] if isinstance(node.get("id"), str) and node["id"] else ["empty, invalid or repeated id"]
        out += [] if type(node.get("depth")) is int and node["depth"] == depth else ["wrong depth"]
        return out + ([] if isinstance(node.get("children"), list) else ["children must be an array"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, raw in zip(batch["doc_id"], batch["tree"]):
                try:
                    whole = json.loads(raw or "")
                except (ValueError, RecursionError):
                    whole = None
                if not isinstance(whole, dict) or set(whole) != {"root"}:
                    rows.append((doc, None, None, ["expected exactly a root"]))
                    continue
                rows += [(doc, n, node["id"] if isinstance(node, dict) and isinstance(node.get("id"), str) else None, faults(node, depth)) for n, (node, _, _, depth) in enumerate(_walk(whole["root"]))]
            yield pd.DataFrame(rows, columns=["doc_id", "ord", "node_id", "errors"]).astype({"ord": "Int64"})

    d = trees.select("doc_id", "tree").mapInPandas(run, kind)
    again = F.col("node_id").isNotNull() & (F.col("node_id") != "") & (F.row_number().over(Window.partitionBy("doc_id", "node_id").orderBy("ord")) > 1)
    d = d.withColumn("errors", F.when(again, F.array_union("errors", F.array(F.lit("empty, invalid or repeated id")))).otherwise(F.col("errors")))
    return d.select("doc_id", "ord", "node_id", F.explode("errors").alias("error"))


def nest_trees(nodes: DataFrame) -> DataFrame:
    """Node rows -> (doc_id, tree: JSON text) with exactly id, label, title, text, depth, children; a document is one group. Written from the leaves up, at any depth."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["sibling_pos", "node_id"], kind="stable")
        below: dict = {}
        for r in g.itertuples():
            below.setdefault(r.parent_id, []).append(r)
        order = [(r, below.pop(r.node_id, [])) for r in below.pop(None, [])[-1:]]
        for _, children in order:
            order += [(c, below.pop(c.node_id, [])) for c in children]
        made: dict = {}
        for r, children in reversed(order):
            own = json.dumps({"id": r.node_id, "label": r.label, "title": r.title, "text": r.text, "depth": int(r.depth)}, ensure_ascii=False)
            made[r.Index] = f'{own[:-1]}, "children": [{", ".join(made.pop(c.Index) for c in children)}]}}'
        return pd.DataFrame({"doc_id": [g["doc_id"].iloc[0]], "tree": [f'{{"root": {made[order[0][0].Index] if order else "null"}}}']})

    return nodes.select("doc_id", "node_id", "parent_id", "sibling_pos", "label", "title", "text", "depth").groupBy("doc_id").applyInPandas(run, "doc_id long, tree string")


def normalize_nodes(nodes: DataFrame) -> DataFrame:
    """Missing ids, labels, titles and texts filled in: 'root' at depth 0, a hash of document and place elsewhere."""
    made = F.concat(F.lit("item-"), F.substring(F.sha1(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("ord").cast("string"))), 1, 6))
    ident = F.coalesce(F.when(F.col("node_id") != "", F.col("node_id")), F.when(F.col("true_depth") == 0, "root").otherwise(made))
    return nodes.withColumn("node_id", ident).withColumns({c: F.coalesce(c, F.lit("")) for c in ("label", "title", "text")}).withColumn("depth", F.col("true_depth"))
