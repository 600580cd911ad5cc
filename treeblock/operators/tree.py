"""Trees as frames of nodes: building, path lookup, search, edits.

NODES: file, node_id (parse order, which is depth first), parent_id, ord (place among its siblings), key (of a mapping's
entry), node_path (canonical, / for the root), depth, bfs (breadth-first place), kind (scalar, sequence, mapping, alias),
style, tag, tag_name, tag_version, anchor, alias_of (node_id), text, size (children).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from treeblock.plans.paths import Path, escape

NODES = (
    "file string, node_id int, parent_id int, ord int, key string, node_path string, depth int, bfs int, kind string, style string, "
    "tag string, tag_name string, tag_version string, anchor string, alias_of int, text string, size int"
)


def from_text(df: DataFrame, file: str, text: str) -> DataFrame:
    """NODES of a column of YAML (or JSON) texts; a null text or one that does not parse has no nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from treeblock.sources.treetext import TreeError, parse, rows

        for batch in batches:
            out = []
            for name, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if source is not None:
                    try:
                        out += rows(name, parse(source))
                    except TreeError:
                        continue
            yield pa.RecordBatch.from_pylist(out, schema=_arrow())

    return df.select(F.col(file).cast("string"), F.col(text).cast("string")).mapInArrow(run, NODES)


def _arrow() -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32()}
    return pa.schema([(n, kinds[t]) for n, t in (f.split() for f in NODES.split(", "))])


def from_columns(df: DataFrame, file: Column, entries: dict[str, Column]) -> DataFrame:
    """NODES of flat mappings, one a row, made of columns: no Python."""
    pairs = [F.struct(F.lit(i + 1).alias("node_id"), F.lit(0).alias("parent_id"), F.lit(i).alias("ord"), F.lit(k).alias("key"), F.lit("/" + escape(k)).alias("node_path"), F.lit(1).alias("depth"), F.lit("scalar").alias("kind"), v.cast("string").alias("text"), F.lit(0).alias("size")) for i, (k, v) in enumerate(entries.items())]
    null = lambda t: F.lit(None).cast(t)
    root = F.struct(F.lit(0).alias("node_id"), null("int").alias("parent_id"), F.lit(0).alias("ord"), null("string").alias("key"), F.lit("/").alias("node_path"), F.lit(0).alias("depth"), F.lit("mapping").alias("kind"), null("string").alias("text"), F.lit(len(pairs)).alias("size"))
    rows = df.select(file.cast("string").alias("file"), F.explode(F.array(root, *pairs)).alias("n"))
    n = F.col("n")
    plain = F.when(n["kind"] == "scalar", "plain")
    return rows.select("file", *[n[c].alias(c) for c in ("node_id", "parent_id", "ord", "key", "node_path", "depth")], n["node_id"].alias("bfs"), n["kind"].alias("kind"), plain.alias("style"), *[null("string").alias(c) for c in ("tag", "tag_name", "tag_version", "anchor")], null("int").alias("alias_of"), n["text"].alias("text"), n["size"].alias("size"))


def lookup(nodes: DataFrame, path: str | Path, aliases: bool = True) -> DataFrame:
    """The node at a path of every file, aliases followed at each step; of equal keys the first counts, negative indices
    count from the end. Without aliases, a path without negative indices is one predicate on node_path."""
    path = Path.parse(path) if isinstance(path, str) else path
    if not aliases and all(s.index is None or s.index >= 0 for s in path.steps):
        found = nodes.where(F.col("node_path").isin(path.canonical()))
        return found if len(path.canonical()) == 1 else _first(found)
    now = nodes.where("parent_id is null")
    for step in path.steps:
        now = _followed(nodes, now).select("file", F.col("node_id").alias("parent_id"), F.col("kind").alias("_kind"), F.col("size").alias("_n"))
        child = nodes.join(now, ["file", "parent_id"])
        by_key = (F.col("_kind") == "mapping") & (F.col("key") == step.key) if step.key is not None else F.lit(False)
        by_index = (F.col("_kind") == "sequence") & (F.col("ord") == (F.lit(step.index) if step.index >= 0 else F.col("_n") + step.index)) if step.index is not None else F.lit(False)
        now = _first(child.where(by_key | by_index).drop("_kind", "_n")).select(*nodes.columns)
    return _followed(nodes, now)


def _first(nodes: DataFrame) -> DataFrame:
    """Of each file, the node of the least ord."""
    return nodes.groupBy("file").agg(F.min_by(F.struct(*nodes.columns), "ord").alias("n")).select("n.*")


def _followed(nodes: DataFrame, some: DataFrame) -> DataFrame:
    """some, with aliases replaced by what they stand for."""
    plain = some.where("kind != 'alias'")
    targets = some.where("kind = 'alias'").select("file", F.col("alias_of").alias("node_id"))
    return plain.select(*nodes.columns).unionByName(nodes.join(targets.distinct(), ["file", "node_id"]).select(*nodes.columns))


def find(nodes: DataFrame, predicate: Column, order: str = "bfs", descend: Column | None = None, max_depth: int = -1, first: bool = False) -> DataFrame:
    """Nodes that satisfy a predicate, with place (1, 2, ...) in the order of search of their file.

    The root is tested too. Containers deeper than max_depth are not opened, nor are those that descend refuses, save
    the root; both bound what is reached. first keeps one node a file. Aliased nodes are visited where they stand.
    """
    reached = nodes.where("kind != 'alias'")
    if max_depth >= 0:
        reached = reached.where(F.col("depth") <= max_depth + 1)
    if descend is not None:
        shut = reached.where((F.col("depth") > 0) & (F.col("size") > 0) & ~F.coalesce(descend, F.lit(False))).select("file", F.col("node_path").alias("above"))
        steps = F.split("node_path", "/")
        ups = reached.where("depth > 1").select("file", "node_id", F.explode(F.transform(F.sequence(F.lit(2), F.size(steps) - 1), lambda i: F.array_join(F.slice(steps, 1, i), "/"))).alias("above"))
        reached = reached.join(ups.join(shut, ["file", "above"], "left_semi").select("file", "node_id").distinct(), ["file", "node_id"], "left_anti")
    found = reached.where(predicate)
    by = "bfs" if order == "bfs" else "node_id"
    if first:
        return found.groupBy("file").agg(F.min_by(F.struct(*nodes.columns), by).alias("n")).select("n.*").withColumn("place", F.lit(1))
    return found.withColumn("place", F.row_number().over(W.partitionBy("file").orderBy(by)))


def find_tagged(nodes: DataFrame, name: str) -> DataFrame:
    """Nodes of a tag whatever its version, in parse order."""
    return nodes.where(F.col("tag_name") == name).orderBy("file", "node_id")


def update(base: DataFrame, changes: DataFrame, keys: list[str], value: str = "value", ord_: str = "ord") -> DataFrame:
    """Mapping entries (keys..., key, value, ord) after an update: changed ones keep their place, new ones follow in
    the order of the changes."""
    b = base.select(*keys, "key", F.col(value).alias("_b"), F.col(ord_).alias("_bo"))
    c = changes.select(*keys, "key", F.col(value).alias("_c"), F.col(ord_).alias("_co"), F.lit(True).alias("_in"))
    both = b.join(c, [*keys, "key"], "full")
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.col("_bo").isNull(), "_bo", "_co")) - 1
    return both.select(*keys, "key", F.when(F.col("_in"), F.col("_c")).otherwise(F.col("_b")).alias(value), place.alias(ord_))


def remove(nodes: DataFrame, path: str) -> DataFrame:
    """nodes without the one at a path of each file and all below; later elements of its sequence move up."""
    gone = lookup(nodes, path, aliases=False).select("file", F.col("node_path").alias("_p"), F.col("parent_id").alias("_parent"), F.col("ord").alias("_o"))
    rows = nodes.join(gone, "file", "left")
    below = F.coalesce((F.col("node_path") == F.col("_p")) | F.col("node_path").startswith(F.concat("_p", F.lit("/"))), F.lit(False))
    rows = rows.where(~below)
    later = F.coalesce((F.col("parent_id") == F.col("_parent")) & (F.col("ord") > F.col("_o")), F.lit(False))
    rows = rows.withColumn("ord", F.col("ord") - later.cast("int")).withColumn("size", F.col("size") - F.coalesce((F.col("node_id") == F.col("_parent")).cast("int"), F.lit(0)))
    return repathed(rows.drop("_p", "_parent", "_o"))


def insert(nodes: DataFrame, path: str, value) -> DataFrame:
    """nodes with a scalar, list or dict at a path of each file. Mappings are made on the way, a scalar in the way is
    replaced, an index equal to a sequence's length appends, the empty path replaces the root.

    Each file's tree is edited as a whole: a tree is one document, far smaller than its blocks.
    """
    from treeblock.sources import treetext

    def run(table: pa.Table) -> pa.Table:
        name = table.column("file")[0].as_py()
        doc = treetext.from_rows(table.to_pylist())
        treetext.insert(doc, Path.parse(path), value)
        return pa.Table.from_pylist(treetext.rows(name, doc), schema=_arrow())

    return nodes.groupBy("file").applyInArrow(run, NODES)


def repathed(nodes: DataFrame) -> DataFrame:
    """nodes with node_path after their ord and key; trees are walked level by level, each file in one task."""
    from treeblock.sources import treetext

    def run(table: pa.Table) -> pa.Table:
        name = table.column("file")[0].as_py()
        return pa.Table.from_pylist(treetext.rows(name, treetext.from_rows(table.to_pylist())), schema=_arrow())

    return nodes.select(*[f.split()[0] for f in NODES.split(", ")]).groupBy("file").applyInArrow(run, NODES)
