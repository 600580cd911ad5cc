"""Trees made of tables: events' props, and a tree of each region with its nations."""

from __future__ import annotations

from pyspark.sql import functions as F

from treeblock.operators import compare as C
from treeblock.operators import tree as T
from treeblock.plans.registry import register, table


def _props(spark, sf):
    df = table(spark, sf, "events").withColumn("file", F.col("event_id").cast("string"))
    return T.from_text(df, "file", "props")


def _regions(spark, sf):
    """A JSON text of each region: its name and its nations in the order of their keys, each with key, name and counts."""
    n = table(spark, sf, "nation").select("n_regionkey", F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.struct((F.col("n_nationkey") % 3).alias("ports"), F.lit(1.5).alias("rate")).alias("info")).alias("n"))
    n = n.groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n")).alias("nations"))
    r = table(spark, sf, "region").join(n, F.col("r_regionkey") == F.col("n_regionkey"))
    doc = F.to_json(F.struct(F.col("r_name").alias("name"), F.col("nations")))
    return T.from_text(r.select(F.col("r_regionkey").cast("string").alias("file"), doc.alias("doc")), "file", "doc")


N = "(SELECT n_regionkey, n_nationkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i, count(*) OVER (PARTITION BY n_regionkey) AS c FROM nation)"
#: All nodes of the regions' trees: file, node_path, depth, kind, text, and places in breadth-first and depth-first order.
ALL = f"""(SELECT file, node_path, depth, kind, text, row_number() OVER (PARTITION BY file ORDER BY depth, a, b) AS bfs, row_number() OVER (PARTITION BY file ORDER BY d1, d2, d3, d4) AS dfs FROM (
  SELECT CAST(r_regionkey AS VARCHAR) AS file, '/' AS node_path, 0 AS depth, 'mapping' AS kind, NULL AS text, 0 AS a, 0 AS b, 0 AS d1, 0 AS d2, 0 AS d3, 0 AS d4 FROM region
  UNION ALL SELECT CAST(r_regionkey AS VARCHAR), '/name', 1, 'scalar', r_name, 0, 0, 1, 0, 0, 0 FROM region
  UNION ALL SELECT CAST(r_regionkey AS VARCHAR), '/nations', 1, 'sequence', NULL, 1, 0, 2, 0, 0, 0 FROM region
  UNION ALL SELECT CAST(n_regionkey AS VARCHAR), '/nations/' || i, 2, 'mapping', NULL, i, 0, 3, i, 0, 0 FROM {N}
  UNION ALL SELECT CAST(n_regionkey AS VARCHAR), '/nations/' || i || '/key', 3, 'scalar', CAST(n_nationkey AS VARCHAR), i, 0, 3, i, 1, 0 FROM {N}
  UNION ALL SELECT CAST(n_regionkey AS VARCHAR), '/nations/' || i || '/name', 3, 'scalar', n_name, i, 1, 3, i, 2, 0 FROM {N}
  UNION ALL SELECT CAST(n_regionkey AS VARCHAR), '/nations/' || i || '/info', 3, 'mapping', NULL, i, 2, 3, i, 3, 0 FROM {N}
  UNION ALL SELECT CAST(n_regionkey AS VARCHAR), '/nations/' || i || '/info/ports', 4, 'scalar', CAST(n_nationkey % 3 AS VARCHAR), i, 0, 3, i, 3, 1 FROM {N}
  UNION ALL SELECT CAST(n_regionkey AS VARCHAR), '/nations/' || i || '/info/rate', 4, 'scalar', '1.5', i, 1, 3, i, 3, 2 FROM {N}))"""


@register("tree_flatten", "SELECT CAST(event_id AS VARCHAR) AS file, '/k' AS node_path, json_extract_string(props, '$.k') AS text FROM events")
def flatten(spark, sf):
    return _props(spark, sf).where("depth = 1").select("file", "node_path", "text")


@register("tree_nodes", f"SELECT file, node_path, depth, kind, text, CAST(dfs - 1 AS INTEGER) AS node_id, CAST(bfs - 1 AS INTEGER) AS bfs FROM {ALL}")
def nodes(spark, sf):
    return _regions(spark, sf).select("file", "node_path", "depth", "kind", "text", "node_id", "bfs")


@register("tree_lookup", f"SELECT CAST(n_regionkey AS VARCHAR) AS file, '/nations/1/name' AS node_path, n_name AS text FROM {N} WHERE i = 1")
def lookup(spark, sf):
    return T.lookup(_regions(spark, sf), "nations/[1]/name").select("file", "node_path", "text")


@register("tree_lookup_fast", f"SELECT CAST(n_regionkey AS VARCHAR) AS file, n_name AS text FROM {N} WHERE i = 2")
def lookup_fast(spark, sf):
    return T.lookup(_regions(spark, sf), "/nations/2/name", aliases=False).select("file", "text")


@register("tree_neg_index", f"SELECT CAST(n_regionkey AS VARCHAR) AS file, n_name AS text FROM {N} WHERE i = c - 1")
def neg_index(spark, sf):
    return T.lookup(_regions(spark, sf), "nations/[-1]/name").select("file", "text")


@register("tree_len", f"SELECT CAST(n_regionkey AS VARCHAR) AS file, CAST(count(*) AS INTEGER) AS size FROM {N} GROUP BY 1")
def length(spark, sf):
    return T.lookup(_regions(spark, sf), "nations", aliases=False).select("file", "size")


@register("tree_iterate_reverse", f"SELECT CAST(n_regionkey AS VARCHAR) AS file, CAST(c - 1 - i AS INTEGER) AS place, n_name AS text FROM {N}")
def iterate_reverse(spark, sf):
    names = _regions(spark, sf).where(F.col("node_path").rlike("^/nations/[0-9]+/name$"))
    parents = T.lookup(_regions(spark, sf), "nations", aliases=False).select("file", "size")
    index = F.regexp_extract("node_path", "^/nations/([0-9]+)", 1).cast("int")
    return names.select("file", "text", index.alias("i")).join(parents, "file").select("file", (F.col("size") - 1 - F.col("i")).alias("place"), "text")


@register("tree_find_bfs", f"SELECT file, node_path, CAST(row_number() OVER (PARTITION BY file ORDER BY bfs) AS INTEGER) AS place FROM {ALL} WHERE kind = 'scalar'")
def find_bfs(spark, sf):
    return T.find(_regions(spark, sf), F.col("kind") == "scalar").select("file", "node_path", "place")


@register("tree_find_dfs", f"SELECT file, node_path, CAST(row_number() OVER (PARTITION BY file ORDER BY dfs) AS INTEGER) AS place FROM {ALL} WHERE kind <> 'scalar'")
def find_dfs(spark, sf):
    return T.find(_regions(spark, sf), F.col("kind") != "scalar", order="dfs").select("file", "node_path", "place")


@register("tree_find_first", f"SELECT file, arg_min(node_path, bfs) AS node_path FROM {ALL} WHERE text LIKE '%A%' GROUP BY file")
def find_first(spark, sf):
    return T.find(_regions(spark, sf), F.col("text").contains("A"), first=True).select("file", "node_path")


@register("tree_find_depth", f"SELECT file, node_path, CAST(row_number() OVER (PARTITION BY file ORDER BY bfs) AS INTEGER) AS place FROM {ALL} WHERE depth <= 3 AND kind = 'scalar'")
def find_depth(spark, sf):
    return T.find(_regions(spark, sf), F.col("kind") == "scalar", max_depth=2).select("file", "node_path", "place")


@register("tree_descend", f"SELECT file, node_path, CAST(row_number() OVER (PARTITION BY file ORDER BY bfs) AS INTEGER) AS place FROM {ALL} WHERE kind = 'scalar' AND node_path NOT LIKE '%/info/%'")
def descend(spark, sf):
    shut = F.coalesce(F.col("key") == "info", F.lit(False))
    return T.find(_regions(spark, sf), F.col("kind") == "scalar", descend=~shut).select("file", "node_path", "place")


@register("tree_remove", f"SELECT CAST(n_regionkey AS VARCHAR) AS file, '/nations/' || (i - 1) || '/name' AS node_path, n_name AS text FROM {N} WHERE i > 0")
def remove(spark, sf):
    left = T.remove(_regions(spark, sf), "nations/0")
    return left.where(F.col("node_path").rlike("^/nations/[0-9]+/name$")).select("file", "node_path", "text")


@register(
    "tree_set",
    f"SELECT file, node_path, CASE WHEN node_path = '/name' THEN 'renamed' ELSE text END AS text FROM {ALL} WHERE depth <= 1 UNION ALL SELECT DISTINCT file, unnest(['/extra', '/extra/deep', '/extra/deep/x']), unnest([NULL, NULL, '7']) FROM {ALL}",
)
def set_(spark, sf):
    changed = T.insert(T.insert(_regions(spark, sf), "name", "renamed"), "extra/deep/x", 7)
    return changed.where("depth <= 1 or node_path like '/extra/%'").select("file", "node_path", "text")


@register("tree_append", f"SELECT CAST(n_regionkey AS VARCHAR) AS file, '/nations/' || max(c) AS node_path, 'new' AS text FROM {N} GROUP BY 1")
def append(spark, sf):
    sizes = T.insert(_regions(spark, sf), "nations/5", "new")
    return sizes.where("text = 'new'").select("file", "node_path", "text")


@register(
    "tree_update",
    """SELECT k AS file, key, value, CAST(row_number() OVER (PARTITION BY k ORDER BY o) - 1 AS INTEGER) AS ord FROM (
    SELECT p_partkey AS k, 'name' AS key, p_name AS value, 0 AS o FROM part UNION ALL SELECT p_partkey, 'size', CAST(p_size + 1 AS VARCHAR), 1 FROM part
    UNION ALL SELECT p_partkey, 'brand', p_brand, 2 FROM part UNION ALL SELECT p_partkey, 'type', p_type, 3 FROM part)""",
)
def update(spark, sf):
    part = table(spark, sf, "part")
    entries = lambda d: part.select(F.col("p_partkey").alias("file"), F.posexplode(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in d.items()])).alias("ord", "e")).select("file", "e.key", "e.value", "ord")
    base = entries({"name": F.col("p_name"), "size": F.col("p_size").cast("string"), "brand": F.col("p_brand")})
    change = entries({"type": F.col("p_type"), "size": (F.col("p_size") + 1).cast("string")})
    return T.update(base, change, ["file"])


def _orders(spark, sf, price, status):
    entries = {"status": status, "price": price, "date": F.col("o_orderdate")}
    return T.from_columns(table(spark, sf, "orders"), F.col("o_orderkey"), entries)


@register("tree_from_columns", "SELECT CAST(o_orderkey AS VARCHAR) AS file, unnest(['/', '/status', '/price']) AS node_path, unnest([NULL, o_orderstatus, CAST(o_custkey AS VARCHAR)]) AS text FROM orders")
def from_columns(spark, sf):
    return _orders(spark, sf, F.col("o_custkey"), F.col("o_orderstatus")).where("node_path != '/date'").select("file", "node_path", "text")


@register(
    "tree_compare",
    """SELECT CAST(o_orderkey AS VARCHAR) AS file, '/price' AS node_path, 'value' AS difference FROM orders WHERE o_orderkey % 5 = 0
    UNION ALL SELECT CAST(o_orderkey AS VARCHAR), '/status', 'value' FROM orders WHERE o_orderkey % 7 = 0""",
)
def compare(spark, sf):
    k = F.col("o_orderkey")
    left = _orders(spark, sf, F.col("o_custkey"), F.col("o_orderstatus"))
    right = _orders(spark, sf, F.col("o_custkey") + F.when(k % 5 == 0, 1).otherwise(0), F.concat("o_orderstatus", F.when(k % 7 == 0, "x").otherwise("")))
    return C.differences(left, right, limit=None).select("file", "node_path", "difference")


@register("tree_compare_tol", "SELECT CAST(o_orderkey AS VARCHAR) AS file, '/price' AS node_path, 'value' AS difference FROM orders WHERE o_orderkey % 3 = 0")
def compare_tol(spark, sf):
    k = F.col("o_orderkey")
    left = _orders(spark, sf, F.col("o_totalprice"), F.col("o_orderstatus"))
    factor = F.when(k % 3 == 0, 1.001).when(k % 3 == 1, 1.0000001).otherwise(1.0)
    right = _orders(spark, sf, F.col("o_totalprice") * factor, F.col("o_orderstatus"))
    return C.differences(left, right, tolerance=1e-5, limit=None).select("file", "node_path", "difference")


@register("tree_compare_missing", "SELECT CAST(o_orderkey AS VARCHAR) AS file, '/date' AS node_path, 'missing_right' AS difference FROM orders")
def compare_missing(spark, sf):
    left = _orders(spark, sf, F.col("o_custkey"), F.col("o_orderstatus"))
    return C.differences(left, left.where("node_path != '/date'"), limit=None).select("file", "node_path", "difference")
