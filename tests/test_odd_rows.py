"""Registered queries against their SQL over rows that the tables lack: nulls, empty texts, zeros, other signs."""

import duckdb
import pytest

from tests.oracle import check
from treeblock.plans import registry


def check_over(spark, folder, name, table, schema, rows):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{table}.parquet")
    duck = duckdb.connect()
    duck.sql(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    check(registry.queries()[name](spark, str(folder)), duck, registry.oracle_sql()[name])


@pytest.mark.parametrize("name", ["blk_md5", "blk_md5_lenient"])
def test_checksums_of_texts_without_bytes(spark, tmp_path, name):
    rows = [(k, t) for k in (0, 1, 2, 3, 4, 5, -1, -2, None) for t in (None, "", "a", "aa", "aba")]
    check_over(spark, tmp_path, name, "documents", "doc_id long, text string", rows)


@pytest.mark.parametrize("name", ["conv_f32", "conv_f32_overflow"])
def test_floats_of_odd_quantities(spark, tmp_path, name):
    odd = [1.0, 50.0, 0.0, -3.0, None, float("nan"), float("inf"), float("-inf"), 1e-300, 3e38]
    rows = [(i, n, q, q) for i, (n, q) in enumerate((n, q) for n in (1, 2, 3, 0, -1, -2, None) for q in odd)]
    check_over(spark, tmp_path, name, "lineitem", "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double", rows)


def test_truth_of_nulls(spark, tmp_path):
    check_over(spark, tmp_path, "conv_bool8", "labels", "doc_id long, quality int", [(1, 0), (2, 1), (3, None), (None, 2)])


#: Customers' keys: zero, of both signs, none, of more bits than a float has.
NUMBERS = [0, 1, -1, -2, -3, None, 59, 60, 3600, -59, -3599, -3600, -3601, 7207, 16777217, 59000001, 60000000007]


def orders(most):
    return [(k, v) for k in [*range(48), -1, -5, None] for v in NUMBERS + most]


def test_floats_of_odd_keys(spark, tmp_path):
    rows = orders([(1 << 48) + 3, -(1 << 50) - 1, (1 << 60) + 12345])
    check_over(spark, tmp_path, "scal_as_float32", "orders", "o_orderkey long, o_custkey long", rows)


def test_spellings_of_odd_keys(spark, tmp_path):
    check_over(spark, tmp_path, "scal_resolve", "orders", "o_orderkey long, o_custkey long", orders([1800000000001]))


def test_spellings_of_odd_keys_in_yaml11(spark, tmp_path):
    check_over(spark, tmp_path, "scal_resolve_yaml11", "orders", "o_orderkey long, o_custkey long", orders([1800000000001]))
