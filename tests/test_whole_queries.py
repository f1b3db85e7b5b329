"""Queries over whole tables against DuckDB, and no row left out."""

import glob
from collections import Counter

import duckdb
import pytest

from stowage.plans.adapters import MEMBERS_SQL
from stowage.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["rows_not_in", "rows_not_in_all_lines", "as_of", "as_of_all_events", "range_locate", "range_locate_all_spans", "run_plan", "catalog_import", "kinds_indexed", "kinds_indexed_older"])
def test_whole(spark, name):
    db = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        db.sql(f"CREATE VIEW {path.split('/')[-1][:-8]} AS SELECT * FROM '{path}'")
    got = [tuple(r) for r in QUERIES[name](spark, SF).collect()]
    assert Counter(got) == Counter(db.sql(ORACLES[name]).fetchall())
    if name.startswith("as_of"):
        assert len(got) == db.sql("SELECT count(*) FROM events").fetchall()[0][0]
    if name.startswith("range_locate"):
        assert sum(r[2] for r in got) == db.sql(f"WITH {MEMBERS_SQL} SELECT count(*) FROM members").fetchall()[0][0]


def test_lookup_by_keys_against_a_dictionary(spark):
    """Repeated and unknown keys add nothing, every row of a key comes."""
    from stowage.operators import catalogs

    rows = spark.createDataFrame([(i % 7, f"n{i}") for i in range(40)], "id long, name string")
    keys = spark.createDataFrame([(3, "x"), (3, "y"), (5, "z"), (99, "w"), (None, "v")], "id long, other string")
    got = catalogs.lookup(rows, keys, ["id"])
    assert got.columns == ["id", "name"]
    assert sorted(tuple(r) for r in got.collect()) == sorted((i % 7, f"n{i}") for i in range(40) if i % 7 in (3, 5))
