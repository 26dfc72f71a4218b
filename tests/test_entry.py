import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
LIGHT = ["keyset_page", "full_outer_diff", "best_per_page", "adaptive_expand", "plateau_select", "stale_dependents", "stratified_sample", "log_rotation", "title_overlap_candidates", "vector_topk", "graph_two_hop", "ranking_metrics"]


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", LIGHT)
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = entry.queries()[name](spark, sf)
    want = con.sql(entry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)

    def plain(x):
        return f"{x:.9g}" if isinstance(x, float) else str(x)

    rows = lambda data, names: sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in data)
    assert rows([tuple(r) for r in got.collect()], got.columns) == rows(want.fetchall(), want.columns)
