"""Ranked search, fill-in-middle and suffix dedup give what DuckDB makes of that SQL, over the smallest tables."""

import os

import duckdb
import pytest

from ladderline.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.mark.parametrize("name", ["op11_lexical_search", "op12_fill_in_middle", "op13_suffix_dedup"])
def test_agrees_with_sql(spark, name):
    db = duckdb.connect()
    for t in os.listdir(DATA):
        db.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{t}'")
    df = queries.QUERIES[name](spark, DATA)
    found = db.execute(queries.ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    want = sorted(repr([plain(r[columns.index(c)]) for c in sorted(columns)]) for r in found.fetchall())
    assert sorted(repr([plain(r[c]) for c in sorted(columns)]) for r in df.collect()) == want
