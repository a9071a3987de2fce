"""Every query with a DuckDB twin against it at the smallest scale, and the fixture's known totals."""

import collections

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from veilspark.plans import registry
from veilspark.sources import fixture

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows(df: pd.DataFrame) -> collections.Counter:
    def plain(v):
        if v is None or v is pd.NA or v != v:
            return None
        if isinstance(v, bool) or getattr(v, "dtype", None) == bool:
            return bool(v)
        return round(float(v), 6) if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "iuf" else str(v)

    return collections.Counter(tuple(map(plain, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_duckdb(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = duck.sql(registry.ORACLES[name]).df()
    assert sorted(want.columns) == cols
    assert rows(df.select(cols).toPandas()) == rows(want[cols])


def test_every_query_runs(spark):
    for name in set(registry.QUERIES) - set(registry.ORACLES):
        assert registry.QUERIES[name](spark, SF).count() >= 0


def test_fixture_totals(spark):
    s = fixture.spans(spark, SF)
    got = s.agg(F.count("*"), F.countDistinct("doc_id"), F.sum("span_seq"), F.sum(F.length("text")), F.sum("page_number"), F.sum("bbox.x0"), F.sum("bbox.y1"), F.sum("font_size"), F.sum("font_color.r"), F.count("background_color")).first()
    assert tuple(got) == (1829, 200, 17385, 487733, 3333, 138030.0, 232236.0, 16279.5, 69811, 1759)


def test_fixture_results(spark):
    r = registry.QUERIES["risk_level"](spark, SF)
    assert tuple(r.agg(F.sum("visible_count"), F.sum("suspicious_count"), F.sum("invisible_count"), F.sum("unknown_count")).first()) == (987, 359, 332, 151)
    assert {x.risk_level: x["count"] for x in r.groupBy("risk_level").count().collect()} == {"safe": 90, "low": 8, "medium": 46, "high": 5, "critical": 51}
    assert registry.QUERIES["gate_score"](spark, SF).agg(F.sum("score")).first()[0] == 9537
    assert registry.QUERIES["web_score"](spark, SF).agg(F.sum("score")).first()[0] == 5570


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 200
    assert set(entry.oracle_sql()) <= set(entry.queries())
