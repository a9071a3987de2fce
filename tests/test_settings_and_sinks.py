"""Settings by tenant, and a text file a document."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.test_ordered import made
from tests.test_spans import frame
from veilspark.config import Config
from veilspark.operators import risk, sanitize, tenants
from veilspark.operators import spans as span_ops
from veilspark.sources import text_files

# ---- settings


def test_two_tenants_in_one_run_equal_two_runs(spark, monkeypatch):
    spans = frame(spark, made(300, random.Random(9), docs=6)).cache()
    docs = spark.createDataFrame([(k, "ab-"[k % 3] if k % 3 < 2 else None) for k in range(7)], "doc_id long, tenant string")
    table = spark.createDataFrame(
        [("a", 1.0, 2.0, 2.0, None, 3, 100, False, "flag", None), ("b", 3.5, None, 9.0, 20.0, None, 1, None, "preserve", "?? ")],
        "tenant string, invisible_contrast double, suspicious_contrast double, min_contrast double, min_readable_size double, invisible_threshold int, suspicious_threshold int, check_hidden_instructions boolean, default_strategy string, flag_prefix string",
    )
    own = {
        "a": Config(invisible_contrast=1.0, suspicious_contrast=2.0, min_contrast=2.0, invisible_threshold=3, suspicious_threshold=100, check_hidden_instructions=False, default_strategy="flag"),
        "b": Config(invisible_contrast=3.5, min_contrast=9.0, min_readable_size=20.0, suspicious_threshold=1, default_strategy="preserve", flag_prefix="?? "),
        None: Config(),
    }
    for few in (tenants.FEW, 1):
        monkeypatch.setattr(tenants, "FEW", few)
        settled = tenants.with_settings(docs, table)
        analyzed = tenants.analyzed(spans, settled)
        report = tenants.risk_report(analyzed, settled)
        clean = tenants.sanitize_by_level(analyzed, report)
        got = {r.doc_id: r for r in report.drop("settings").collect()}, {r.doc_id: r for r in clean.collect()}
        for tenant, c in own.items():
            mine = docs.where(F.col("tenant").eqNullSafe(F.lit(tenant)))
            alone = span_ops.analyzed(spans.join(mine.select("doc_id"), "doc_id"), c)
            alone_report = risk.risk_report(alone, mine, c)
            for r in alone_report.collect():
                assert got[0][r.doc_id] == r, (tenant, r)
            for r in sanitize.sanitize_by_level(alone, alone_report, c).collect():
                assert got[1][r.doc_id] == r
        assert len(got[0]) == 7 and len({r.risk_level for r in got[0].values()}) > 1


def test_bad_settings(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, tenant string")
    for table in (spark.createDataFrame([("a", 1.0), ("a", 2.0)], "tenant string, min_contrast double"), spark.createDataFrame([("a", 1.0)], "tenant string, contrast double")):
        with pytest.raises(ValueError):
            tenants.with_settings(docs, table)


# ---- text files


def held(folder):
    return {p.name: p.read_text() for p in Path(folder).glob("part-*/*")}


def test_a_file_a_row(spark, tmp_path):
    df = spark.range(10_000).selectExpr("concat('d', id, '.txt') AS name", "if(id % 7 = 0, null, concat('té ', id)) AS text").repartition(6)
    text_files.write_text_files(df, str(tmp_path / "out"))
    got = held(tmp_path / "out")
    assert len(got) == 10_000 and got["d7.txt"] == "" and got["d8.txt"] == "té 8"
    assert {p.name[:5] for p in (tmp_path / "out").iterdir()} == {"part-", "_SUCC"}
    text_files.write_text_files(df.limit(2), f"file://{tmp_path}/out", overwrite=False)
    assert len(list((tmp_path / "out").glob("part-*/*"))) == 10_002
    text_files.write_text_files(df.limit(3), str(tmp_path / "out"))
    assert len(held(tmp_path / "out")) == 3


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    df = spark.range(100).selectExpr("concat('d', id) AS name", "if(id = 99, raise_error('no'), 'x') AS text").repartition(3)
    with pytest.raises(Exception, match="no"):
        text_files.write_text_files(df, str(tmp_path / "out"))
    assert not list(tmp_path.glob("out/*"))
    for names in (["a/b"], ["_a"], [None], ["x", "x"]):
        with pytest.raises(Exception):
            text_files.write_text_files(spark.createDataFrame([(n, "t") for n in names], "name string, text string").coalesce(1), str(tmp_path / "out"))
        assert not list(tmp_path.glob("out/*"))


def test_names_of_files(spark):
    paths = ["file:/in/a b.docx", "file:/other/a b.docx", "/x/.hidden", "/x/é.pdf"]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in paths], "path string").select(text_files.file_name()).collect()]
    assert len(set(got)) == 4 and all(n.endswith(".txt") and "/" not in n and n[0] not in "._" for n in got)
