"""Spans of files through the data source, against the reader functions."""

import os

import pytest
from pyspark.sql import functions as F

from tests.test_streams import docx, put
from veilspark.sources import docx as docx_reader
from veilspark.sources import samples, span_files
from veilspark.sources.files import NEEDS_OCR


@pytest.fixture
def folder(spark, tmp_path):
    span_files.register(spark)
    inbox = tmp_path / "in"
    for k in range(6):
        put(inbox, f"d{k}.docx", samples.docx_of("\n".join(f"line {k} {n}" for n in range(3 + k))), k)
    put(inbox, "sub/words.PDF", samples.pdf_of("some words here"), 10)
    put(inbox, "sub/scan.pdf", samples.picture_pdf(), 11)
    put(inbox, "broken.docx", b"junk", 12)
    put(inbox, "note.txt", b"not read", 13)
    return inbox


def opened(partitions):
    return sorted(os.path.basename(f.path) for p in partitions for f in p.files)


def test_spans_and_errors(spark, folder):
    df = spark.read.format("span_files").load(f"file://{folder}").cache()
    errors = {os.path.basename(r.path): r.error for r in df.where("error IS NOT NULL").collect()}
    assert errors == {"scan.pdf": NEEDS_OCR, "broken.docx": "BadZipFile: File is not a zip file"}
    for k in range(6):
        got = df.where(F.col("path").endswith(f"/d{k}.docx")).select("span.*").orderBy("span_seq").collect()
        assert [(r.span_seq, r.text, r.page_number) for r in got] == [s[:3] for s in docx_reader.read_docx((folder / f"d{k}.docx").read_bytes())]
    assert [r.text for r in df.where("path LIKE '%words.PDF'").select("span.text").collect()] == ["some", "words", "here"]
    assert df.where("span IS NULL").count() == 2


def test_filters_choose_files_before_they_are_opened(spark, folder):
    df = spark.read.format("span_files").load(str(folder))
    for where, n in [("format = 'pdf'", 2), (f"path = '{folder}/d1.docx'", 1), (f"path IN ('{folder}/d1.docx', '{folder}/d2.docx')", 2), (f"path LIKE '{folder}/d%'", 6), ("format = 'pdf' AND format = 'docx'", 0)]:
        chosen = df.where(where)
        paths = {r.path for r in chosen.select("path").distinct().collect()}
        assert len(paths) == n, where
    each = spark.read.format("span_files").option("partitionBytes", 1).load(str(folder))
    assert each.rdd.getNumPartitions() == 9 and each.where("format = 'pdf'").rdd.getNumPartitions() == 2
    reader = span_files.SpanReader({"path": str(folder)})
    left = list(reader.pushFilters([span_files.EqualTo(("format",), "docx"), span_files.StringStartsWith(("path",), f"{folder}/d"), span_files.EqualTo(("error",), "x")]))
    assert len(left) == 1 and opened(reader.partitions()) == [f"d{k}.docx" for k in range(6)]
    # a file that is left out is not read: what is there in its place can't be
    (folder / "d5.docx").unlink()
    (folder / "d5.docx").symlink_to(folder / "nowhere")
    assert df.where(f"path = '{folder}/d4.docx'").count() == 7


def test_partitions_by_bytes(spark, folder):
    whole = span_files.SpanReader({"path": str(folder)})
    assert len(whole.partitions()) == 1
    least = span_files.SpanReader({"path": str(folder), "partitionBytes": "1"})
    assert len(least.partitions()) == 9 and opened(least.partitions()) == opened(whole.partitions())
    size = os.path.getsize(folder / "d5.docx")
    parts = span_files.dealt(span_files.listed(str(folder)), 2 * size)
    assert len(parts) > 1 and all(len(p.files) == 1 or sum(f.size for f in p.files) <= 2 * size for p in parts)
    df = spark.read.format("span_files").option("partitionBytes", 2 * size).load(str(folder))
    assert df.rdd.getNumPartitions() == len(parts) and df.count() == spark.read.format("span_files").load(str(folder)).count()
    with pytest.raises(ValueError):
        span_files.SpanReader({"path": str(folder), "partitionBytes": "0"})


def test_nothing_to_read(spark, tmp_path, folder):
    (tmp_path / "empty").mkdir()
    assert spark.read.format("span_files").load(str(tmp_path / "empty")).count() == 0


def test_the_stream_takes_each_file_once(spark, folder, tmp_path):
    def run():
        q = spark.readStream.format("span_files").load(str(folder)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return spark.read.parquet(str(tmp_path / "out"))

    batch = spark.read.format("span_files").load(str(folder))
    assert sorted(map(str, run().collect())) == sorted(map(str, batch.collect()))
    put(folder, "later.docx", docx("new"), 100)
    out = run()
    assert out.where("path LIKE '%later.docx'").count() == 1
    assert sorted(map(str, out.collect())) == sorted(map(str, spark.read.format("span_files").load(str(folder)).collect()))
