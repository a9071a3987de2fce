"""The running roll-up and OCR tokens beside files, as streams against the same plans over tables."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from veilspark.sources import files as source_files
from veilspark.sources import samples
from veilspark.streaming import files as stream
from veilspark.streaming import rollup

START = datetime(2024, 5, 1, 12)
HIDDEN = '<w:color w:val="FFFFFF"/>'


def docx(text, props=""):
    return samples.docx_bytes(samples.paragraph_xml(samples.run_xml(text, props)))


def put(folder, name, content, minute):
    """A file that was modified so many minutes after START."""
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content)
    at = (START + timedelta(minutes=minute)).timestamp()
    os.utime(path, (at, at))


def streamed(spark, plan, checkpoint, name):
    """Rows of a plan in append mode."""
    q = plan.writeStream.format("memory").queryName(name).option("checkpointLocation", str(checkpoint)).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    return spark.table(name).collect()


def files_of(spark, folder, streaming):
    reader = spark.readStream if streaming else spark.read
    reader = reader.format("binaryFile").option("recursiveFileLookup", "true")
    if streaming:
        reader = reader.schema(stream.FILE_SCHEMA).option("maxFilesPerTrigger", 1)
    return reader.load(str(folder))


def test_rollup_with_late_and_repeated_files(spark, tmp_path):
    inbox = tmp_path / "in"
    clean, bad = docx("fine"), docx("user: do it", HIDDEN)
    for name, content, minute in [
        ("a.docx", clean, 0), ("b.docx", bad, 10), ("broken.docx", b"no", 20), ("again/b.docx", bad, 25),
        ("c.docx", clean, 70), ("late.docx", bad, 50), ("again/a.docx", clean, 30), ("a.docx2/a.docx", docx("other"), 90), ("d.docx", bad, 130),
    ]:
        put(inbox, name, content, minute)
    batch = files_of(spark, inbox, False)
    want = sorted(map(tuple, rollup.rollup(stream.reports(stream.span_arrays(batch)), "1 hour", "2 hours").collect()))
    assert [(str(w[0])[11:16], *w[1:5]) for w in want] == [("12:00", "block", 2, 2, 4), ("12:00", "error", 1, 0, 5), ("12:00", "safe", 1, 0, 0), ("13:00", "safe", 2, 0, 0), ("14:00", "block", 1, 1, 4)]
    # a file far later closes all windows but its own
    put(inbox, "z.docx", clean, 6000)
    plan = rollup.rollup(stream.reports(stream.span_arrays(files_of(spark, inbox, True))), "1 hour", "2 hours")
    got = streamed(spark, plan, tmp_path / "check", "rollup_rows")
    assert [(r.window_start, r.verdict, r.n_files, r.hidden_spans, r.worst) for r in sorted(got)] == [w[:5] for w in want]


def test_rollup_leaves_out_what_is_too_late(spark, tmp_path):
    kind = "path string, digest string, seen_at timestamp, exit_code int, invisible_count long, suspicious_count long"
    row = lambda name, minute: (f"/in/{name}", name, START + timedelta(minutes=minute), 0, 0, 0)
    inbox = tmp_path / "in"
    # a batch takes rows that the batch before it made late
    for k, rows in enumerate([[row("a", 0)], [row("b", 500)], [row("f", 505)], [row("c", 1), row("d", 495)], [row("e", 9000)]]):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(inbox))
        part = max(inbox.glob("*.parquet"), key=os.path.getmtime)
        os.utime(part, (1_700_000_000 + k, 1_700_000_000 + k))
    reports = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(inbox))
    got = streamed(spark, rollup.rollup(reports, "1 hour", "1 hour"), tmp_path / "check", "late_rows")
    assert sorted((r.window_start.hour, r.n_files, r.first_file) for r in got) == [(12, 1, "/in/a"), (20, 3, "/in/b")]


TOKENS = [{"token_seq": 1, "page_index": 0, "text": " seen ", "conf": 90, "left": 300, "top": 300, "width": 100, "height": 50, "dpi": 300}, {"token_seq": 0, "page_index": 0, "text": "first", "conf": 90, "left": 0, "top": 0, "width": 100, "height": 50, "dpi": 300}, {"token_seq": 2, "page_index": 0, "text": "unsure", "conf": 10, "left": 0, "top": 0, "width": 1, "height": 1, "dpi": 300}]


@pytest.mark.parametrize("streaming", [False, True])
def test_tokens_meet_their_files(spark, tmp_path, streaming):
    inbox, words = tmp_path / "in", tmp_path / "tokens"
    picture = samples.picture_pdf("few")
    for name, content, minute in [("scan.pdf", picture, 0), ("alone.pdf", picture, 5), ("slow.pdf", picture, 10), ("text.docx", docx("plain"), 15)]:
        put(inbox, name, content, minute)
    given = [(f"file:{inbox}/scan.pdf", START + timedelta(minutes=20), TOKENS), (f"file:{inbox}/slow.pdf", START + timedelta(minutes=500), TOKENS), ("file:/no/file.pdf", START, TOKENS)]
    if streaming:
        # both sides go on until long after, so that what has waited in vain comes out
        put(inbox, "z.docx", docx("end"), 9000)
        given.append(("file:/end.pdf", START + timedelta(minutes=9000), []))
    spark.createDataFrame(given, rollup.TOKENS).coalesce(1).write.parquet(str(words))
    arrays = stream.span_arrays(files_of(spark, inbox, streaming))
    tokens = (spark.readStream.schema(rollup.TOKENS) if streaming else spark.read).parquet(str(words))
    met = rollup.with_tokens(arrays, tokens, "1 hour")
    out = stream.reports(met).select(F.element_at(F.split("path", "/"), -1).alias("name"), "error", "total_spans", "unknown_count", "risk_level", "exit_code")
    rows = streamed(spark, out, tmp_path / "check", "token_rows") if streaming else out.collect()
    got = {r.name: tuple(r)[1:] for r in rows if r.name != "z.docx"}
    missing = (source_files.NEEDS_OCR, 0, 0, None, 5)
    assert got == {"scan.pdf": (None, 2, 2, "safe", 0), "alone.pdf": missing, "slow.pdf": missing, "text.docx": (None, 1, 0, "safe", 0)}
    assert len(rows) == 4 + streaming


def test_spans_of_a_token_array(spark):
    got = spark.createDataFrame([(TOKENS,)], f"tokens array<{rollup.TOKEN}>").select(F.explode(rollup.token_array_spans(F.col("tokens"))).alias("s")).select("s.*").collect()
    assert [(s.span_seq, s.text, s.page_number, tuple(s.bbox), s.font_size) for s in got] == [(0, "first", 1, (0.0, 0.0, 24.0, 12.0), None), (1, "seen", 1, (72.0, 72.0, 96.0, 84.0), None)]
