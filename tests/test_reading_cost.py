"""What reading files costs: calls by string and not by character, files read once, and the same words as one by one."""

import io
import random
import re
import sys
import zipfile

import pytest
from pyspark.sql import functions as F

from veilspark.plans import registry
from veilspark.sources import extraction, files, pdf, pdf_objects
from veilspark.sources import samples as X

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("packed", [False, True])
def test_calls_grow_with_words(packed):
    data = X.pdf_of("\n".join(" ".join(["ä" * 40] * 20) for _ in range(80)), packed)
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event == "call"

    sys.setprofile(count)
    try:
        spans = pdf.read_pdf(data)
    finally:
        sys.setprofile(None)
    assert len(spans) == 1600 and calls < sum(len(s[1]) for s in spans) / 2


def test_strings_at_once_as_character_by_character(monkeypatch):
    rng = random.Random(3)
    fonts = [b"<< /Type /Font /Subtype /Type1 /Encoding << /Differences [97 /fi /space /b] >> >>", b"<< /Type /Font /Subtype /Type1 /FirstChar 97 /Widths [500 0 -300 1000] >>"]
    steps = ["(ab cd) Tj", "(a\\(b) Tj", "[(ab) -900 (c ) 50 (d)] TJ", "3 0 Td", "0 -12 Td", "1 Tc", "0 Tc", "2 Tw", "0 Tw", "50 Tz", "100 Tz", "/F1 0.5 Tf", "/F1 12 Tf", "0.7 0.7 -0.7 0.7 90 90 Tm", "1 0 0 1 80 80 Tm", "-1 0 0 1 80 80 Tm", "1 g", "0 g", "3 Tr", "0 Tr", "0 0 200 200 re f"]
    made = []
    for k in range(300):
        page = "BT /F1 12 Tf 72 700 Td " + " ".join(rng.choices(steps, k=30)) + " ET"
        made.append(X.pdf_bytes([page], resources=b"/Font << /F1 3 0 R >>", more=[fonts[k % 2]]))
    at_once = [pdf.read_file(x) for x in made]
    monkeypatch.setattr(pdf.Page, "show_line", lambda self, raw: False)
    assert [pdf.read_file(x) for x in made] == at_once


def test_span_columns_as_rows():
    some = (0, "a", 1, (0.0, 1.0, 2.0, 3.0), None, None, (1, 2, 3)), (1, "b", 2, (0.0, 1.0, 2.0, 4.0), 1.0, (1, 2, 3), None)
    for spans in ([], [None], [None, some[0], None, some[1]], list(some)):
        assert extraction.span_array(spans).to_pylist() == [s and extraction.as_struct(s) for s in spans]


@pytest.mark.parametrize("name", ["read_or_error", "ocr_route"])
def test_files_are_read_once(spark, name):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2  # one makes the files, one reads them


def test_outcomes_as_spans_and_errors(spark):
    rows = [(1, X.pdf_of("two words")), (2, X.picture_pdf()), (3, X.picture_pdf("few")), (4, X.picture_pdf()), (5, b"junk"), (6, X.docx_of("a\n\nb")), (7, X.pdf_of(""))]
    given = spark.createDataFrame(rows, "doc_id long, content binary").withColumn("path", F.lit("a.pdf")).withColumn("error", F.when(F.col("doc_id") == 6, "refused"))
    tokens = spark.createDataFrame([(2, 0, 0, "x", 90, 1, 1, 5, 5, 72), (2, 0, 1, "y", 90, 1, 1, 5, 5, 72), (3, 0, 0, "z", 10, 1, 1, 5, 5, 72), (1, 0, 0, "n", 90, 1, 1, 5, 5, 72)], "doc_id long, page_index int, token_seq long, text string, conf int, left int, top int, width int, height int, dpi int")
    for t in (None, tokens):
        spans, errors = files.spans_of_files(given, tokens=t)
        n, why = {r.doc_id: r["count"] for r in spans.groupBy("doc_id").count().collect()}, {r.doc_id: r.error for r in errors.collect()}
        assert {r.doc_id: (r.n_spans, r.error) for r in files.outcomes(given, tokens=t).collect()} == {k: (n.get(k, 0), why.get(k)) for k in range(1, 8)}


def test_archive_that_happens_to_say_pdf():
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w") as out, zipfile.ZipFile(io.BytesIO(X.docx_of("one\ntwo"))) as given:
        out.writestr("first", b"\x00%PDF\x00")
        for name in given.namelist():
            out.writestr(name, given.read(name))
    assert [s[1] for s in files.read_any(made.getvalue())[0]] == ["one", "two"]
    assert [s[1] for s in files.read_any(b"PK\x03\x04" + X.pdf_of("both kinds"))[0]] == ["both", "kinds"]


def test_want_of_memory_is_no_error_of_a_file():
    def read(content):
        raise MemoryError

    with pytest.raises(MemoryError):
        extraction.attempt(read, b"")


@pytest.mark.parametrize("packed", [False, True])
def test_calls_grow_with_strings(packed):
    data = X.pdf_of("\n".join(" ".join(["ab"] * 200) for _ in range(80)), packed)
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event == "call"

    sys.setprofile(count)
    try:
        spans = pdf.read_columns(data)[0]
    finally:
        sys.setprofile(None)
    assert len(spans.text) == 16000 and calls < len(spans.text) / 4


def test_columns_as_rows():
    hidden = X.pdf_bytes([X.pdf_page(["one two", "", "three"], before="0.5 g", after="1 0 0 rg 60 700 40 40 re f"), X.pdf_page(["fo\xa0ur"])])
    pattern = X.pdf_bytes(["BT /Pattern cs /P1 scn 72 700 Td (no colour) Tj ET"])
    made = [hidden, X.pdf_of("a b\nc " * 30, True), X.pdf_bytes([""]), pattern, X.pdf_of("日 \U0001f600")]
    want = [extraction.as_struct(s) for x in made for s in pdf.read_pdf(x)]
    assert len(want) > 70 and {s["page_number"] for s in want} == {1, 2} and any(s["font_color"] is None for s in want)
    assert extraction.column_array([pdf.read_columns(x)[0] for x in made]).to_pylist() == want


def test_files_of_all_kinds_in_a_batch(spark):
    made = [X.pdf_of("a b\n\nc"), b"junk", X.docx_of("d e\n\nf"), X.pdf_of(""), X.pdf_of("g " * 9000), X.docx_of(""), X.pdf_of("h")]
    given = spark.createDataFrame(list(enumerate(made)), "doc_id long, content binary").coalesce(1)
    got = extraction.extract(given, files.read_columns).select("doc_id", "span_seq", "text", "page_number", "bbox", "native_chars", "error").collect()
    want = []
    for k, x in enumerate(made):
        spans, info, error = extraction.attempt(files.read_any, x)
        want += [(k, s[0], s[1], s[2], s[3], info.native_chars, error) for s in spans] or [(k, None, None, None, None, info.native_chars, error)]
    assert [(r.doc_id, r.span_seq, r.text, r.page_number, r.bbox and tuple(r.bbox), r.native_chars, r.error) for r in got] == want


def test_tokens_at_once_as_one_by_one(monkeypatch):
    rng = random.Random(5)
    tokens = [b"1", b"-2.5", b"--3", b"+.5", b"4.", b"1-2", b".", b"-", b"1e5", b"12 0 R", b"12 0 Rx", b"Tj", b"'", b'"', b"T*", b"true", b"null", b"obj<", b"<6162>", b"<616>", b"<61 62>", b"<>", b"<zz>", b"(a b)", b"(a\\(b)", b"(a(b))", b"()", b"/Na#41me", b"/", b"/A/B", b"<< /K 1 /L null >>", b"[1 (x) /N]", b">>", b"]", b"% 7 Tj\n", b"% (x\r", b"{", b"!x"]
    made = [b"".join(rng.choice([b" ", b"\n", b"\0", b"%c\n "]) + rng.choice(tokens) for _ in range(40)) for _ in range(400)]

    def read(data, refs):
        reader, out = pdf_objects.Reader(data), []
        while len(out) < 300 and (not out or reader.at < len(data)):
            x = reader.read(refs)
            out.append((type(x), x, reader.at))
        return out

    at_once = [read(x, refs) for x in made for refs in (False, True)]
    monkeypatch.setattr(pdf_objects, "_PLAIN", re.compile(rb"(?!)"))
    assert [read(x, refs) for x in made for refs in (False, True)] == at_once


def test_digits_of_sample_pages():
    codes, _, _ = X.unicode_font("ab 日\U0001f600")
    digits = {ord(c): f"{k:04x}" for c, k in codes.items()}
    lines = ["a b", "", "\U0001f600日b", " "]
    assert X.pdf_page(lines, codes) == "BT /F1 12 Tf 0 g 72 720 Td " + " 0 -14 Td ".join(f"<{x.translate(digits)}> Tj" for x in lines) + " ET "


def test_tables_of_characters_at_once_as_one_by_one(monkeypatch):
    rows = [b"<01> <0061>", b"<02> <00660069>", b"<03> <d83dde00>", b"<04> <d83d>", b"<05> <de00>", b"<06> <fffd>", b"<07> <>", b"<0008><0062>", b"<02> <0063>"]
    made = [b"1 beginbfchar " + b"\n".join(x) + b" endbfchar" for x in (rows, rows[:1], rows[3:5], rows[::8], [], rows[:1] + [b"<9> <61>"], [b"<01> <0061> <02>"])]
    at_once = [pdf.unicode_table(x) for x in made]
    assert at_once[0][0][b"\x02"] == "c" and at_once[0][0][b"\x03"] == "\U0001f600"
    monkeypatch.setattr(pdf, "_PAIRS", re.compile(rb"(?!)"))
    assert [pdf.unicode_table(x) for x in made] == at_once
