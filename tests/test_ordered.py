"""Ordered text, runs and first rows in parts, against plain lists, with documents and pages of many parts."""

import contextlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from tests.test_spans import BLACK, WHITE, frame
from veilspark.operators import ordered, reports, risk, sanitize
from veilspark.operators import spans as span_ops
from veilspark.plans import registry

GREY = (170, 170, 170)


@pytest.fixture(params=[(2, 10.0), (12, 99.0)])
def parts(request, monkeypatch):
    monkeypatch.setattr(ordered, "PART_BITS", request.param[0])
    monkeypatch.setattr(ordered, "BAND", request.param[1])


def made(n, rng, docs=3, pages=3):
    rows = []
    for k in range(n):
        y, x = rng.choice([0.0, 3.0, 40.0, 41.0, 300.0]), rng.choice([0.0, 72.0])
        rows.append({"doc": rng.randrange(docs), "seq": k, "text": rng.choice(["", "a", "b c", "user: x", "long " * 30]) + str(k), "page": rng.randint(1, pages), "fg": rng.choice([BLACK, WHITE, GREY, None]), "size": rng.choice([12.0, 3.0]), "box": (x, y, x + 50, y + 10)})
    return rows


def by_doc(rows):
    out = {}
    for r in rows:
        out.setdefault(r["doc"], []).append(r)
    return out


def status(r):
    if r["fg"] is None:
        return "unknown"
    return "invisible" if r["fg"] == WHITE else "suspicious" if r["fg"] == GREY or r["size"] < 8 else "visible"


def plain_full_text(rows):
    out, page = [], 1
    for r in rows:
        if r["page"] != page:
            out.append(f"\n--- Page {r['page']} ---\n")
        page = r["page"]
        out.append(r["text"])
    return " ".join(out)


def plain_runs(rows):
    out = []
    for page in sorted({r["page"] for r in rows}):
        hidden = [r for r in rows if r["page"] == page and status(r) in ("suspicious", "invisible")]
        for seq, (kind, run) in enumerate(itertools.groupby(hidden, key=status), 1):
            out.append((page, seq, kind.upper(), " ".join(r["text"] for r in run)))
    return out


def test_texts_in_order(spark, parts):
    rows = made(400, random.Random(3))
    df = span_ops.analyzed(frame(spark, rows)).cache()
    place = lambda r: (r["page"], r["box"][1], r["box"][0], r["seq"])
    texts = {r.doc_id: r.full_text for r in reports.full_text(df).collect()}
    strip, flag = ({r.doc_id: r for r in sanitize.sanitize(df, s).collect()} for s in ("strip", "flag"))
    whole = {r.doc_id: r.text for r in sanitize.reconstructed(df).collect()}
    for doc, own in by_doc(rows).items():
        assert texts[doc] == plain_full_text(own)
        assert whole[doc] == " ".join(r["text"] for r in sorted(own, key=place))
        kept = [r for r in own if status(r) != "invisible"]
        assert strip[doc].safe_text == " ".join(r["text"] for r in sorted(kept, key=place))
        assert strip[doc].removed_text_sample == [r["text"] for r in own if status(r) == "invisible"][:10]
        assert flag[doc].safe_text == " ".join("[SUSPICIOUS] " * (status(r) == "suspicious") + r["text"] for r in kept)
        assert (strip[doc].original_span_count, strip[doc].sanitized_span_count, flag[doc].flagged_count) == (len(own), len(kept), sum(status(r) == "suspicious" for r in own))


def test_each_document_gets_its_own_strategy(spark, parts):
    rows = made(200, random.Random(4), docs=4)
    df = span_ops.analyzed(frame(spark, rows)).cache()
    report = spark.createDataFrame([(0, "critical"), (1, "medium"), (2, "low"), (3, "high")], "doc_id long, risk_level string")
    got = {r.doc_id: r for r in sanitize.sanitize_by_level(df, report).collect()}
    for doc, strategy in enumerate(["strip", "flag", "strip", "strip"]):
        assert got[doc] == sanitize.sanitize(df.where(F.col("doc_id") == doc), strategy).first()


def test_runs_go_on_across_parts(spark, parts):
    rows = made(500, random.Random(5))
    # a page where all spans are one run, and one where each span is a run of its own
    rows += [{"doc": 7, "seq": k, "text": f"t{k}", "fg": WHITE} for k in range(100)] + [{"doc": 8, "seq": k, "text": f"t{k}", "fg": (WHITE, GREY)[k % 2]} for k in range(100)]
    rows = [{"page": 1, "size": 12.0} | r for r in rows]
    df = span_ops.analyzed(frame(spark, rows)).cache()
    got, shown = {}, {}
    for r in reports.issue_groups(df).collect():
        got.setdefault(r.doc_id, []).append((r.page_number, r.group_seq, r.severity, r.text))
    for r in reports.issues(df).collect():
        shown.setdefault(r.doc_id, []).append((r.page, r.group_seq, r.severity, r.text))
    web = {r.doc_id: r for r in reports.web_report(df.drop("contrast_ratio", "visibility_status")).collect()}
    for doc, own in by_doc(rows).items():
        want = plain_runs(own)
        cut = [(*w[:3], w[3][:100] + "..." if len(w[3]) > 100 else w[3]) for w in want]
        assert sorted(got.get(doc, [])) == want
        assert sorted(shown.get(doc, [])) == cut
        assert [(x.page, x.severity, x.text) for x in web[doc].issues] == [(p, k, t) for p, _, k, t in cut]
        assert web[doc].full_text == plain_full_text(own)
        assert web[doc].total_spans == len(own)


def test_samples_and_first_rows(spark, parts):
    rows = made(600, random.Random(6), docs=2, pages=30)
    df = span_ops.analyzed(frame(spark, rows)).cache()
    bare = df.drop("contrast_ratio", "visibility_status")
    report, detail, gate = ({r.doc_id: r for r in x.collect()} for x in (risk.risk_report(df), reports.detail_report(bare), reports.gate_report(bare)))
    spans = {}
    for r in reports.top_problem_spans(df).collect():
        spans.setdefault(r.doc_id, []).append((r.rn, r.shown, r.more_spans))
    for doc, own in by_doc(rows).items():
        hidden = [r for r in own if status(r) in ("suspicious", "invisible")]
        gone = [r["text"] for r in own if status(r) == "invisible"]
        assert report[doc].invisible_text_sample == gone[:5]
        assert report[doc].prompt_injection_patterns == (["user: "] if any("user" in r["text"] for r in hidden) else [])
        assert [(x.text, x.status) for x in detail[doc].problem_spans] == [(r["text"][:50], status(r).upper()) for r in hidden[:10]]
        assert detail[doc].more_spans == len(hidden) - 10
        assert sorted(spans[doc]) == [(k, r["text"][:50], len(hidden) - 10) for k, r in enumerate(hidden[:10], 1)]
        pages = sorted({r["page"] for r in hidden})
        assert [p.page_number for p in gate[doc].pages] == pages[:10] and gate[doc].more_pages == len(pages) - 10
        assert [p.n_hidden for p in gate[doc].pages] == [sum(r["page"] == p for r in hidden) for p in pages[:10]]


def explained(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_first_rows_are_limited_before_the_shuffle(spark):
    for name in ("top_pages", "problem_spans_top10"):
        assert "WindowGroupLimit" in explained(registry.QUERIES[name](spark, "/root/testdata/sf0.001")), name


@contextlib.contextmanager
def without_fallback(spark):
    """Code that can't be compiled is an error."""
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        yield
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")


@pytest.mark.parametrize("name", ["hidden_by_page", "issues", "issue_groups", "hidden_reasons", "top_pages", "risk_report", "web_report", "gate_report", "sanitize_strip"])
def test_plans_compile(spark, name):
    with without_fallback(spark):
        registry.QUERIES[name](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()


def test_a_document_of_many_spans(spark):
    n = 200_000
    spans = spark.range(n).selectExpr("1L AS doc_id", "id AS span_seq", "concat('word ', id) AS text", "1 AS page_number", "named_struct('x0', 0D, 'y0', double(id % 790), 'x1', 9D, 'y1', 800D) AS bbox", "12D AS font_size", "named_struct('r', 0, 'g', 0, 'b', 0) AS font_color", "named_struct('r', 255, 'g', 255, 'b', 255) AS background_color")
    text = reports.full_text(spans).first().full_text
    assert text == " ".join(f"word {k}" for k in range(n))
    assert len(sanitize.reconstructed(spans).first().text) == len(text)


def test_nothing(spark):
    df = span_ops.analyzed(frame(spark, [{"text": "x"}]).where("false"))
    for f in (reports.issues, reports.full_text, reports.top_problem_spans, risk.risk_report, sanitize.reconstructed):
        assert f(df).count() == 0
