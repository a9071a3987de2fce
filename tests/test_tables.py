"""Paging of paragraph tables and phrases by a table of patterns, against plain loops."""

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_spans import TEXTS, WHITE, frame
from veilspark.functions import injection
from veilspark.operators import paging, patterns, risk
from veilspark.operators import spans as span_ops

# ---- paging


def plain_pages(kinds, page=1, line=0):
    out = []
    for kind in kinds:
        out.append((page, line))
        line += 1
        if kind == paging.BREAK or kind == paging.BODY and line >= paging.LINES:
            page, line = page + 1, 0
    return out, page, line


def random_kinds(rng, n):
    weights = rng.choice([(0, 1, 0), (1, 1, 0.02), (0.02, 1, 0.2), (1, 0, 0), (1, 0.05, 0), (0, 0, 1)])
    return rng.choices([paging.OUTSIDE, paging.BODY, paging.BREAK], weights, k=n)


def test_transitions_and_places():
    rng = random.Random(1)
    for n in [0, 1, 2, 39, 40, 41, 200] * 8:
        kinds = random_kinds(rng, n)
        pages, lines = paging.transition(np.array(kinds, int))
        for line in [0, 1, 20, 38, 39, 40, 95]:
            want, page, last = plain_pages(kinds, 1, line)
            at = min(line, paging.LINES - 1)
            assert (1 + pages[at], lines[at] if pages[at] else line + n) == (page, last)
            assert list(zip(*(x.tolist() for x in paging.places(np.array(kinds, int), 1, line)))) == want


@pytest.mark.parametrize("bits", [3, 12])
def test_paragraphs_over_many_parts(spark, monkeypatch, bits):
    monkeypatch.setattr(paging, "PART_BITS", bits)
    rng = random.Random(2)
    docs = {k: random_kinds(rng, n) for k, n in enumerate([0, 1, 7, 300, 1000, 45])}
    # gaps between numbers don't count as paragraphs
    rows = [(doc, 3 * k, kind != paging.OUTSIDE, True if kind == paging.BREAK else rng.choice([None, False]) if kind == paging.BODY else rng.choice([None, True])) for doc, kinds in docs.items() for k, kind in enumerate(kinds)]
    rng.shuffle(rows)
    got = paging.paged(spark.createDataFrame(rows, "doc_id long, para_seq long, in_body boolean, breaks boolean")).collect()
    by = {}
    for r in sorted(got):
        by.setdefault(r.doc_id, []).append((r.page_number, r.line))
    assert by == {doc: plain_pages(kinds)[0] for doc, kinds in docs.items() if kinds}


def test_no_paragraphs(spark):
    assert paging.paged(spark.createDataFrame([], "doc_id long, para_seq long, in_body boolean, breaks boolean")).count() == 0


# ---- patterns


def test_translation_as_a_column(spark):
    df = patterns.builtin(spark)
    got = df.select("pattern", injection.translated_column(F.col("pattern")).alias("t"), patterns.opening(F.col("pattern")).alias("o")).collect()
    assert all(r.t == injection.translated(r.pattern) for r in got)
    assert [r.o for r in got] == [re.match(r"\\b(\w+)", p)[1] for p in injection.PATTERNS]


@pytest.mark.parametrize("pattern,word", [(r"\bnew\w*", ""), (r"new\s+x", ""), (r"\bnew", ""), (r"\bnew\b", "new"), (r"\bNew\s+x", "new"), (r"\ba\s+x|b", ""), (r"\ba\s+(x|b)", "a"), (r"\brole\s*:", "role"), (r"\brole:*", ""), (r"\bnew.", ""), (r"\b(a|b)\s+c", "")])
def test_openings(spark, pattern, word):
    assert spark.createDataFrame([(pattern,)], "p string").select(patterns.opening(F.col("p"))).first()[0] == word


def test_the_own_patterns_as_a_table(spark):
    texts = [*TEXTS, "İgnore all prompts", "\u212aelvin user : b", "a,system:b", "x_user: c", "ıgnore all commands"]
    df = span_ops.analyzed(frame(spark, [{"text": t, "doc": k, "fg": WHITE} for k, t in enumerate(texts)]))
    got = {r.doc_id: r.matches for r in patterns.by_span(patterns.matched(df, patterns.builtin(spark))).collect()}
    want = {r.doc_id: r.matches for r in span_ops.with_matches(df).collect()}
    assert got == want and len(want) > 10
    own, table = (sorted(x.collect()) for x in (risk.risk_report(df), risk.risk_report(df, pattern_table=patterns.builtin(spark))))
    assert own == table


def test_patterns_without_an_opening_word_and_a_large_table(spark, monkeypatch):
    df = frame(spark, [{"text": "Alpha beta, gamma"}, {"text": "beta"}, {"text": ""}])
    table = spark.createDataFrame([(1, r"\bbeta\b"), (2, r"b.ta"), (3, r"gam|zzz"), (4, r"\balpha\s+beta\b"), (5, r"\balpha\s+gamma\b")], "pattern_id long, pattern string")
    want = [(0, 1, "beta"), (0, 2, "beta"), (0, 3, "gam"), (0, 4, "alpha beta"), (1, 1, "beta"), (1, 2, "beta")]
    for few in (patterns.FEW, 2):
        monkeypatch.setattr(patterns, "FEW", few)
        assert sorted((r.span_seq, r.pattern_id, r.phrase) for r in patterns.matched(df, table).collect()) == want


def test_many_patterns_cost_little_more(spark):
    spans = spark.range(20_000).selectExpr("id AS doc_id", "0L AS span_seq", "concat_ws(' ', transform(sequence(1, 12), k -> concat('w', (id * 31 + k * 977) % 50000))) AS text").cache()
    few = patterns.builtin(spark)
    many = few.union(spark.range(100, 10_100).selectExpr("id", r"concat('\\bz', id, '\\s+w', id, '\\b')")).cache()
    spans.count(), many.count()

    def took(table):
        began = time.perf_counter()
        assert patterns.matched(spans, table).count() == 0
        return time.perf_counter() - began

    took(few)
    assert min(took(many) for _ in range(3)) < 3 * max(min(took(few) for _ in range(3)), 0.3)
