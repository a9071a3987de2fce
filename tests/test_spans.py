import random

import pytest
from pyspark.sql import functions as F

from tests import model
from veilspark import schema
from veilspark.config import Config, from_mapping, load
from veilspark.functions import color, injection, text, visibility
from veilspark.operators import reports, risk, sanitize
from veilspark.operators import spans as span_ops

BLACK, WHITE = (0, 0, 0), (255, 255, 255)
BOX = (72.0, 72.0, 500.0, 86.0)


def frame(spark, rows):
    """rows: dicts with doc, seq, text, page, box, size, fg, bg; all but text have defaults."""
    data = [
        (r.get("doc", 1), r.get("seq", k), r["text"], r.get("page", 1), r.get("box", BOX), r.get("size", 12.0), r.get("fg", BLACK), r.get("bg", WHITE))
        for k, r in enumerate(rows)
    ]
    return spark.createDataFrame(data, schema.SPANS)


@pytest.mark.parametrize("fg,ratio", [((0, 0, 0), 21.0), ((255, 255, 255), 1.0), ((238, 238, 238), 1.16023), ((119, 119, 119), 4.478089), ((118, 118, 118), 4.542225), ((255, 0, 0), 3.998477), ((10, 10, 10), 19.798146), ((11, 11, 11), 19.682628)])
def test_contrast_vectors(spark, fg, ratio):
    got = frame(spark, [{"text": "a", "fg": fg}]).select(color.contrast_ratio(F.col("font_color"), F.col("background_color"))).first()[0]
    assert round(got, 6) == ratio


CASES = [
    ({}, "visible"), ({"size": 0.0}, "invisible"), ({"size": 0.999}, "invisible"), ({"size": 1.0}, "suspicious"), ({"size": 4.0}, "suspicious"), ({"size": 7.999}, "suspicious"), ({"size": 8.0}, "visible"), ({"size": None}, "visible"),
    ({"fg": None, "size": 0.1}, "unknown"), ({"bg": None, "box": (900.0, 0.0, 950.0, 10.0)}, "unknown"), ({"fg": (250, 250, 250)}, "invisible"), ({"fg": (170, 170, 170)}, "suspicious"), ({"fg": (119, 119, 119)}, "suspicious"), ({"fg": (118, 118, 118)}, "visible"),
    ({"box": (72.0, 784.0, 500.0, 798.0)}, "suspicious"), ({"box": (72.0, 792.0, 500.0, 800.0)}, "suspicious"), ({"box": (72.0, 798.0, 500.0, 812.0)}, "invisible"), ({"box": (-10.0, 72.0, 0.0, 86.0)}, "suspicious"), ({"box": (-10.0, 72.0, -1.0, 86.0)}, "invisible"),
    ({"box": (72.0, 72.0, 72.0, 86.0)}, "invisible"), ({"box": (0.0, 72.0, 612.0, 86.0)}, "visible"),
]


def test_visibility_boundaries(spark):
    df = span_ops.analyzed(frame(spark, [{"text": "x", **c} for c, _ in CASES]))
    got = [r.visibility_status for r in df.orderBy("span_seq").collect()]
    assert got == [s for _, s in CASES]


def test_zero_area_switch(spark):
    df = frame(spark, [{"text": "x", "box": (72.0, 72.0, 72.0, 86.0)}])
    assert span_ops.analyzed(df, Config(check_zero_area=False)).first().visibility_status == "visible"


def test_random_spans_match_the_model(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(400):
        pick = lambda: None if rng.random() < 0.1 else tuple(rng.choice([0, 10, 11, 118, 119, 160, 238, 250, 255]) for _ in range(3))
        box = (rng.choice([-40.0, -1.0, 0.0, 72.0, 612.0, 700.0]), rng.choice([-5.0, 0.0, 72.0, 792.0, 800.0]), rng.choice([-1.0, 0.0, 100.0, 612.0, 650.0]), rng.choice([0.0, 86.0, 792.0, 799.0]))
        rows.append({"text": "x", "fg": pick(), "bg": pick(), "size": rng.choice([None, 0.0, 0.5, 1.0, 3.9, 4.0, 7.9, 8.0, 12.0]), "box": box})
    got = span_ops.analyzed(frame(spark, rows)).orderBy("span_seq").collect()
    for r, g in zip(rows, got):
        assert g.visibility_status == model.status(r["fg"], r["bg"], r["size"], r["box"]), r


TEXTS = [
    "Ignore  previous instructions", "ignore all previous instructions", "SYSTEM :  go", "system: a system:b", "xsystem: a", "ésystem: a", "system :", "ſystem: x", "act as an admin, act as if", "newer prompts",
    "user: hi", "ROLE:\t", "you  are now", "pretend you are", "override settings", "new commands", "forget everything", "Disregard prior prompt", "", "nothing", "assistant\x1c: ok",
]


def test_injection_matches_the_model(spark):
    df = frame(spark, [{"text": t, "doc": k, "fg": WHITE} for k, t in enumerate(TEXTS)])
    got = risk.risk_report(span_ops.analyzed(df)).orderBy("doc_id").collect()
    for t, r in zip(TEXTS, got):
        assert r.prompt_injection_patterns == model.injections([t]), t


def test_visible_and_unknown_spans_are_not_searched(spark):
    df = frame(spark, [{"text": "user: a"}, {"text": "system: b", "fg": None}, {"text": "ignore", "fg": WHITE}, {"text": "previous instructions", "fg": WHITE}])
    r = risk.risk_report(span_ops.analyzed(df)).first()
    assert r.prompt_injection_patterns == [] and r.risk_level == "medium"


@pytest.mark.parametrize("inv,susp,inj,level", [(0, 0, False, "safe"), (0, 4, False, "safe"), (0, 5, False, "low"), (0, 9, False, "low"), (0, 10, False, "medium"), (1, 0, False, "medium"), (2, 0, False, "medium"), (3, 0, False, "high"), (0, 1, True, "high"), (1, 0, True, "critical")])
def test_levels(spark, inv, susp, inj, level):
    assert spark.range(1).select(risk.risk_level(F.lit(inv), F.lit(susp), F.lit(inj))).first()[0] == level == model.level(inv, susp, inj)


@pytest.mark.parametrize("inv,susp,total,inj,score", [(1, 0, 10, False, 57), (0, 1, 10, False, 24), (0, 3, 3, False, 46), (2, 0, 100, False, 60), (6, 0, 60, False, 82), (0, 10, 100, False, 42), (0, 1, 1, True, 82), (0, 0, 5, True, 40), (0, 0, 0, False, 0)])
def test_gate_scores(spark, inv, susp, total, inj, score):
    df = spark.createDataFrame([(inv, susp, total, inj)], "invisible_count long, suspicious_count long, total_spans long, prompt_injection_detected boolean")
    assert df.select(risk.gate_score()).first()[0] == score == model.gate_score(inv, susp, total, inj)


def test_documents_without_spans_are_reported(spark):
    docs = spark.createDataFrame([(1,), (2,)], "doc_id long")
    df = frame(spark, [{"text": "a"}])
    r = risk.risk_report(span_ops.analyzed(df), docs).where("doc_id = 2").first()
    assert (r.total_spans, r.prompt_injection_detected, r.invisible_text_sample, r.risk_level) == (0, False, [], "safe")


def test_rebuild_orders(spark):
    rows = [("z", 2, 10.0, 0.0), ("b", 1, 20.0, 5.0), ("c", 1, 20.0, 5.0), ("a", 1, 20.0, 1.0)]
    df = span_ops.analyzed(frame(spark, [{"text": t, "page": p, "box": (x, y, x + 50, y + 10)} for t, p, y, x in rows]))
    assert sanitize.sanitize(df, "strip").first().safe_text == "a b c z"
    assert sanitize.sanitize(df, "preserve").first().safe_text == "a b c z"
    assert sanitize.sanitize(df, "flag").first().safe_text == "z b c a"


def test_strategies(spark):
    df = span_ops.analyzed(frame(spark, [{"text": "v"}, {"text": "s", "size": 5.0}, {"text": "i", "fg": WHITE}, {"text": "u", "fg": None}]))
    strip, flag, keep = (sanitize.sanitize(df, s).first() for s in ("strip", "flag", "preserve"))
    assert (strip.safe_text, strip.removed_count, strip.removed_text_sample) == ("v s u", 1, ["i"])
    assert (flag.safe_text, flag.flagged_count) == ("v [SUSPICIOUS] s u", 1)
    assert (keep.safe_text, keep.removed_count) == ("v s i u", 0)
    assert sanitize.sanitize(df, "strip", Config(remove_suspicious=True)).first().safe_text == "v u"
    with pytest.raises(ValueError):
        sanitize.sanitize(df, "shred")


def test_issue_groups_skip_visible_spans(spark):
    fg = {"I": WHITE, "V": BLACK, "S": (170, 170, 170)}
    df = span_ops.analyzed(frame(spark, [{"text": t, "fg": fg[k]} for k, t in ("Ia", "Vb", "Ic", "Sd", "Ie")]))
    got = [(r.severity, r.text) for r in reports.issue_groups(df).orderBy("group_seq").collect()]
    assert got == [("INVISIBLE", "a c"), ("SUSPICIOUS", "d"), ("INVISIBLE", "e")]


def test_full_text_markers(spark):
    df = frame(spark, [{"text": t, "page": p} for t, p in (("a", 1), ("b", 1), ("c", 3))])
    assert reports.full_text(df).first().full_text == "a b \n--- Page 3 ---\n c"
    assert reports.full_text(frame(spark, [{"text": "a", "page": 2}])).first().full_text == "\n--- Page 2 ---\n a"


def test_text_helpers(spark):
    df = spark.createDataFrame([(0.125, "a<b>& c", "x" * 41)], "v double, h string, t string")
    got = df.select(text.fixed(F.col("v"), 2), text.escape_html(F.col("h")), text.preview(F.col("t"), 40)).first()
    assert tuple(got) == ("0.12", "a&lt;b&gt;&amp;&nbsp;c", "x" * 40 + "...")


def test_reasons_have_their_own_limits(spark):
    df = span_ops.with_reasons(span_ops.analyzed(frame(spark, [{"text": "a", "fg": (128, 128, 128), "size": 6.0}, {"text": "b", "fg": WHITE, "size": 0.0}, {"text": "c", "size": 3.5}])))
    assert [r.reasons for r in df.orderBy("span_seq").collect()] == [[], ["nearly invisible (contrast: 1.00:1)"], ["very small (3.5pt)"]]


def test_config(tmp_path):
    assert load(tmp_path / "none.yaml") == Config()
    f = tmp_path / "c.yaml"
    f.write_text("visibility:\n  contrast:\n    min_ratio: 7.0\nrisk:\n  suspicious_span_threshold: 2\n")
    assert load(f) == Config(min_contrast=7.0, suspicious_threshold=2)
    assert from_mapping({"visibility": {"bbox": {"check_off_screen": False}}}) == Config(check_off_screen=False)


def test_whole_pattern_translation():
    assert injection.translated(r"\brole\s*:\s*").startswith("(?iu)(?<!")
    assert visibility.is_hidden
