"""A row-at-a-time model of the span rules, written from the specification and independent of the engine's plans."""

from __future__ import annotations

import re

from veilspark.functions.injection import PATTERNS

def luminance(rgb):
    lin = [c / 12.92 if c <= 0.03928 else ((c + 0.055) / 1.055) ** 2.4 for c in (v / 255.0 for v in rgb)]
    return 0.2126 * lin[0] + 0.7152 * lin[1] + 0.0722 * lin[2]


def contrast(fg, bg):
    if fg is None or bg is None:
        return None
    a, b = sorted((luminance(fg), luminance(bg)))
    return (b + 0.05) / (a + 0.05)


def status(fg, bg, size, box, w=612, h=792):
    if fg is None or bg is None:
        return "unknown"
    c = contrast(fg, bg)
    x0, y0, x1, y1 = box
    found = set()
    found.add("invisible" if c < 1.5 else "suspicious" if c < 4.5 else "visible")
    found.add("visible" if size is None else "invisible" if size < 1 else "suspicious" if size < 8 else "visible")
    if x1 - x0 <= 0 or y1 - y0 <= 0 or x1 < 0 or y1 < 0 or x0 > w or y0 > h:
        found.add("invisible")
    elif x0 < 0 or y0 < 0 or x1 > w or y1 > h:
        found.add("suspicious")
    return next(s for s in ("invisible", "suspicious", "visible") if s in found)


def injections(texts):
    out = set()
    for t in texts:
        for p in PATTERNS:
            if m := re.search(p, t.lower(), re.IGNORECASE):
                out.add(m.group(0))
    return sorted(out)


def level(inv, susp, inj):
    if inj and inv:
        return "critical"
    if inv >= 3 or inj:
        return "high"
    if inv >= 1 or susp >= 10:
        return "medium"
    return "low" if susp >= 5 else "safe"


def gate_score(inv, susp, total, inj):
    s = (50 + min(5 * inv, 30) if inv else 0) + (20 + min(2 * susp, 20) if susp else 0) + (40 if inj else 0)
    return min(100, s + (int((inv + susp) / total * 20) if total else 0))
