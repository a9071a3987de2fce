"""License scans by an exact set-similarity join (operator 4).

Templates (license phrases and notices) are joined with text blocks: windows of 2 H words that start every H words, H being the
longest template's length, so every passage as long as a template lies in a block. A block contains a template when
it holds at least the template's threshold of its distinct words, and all of those that tell its license from others.

All tokens are ordered by how often they occur in the corpus, rarest first. A block that reaches a threshold
t of a template with k tokens must hold one of its k - ceil(t k) + 1 rarest: only blocks with such a prefix token become candidates.
The length filter drops candidates with fewer template words than needed; the positional filter drops those in
which the tokens from the first shared one on, in either order, are too few. What is left is counted exactly.
Phrases have threshold 1, and the places where their words stand one after another are then read off the block.

The templates and the counts of their words (a bounded vocabulary) go to every task; texts are read in place and
nothing of them is shuffled.

Defined cases: a null or empty text has no words, no places (first_word and last_word null), empty label strings and score 0;
rows that share a doc_id, or are equal in all columns, are scanned one by one; tokens that occur equally often are ordered by their bytes; of
several containments the largest is the score; a very long text is held with its list of words, about eleven times its bytes; a null
doc_id stays null; extra columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import trimmed

THRESHOLD = 0.8

# Phrases whose places count as base, and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
# Opening sentences of license notices, their labels, and words without which a text is another license's.
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit", ""),
    ("licensed under the apache license version 2 0", "apache", "apache"),
    ("you may not use this file except in compliance with the license", "apache", "compliance"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl", "program gnu"),
    ("this work is licensed under the gnu general public license version 3", "gpl", "gnu"),
    ("gnu lesser general public license as published by the free software foundation", "lgpl", "lesser"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd", "redistribution"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by", "creative commons attribution"),
    ("licensed under cc by nc 4 0", "cc-by-nc", "cc nc"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl", "mozilla"),
)
#: Rows that a table of notices may have: they go to every task.
MOST_NOTICES = 10_000


def notices_of(table: DataFrame) -> tuple[tuple[str, str, str], ...]:
    """Notices of a table (text, label, required): templates with their labels and the words, parted by spaces, that a block must hold."""
    clean = lambda x: b" ".join(words_of((x or "").encode())).decode()
    rows = table.select("text", "label", "required").limit(MOST_NOTICES + 1).collect()
    if len(rows) > MOST_NOTICES:
        raise ValueError(f"more than {MOST_NOTICES} notices")
    found = [(clean(r.text), r.label, clean(r.required)) for r in rows]
    for text, label, required in found:
        if not text or not label or not set(required.split()) <= set(text.split()):
            raise ValueError(f"a notice needs words, a label, and required words that it holds: {text!r}, {label!r}, {required!r}")
    return tuple(sorted(found))


_TABLE = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words: every byte of a code point from U+0080 on belongs to a word."""
    return text.translate(_TABLE).split()


class Template(NamedTuple):
    words: tuple[int, ...]
    """Token numbers in the template's own order."""
    ordered: tuple[int, ...]
    """Distinct token numbers, rarest first; a token's number is its place in that order."""
    need: int
    """Tokens that a block must hold."""
    label: str
    is_phrase: bool
    required: frozenset[int]
    """Tokens without which no block holds the template."""


class Index:
    """Templates over the frequency order of their tokens."""

    def __init__(self, phrases: tuple, notices: tuple, threshold: float, counts: dict[bytes, int]) -> None:
        texts = [(t.encode().split(), label, 1.0, True, []) for t, label in phrases] + [(t.encode().split(), label, threshold, False, r.encode().split()) for t, label, r in notices]
        tokens = sorted({w for t, *_ in texts for w in t}, key=lambda w: (counts.get(w, 0), w))
        self.number = {w: k for k, w in enumerate(tokens)}
        self.templates = []
        for t, label, share, is_phrase, required in texts:
            ids = tuple(self.number[w] for w in t)
            self.templates.append(Template(ids, tuple(sorted(set(ids))), math.ceil(share * len(set(ids)) - 1e-9), label, is_phrase, frozenset(self.number[w] for w in required)))
        self.half = max(len(t.words) for t in self.templates)
        self.prefix: dict[int, list[int]] = {}
        for k, t in enumerate(self.templates):
            for token in t.ordered[: len(t.ordered) - t.need + 1]:
                self.prefix.setdefault(token, []).append(k)
        self.is_prefix = np.zeros(len(tokens) + 1, bool)
        self.is_prefix[list(self.prefix)] = True

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Token numbers, -1 for words that no template has."""
        get = self.number.get
        return np.fromiter((get(w, -1) for w in words), np.int32, len(words))

    def contained(self, t: Template, block: list[int]) -> float:
        """The share of t's tokens in a block, given as its distinct tokens in order; 0 once a filter shows it to be too low."""
        if len(block) < t.need:
            return 0.0
        held, i, j = 0, 0, 0
        while i < len(t.ordered) and j < len(block):
            if held + min(len(t.ordered) - i, len(block) - j) < t.need:
                return 0.0
            if t.ordered[i] == block[j]:
                held, i, j = held + 1, i + 1, j + 1
            elif t.ordered[i] < block[j]:
                i += 1
            else:
                j += 1
        return held / len(t.ordered) if held >= t.need and t.required.issubset(block) else 0.0

    def scan(self, words: list[bytes]) -> tuple[set[tuple[int, str]], set[str], float]:
        """The places (start, label) of phrases, the labels of notices, and the best containment."""
        ids = self.numbers(words)
        at = np.flatnonzero(self.is_prefix[ids])
        places: set[tuple[int, str]] = set()
        labels: set[str] = set()
        best = 0.0
        candidates: dict[int, set[int]] = {}
        for p in at.tolist():
            for b in (p // self.half - 1, p // self.half):
                if b >= 0 or p < self.half:
                    candidates.setdefault(max(b, 0), set()).update(self.prefix[int(ids[p])])
        for b, found in candidates.items():
            window = ids[b * self.half : (b + 2) * self.half]
            block = np.unique(window[window >= 0]).tolist()
            for k in found:
                t = self.templates[k]
                share = self.contained(t, block)
                if not share:
                    continue
                if not t.is_phrase:
                    labels.add(t.label)
                    best = max(best, share)
                    continue
                n = len(t.words)
                for s in np.flatnonzero(window[: len(window) - n + 1] == t.words[0]).tolist():
                    if tuple(window[s : s + n].tolist()) == t.words:
                        places.add((b * self.half + s, t.label))
                        best = 1.0
        return places, labels, best


def _count(vocabulary: frozenset):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                counts.update(w for w in words_of(text.as_py() or b"") if w in vocabulary)
        yield pa.record_batch([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    return run


def _scan(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for text in batch.column(1).cast(pa.binary()):
                words = words_of(text.as_py() or b"")
                places, labels, best = index.scan(words)
                starts = [s for s, _ in places]
                base = {label for _, label in places}
                row = (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), best)
                for column, value in zip(out, row):
                    column.append(value)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.record_batch([batch.column(0), *[pa.array(x, k) for x, k in zip(out, kinds)]], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return run


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: tuple = PHRASES, notices: tuple = NOTICES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row of docs."""
    vocabulary = frozenset(w for t, *_ in (*phrases, *notices) for w in t.encode().split())
    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(trimmed(_count(vocabulary)), "word binary, n long")
    counts = {bytes(r.word): r.n for r in counted.groupBy("word").agg(F.sum("n").alias("n")).collect()}  # a row a template word
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    kinds = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return rows.mapInArrow(trimmed(_scan(Index(phrases, notices, threshold, counts))), kinds)
