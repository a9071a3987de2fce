r"""Prompt-injection phrases.

The patterns are written for Unicode text in which \s and \b follow the Unicode character classes. For the JVM's engine they are
translated: (?iu) for case, an explicit class for white space, and look-around for word edges.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns, in order.
PATTERNS = (
    r"\bignore\s+(previous|prior|above|all)\s+(instructions?|prompts?|commands?)\b",
    r"\bdisregard\s+(previous|prior|above|all)\s+(instructions?|prompts?|commands?)\b",
    r"\bforget\s+(everything|all|previous|prior|above)\b",
    r"\bsystem\s*:\s*",
    r"\bassistant\s*:\s*",
    r"\buser\s*:\s*",
    r"\byou\s+are\s+now\b",
    r"\bpretend\s+(to\s+be|you\s+are)\b",
    r"\bact\s+as\s+(if|a|an)\b",
    r"\brole\s*:\s*",
    r"\bnew\s+(instructions?|prompts?|commands?)\b",
    r"\boverride\s+(previous|settings?|instructions?)\b",
)

_SPACE = r"(?U:[\s\x1c-\x1f])"
_LETTER = r"[\p{L}\p{N}_]"
#: The same for patterns whose classes are those of ASCII alone.
_ASCII_SPACE, _ASCII_LETTER = r"[\t\n\f\r ]", "[A-Za-z0-9_]"


def translated(pattern: str) -> str:
    body = pattern.replace(r"\s", _SPACE)
    if body.startswith(r"\b"):
        body = rf"(?<!{_LETTER})" + body[2:]
    if body.endswith(r"\b"):
        body = body[:-2] + rf"(?!{_LETTER})"
    return "(?iu)" + body


def translated_column(pattern: Column, plain: bool = False) -> Column:
    """translated() of a column of patterns. plain: case is told apart, and \\s and \\b follow the ASCII classes, so that a word ends before ä."""
    space, letter, flags = (_ASCII_SPACE, _ASCII_LETTER, "") if plain else (_SPACE, _LETTER, "(?iu)")
    edge, body = F.lit(r"\b"), F.replace(pattern, F.lit(r"\s"), F.lit(space))
    begins, ends = F.startswith(body, edge), F.endswith(body, edge)
    bare = F.regexp_replace(body, r"^\\b|\\b$", "")
    return F.concat(F.lit(flags), F.when(begins, rf"(?<!{letter})").otherwise(""), bare, F.when(ends, rf"(?!{letter})").otherwise(""))


#: A word that each pattern opens with: a text without any of them matches none.
OPENING = "(?iu)" + "|".join(sorted({re.match(r"\\b(\w+)", p)[1] for p in PATTERNS}))


def matches(text: Column) -> Column:
    """The first match of each pattern in the lower-cased text, in pattern order. Most texts fail the one test for an
    opening word and are spared the twelve searches."""
    low = F.lower(text)
    found = F.array(*[F.regexp_extract(low, translated(p), 0) for p in PATTERNS])
    return F.when(low.rlike(OPENING), F.filter(found, lambda x: x != "")).otherwise(F.array().cast("array<string>"))
