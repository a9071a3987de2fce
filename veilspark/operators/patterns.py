r"""Phrases by a table of patterns: an inverted index from opening words to patterns decides which spans are searched for which.

A pattern that begins with `\b` and a word, followed by white space, a word edge or a sign, can only match where a span has just that
word. Spans are cut into words, the words meet the index by an equi-join, and only the pairs that meet are searched,
so that the cost depends on how often the opening words occur and not on how many patterns there are. Patterns that begin otherwise are searched
for in every span. The table stays a DataFrame; it is broadcast while it has FEW patterns at most and joined by a shuffle beyond.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import injection

FEW = 50_000
#: Stands in every span for patterns that have no opening word.
ANY = ""
#: Characters whose case folds to a letter of plain words, as the search engine has it, and those letters.
_FOLDED, _PLAIN = "ſKı", "ski"


def builtin(spark: SparkSession) -> DataFrame:
    """pattern_id, pattern: the engine's own patterns, in order."""
    return spark.createDataFrame(list(enumerate(injection.PATTERNS)), "pattern_id long, pattern string")


def opening(pattern: Column) -> Column:
    r"""The word that a pattern begins with, ANY if it has none that must stand alone: what follows must be `\s+`, `\b`, or a sign that is no
    letter, perhaps after `\s*`. A pattern with `|` outside of groups may begin otherwise."""
    word = F.regexp_extract(pattern, r"^\\b(\w+)(?:\\s\+|\\b|(?:\\s\*)?[:;,!/](?![*?{]))", 1)
    grouped = F.regexp_replace(pattern, r"\([^()]*\)", "")
    return F.when(F.contains(grouped, F.lit("|")), F.lit(ANY)).otherwise(F.lower(word))


def indexed(patterns: DataFrame, plain: bool = False) -> DataFrame:
    """pattern_id, opening, regex of patterns (pattern_id, pattern)."""
    p = F.col("pattern")
    return patterns.select("pattern_id", opening(p).alias("opening"), injection.translated_column(p, plain).alias("regex"))


def words(text: Column, plain: bool = False) -> Column:
    """The distinct words of a text, folded as patterns are searched, and ANY."""
    folded = F.lower(text) if plain else F.translate(F.lower(text), _FOLDED, _PLAIN)
    return F.array_distinct(F.array_append(F.split(folded, r"[^\p{L}\p{N}_]+"), F.lit(ANY)))


def matched(spans: DataFrame, patterns: DataFrame, plain: bool = False) -> DataFrame:
    """doc_id, span_seq, pattern_id, phrase: the first match of each pattern in each span (doc_id, span_seq, text), in lower case. plain: patterns
    in lower case whose classes are those of ASCII, as injection.translated_column() has it; their opening words stay whole words of any letters."""
    index = indexed(patterns, plain)
    index = F.broadcast(index) if index.limit(FEW + 1).count() <= FEW else index
    # the text goes along: a span has few words that open a pattern, and those alone are searched
    cut = spans.select("doc_id", "span_seq", F.lower("text").alias("_low"), F.explode(words(F.col("text"), plain)).alias("opening"))
    pairs = cut.join(index, "opening")
    found = pairs.select("doc_id", "span_seq", "pattern_id", F.expr("regexp_extract(_low, regex, 0)").alias("phrase"))
    return found.where("phrase <> ''")


def by_span(found: DataFrame) -> DataFrame:
    """doc_id, span_seq, matches: the phrases of a span in the order of the patterns."""
    items = F.array_sort(F.collect_list(F.struct("pattern_id", "phrase")))
    return found.groupBy("doc_id", "span_seq").agg(F.transform(items, lambda x: x["phrase"]).alias("matches"))


def by_document(found: DataFrame) -> DataFrame:
    """doc_id, prompt_injection_patterns: the distinct phrases of a document, sorted."""
    return found.groupBy("doc_id").agg(F.array_sort(F.collect_set("phrase")).alias("prompt_injection_patterns"))
