"""The queries of this subpackage, each over its whole table, and their DuckDB twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, codes, conversations, jpeg, licenses, line_dedup, mixing, quality, sharding, simhash, topk, vectors, warc


#: The vocabulary that op8 and the pipeline encode with; the operator takes any path.
VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


def op9_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), VOCABULARY, public_tokenizers.PATTERN)


def op7_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_docs(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op5_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.media_features(jpeg.media_column(table(spark, sf_dir, "documents")))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"))


def op10_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings"))


def op12_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_scores(table(spark, sf_dir, "embeddings"))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(table(spark, sf_dir, "conversations"))


QUERIES = {"op1_sharding": op1_sharding, "op10_vectors": op10_vectors, "op3_warc": op3_warc, "op4_licenses": op4_licenses, "op5_jpeg": op5_jpeg, "op7_quality_cnn": op7_quality_cnn, "op8_byte_bpe": op8_byte_bpe, "op2_mixing": op2_mixing, "op6_line_dedup": op6_line_dedup, "op9_simhash_pigeonring": op9_simhash_pigeonring, "op11_vector_codes": op11_vector_codes, "op12_topk": op12_topk, "op13_conversations": op13_conversations}


def _license_sql() -> str:
    """Phrases by the words that follow each word; notices by counting their words in every window."""
    index = licenses.Index(licenses.PHRASES, licenses.NOTICES, licenses.THRESHOLD, {})
    at = ["word", "w1", "w2", "w3"]
    phrases = " UNION ALL ".join(f"SELECT doc_id, pos, '{label}' AS label FROM s WHERE " + " AND ".join(f"{c} = '{w}'" for c, w in zip(at, phrase.split())) for phrase, label in licenses.PHRASES)
    notices = [t for t in index.templates if not t.is_phrase]
    words = {k: w.decode() for w, k in index.number.items()}
    listed = ", ".join(f"({k}, '{t.label}', {t.need}, {len(t.ordered)}, '{words[w]}', {len(t.required)}, {w in t.required})" for k, t in enumerate(notices) for w in t.ordered)
    return rf"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
e AS (SELECT doc_id, CAST(generate_subscripts(w, 1) - 1 AS BIGINT) AS pos, unnest(w) AS word FROM t),
s AS (SELECT *, lead(word, 1) OVER o AS w1, lead(word, 2) OVER o AS w2, lead(word, 3) OVER o AS w3 FROM e WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
p AS ({phrases}),
b AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word FROM p GROUP BY doc_id),
v AS (SELECT * FROM (VALUES {listed}) x(k, label, need, size, word, n_required, required)),
m AS (SELECT e.doc_id, e.pos // {index.half} - d.d AS block, v.k, v.label, v.need, v.size, v.word, v.n_required, v.required FROM e JOIN v ON v.word = e.word CROSS JOIN (VALUES (0), (1)) d(d) WHERE e.pos // {index.half} >= d.d),
c AS (SELECT doc_id, label, count(DISTINCT word)::DOUBLE / any_value(size) AS share FROM m GROUP BY doc_id, block, k, label HAVING count(DISTINCT word) >= any_value(need) AND count(DISTINCT word) FILTER (WHERE required) = any_value(n_required)),
a AS (SELECT doc_id, label, 1.0::DOUBLE AS share, TRUE AS base FROM p UNION ALL SELECT doc_id, label, share, FALSE FROM c),
g AS (SELECT doc_id, max(share) AS score, array_to_string(list_sort(list_distinct(list(label) FILTER (WHERE base))), ',') AS base_labels, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels FROM a GROUP BY doc_id)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM t LEFT JOIN b ON b.doc_id = t.doc_id LEFT JOIN g ON g.doc_id = t.doc_id
"""


#: All pairs of a label; what is reachable from each vector grows step by step.
_VECTOR_SQL = """
WITH RECURSIVE u AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
c AS (SELECT vec_id AS a, vec_id AS r FROM embeddings UNION SELECT l.b, c.r FROM c JOIN l ON l.a = c.a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
m AS (SELECT a, min(r) AS r FROM c GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, m.r AS component_id, m.r = v.vec_id AS kept, CASE WHEN EXISTS (SELECT 1 FROM l) THEN 1.0::DOUBLE END AS recall
FROM embeddings v JOIN m ON m.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""


#: Vectors of which every component is a finite number, as integers.
_INTEGERS = """SELECT vec_id, label, list_transform(embedding, lambda x: floor({factor} * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""


def _codes_sql() -> str:
    """Every part against every entry; vectors are taken to have one length, which four divides. The sums are whole numbers below 2**53."""
    near = "SELECT vec_id, part, min(struct_pack(d := p.xx + list_inner_product(c.x, c.x) - 2 * list_inner_product(p.x, c.x), entry := c.entry)) AS b FROM p JOIN {c} c USING (part) GROUP BY vec_id, part"
    rounds = ""
    for k in range(codes.ROUNDS):
        rounds += f"""
a{k} AS MATERIALIZED ({near.format(c=f'c{k}')}),
s{k} AS (SELECT part, a{k}.b.entry AS entry, unnest(p.x) AS y, generate_subscripts(p.x, 1) AS pos FROM p JOIN a{k} USING (vec_id, part)),
m{k} AS (SELECT part, entry, list(y ORDER BY pos) AS x FROM (SELECT part, entry, pos, floor(sum(y) / count(*)) AS y FROM s{k} GROUP BY part, entry, pos) GROUP BY part, entry),
c{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m{k}.x, c{k}.x) AS x FROM c{k} LEFT JOIN m{k} USING (part, entry)),"""
    last = f"c{codes.ROUNDS}"
    return f"""
WITH v AS ({_INTEGERS.format(factor='1024')}),
p AS MATERIALIZED (SELECT vec_id, part, e[part * (len(e) // 4) + 1 : (part + 1) * (len(e) // 4)] AS x, list_inner_product(x, x) AS xx FROM v CROSS JOIN (SELECT unnest(range(4)) AS part)),
c0 AS MATERIALIZED (SELECT part, rank - 1 AS entry, x FROM p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS rank FROM v) r USING (vec_id) WHERE rank <= 256),{rounds}
f AS ({near.format(c=last)}),
r AS (SELECT vec_id, string_agg(format('{{:02x}}', b.entry), '' ORDER BY part) AS code, CAST(sum(b.d) AS BIGINT) AS error FROM f GROUP BY vec_id),
h AS (SELECT sha256(string_agg(CAST(CAST(y AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM (SELECT part, entry, unnest(x) AS y, generate_subscripts(x, 1) AS pos FROM {last}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM r JOIN v USING (vec_id) CROSS JOIN h
"""


ORACLES = {
    "op11_vector_codes": _codes_sql(),
    "op12_topk": f"""
WITH v AS ({_INTEGERS.format(factor='256')}),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score FROM v q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 5
""",
    "op10_vectors": _VECTOR_SQL,
    "op4_licenses": _license_sql(),
    "op3_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to
FROM f
""",
    "op6_line_dedup": r"""
WITH l AS (
  SELECT doc_id, CAST(generate_subscripts(a, 1) AS BIGINT) AS pos, unnest(a) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)),
k AS (
  SELECT doc_id, pos, line,
    translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
r AS (SELECT key, min(doc_id) AS keeper FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.doc_id, k.pos, k.line, r.keeper IS NOT NULL AND r.keeper <> k.doc_id AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
""",
}
