"""The registered queries of this package: thin wrappers that derive digest columns from the operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelab.llm import ann, collocations, lines, mixing, packing, repeats, secrets, simhash, tokens, topk, toxicity, warc, whitening

from scorelab.llm.common import stored


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _asked(rows: DataFrame) -> DataFrame:
    """The stated query set."""
    return rows.where(F.col("vec_id") % 50 == 0)


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk.quantised(_read(spark, sf_dir, "embeddings"))
    return topk.top_k(rows, _asked(rows))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_print().alias("fingerprint"), "component_id")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity.scored(docs, toxicity.learned(docs, _read(spark, sf_dir, "labels")))
    predicted = (F.col("_score") >= toxicity.THRESHOLD).cast("int")
    return found.select("doc_id", toxicity.held_out().alias("held_out"), F.col("_score").alias("score"), predicted.alias("predicted"))


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(_read(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(_read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scanned(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.expr(f"cast(size(filter(base_spans, x -> x.kind = '{k}')) as long) as n_{k}") for k, _, _ in secrets.BASE]
    base = F.sha2(F.expr(secrets.joined("base_spans")), 256).alias("base_sha256")
    return found.select("doc_id", *counts, base, F.expr(secrets.joined("all_spans")).alias("spans"))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ann.usable(_read(spark, sf_dir, "embeddings"))
    return ann.nearest(rows, _asked(rows))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count().alias("size"))
    placed = stored(mixing.schedule(docs), "mix-places")
    mix = mixing.with_served(placed, mixing.served_words(placed))
    return mix.select("doc_id", "size", "source_size", "target", mixing.taken().alias("taken"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(_read(spark, sf_dir, "pages"), payloads=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_read(spark, sf_dir, "documents").select("lang", "text"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = lines.without_common_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whitened(_read(spark, sf_dir, "embeddings"))
    deviation = F.expr("try_cast(deviation as bigint)").alias("deviation")
    return found.select("vec_id", "component", "n", deviation, "whitened", "explained", "identity_error")


QUERIES = {
    "op1_exact_topk": op1_exact_topk,
    "op2_simhash": op2_simhash,
    "op3_toxicity": op3_toxicity,
    "op4_repeats": op4_repeats,
    "op5_token_counts": op5_token_counts,
    "op6_secrets": op6_secrets,
    "op7_neighbours": op7_neighbours,
    "op8_packing": op8_packing,
    "op9_mixing": op9_mixing,
    "op10_warc": op10_warc,
    "op11_collocations": op11_collocations,
    "op12_line_dedup": op12_line_dedup,
    "op13_whitening": op13_whitening,
}

ORACLES = {
    "op1_exact_topk": """
WITH parts AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, x.vec_id, list_sum(list_transform(list_zip(q.v, x.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM parts q JOIN parts x ON q.vec_id % 50 = 0 AND q.vec_id <> x.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
""",
    "op10_warc": r"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
  FROM pages),
g AS (SELECT payload_digest, max(page_id) AS kept FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest HAVING count(*) > 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN kept IS NOT NULL AND page_id IS DISTINCT FROM kept THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM kept THEN kept END AS refers_to
FROM p LEFT JOIN g USING (payload_digest)
""",
    "op9_mixing": r"""
WITH docs AS (
  SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '')) AS k,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
weighed AS (
  SELECT source, source_size, 3 * source_size AS cap,
         [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM sources),
levels AS (
  SELECT *, ((sum(source_size) OVER ()) - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / (sum(weight) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST
               ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM weighed),
chosen AS (SELECT level FROM levels WHERE level * weight <= cap ORDER BY cap::DOUBLE / weight, level LIMIT 1),
targets AS (
  SELECT source, source_size, least(cap::DOUBLE, (SELECT level FROM chosen) * weight) AS target FROM levels),
placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM docs)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(floor(target)::BIGINT - before, size))
        + greatest(0, least(floor(target)::BIGINT - source_size - before, size))
        + greatest(0, least(floor(target)::BIGINT - 2 * source_size - before, size)))::BIGINT AS taken
FROM placed JOIN targets ON placed.source IS NOT DISTINCT FROM targets.source
""",
    "op11_collocations": r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents),
pieces AS (
  SELECT lang, d, generate_subscripts(ps, 1) AS p, unnest(ps) AS piece
  FROM (SELECT lang, d, string_split_regex(t, '[.,;:!?\x0A-\x0D]') AS ps FROM docs)),
words AS (
  SELECT lang, d, p, generate_subscripts(ws, 1) AS i, unnest(ws) AS w
  FROM (SELECT lang, d, p, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces)),
runs AS (
  SELECT lang, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM words WINDOW o AS (PARTITION BY d, p ORDER BY i)),
counts AS (
  SELECT lang, phrase, words, count(*)::BIGINT AS f FROM (
    SELECT lang, w AS phrase, 1 AS words FROM runs
    UNION ALL SELECT lang, w || ' ' || w2, 2 FROM runs WHERE w2 IS NOT NULL
    UNION ALL SELECT lang, w || ' ' || w2 || ' ' || w3, 3 FROM runs WHERE w3 IS NOT NULL)
  GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE words = 1 GROUP BY lang),
found AS (SELECT lang, phrase, words, f AS a, string_split(phrase, ' ') AS ws FROM counts WHERE words > 1 AND f >= 10),
longer AS (
  SELECT lang, phrase, max(a) AS most FROM (
    SELECT lang, ws[1] || ' ' || ws[2] AS phrase, a FROM found WHERE words = 3
    UNION ALL SELECT lang, ws[2] || ' ' || ws[3], a FROM found WHERE words = 3)
  GROUP BY ALL),
alone AS (
  SELECT found.* FROM found LEFT JOIN longer USING (lang, phrase) WHERE most IS NULL OR 100 * most < 50 * a),
cuts AS (
  SELECT lang, phrase, a, k, array_to_string(ws[1:k], ' ') AS head, array_to_string(ws[k + 1:], ' ') AS rest
  FROM alone, range(1, 3) t(k) WHERE k < words),
scored AS (
  SELECT cuts.lang, cuts.phrase, a, k, x.f AS l, y.f AS r,
         (1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts JOIN counts x ON x.lang = cuts.lang AND x.phrase = head JOIN counts y ON y.lang = cuts.lang AND y.phrase = rest),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM weakest JOIN totals USING (lang) QUALIFY rank <= 2000
""",
    "op12_line_dedup": r"""
WITH docs AS (SELECT row_number() OVER () AS d, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT d, doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS line FROM docs),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
common AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT d) >= 3),
marked AS (
  SELECT d, doc_id, i, line, common.k IS NOT NULL AND doc_id IS DISTINCT FROM keeper AS gone
  FROM keyed LEFT JOIN common USING (k))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY d, doc_id
""",
}
