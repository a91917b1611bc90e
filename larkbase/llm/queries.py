"""The queries of this subpackage, by the names under which the entry point registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkbase.llm.common import id_bucket, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkbase.llm import toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    config = toxicity.ToxicityConfig()
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), config)
    return toxicity.score(docs, model).select(
        "doc_id", (id_bucket(F.col("doc_id"), config.held_out_mod) == 0).alias("held_out"), "score", "predicted"
    )


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkbase.llm import mixing

    return mixing.assign(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkbase.llm import sharding

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.assign_shards(docs, 24).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkbase.llm import quality

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return quality.judge(docs).select("doc_id", *quality.MEASURES, "base_failed", "kept")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkbase.llm import linededup

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.drop_lines(docs, min_docs=10, min_chars=1).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkbase.llm import simhash

    return simhash.group(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "fingerprint", "component_id")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkbase.llm import secretscan

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secretscan.scan(docs)


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's file is; `larkbase.tokenizers` in the session's settings may name another folder."""
    folder = SparkSession.getActiveSession().conf.get("larkbase.tokenizers", None)
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkbase.llm import bpe

    return bpe.digest(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_file("byte_bpe_50k.json"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkbase.llm import topk

    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return topk.top_k(vectors, F.col("id") % 100 == 0, topk.TopKConfig(k=10, scale=1024))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkbase.llm import tokencount

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokencount.count_tokens(docs, tokenizer_file("word_bpe_49k.json"), 2048).select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"), "fits_chars"
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_mixing": op2_mixing,
    "op3_sharding": op3_sharding,
    "op4_simhash": op4_simhash,
    "op5_secret_scan": op5_secret_scan,
    "op6_bpe": op6_bpe,
    "op7_topk": op7_topk,
    "op8_token_counts": op8_token_counts,
    "op9_quality": op9_quality,
    "op10_line_dedup": op10_line_dedup,
}

#: DuckDB SQL for the queries that SQL can express.
ORACLES: dict[str, str] = {
    "op7_topk": r"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.r AS q, q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.v, d.v) AS BIGINT) AS score
    FROM v q JOIN v d ON q.r <> d.r AND len(q.v) = len(d.v) WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id NULLS LAST) AS r FROM scored)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 10
""",
    "op9_quality": r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, lang, source FROM documents),
words AS (SELECT r, doc_id, lang, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs),
line_counts AS (SELECT r, count(*) AS n_text_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
positions AS (SELECT r, unnest(range(1, len(w) - 1)) AS pos, w FROM words WHERE len(w) >= 3),
windows AS (SELECT r, pos, w[pos] || ' ' || w[pos + 1] || ' ' || w[pos + 2] AS three FROM positions),
twice AS (SELECT r, pos FROM windows QUALIFY count(*) OVER (PARTITION BY r, three) > 1),
repeats AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest([pos, pos + 1, pos + 2]) AS p FROM twice) GROUP BY r),
measures AS (SELECT r, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_text_lines, 0) AS n_text_lines
    FROM words LEFT JOIN line_counts USING (r) LEFT JOIN repeats USING (r)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measures),
valued AS (SELECT r, lang, source, base_failed, unnest(['symbol_share', 'dup_line_share', 'repeat_share', 'mean_word']) AS rule, unnest([
    CASE WHEN n_words > 0 THEN 10000 * greatest(n_symbols - CAST(ceil(2 * sqrt(n_symbols)) AS BIGINT), 0) // n_words ELSE 0 END,
    CASE WHEN n_text_lines > 0 THEN 10000 * greatest(n_dup_lines - CAST(ceil(2 * sqrt(n_dup_lines)) AS BIGINT), 0) // n_text_lines ELSE 0 END,
    CASE WHEN n_words > 0 THEN 10000 * greatest(n_repeat_words - CAST(ceil(2 * sqrt(n_repeat_words)) AS BIGINT), 0) // n_words ELSE 0 END,
    CASE WHEN n_words > 0 THEN 100 * word_chars // n_words ELSE 0 END]) AS v FROM judged),
bucketed AS (SELECT lang, source, rule, greatest(length(bin(v)) - 6, 0) AS shift, v FROM valued WHERE NOT base_failed),
sketch AS (SELECT lang, source, rule, CAST(shift * 32 + (v >> shift) AS INTEGER) AS b, CAST(count(*) AS HUGEINT) AS n FROM bucketed GROUP BY ALL),
of_lang AS (SELECT lang, rule, b, CAST(sum(n) AS HUGEINT) AS n FROM sketch GROUP BY ALL),
of_all AS (SELECT rule, b, CAST(sum(n) AS HUGEINT) AS n FROM sketch GROUP BY ALL),
groups AS (SELECT lang, source, l.n AS n_lang, a.n AS n_all FROM (SELECT DISTINCT lang, source FROM sketch) g
    JOIN (SELECT lang AS k, CAST(sum(n) AS HUGEINT) AS n FROM of_lang WHERE rule = 'symbol_share' GROUP BY lang) l ON l.k IS NOT DISTINCT FROM g.lang
    CROSS JOIN (SELECT CAST(sum(n) AS HUGEINT) AS n FROM of_all WHERE rule = 'symbol_share') a),
parts AS (SELECT g.lang, g.source, rule, b, n * n_lang * n_all AS w FROM sketch s JOIN groups g ON s.lang IS NOT DISTINCT FROM g.lang AND s.source IS NOT DISTINCT FROM g.source
    UNION ALL SELECT g.lang, g.source, rule, b, n * n_all * 200 FROM of_lang s JOIN groups g ON s.lang IS NOT DISTINCT FROM g.lang
    UNION ALL SELECT g.lang, g.source, rule, b, n * n_lang * 50 FROM of_all s CROSS JOIN groups g),
mixed AS (SELECT lang, source, rule, b, CAST(sum(w) AS HUGEINT) AS w FROM parts GROUP BY ALL),
ranked AS (SELECT *, CAST(sum(w) OVER o AS HUGEINT) AS upto, CAST(sum(w) OVER (PARTITION BY lang, source, rule) AS HUGEINT) AS total,
    CAST(coalesce(sum(w) OVER (PARTITION BY lang, source, rule ORDER BY b RANGE BETWEEN 1 FOLLOWING AND 64 FOLLOWING), 0) AS HUGEINT) AS ahead
    FROM mixed WINDOW o AS (PARTITION BY lang, source, rule ORDER BY b)),
places AS (SELECT lang, source, rule, min(b) FILTER (WHERE upto * 4 >= total) AS low, min(b) FILTER (WHERE upto * 4 >= total * 3) AS high,
    min(b) FILTER (WHERE upto * 4 >= total * 3 AND upto < total AND ahead * 1000 <= total) + 1 AS beyond FROM ranked GROUP BY ALL),
marks AS (SELECT *, greatest(low // 32 - 1, 0) AS s1, greatest(high // 32 - 1, 0) AS s3, greatest(beyond // 32 - 1, 0) AS sv FROM places),
quartiles AS (SELECT lang, source, rule, CAST(low - s1 * 32 AS BIGINT) << s1 AS q1, CAST(high - s3 * 32 AS BIGINT) << s3 AS q3, (CAST(beyond - sv * 32 AS BIGINT) << sv) - 1 AS valley FROM marks),
cuts AS (SELECT lang, source, rule, CASE WHEN q3 > q1 THEN q3 + 6 * (q3 - q1) ELSE valley END AS cut FROM quartiles),
passed AS (SELECT v.r, bool_and(c.cut IS NULL OR v.v <= c.cut) AS ok FROM valued v
    LEFT JOIN cuts c ON c.lang IS NOT DISTINCT FROM v.lang AND c.source IS NOT DISTINCT FROM v.source AND c.rule = v.rule GROUP BY v.r)
SELECT doc_id, n_words, word_chars, n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
    CAST(n_text_lines AS BIGINT) AS n_text_lines, base_failed, NOT base_failed AND ok AS kept FROM judged JOIN passed USING (r)
""",
    "op10_line_dedup": r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM docs),
keyed AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
wide AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10),
marked AS (SELECT k.*, w.key IS NOT NULL AS gone FROM keyed k LEFT JOIN wide w ON k.key = w.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
""",
}
