"""Queries of the operators in this package, with their oracle statements where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import ball_codes, embeddings, lines, mixing, ngram_join, nn_descent, order_minhash, packing, prefix_trie, quality, tokens, toxicity, urls
from foliant.llm.trie_oracle import CONVERSATION_TRIE
from foliant.llm.vector_oracles import ball_codes_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- 3: mixing ------------------------------------------------------------------------------------------------------


@_query(
    "op3_mix_sources",
    r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS number
  FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS size, 3 * sum(size)::BIGINT AS cap,
    (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS weight
  FROM sized GROUP BY source),
steps AS (
  SELECT cap::DOUBLE / weight AS ratio,
    ((SELECT sum(size) FROM src) - coalesce(sum(cap) OVER w, 0))::BIGINT AS rest,
    ((SELECT sum(weight) FROM src) - coalesce(sum(weight) OVER w, 0))::BIGINT AS weights
  FROM src WINDOW w AS (ORDER BY cap::DOUBLE / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT rest, weights FROM steps WHERE ratio >= rest::DOUBLE / weights ORDER BY ratio LIMIT 1),
filled AS (
  SELECT source, size AS source_size, CASE WHEN cap::DOUBLE <= (rest * weight)::DOUBLE / weights THEN cap::DOUBLE ELSE (rest * weight)::DOUBLE / weights END AS target
  FROM src, level),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM filled),
units AS (SELECT source, number, sum(size) AS words, count(*) AS rows FROM sized GROUP BY ALL),
placed AS (
  SELECT source, number, words, rows, coalesce(sum(words) OVER (PARTITION BY source ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM units),
copies AS (SELECT *, row_number() OVER (PARTITION BY source, number) AS j FROM sized)
SELECT s.doc_id, s.size, p.source_size, p.target,
  (s.size * (p.whole + CASE WHEN u.words = 0 THEN 0 WHEN s.j <= floor((p.target - p.whole * p.source_size - u.start)::DOUBLE * u.rows / u.words + 0.5) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM copies s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source
JOIN placed u ON s.source IS NOT DISTINCT FROM u.source AND s.number = u.number""",
)
def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


# --- 5: line dedup --------------------------------------------------------------------------------------------------


@_query("op5_line_dedup")
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs, percent=85).select("doc_id", "n_lines", "n_dropped", "text")


# --- 6: URL filters -------------------------------------------------------------------------------------------------

URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


@_query(
    "op6_url_filter",
    r"""
WITH parts AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parsed AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts),
rules(rule_host, rule_path, decision) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
judged AS (
  SELECT p.*, (SELECT max_by(rule_host || rule_path || ' ' || decision, length(rule_host || rule_path)) FROM rules
    WHERE (p.host = rule_host OR ends_with(p.host, '.' || rule_host)) AND starts_with(p.path, rule_path)) AS best
  FROM parsed p)
SELECT page_id, host, path, split_part(best, ' ', 1) AS rule, CASE WHEN best IS NULL THEN 'allow' ELSE split_part(best, ' ', 2) END AS verdict FROM judged""",
)
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judge_urls(_table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


# --- 1 and 2: classifiers -------------------------------------------------------------------------------------------


@_query("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    weights = toxicity.train(docs, _table(spark, sf_dir, "labels"), toxicity.learnable)
    scored = toxicity.score(docs, weights, cut=0.7)
    return scored.select("doc_id", (~toxicity.learnable(F.col("doc_id"))).alias("held_out"), "score", "predicted", "offending")


@_query("op2_quality")
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.train(docs, _table(spark, sf_dir, "labels"), quality.learnable)
    scored = quality.score(docs, model, cut=0.3)
    return scored.select("doc_id", (~quality.learnable(F.col("doc_id"))).alias("held_out"), "score", "predicted")


# --- 4: fingerprints ------------------------------------------------------------------------------------------------


@_query("op4_order_minhash")
def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.order_fingerprints(_table(spark, sf_dir, "documents"))


# --- 7 and 8: tokens ------------------------------------------------------------------------------------------------


def _tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


@_query("op7_token_counts")
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(_table(spark, sf_dir, "documents"), _tokenizer(), tokens.fresh_cache(spark), limit=2048)


@_query("op8_packing")
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), _tokenizer(), capacity=4096, end_id=1)


# --- 9 and 10: joins ------------------------------------------------------------------------------------------------


@_query("op9_ngram_join")
def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents"), words=5, percent=75)


@_query("op10_embedding_near")
def op10_embedding_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"), threshold=0.98)


# --- 11: conversations ----------------------------------------------------------------------------------------------


@_query("op11_prefix_trie", CONVERSATION_TRIE)
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(_table(spark, sf_dir, "conversations"))


# --- 12: vector codes -----------------------------------------------------------------------------------------------


@_query("op12_ball_codes", ball_codes_sql())
def op12_ball_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_codes.compress(_table(spark, sf_dir, "embeddings"))


# --- 13: nearest neighbours -----------------------------------------------------------------------------------------


@_query("op13_nn_descent")
def op13_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return nn_descent.greedy_search(nn_descent.build_graph(rows), rows.where("vec_id % 50 = 0"), top=5)
