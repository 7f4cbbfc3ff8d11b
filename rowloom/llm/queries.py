"""The operators over the driver's tables, one query each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, html_text, mixing, ngram_lm, quality, simhash, substring, tokens, url_filter, warc

URL_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
DAMAGE_ONE_IN = 500


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "rule string, verdict string")
    return url_filter.judge(_read(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op3_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.write_and_audit(_read(spark, sf_dir, "pages"), DAMAGE_ONE_IN)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.passages(_read(spark, sf_dir, "documents"))


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_and_read_back(_read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.train_and_score(_read(spark, sf_dir, "documents"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_read(spark, sf_dir, "pages"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return mixing.mix(docs).select("doc_id", "source", "lang", "n_chars", "copy", "rate", "shuffle_key", "text")


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(_read(spark, sf_dir, "documents"), ["doc_id", "lang"], vocabulary("piece_bpe_32k.model"), vocabulary("byte_bpe_50k.tiktoken"))
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select(*first, "chars_per_token", "byte_share", "token_bits", "chars_per_token_bpe")


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_url_filter, op3_warc_audit, op4_substring_dedup, op5_token_output, op6_lm_score, op7_html_text, op8_mix_sources, op9_simhash_dedup, op10_quality_rules)}

_HOST = "coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"
_PATH = "coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '')"
_RULES = ", ".join(f"('{r}', '{r[: r.index('/')]}', '{r[r.index('/') :]}', '{v}')" for r, v in URL_RULES)
_UNIFORM = "(('0x' || substr(md5({}), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0)"

_DRAW = "(64 / 3.0::DOUBLE)"  # the highest rate of one draw
ORACLE_SQL = {
    "op2_url_filter": f"""
        WITH rules(rule, h, p, verdict) AS (VALUES {_RULES}),
        urls AS (SELECT page_id, {_HOST} AS host, {_PATH} AS path FROM pages),
        best AS (SELECT u.page_id, u.host, u.path, r.rule, r.verdict,
                        row_number() OVER (PARTITION BY u.page_id ORDER BY length(r.rule) DESC NULLS LAST) AS k
                 FROM urls u LEFT JOIN rules r ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p))
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM best WHERE k = 1""",
    "op8_mix_sources": f"""
        WITH RECURSIVE sizes AS (SELECT source AS s, count(*) AS n FROM documents GROUP BY source),
        rates AS (SELECT s, (SELECT sum(n) FROM sizes)::DOUBLE * 1.0 / (SELECT count(*) FROM sizes)::DOUBLE / n AS rate FROM sizes),
        pieces AS (SELECT s, rate, i, least(greatest(rate - i * {_DRAW}, 0.0), {_DRAW}) AS r FROM (SELECT s, rate, unnest(range(0, greatest(1, ceil(rate / {_DRAW}))::BIGINT)) AS i FROM rates)),
        steps(s, i, r, k, p, c) AS (
            SELECT s, i, r, 0, exp(-r), exp(-r) FROM pieces
            UNION ALL SELECT s, i, r, k + 1, p * r / (k + 1), c + p * r / (k + 1) FROM steps WHERE k < 80),
        draws AS (
            SELECT d.doc_id, d.source, d.text, d.lang, d.n_chars, p.rate, p.i,
                   CASE WHEN p.i = 0 THEN {_UNIFORM.format("'42:' || d.doc_id")} ELSE {_UNIFORM.format("'42:' || d.doc_id || ':draw:' || p.i")} END AS u
            FROM documents d JOIN pieces p ON d.source IS NOT DISTINCT FROM p.s),
        counts AS (
            SELECT doc_id, source, lang, n_chars, text, rate, sum((SELECT min(k) FROM steps t WHERE t.s IS NOT DISTINCT FROM draws.source AND t.i = draws.i AND u < t.c)) AS k
            FROM draws GROUP BY ALL),
        copies AS (SELECT *, unnest(range(1, k::BIGINT + 1))::INTEGER AS copy FROM (SELECT doc_id, source, lang, n_chars, text, rate, sum(k) AS k FROM counts GROUP BY ALL) WHERE k > 0)
        SELECT doc_id, source, lang, n_chars, copy, rate, {_UNIFORM.format("'42:' || doc_id || ':' || copy")} AS shuffle_key, text FROM copies""",
}
