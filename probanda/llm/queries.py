"""The queries of the training-data operators, with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import fill_middle, fingerprints, languages, licences, minhash, mixing, ngram_join, personal_data, quality, resampling, segmentation, token_files, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(_table(spark, sf_dir, "documents"))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.personal_data(_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.identify(_table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(_table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_table(spark, sf_dir, "documents"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op8_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmentation.round_trips(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licences(_table(spark, sf_dir, "documents"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_copies(_table(spark, sf_dir, "documents"))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.report(_table(spark, sf_dir, "documents"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_fingerprints, op2_personal_data, op3_toxicity, op4_languages, op5_quality, op6_mixing, op7_token_files, op8_segmentation, op9_licences, op10_ngram_join, op11_minhash, op12_fill_middle, op13_resampling)
}

_STOPS = ", ".join(f"'{w}'" for w in sorted(set(quality.STOP_WORDS)))
_RULES = " AND ".join(f"{measure} {sign} {limit}" for measure, low, high in quality.RULES.values() for sign, limit in ((">=", low), ("<=", high)) if limit is not None)

QUALITY_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM t),
g AS (SELECT r, unnest(generate_series(1, len(words) - 2)) AS i, words FROM w WHERE len(words) >= 3),
h AS (SELECT r, i, count(*) OVER (PARTITION BY r, words[i], words[i + 1], words[i + 2]) AS c FROM g),
p AS (SELECT r, count(DISTINCT i + k) AS n FROM h, (VALUES (0), (1), (2)) AS o(k) WHERE c >= 2 GROUP BY r),
m AS (SELECT w.*, len(words) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
        length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words,
        greatest(len(words), 1) AS n,
        length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS capitals,
        len(list_filter(words, lambda x: x IN ({_STOPS}))) AS stops FROM w LEFT JOIN p USING (r)),
q AS (SELECT *, word_chars / n AS mean_word_chars, n_symbols / n AS symbols_per_word, stops / n AS stop_word_share,
        n_dup_lines / greatest(len(lines), 1) AS dup_line_share, capitals / greatest(word_chars, 1) AS capital_share,
        n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND {_RULES} AS kept FROM q
"""

ORACLES: dict[str, str] = {"op5_quality": QUALITY_SQL, "op9_licences": licences.licences_sql(), "op11_minhash": minhash.DUPLICATES_SQL, "op12_fill_middle": fill_middle.MIDDLE_SQL, "op13_resampling": resampling.RESAMPLING_SQL}
