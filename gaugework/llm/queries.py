"""The numbered queries. Each reads its whole table, applies one operator and keeps the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from . import alignment, compression_quality, language_model, media, ngram_join, packing, piece_bpe, quality_rules, rollups, simhash, substring_dedup, token_files, vector_codes
from .common import fold_of, new_folder, token_path, written


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(documents(spark, sf_dir).select("doc_id", "text"), digest_only=True)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.digests(documents(spark, sf_dir), token_path("piece_bpe_32k.model"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_groups(documents(spark, sf_dir))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, shards = token_files.store(documents(spark, sf_dir), token_path("word_bpe_49k.json"))
    return token_files.read_shards(spark, shards)


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.scores(documents(spark, sf_dir))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = packing.pieces(documents(spark, sf_dir), token_path("byte_bpe_50k.json"))
    return packing.pack(written(spark, parts, "pieces"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(documents(spark, sf_dir))
    return judged.select("doc_id", "n_words", *quality_rules.BASE, "base_failed", "kept", "quality_probability", "votes")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = compression_quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = compression_quality.score(docs, model)
    return scored.select("doc_id", (fold_of("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as stored WAVE files, read back: digests, features of all samples and the PCM, filtered before it is resampled."""
    stored = written(spark, media.store_texts(documents(spark, sf_dir)), "media", compression="zstd")
    return media.features(stored, filtered=True)


def _marked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with toxic and quality, null where a document has no label."""
    marks = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    return docs.join(marks, "doc_id", "left")


TOXIC, LOW = "toxic = 1", "quality = 0 and coalesce(toxic, 0) <> 1"


def _four_batches(spark: SparkSession, counted: DataFrame, labels: DataFrame, first: str, second: str) -> DataFrame:
    """Totals after four batches: all documents come, counted by ``first``; the toxic ones go; those of low quality are counted anew by
    ``second``; and the second batch arrives again. ``counted`` has a column of each name; texts are not moved to meet their labels."""
    counted = written(spark, _marked(counted, labels), "token-counts")

    def by(version: str, rows: DataFrame) -> DataFrame:
        return rows.select("source", "lang", F.lit(version).alias("tokenizer"), F.col(version).alias("n_tokens"))

    toxic, low = counted.filter(TOXIC), counted.filter(LOW)
    totals = rollups.Rollup(spark, new_folder(spark, "token-totals"))
    totals.commit("load", rollups.changes(new=by(first, counted)))
    totals.commit("toxic", rollups.changes(old=by(first, toxic)))
    totals.commit("recount", rollups.changes(new=by(second, low), old=by(first, low)))
    totals.commit("toxic", rollups.changes(old=by(first, toxic)))
    return totals.totals()


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of a corpus counted by one public tokenizer, from which toxic documents go and of which those of low quality are counted anew by another."""
    versions = ["byte_bpe_50k", "word_bpe_49k"]
    counted = rollups.count_tokens(documents(spark, sf_dir), {v: token_path(f"{v}.json") for v in versions}, ["doc_id", "source", "lang"])
    return _four_batches(spark, counted, spark.read.parquet(f"{sf_dir}/labels.parquet"), *versions)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tokenizers' ids aligned over the same bytes, and how often each text's links occur in the corpus."""
    return alignment.aligned_digests(documents(spark, sf_dir), token_path("byte_bpe_50k.json"), token_path("piece_bpe_32k.model"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(documents(spark, sf_dir))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return vector_codes.vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def rollup_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same batches with counts that SQL can make, by DataFrame functions only."""
    versions = list(rollups.COUNTERS)
    counted = documents(spark, sf_dir).select("doc_id", "source", "lang", *(rollups.token_count("text", v).alias(v) for v in versions))
    return _four_batches(spark, counted, spark.read.parquet(f"{sf_dir}/labels.parquet"), *versions)


WORD_COUNTS_SQL = rf"""
WITH marks AS (SELECT doc_id, max(toxic) AS toxic, min(quality) AS quality FROM labels GROUP BY doc_id),
kept AS (
  SELECT source, lang, coalesce(text, '') AS text, CASE WHEN quality = 0 THEN 'words-2' ELSE 'words-1' END AS tokenizer
  FROM documents LEFT JOIN marks USING (doc_id) WHERE coalesce(toxic, 0) <> 1)
SELECT source, lang, tokenizer, count(*) AS n_docs,
  CAST(sum(CASE WHEN tokenizer = 'words-1' THEN len(regexp_extract_all(text, '{rollups.COUNTERS["words-1"]}'))
                ELSE len(regexp_extract_all(text, '{rollups.COUNTERS["words-2"]}')) END) AS BIGINT) AS n_tokens
FROM kept GROUP BY source, lang, tokenizer
"""

def vector_codes_sql() -> str:
    """Product codes in SQL: every part against every entry, in as many steps as there are rounds."""
    v = vector_codes
    near = "list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))"

    def assigned(n: int) -> str:
        return f"""a{n} AS (SELECT r, vec_id, p, any_value(x) AS x, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
  SELECT r, vec_id, p, x, e, {near} AS d FROM parts JOIN c{n} USING (p)) GROUP BY r, vec_id, p)"""

    def moved(n: int) -> str:
        return f"""m{n} AS (SELECT p, e, list(m ORDER BY i) AS c FROM (
  SELECT p, e, i, CAST(floor(sum(x[i]) / count(*)) AS BIGINT) AS m FROM (SELECT p, e, x, unnest(range(1, len(x) + 1)) AS i FROM a{n}) GROUP BY p, e, i) GROUP BY p, e),
c{n + 1} AS (SELECT p, e, coalesce(m{n}.c, c{n}.c) AS c FROM c{n} LEFT JOIN m{n} USING (p, e))"""

    steps = ",\n".join(f"{assigned(n)},\n{moved(n)}" for n in range(v.ROUNDS))
    return f"""
WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {v.SCALE}) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
shape AS (SELECT max(len(v)) // {v.PARTS} AS width FROM kept),
parts AS (SELECT r, vec_id, p, v[p * width + 1 : (p + 1) * width] AS x FROM kept, shape, range({v.PARTS}) t(p)),
c0 AS (SELECT p, r - 1 AS e, x AS c FROM parts WHERE r <= {v.ENTRIES}),
{steps},
{assigned(v.ROUNDS)},
book AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{v.ROUNDS}),
coded AS (SELECT r, vec_id, string_agg(lower(printf('%02x', e)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{v.ROUNDS} GROUP BY r, vec_id)
SELECT c.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded c JOIN kept USING (r), book
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_ngram_join": op3_ngram_join,
    "op4_token_files": op4_token_files,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_packing": op6_packing,
    "op7_quality_rules": op7_quality_rules,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_media_columns": op9_media_columns,
    "op10_token_counts": op10_token_counts,
    "op11_alignment": op11_alignment,
    "op12_simhash": op12_simhash,
    "op13_vector_codes": op13_vector_codes,
    "rollup_word_counts": rollup_word_counts,
}
ORACLES: dict[str, str] = {"rollup_word_counts": WORD_COUNTS_SQL, "op13_vector_codes": vector_codes_sql()}
