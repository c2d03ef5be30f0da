"""The registered queries opN_<name> and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import ann, decontaminate, jaccard_join, language, line_dedup, pii, quality, secrets, segment, url_filter
from tessera.llm.common import fold, table


def op1_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def _span_digest(found: DataFrame, kinds: tuple[str, ...], by_start: bool) -> DataFrame:
    """Counts of base spans by kind, the hash of their list and the list of all spans."""
    order = lambda x: sum((F.when(x["kind"] == k, i).otherwise(0) for i, k in enumerate(kinds)), F.lit(0))
    key = (lambda x: (x["start"], order(x))) if by_start else (lambda x: (order(x), x["start"]))
    written = lambda spans: F.array_join(
        F.transform(F.array_sort(F.transform(spans, lambda x: F.struct(*(k.alias(f"k{i}") for i, k in enumerate(key(x))), x["end"].alias("end"), x["kind"].alias("kind"), x["start"].alias("start")))), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))),
        ",",
    )
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [count(k) for k in kinds]
    return found.select("doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.concat("base", "added")).alias("spans"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_digest(pii.find(table(spark, sf_dir, "documents")), pii.KINDS, by_start=False)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _span_digest(secrets.find(docs, secrets.learn(docs)), secrets.KINDS, by_start=True)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = quality.Settings()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), settings)
    scored = quality.with_scores(docs, model, settings)
    return scored.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= settings.threshold).cast("int").alias("predicted"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = segment.encode(table(spark, sf_dir, "documents"))
    each = encoded.select("doc_id", F.posexplode("samples").alias("place", "s"))
    ids = F.col("s.ids")
    each = each.select("doc_id", (F.col("place") + 1).alias("sample"), F.size(ids).cast("long").alias("n_ids"), F.xxhash64(ids).alias("ids_hash"), "s.log_prob", "s.perturbed", "s.inclusion", ids.alias("text"))
    # The text that the ids give back takes their place, so they go to Python once and not back.
    decoded = segment.decode(each, "text")
    return decoded.withColumn("text_hash", F.xxhash64("text")).drop("text")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    predicted = language.predict(docs.select("doc_id", "text"), language.fit(docs))
    return predicted.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score", "rejected")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_inverted_multi_index, op2_url_filter, op3_decontaminate, op4_ngram_jaccard, op5_personal_data, op6_line_dedup, op7_secrets, op8_quality, op9_sentencepiece, op10_language)}


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filter": url_filter.oracle(), "op3_decontaminate": decontaminate.oracle(), "op4_ngram_jaccard": jaccard_join.oracle(), "op6_line_dedup": line_dedup.oracle()}
