"""The corpus pipeline: five stages over documents, each written as Parquet and read again.

1. quality_classifier drops the documents that the classifier rejects.
2. line_dedup drops repeats of lines that ten or more documents have; the first
   occurrence stays.  A document that loses every line that says anything goes.
3. ngram_jaccard_join keeps one document of each near-duplicate component, the
   one with the smallest id.
4. decontamination drops documents that hold a window of a benchmark item.
5. sentencepiece encodes what is left; its rows are the result of run().

Every stage but the last returns the columns of its input.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, jaccard_join, line_dedup, quality, segment
from tessera.llm import text as kernel
from tessera.llm.common import checkpoint_folder, delete_at_end, table

#: The classifier and the sampler are fitted or drawn; SQL can't express them.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    settings = quality.Settings()
    model = quality.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"), settings)
    kernel.give_back()  # the rows of the fit, else the driver holds their memory through all later stages
    return quality.accepted(docs, model, settings)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(docs, keep_first=True)
    says = lambda text: F.coalesce(F.col(text), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    kept = kept.where(~says("text") | says("kept_text"))
    # A row that loses nothing stays as it is.
    changed = F.col("n_dropped") > 0
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return kept.select(*(F.when(changed, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in docs.columns))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = jaccard_join.deduplicated(docs)
    kernel.give_back()
    return kept


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    encoded = segment.encode(docs.select("doc_id", "text"))
    each = encoded.select("doc_id", F.posexplode("samples").alias("place", "s"))
    return each.select("doc_id", (F.col("place") + 1).alias("sample"), F.col("s.ids").alias("ids"), "s.log_prob", "s.inclusion")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup_stage),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; what each returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    base = f"{checkpoint_folder(spark)}/tessera-pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{base}/{number}-{name}"
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        delete_at_end(spark, path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
