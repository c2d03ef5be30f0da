"""The generic code model: entities and relationships of checked kinds."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.model import ENTITIES, ENTITY_KINDS, RELATIONSHIP_KINDS, RELATIONSHIPS


@dataclass
class CodeModel:
    name: str
    entities: DataFrame
    relationships: DataFrame
    metadata: dict[str, str] = field(default_factory=dict)


def code_model(spark: SparkSession, name: str, entities: Iterable[Mapping] | DataFrame = (), relationships: Iterable[Mapping] | DataFrame = (), metadata: Mapping[str, str] | None = None) -> CodeModel:
    """A model from rows or tables; missing fields are null and missing metadata is empty."""

    def table(rows, schema, defaults) -> DataFrame:
        if isinstance(rows, DataFrame):
            return rows.select(*schema.names)
        return spark.createDataFrame([tuple((defaults | dict(r)).get(c) for c in schema.names) for r in rows], schema)

    own = table(entities, ENTITIES, {"metadata": {}})
    rel = table(relationships, RELATIONSHIPS, {"metadata": {}})
    return CodeModel(name, _checked(own, ENTITY_KINDS), _checked(rel, RELATIONSHIP_KINDS), dict(metadata or {}))


def _checked(rows: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    wrong = F.raise_error(F.concat(F.lit("unknown kind: "), F.coalesce("kind", F.lit("null"))))
    return rows.withColumn("kind", F.when(F.col("kind").isin(*kinds), F.col("kind")).otherwise(wrong))
