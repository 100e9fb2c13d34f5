"""Registries as tables: idempotent upserts, conflicts, and state changes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfield.functions.scalars import token, uuid5

#: Fixed value: the namespace of registered ids.
NAMESPACE = str(uuid.uuid5(uuid.NAMESPACE_DNS, "enrollment.registered_dog.v1"))


def registered(registry: DataFrame | None, batch: DataFrame, key: str, once: bool = False) -> DataFrame:
    """registry(key, images) with the batch's keys added: each row counts one, or, with once, each
    distinct key. New keys are inserted."""
    new = (batch.select(key).distinct() if once else batch.select(key)).filter(F.col(key).isNotNull())
    counts = new.groupBy(key).agg(F.count("*").alias("images"))
    both = counts if registry is None else registry.select(key, "images").union(counts)
    return both.groupBy(key).agg(F.sum("images").alias("images"))


def with_ids(registry: DataFrame, key: str) -> DataFrame:
    """registry with dataset (before the first colon of the key), identity token and registered id."""
    return registry.select(
        key,
        F.substring_index(F.col(key), ":", 1).alias("dataset"),
        token("identity", F.col(key)).alias("identity_token"),
        uuid5(NAMESPACE, F.col(key)).alias("registered_id"),
        "images",
    )


def enrolment(existing: DataFrame, batch: DataFrame, key: str, payload: str) -> DataFrame:
    """batch rows with an outcome: CREATED (its key is new), SAME (the key holds the same payload) or
    CONFLICT (it holds another, or the batch itself gives the key two)."""
    hashed = batch.withColumn("_h", F.sha2(F.col(payload).cast("string"), 256))
    inner = hashed.groupBy(key).agg(F.count_distinct("_h").alias("_kinds"))
    old = existing.select(key, F.sha2(F.col(payload).cast("string"), 256).alias("_old"))
    outcome = (
        F.when((F.col("_kinds") > 1) | (F.col("_old") != F.col("_h")), "CONFLICT").when(F.col("_old").isNull(), "CREATED").otherwise("SAME")
    )
    return hashed.join(inner, key).join(old, key, "left").withColumn("outcome", outcome).drop("_h", "_kinds", "_old")


def illegal_changes(changes: DataFrame, legal: list[tuple[str, str]]) -> DataFrame:
    """changes(id, was, now) that are not among the legal ones."""
    table = changes.sparkSession.createDataFrame(legal, "was string, now string")
    return changes.join(F.broadcast(table), ["was", "now"], "left_anti")  # legal is a fixed list
