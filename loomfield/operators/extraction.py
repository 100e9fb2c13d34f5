"""The boundary to feature extractors: batch functions from bytes or text to vectors, run by Arrow in
the tasks, with a typed status for every channel that could not be filled."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Channel:
    """A named extractor: embed(values) gives one vector, or None, for each value. `start` makes embed
    once in each task, so a model is loaded there and never sent."""

    name: str
    dimension: int
    start: Callable[[], Callable[[list], list]]
    required: bool = True


def extracted(rows: DataFrame, key: str, value: str, channels: list[Channel], at_once: int = 256) -> DataFrame:
    """(key, vectors map<channel, vector>, status map<channel, state>): AVAILABLE, MISSING (null value),
    REJECTED (no vector), INVALID (wrong length or not finite); admitted if all required channels are
    available."""
    schema = T.StructType(
        [
            T.StructField("key", rows.schema[key].dataType),
            T.StructField("vectors", T.MapType(T.StringType(), T.ArrayType(T.FloatType()))),
            T.StructField("status", T.MapType(T.StringType(), T.StringType())),
        ]
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        form, live = to_arrow_schema(schema), [(c, c.start()) for c in channels]
        for batch in batches:
            for at in range(0, batch.num_rows, at_once):
                part = batch.slice(at, at_once)
                values = part.column(1).to_pylist()
                vectors: list[list] = [[] for _ in values]
                status: list[list] = [[] for _ in values]
                for channel, embed in live:
                    have = [k for k, v in enumerate(values) if v is not None]
                    got = dict(zip(have, embed([values[k] for k in have]) if have else [], strict=True))
                    for k in range(len(values)):
                        state, vector = "MISSING", None
                        if k in got:
                            vector = None if got[k] is None else np.asarray(got[k], np.float32)
                            state = "REJECTED" if vector is None else "AVAILABLE" if vector.shape == (channel.dimension,) and np.isfinite(vector).all() else "INVALID"
                        if state == "AVAILABLE":
                            vectors[k].append((channel.name, vector.tolist()))
                        status[k].append((channel.name, state))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(vectors, form.field(1).type), pa.array(status, form.field(2).type)], schema=form
                )

    need = F.array(*[F.lit(c.name) for c in channels if c.required])
    out = rows.select(F.col(key).alias("key"), value).mapInArrow(run, schema)
    return out.withColumn("admitted", F.forall(need, lambda n: F.col("status")[n] == "AVAILABLE")).withColumnRenamed("key", key)
