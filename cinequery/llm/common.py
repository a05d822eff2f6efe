"""Helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import Scratch


def project(df: DataFrame, **columns: str) -> DataFrame:
    """Columns of `df` by exact name, cast to the given types; a missing column is null.

    Columns that differ only in case, or repeat a name, cannot clash: every
    input column first gets a positional name. The first exact match counts.
    """
    names = df.columns
    renamed = df.toDF(*[f"_in{i}" for i in range(len(names))])
    picked = []
    for name, kind in columns.items():
        source = F.col(f"_in{names.index(name)}") if name in names else F.lit(None)
        picked.append(source.cast(kind).alias(name))
    return renamed.select(*picked)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes `df` to the shared folder and reads it back, so that lineage ends there."""
    return Scratch(df.sparkSession, name).write(df, name)


def filtered(df: DataFrame, keep: Callable[[], Callable[[str | None], bool]], column: str = "text") -> DataFrame:
    """The rows of `df`, all columns as they are, whose text passes. `keep` makes the test once a task; no shuffle."""
    at = df.columns.index(column)
    schema, names = df.schema, df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = keep()
        for b in batches:
            out = b.filter(pa.array([test(t.as_py()) for t in b.column(at)], pa.bool_()))
            yield pa.RecordBatch.from_arrays(out.columns, names)

    return df.mapInArrow(run, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(df: DataFrame) -> int:
    """UTF-8 bytes in the column `text`."""
    return int(df.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
