"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources.scratch import parquet


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the folder that all machines share, so that its lineage ends there and a lost executor costs no rerun of what is before it."""
    return parquet(df, what)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names like those wanted that no column of df has, whatever its case."""
    own = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in own:
            name += "_"
        own.add(name.lower())
        out.append(name)
    return out


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. lower() does the same for a text that is ASCII throughout, and faster."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def by_batch(df: DataFrame, schema: str, function: Callable[[pa.RecordBatch], dict[str, list]]) -> DataFrame:
    """A function from an Arrow batch to columns, applied to all batches of every partition."""
    from pyspark.sql.types import StructType

    names = StructType.fromDDL(schema).names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = function(batch)
                yield pa.RecordBatch.from_arrays([pa.array(made[n], t) for n, t in zip(names, types, strict=True)], names=names)

    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(f.dataType) for f in StructType.fromDDL(schema)]
    return df.mapInArrow(run, schema)
