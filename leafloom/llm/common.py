"""Table access and small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tagged(df: DataFrame, tab: str, key: str, text: str, *, where: Column | None = None) -> DataFrame:
    """(tab, row_id, text) of the rows whose text is not null."""
    if where is not None:
        df = df.filter(where)
    return df.filter(F.col(text).isNotNull()).select(F.lit(tab).alias("tab"), F.col(key).alias("row_id"), F.col(text).alias("text"))


def slices(frames: Iterable[pd.DataFrame], *, rows: int = 500) -> Iterator[pd.DataFrame]:
    """The frames of a Python stage in parts of at most ``rows`` rows, so that what is made of a part stays small.

    What goes in at once is bounded by bytes (spark.sql.execution.arrow.maxBytesPerBatch); no setting of the session is
    touched, since it would hold for every other query too.
    """
    for pdf in frames:
        for k in range(0, len(pdf), rows):
            yield pdf.iloc[k : k + rows]


def settled(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder, so that what follows reads its rows instead of working them out again, and the
    loss of an executor doesn't either. The folder is the session's; one of our own is set only where there is none."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(context.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp())
    return df.checkpoint()
