"""Two small aids to physical plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Scans above this size are never repartitioned: their files give partitions enough.
SMALL = 1 << 30


def spread(scan: DataFrame) -> DataFrame:
    """A small table's scan with at least as many partitions as there are cores.

    A small table may lie in one file of one row group, which no split size can divide, and then row-local work would leave
    all cores but one idle. What is moved for that is bounded by SMALL; a larger table is read as its files lie.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() > SMALL:
        return scan
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with further columns that are worked out once per row: a generator stands between them and what uses them, so
    that the optimiser can't copy a costly expression into every place where its column is named."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))
