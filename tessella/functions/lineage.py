"""Cutting long plans, and numbering rows without gathering them."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder that the session names in ``spark.checkpoint.dir``.

    A local session without one gets a folder of its own; on a cluster, whose executors share no local disk, that is an error.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and sc.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()


#: Rows of a table of names or results that is sent to all executors; a longer one is joined by shuffle.
SMALL_ROWS = 200_000


def if_small(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """``df`` written, and marked for broadcast if it has at most ``most`` rows."""
    df = cut(df)
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def numbered(df: DataFrame, by: list[Column | str], out: str) -> DataFrame:
    """``df`` with its rows' places from 0 in the order of ``by``, which must tell rows apart.

    Rows are dealt by ranges; each range numbers its own rows, and one number a range, their count, shifts it.
    """
    dealt = cut(df.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()))
    at, shifts = 0, []
    for r in sorted(dealt.groupBy("_range").count().collect()):
        shifts.append((r["_range"], at))
        at += r["count"]
    shift = df.sparkSession.createDataFrame(shifts, "_range int, _shift long")
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*by)) - 1 + F.col("_shift")
    return dealt.join(F.broadcast(shift), "_range").withColumn(out, place.cast("long")).drop("_range", "_shift")
