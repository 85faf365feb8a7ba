"""What operators share: a cut in the lineage, and numbers along a range partition."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a temporary one where a single machine runs all."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="shared-")
    return found


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the folder that all executors share, without its lineage."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def ranged(df: DataFrame, order: list[str | Column]) -> DataFrame:
    """df sorted over its partitions, with _part (which of them) and _in (place in it, from 0).

    Written once: the bounds between partitions are drawn anew each time the plan runs, so two uses of
    one plan wouldn't speak of the same partitions.
    """
    at = F.monotonically_increasing_id()
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at)
    return checkpointed(rows.withColumns({"_part": F.shiftright("_at", 33), "_in": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_at"))


def before_parts(sizes: DataFrame, n: str) -> DataFrame:
    """(_part, _before) of rows (_part, n): what the partitions before add up to. A row for each partition."""
    return sizes.select("_part", (F.sum(n).over(Window.orderBy("_part")) - F.col(n)).alias("_before"))
