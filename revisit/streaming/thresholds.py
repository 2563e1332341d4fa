"""A threshold that follows a stream, from quantile sketches that are kept with it and merged."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from revisit.functions.columns import ref
from revisit.operators.flagging import flag_over
from revisit.plans.durable import durable_at, forget

SIZE = 4096
_GROUPS = 256


def rank_error(size: int = SIZE) -> float:
    """By what share of the rows the rank of a sketch's quantile may be off, at 99 % confidence."""
    # The published fit of the error of KLL sketches with parameter ``size``.
    return 2.296 / size**0.9723


def sketch(rows: DataFrame, value: str, size: int = SIZE) -> DataFrame:
    """One row (n, sketch) for the values that are numbers; no row where there are none.

    Every task sends one sketch, whatever it has read. They meet in at most ``_GROUPS`` groups
    first, so that the last task merges these only.
    """
    numbers = rows.select(ref(value).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    parts = numbers.groupBy(F.pmod(F.spark_partition_id(), F.lit(_GROUPS)).alias("part")).agg(
        F.count("v").alias("n"), F.kll_sketch_agg_double("v", F.lit(size)).alias("sketch")
    )
    return merged(parts.drop("part"), size)


def merged(sketches: DataFrame, size: int = SIZE) -> DataFrame:
    """Rows (n, sketch) as one; no row for none."""
    whole = sketches.agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", size).alias("sketch"))
    return whole.where("n > 0")


@dataclass
class ThresholdStore:
    """For every batch, a sketch of all values up to it, under ``path``.

    A batch's state is made from that of the batch before and its own values, so a repeated batch
    gives its values once. Only the last two states are kept.
    """

    spark: SparkSession
    path: str
    size: int = SIZE

    def add(self, rows: DataFrame, value: str, batch_id: int) -> None:
        """Merge the values of a batch; null and NaN do not count."""
        parts = sketch(rows, value, self.size)
        earlier = [b for b in self._batches() if b < batch_id]
        if earlier:
            before = self.spark.read.schema(parts.schema).parquet(self._folder(max(earlier)))
            parts = merged(parts.unionByName(before), self.size)
        parts.coalesce(1).write.mode("overwrite").parquet(self._folder(batch_id))
        for old in earlier:
            if old != max(earlier):
                forget(self.spark, self._folder(old))

    def threshold(self, batch_id: int, share: float) -> float | None:
        """The value that ``share`` of all values up to the batch exceed; null before the first value.

        Its rank is off by ``rank_error(size)`` of the rows at most, at 99 % confidence.
        """
        state = self.spark.read.schema("n BIGINT, sketch BINARY").parquet(self._folder(batch_id))
        found = state.select(F.kll_sketch_get_quantile_double("sketch", F.lit(float(1 - share)))).first()
        return None if found is None else found[0]

    def _folder(self, batch_id: int) -> str:
        return f"{self.path}/batch={batch_id}"

    def _batches(self) -> list[int]:
        """Batches whose state is complete."""
        jvm = self.spark._jvm
        place = jvm.org.apache.hadoop.fs.Path(self.path)
        system = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = []
        if system.exists(place):
            for status in system.listStatus(place):
                name = re.fullmatch(r"batch=(\d+)", status.getPath().getName())
                if name and system.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
                    found.append(int(name[1]))
        return found


def stream_flags(
    rows: DataFrame,
    target: str,
    checkpoint: str,
    value: str = "score_ratio",
    flag_share: float = 0.1,
    size: int = SIZE,
    name: str = "flagged",
) -> StreamingQuery:
    """Flag the rows of a stream that exceed the threshold of all that has arrived; runs until all
    present are done.

    Rows get ``name`` and ``threshold`` (both new columns) and are written to a folder by batch id.
    The threshold is what ``flag_share`` of the values exceed, this batch and all before it, each
    counted as often as it arrived; earlier rows keep the flags of their time. Rows without a value
    are not flagged, nor is any row before the first value. ``flag_threshold`` is the exact way,
    which reads all rows again. A batch costs its own rows and one sketch, however long the stream.
    Sketches draw at random: a repeated batch may have another threshold within the error, and
    replaces its own output only.
    """
    spark = rows.sparkSession
    store = ThresholdStore(spark, checkpoint.rstrip("/") + "-thresholds", size)

    def flag(batch: DataFrame, batch_id: int) -> None:
        copy, path = durable_at(batch, "batch")  # read for the sketch and for the flags
        store.add(copy, value, batch_id)
        limit = store.threshold(batch_id, flag_share)
        flagged = flag_over(copy, float("inf") if limit is None else limit, value, name)
        flagged = flagged.withColumn(name, ref(name) & ~F.coalesce(F.isnan(ref(value)), F.lit(False)))
        limit = F.lit(limit).cast("double").alias("threshold")
        flagged.select("*", limit).write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")
        forget(spark, path)

    return (
        rows.writeStream.foreachBatch(flag)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
