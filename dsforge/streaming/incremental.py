"""Structured Streaming forms of the incremental operators: append without duplicates, live counters, rows not yet extracted, failures in a row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_rows(spark: SparkSession, path: str, schema: T.StructType, form: str = "json", files_per_trigger: int | None = None) -> DataFrame:
    """A growing folder of files as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.format(form).load(path)


def append_distinct(stream: DataFrame, key: str, event_time: str | None = None, delay: str = "7 days") -> DataFrame:
    """Rows whose key has not been seen; with an event time the state is dropped after ``delay``, so it stays bounded."""
    if event_time is None:
        return stream.dropDuplicates([key])
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def live_counters(stream: DataFrame, kind: str) -> DataFrame:
    return stream.groupBy(kind).agg(F.count(F.lit(1)).alias("n_events"))


def windowed_counters(stream: DataFrame, event_time: str, kind: str, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Counters by event-time window, final once the watermark has passed."""
    return stream.withWatermark(event_time, delay).groupBy(F.window(event_time, window), kind).agg(F.count(F.lit(1)).alias("n_events"))


def missing_from(read_silver: Callable[[], DataFrame], key: str, process: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that hands on only the rows the typed table lacks, read anew for each batch."""

    def run(batch: DataFrame, epoch: int) -> None:
        held = read_silver().select(F.col(key).cast("string").alias("_key")).distinct()
        process(batch.withColumn("_key", F.col(key).cast("string")).join(held, "_key", "left_anti").drop("_key"), epoch)

    return run


def failures_in_a_row(stream: DataFrame, run: str, order: str, failed: str, limit: int = 3) -> DataFrame:
    """(run, order, n_in_a_row) whenever a run's failures in a row reach ``limit``; the state of a run is one number."""
    kind, when = stream.schema[run].dataType.simpleString(), stream.schema[order].dataType.simpleString()

    def step(key, batches: Iterator, state) -> Iterator:
        import pandas as pd

        n = state.get[0] if state.exists else 0
        out = []
        for pdf in batches:
            for o, f in pdf.sort_values(order)[[order, failed]].itertuples(index=False):
                n = n + 1 if f else 0
                if n >= limit:
                    out.append((key[0], o, n))
        state.update((n,))
        yield pd.DataFrame(out, columns=[run, order, "n_in_a_row"])

    return stream.groupBy(run).applyInPandasWithState(step, f"{run} {kind}, {order} {when}, n_in_a_row long", "n long", "append", "NoTimeout")
