"""Streaming forms of refresh, deduplication, sessions and expiry."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ctxspark.operators.lifecycle import ingestion_outcomes, latest
from ctxspark.runtime import shared_dir


def arrivals(spark: SparkSession, path: str, schema, files_per_trigger: int = 500) -> DataFrame:
    """New Parquet files of a folder, at most so many in a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def first_of_content(stream: DataFrame, key: list[str], time: str, late: str) -> DataFrame:
    """The first row of each key; keys are forgotten when the watermark has passed them."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def session_counts(events: DataFrame, user: str, time: str, gap: str, late: str | None = None) -> DataFrame:
    """Sessions of each user: stretches of events less than `gap` apart (user, started, ended,
    n_events). Works on a table and, with `late`, on a stream."""
    timed = events.withColumn("_t", F.col(time).cast("timestamp"))
    timed = timed.withWatermark("_t", late) if late else timed
    s = timed.groupBy(F.session_window("_t", gap).alias("w"), F.col(user)).agg(F.count("*").alias("n_events"))
    return s.select(user, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n_events")


def ingestion_state(spark: SparkSession, state_dir: str, schema: T.StructType, n: int, full_every: int = 50) -> DataFrame:
    """The state before batch `n`: the newest row of each path in the versions from the last whole one on."""
    if n == 0:
        return spark.createDataFrame([], schema)
    start = (n - 1) // full_every * full_every
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("v", T.IntegerType())])).option("basePath", state_dir).parquet(*[f"{state_dir}/v={i}" for i in range(start, n)])
    newest = rows.groupBy("project_id", "source_path").agg(F.max_by(F.struct(*schema.names), "v").alias("x"))
    return newest.select("x.*").select(*schema.names)


def run_ingestion(stream: DataFrame, state_dir: str, checkpoint: str, full_every: int = 50) -> None:
    """Takes all waiting documents into the state, micro-batch by micro-batch.

    stream: project_id, source_path, content_hash, created_at, doc_id. Each batch writes what it
    changes as a version of its own, numbered by the batch, so that a repeated batch writes the same
    again; every `full_every` batches the version is the whole state, and reading goes back no
    further. Duplicates by path and hash change nothing."""

    def upsert(batch: DataFrame, n: int) -> None:
        state = ingestion_state(batch.sparkSession, state_dir, batch.schema, n, full_every)
        new = latest(batch, ["project_id", "source_path"], [F.desc("created_at"), F.desc("doc_id")])
        changed = ingestion_outcomes(new, state).where("outcome <> 'duplicate'").drop("outcome").select(*batch.schema.names)
        if n % full_every == 0:
            changed = state.join(changed.select("project_id", "source_path"), ["project_id", "source_path"], "left_anti").select(*batch.schema.names).unionByName(changed)
        changed.write.mode("overwrite").parquet(f"{state_dir}/v={n}")

    stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def expiring(stream: DataFrame, key: str, time: str, after_s: int, late: str) -> DataFrame:
    """Keys without a row for `after_s` seconds of event time (key, last_seen), each when it expires."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({key: [k[0]], "last_seen": [pd.Timestamp(last, unit="us")]})
            return
        last = state.get[0] if state.exists else 0
        for f in frames:
            last = max(last, int(f["_t"].max().value // 1000))
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + after_s * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [], "last_seen": []}).astype({"last_seen": "datetime64[us]"})

    kind = stream.schema[key].dataType.simpleString()
    timed = stream.select(F.col(key), F.col(time).cast("timestamp").alias("_t")).withWatermark("_t", late)
    return timed.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, last_seen timestamp", "last long", "append", "EventTimeTimeout")


def counted_windows(spark: SparkSession, path: str, time: str, by: str, width: str) -> DataFrame:
    """Rows per window and kind of a folder (or file) read as a stream to its end: by, started, n_rows."""
    schema = spark.read.parquet(path).schema
    # as a pattern, since the file source takes only folders otherwise
    stream = arrivals(spark, f"{path[:-1]}[{path[-1]}]", schema).withColumn("_t", F.col(time).cast("timestamp"))
    counts = stream.groupBy(F.window("_t", width).alias("w"), F.col(by)).agg(F.count("*").alias("n_rows"))
    place = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    done: list[int] = []

    def keep(batch: DataFrame, n: int) -> None:
        batch.select(by, F.col("w.start").alias("started"), "n_rows").write.mode("overwrite").parquet(f"{place}/{n}")
        done.append(n)

    query = counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{place}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{place}/{max(done)}")
