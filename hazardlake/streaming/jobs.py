"""Streaming jobs: ingest, counters, windows, duplicates, gates, stores.

Every sink writes a folder named by the micro-batch, replaced when a batch is replayed,
so results are exactly-once although sources are at-least-once. Checkpoints and tables
live in a shared folder the caller names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from hazardlake.operators import feed


def write_batch(batch: DataFrame, target: str, batch_id: int) -> None:
    """Write one micro-batch to its own folder of a table."""
    batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")


@contextmanager
def kept_once(batch: DataFrame) -> Iterator[None]:
    """Hold a micro-batch that several writes read, and let go of it also when one fails."""
    batch.persist()
    try:
        yield
    finally:
        batch.unpersist()


def start(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str,
          mode: str = "append", every: str | None = None) -> StreamingQuery:
    """Start a job; without ``every`` it processes what is there and ends."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def run(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Process everything available, then return."""
    start(stream, sink, checkpoint, mode).awaitTermination()


def table_sink(target: str) -> Callable[[DataFrame, int], None]:
    return lambda batch, batch_id: write_batch(batch, target, batch_id)


def read_table(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(target).drop("batch")


def read_last(spark: SparkSession, target: str) -> DataFrame:
    """The newest batch of a table whose batches each hold a whole result."""
    t = spark.read.parquet(target)
    return t.filter(F.col("batch") == t.agg(F.max("batch")).scalar()).drop("batch")


def read_updates(spark: SparkSession, target: str, keys: list[str]) -> DataFrame:
    """The last version of each key of a table written in update mode."""
    t = spark.read.parquet(target)
    row = F.struct(*[c for c in t.columns if c != "batch"])
    return t.groupBy(*keys).agg(F.max_by(row, "batch").alias("__row")).select("__row.*")


# --- counters and windows ------------------------------------------------------------------

def running_counts(stream: DataFrame) -> DataFrame:
    """Posts by platform and type since the start; the state is one row per pair."""
    return stream.groupBy("platform", "post_type").agg(F.count(F.lit(1)).alias("n"))


def windowed_counts(stream: DataFrame, size: str, delay: str, keys: list[str], slide: str | None = None,
                    ts: str = "ts") -> DataFrame:
    """Counts per key in tumbling (or, with ``slide``, sliding) event-time windows.

    In append mode a window comes out once the watermark has passed its end. In update mode
    every batch gives the new counts of the windows it touched, so ``read_updates`` also shows
    windows that are still open. Rows later than ``delay`` are dropped.
    """
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return (stream.withWatermark(ts, delay).groupBy(w.alias("w"), *keys)
            .agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n",
                    (F.col("n") / (F.unix_seconds("w.end") - F.unix_seconds("w.start"))).alias("rate")))


def spikes(counts: DataFrame, keys: list[str], back: int, factor: float, mass: int = 10) -> DataFrame:
    """Windows whose count is at least ``factor`` times the mean of the key's last windows.

    Windows without posts do not exist and do not enter the mean. ``mass`` marks windows
    with that many posts or more.
    """
    from pyspark.sql import Window

    trailing = Window.partitionBy(*keys).orderBy("start").rowsBetween(-back, -1)
    out = counts.withColumn("trailing_mean", F.avg("n").over(trailing))
    return (out.withColumn("mass_event", F.col("n") >= mass)
            .filter((F.col("n") >= F.col("trailing_mean") * factor) & F.col("trailing_mean").isNotNull()))


def spike_stream(stream: DataFrame, keys: list[str], size_s: int, delay: str, back: int, factor: float, mass: int = 10,
                 ts: str = "ts") -> DataFrame:
    """``spikes`` of tumbling windows inside the running query: an alert comes out in the
    micro-batch whose watermark closes its window.

    The state of a key is the counts of its open windows and a ring of those of its last
    ``back`` closed ones; a timer at the end of the first open window closes it without new
    posts. Posts are counted by key and window where they are read, so a key with a third of a
    batch sends few rows to its state. A post of a closed window is late and not counted.
    """
    types = dict(stream.dtypes)
    names = [*keys, "start", "n", "trailing_mean", "mass_event"]
    size = size_s * 1000

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            part["win"] = part["ms"] // size * size
            yield part.groupby([*keys, "win"], as_index=False, dropna=False).agg(seen_at=(ts, "max"), n=("ms", "size"))

    def alert(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        starts, counts, ring = (list(x) for x in state.get) if state.exists else ([], [], [])
        mark, open_ = state.getCurrentWatermarkMs(), dict(zip(starts, counts))
        if not state.hasTimedOut:
            for part in parts:
                for start, n in zip(part["win"], part["n"]):
                    if start + size > mark:
                        open_[int(start)] = open_.get(int(start), 0) + int(n)
        out = []
        for start in sorted(x for x in open_ if x + size <= mark):
            n = open_.pop(start)
            if ring and n >= sum(ring) / len(ring) * factor:
                out.append((*key, pd.Timestamp(start, unit="ms"), n, sum(ring) / len(ring), n >= mass))
            ring = [*ring, n][-back:]
        state.update((sorted(open_), [open_[x] for x in sorted(open_)], ring))
        if open_:
            state.setTimeoutTimestamp(max(min(open_) + size, mark + 1))
        if out:
            yield pd.DataFrame(out, columns=names)

    fields = ", ".join(f"{k} {types[k]}" for k in keys)
    folded = stream.select(*keys, ts, F.unix_millis(ts).alias("ms")).mapInPandas(fold, f"{fields}, win long, seen_at timestamp, n long")
    return folded.withWatermark("seen_at", delay).groupBy(*keys).applyInPandasWithState(
        alert, f"{fields}, start timestamp, n long, trailing_mean double, mass_event boolean",
        "starts array<long>, counts array<long>, ring array<long>", "append", GroupStateTimeout.EventTimeTimeout)


# --- duplicates -------------------------------------------------------------------------------

def drop_duplicates(stream: DataFrame, key: list[str], delay: str, ts: str = "ts") -> DataFrame:
    """First row per key; a key is remembered for ``delay`` of event time.

    The state keeps the newest keys by time. A memory cut to a number of arbitrary ids
    would forget recent ones; this one does not.
    """
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(key)


def dedup_sink(target: str, key: list[str], arrival: list[str]) -> Callable[[DataFrame, int], None]:
    """First row per key against everything earlier batches wrote; no key is forgotten.

    Copies inside a batch are folded before the shuffle, so a key with very many copies
    is no burden. A replay ignores what its own batch wrote before. Each batch reads the keys
    of the whole table; a job without end uses ``drop_duplicates``, whose state is bounded by
    event time.
    """
    def sink(batch: DataFrame, batch_id: int) -> None:
        rank = F.struct(*[F.col(c) for c in arrival])
        fresh = batch.groupBy(*key).agg(F.min_by(F.struct(*batch.columns), rank).alias("r")).select("r.*")
        if batch_id > 0:
            seen = (batch.sparkSession.read.schema(batch.select(*key).schema.add("batch", "integer")).parquet(target)
                    .filter(F.col("batch") < batch_id))
            fresh = fresh.join(seen.select(*key), key, "left_anti")
        write_batch(fresh, target, batch_id)

    return sink


def remember_ids(stream: DataFrame, key: str, ttl_ms: int, delay: str = "1 hour", ts: str = "ts") -> DataFrame:
    """First arrival of every id, remembered until ``ttl_ms`` of event time after its last.

    Each id is its own small state; expired ids leave the store. Repeats are folded where
    they are read, so an id that makes up a third of a batch sends few rows to its state.
    """
    kind = dict(stream.dtypes)[key]

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.groupby(key, as_index=False, dropna=False).agg(seen_at=(ts, "max"), ms=("ms", "max"))

    def seen(k: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        newest = max(int(part["ms"].max()) for part in rows)
        if not state.exists:
            yield pd.DataFrame({key: [k[0]]})
        state.update((True,))
        state.setTimeoutTimestamp(max(newest + ttl_ms, state.getCurrentWatermarkMs() + 1))

    folded = stream.select(key, ts, F.unix_millis(ts).alias("ms")).mapInPandas(
        fold, f"{key} {kind}, seen_at timestamp, ms long")
    return folded.withWatermark("seen_at", delay).groupBy(key).applyInPandasWithState(
        seen, f"{key} {kind}", "seen boolean", "append", GroupStateTimeout.EventTimeTimeout)


# --- gates and tables ---------------------------------------------------------------------------

def gate_sink(target: str, verdict: str = "verdict", extracted: str = "extracted") -> Callable[[DataFrame, int], None]:
    """Per micro-batch: kept, discarded and failed rows to tables, and a row of counters."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        with kept_once(batch):
            kept, discarded = feed.route_posts(batch, verdict, extracted)
            write_batch(kept.filter("error is null"), f"{target}/kept", batch_id)
            write_batch(kept.filter("error is not null"), f"{target}/failed", batch_id)
            write_batch(discarded, f"{target}/discarded", batch_id)
            genuine = F.coalesce(F.col(verdict)["is_genuine"], F.lit(False))
            write_batch(feed.gate_rates(batch, genuine, F.col(extracted).isNotNull()), f"{target}/counters", batch_id)

    return sink


def dead_letter_sink(target: str, corrupt: str = "_corrupt_record") -> Callable[[DataFrame, int], None]:
    """Readable rows to one table, raw text of the others to the dead-letter table."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        with kept_once(batch):
            write_batch(batch.filter(F.col(corrupt).isNull()).drop(corrupt), f"{target}/good", batch_id)
            write_batch(batch.filter(F.col(corrupt).isNotNull()).select(corrupt), f"{target}/dead", batch_id)

    return sink


def late_sink(target: str, ts: Column, now: Column, hours: float = 48) -> Callable[[DataFrame, int], None]:
    """Rows inside the age limit to one table, late rows to a side table."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        fresh = feed.recent(ts, now, hours)
        with kept_once(batch):
            write_batch(batch.filter(fresh), f"{target}/fresh", batch_id)
            write_batch(batch.filter(~fresh), f"{target}/late", batch_id)

    return sink


def serving_sink(target: str, n: int = 10_000, key: str = "id", arrival: tuple[str, ...] = ("ts", "id")) -> Callable[[DataFrame, int], None]:
    """Keep the newest ``n`` posts, the first copy of an id, as a whole table per batch.

    A batch reads the table of the batch before it, so a replay gives the same result.
    """
    def sink(batch: DataFrame, batch_id: int) -> None:
        rows = batch
        if batch_id > 0:
            before = batch.sparkSession.read.schema(batch.schema).parquet(f"{target}/batch={batch_id - 1}")
            rows = before.unionByName(batch)
        rows = feed.first_by_id(rows, key, list(arrival))
        write_batch(feed.retain_newest(rows, n, arrival), target, batch_id)

    return sink


def upsert_sink(target: str) -> Callable[[DataFrame, int], None]:
    """Append report versions; ``read_reports`` shows the last version of each id."""
    return table_sink(target)


def read_reports(spark: SparkSession, target: str, key: str = "id", version: str = "updated_at") -> DataFrame:
    """Latest version per id; of equal versions the one written last."""
    return feed.latest_by_id(spark.read.parquet(target), key, [version, "batch"]).drop("batch")


def compact_reports(spark: SparkSession, target: str, fresh: str, key: str = "id", version: str = "updated_at") -> None:
    """Write the current versions as the first batch of a new table."""
    write_batch(read_reports(spark, target, key, version), fresh, 0)


def record_hook_sink(hook: Callable[[DataFrame, int], DataFrame], target: str) -> Callable[[DataFrame, int], None]:
    """The caller's own processing of a micro-batch, its result stored like any other."""
    return lambda batch, batch_id: write_batch(hook(batch, batch_id), target, batch_id)


def retention_tier(ts: Column, now: Column) -> Column:
    """'realtime' up to 24 hours, 'trend' to 30 days, 'metrics' to 90 days, then 'expired'."""
    age = feed.age_hours(ts, now)
    return (F.when(age <= 24, "realtime").when(age <= 24 * 30, "trend")
            .when(age <= 24 * 90, "metrics").otherwise("expired"))
