"""Structured Streaming forms of the incremental passes: score what is new, latest states, windows, ledgers."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def score_new(stream: DataFrame, done: Callable[[], DataFrame], score: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame], object], checkpoint: str, once: bool = True, mark: Callable[[DataFrame], object] | None = None) -> StreamingQuery:
    """Score posts of a stream that done() does not hold yet, and append them to a sink.

    A batch that is replayed after a failure finds its rows in done() and adds none twice. mark, if
    given, is called after the sink's write succeeded, so nothing is marked that was not stored.
    """

    def batch(df: DataFrame, _: int) -> None:
        new = df.where(F.length(F.trim("text")) > 0).dropDuplicates(["platform_post_id"]).join(done().select("platform_post_id"), "platform_post_id", "left_anti")
        scored = score(new).persist()
        try:
            sink(scored)
            if mark:
                mark(scored)
        finally:
            scored.unpersist()

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()


def hourly_counts(stream: DataFrame, lookback: str = "14 days") -> DataFrame:
    """Posts per hour; rows later than lookback are left to a batch repair."""
    return stream.withWatermark("created_at", lookback).groupBy(F.window("created_at", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("hr"), "n")


def hashtag_counts(stream: DataFrame, lookback: str = "8 days") -> DataFrame:
    """Hashtags per day, from which bursts are judged."""
    tags = stream.withWatermark("created_at", lookback).select("created_at", F.explode(F.transform("hashtags", F.lower)).alias("tag"))
    return tags.groupBy(F.window("created_at", "1 day").alias("w"), "tag").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("day"), "tag", "n")


def without_repeats(stream: DataFrame, within: str = "14 days") -> DataFrame:
    """Snapshots of a post at one collection time, once."""
    return stream.withWatermark("collected_at", within).dropDuplicatesWithinWatermark(["platform_post_id", "collected_at"])


def newest_snapshots(stream: DataFrame) -> DataFrame:
    """The newest snapshot of every post that a batch touches (update mode), in any order of arrival.

    State is one row per post and stays in the JVM. A sink that keeps a post's newest row is right after
    a replayed batch too.
    """
    newest = F.max_by("type", F.struct("collected_at", "type")).alias("type")
    return stream.groupBy("platform_post_id").agg(newest, F.unix_micros(F.max("collected_at")).alias("collected_us"))


def latest_state(stream: DataFrame, ttl_ms: int = 14 * 86_400_000) -> DataFrame:
    """As newest_snapshots, but a row only when a newer snapshot arrives, and no state of posts silent for ttl_ms.

    A Python call per post and batch: for streams whose posts go quiet and are too many to be kept.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        newest = state.get[0] if state.exists else None
        best = None
        for pdf in batches:
            row = pdf.loc[pdf["collected_us"].idxmax()]
            if newest is None or row["collected_us"] > newest:
                newest, best = int(row["collected_us"]), row
        if newest is not None:
            state.update((newest,))
            state.setTimeoutDuration(ttl_ms)
        if best is not None:
            yield pd.DataFrame({"platform_post_id": [key[0]], "type": [best["type"]], "collected_us": [newest]})

    rows = stream.select("platform_post_id", "type", F.unix_micros("collected_at").alias("collected_us"))
    return rows.groupBy("platform_post_id").applyInPandasWithState(step, "platform_post_id string, type string, collected_us long", "newest long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def visit_ledger(stream: DataFrame, key: str) -> DataFrame:
    """Last visit of every key so far (complete mode), against which due() is asked."""
    return stream.groupBy(key).agg(F.max("visited_at").alias("visited_at"))


def due_by_ttl(visits: DataFrame, items: DataFrame, key: str, as_of: str, hours: dict[str, int]) -> DataFrame:
    """items (key, lane) whose last visit is older than their lane's hours, or that had none; an unknown lane is never due."""
    ttl = F.create_map(*[F.lit(x) for kv in hours.items() for x in kv])
    last = visits.groupBy(key).agg(F.max("visited_at").alias("_last"))
    wait = F.element_at(ttl, F.col("lane"))
    age = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros("_last")) / 3.6e9
    return items.where(F.col(key).isNotNull() & wait.isNotNull()).join(last, key, "left").where(F.col("_last").isNull() | (age >= wait)).drop("_last")


def in_flushes(items: list, fetch: Callable[[object], DataFrame], sink: Callable[[DataFrame], object], mark: Callable[[list], object], every: int = 25) -> tuple[int, list]:
    """Fetch items one by one and store what came in every so many; items are marked done only after their rows are stored.

    A fetch that fails leaves its item unmarked and the rest go on. Returns the number marked and the failures.
    """
    done, failed, rows, waiting = 0, [], None, []

    def flush() -> None:
        nonlocal done, rows, waiting
        if waiting:
            if rows is not None:
                sink(rows)
            mark(waiting)
            done += len(waiting)
        rows, waiting = None, []

    for item in items:
        try:
            got = fetch(item)
        except Exception as e:  # noqa: BLE001
            failed.append((item, str(e)))
            continue
        rows = got if rows is None else rows.unionByName(got)
        waiting.append(item)
        if len(waiting) >= every:
            flush()
    flush()
    return done, failed


def run_loop(passes: dict[str, Callable[[], int]], cycles: int | None = None, busy: float = 5.0, idle: tuple[float, float] = (60.0, 180.0), periodic: dict[str, tuple[Callable[[], object], float, float]] | None = None, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic, seed: int | None = None) -> list[dict]:
    """Bounded passes over and over: soon again while there is work, after a jittered pause else.

    A pass gives the number of rows it did; one that fails is noted and stops no other. periodic names jobs
    with their interval and, after a failure, their retry interval in seconds; they run before the passes,
    so a backlog cannot put them off. Returns what each cycle did (cycles=None: never returns).
    """
    jitter, log, due, k = random.Random(seed), [], dict.fromkeys(periodic or {}, clock()), 0
    while cycles is None or k < cycles:
        k += 1
        entry: dict = {"done": {}, "failed": {}, "ran": []}
        for name, (job, each, again) in (periodic or {}).items():
            if clock() >= due[name]:
                try:
                    job()
                    due[name] = clock() + each
                    entry["ran"].append(name)
                except Exception as e:  # noqa: BLE001
                    due[name] = clock() + again
                    entry["failed"][name] = str(e)
        for name, step in passes.items():
            try:
                entry["done"][name] = step()
            except Exception as e:  # noqa: BLE001
                entry["failed"][name] = str(e)
        entry["wait"] = busy if sum(entry["done"].values()) else jitter.uniform(*idle)
        if cycles is not None:
            log.append(entry)
        sleep(entry["wait"])
    return log
