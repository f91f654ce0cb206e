"""Request rates over sliding windows, in batch and as streams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Limits:
    per_minute: int = 60
    per_hour: int = 1_000
    burst: int = 10
    cooldown_seconds: int = 300


def window_counts(events: DataFrame, key: str, time: str = "ts") -> DataFrame:
    """Each event with its key's requests of the last minute and hour, itself included."""
    second = F.unix_micros(F.col(time).cast("timestamp"))
    order = Window.partitionBy(key).orderBy("at")
    minute, hour = (order.rangeBetween(-n * 1_000_000 + 1, 0) for n in (60, 3_600))
    return events.withColumn("at", second).withColumn("minute_count", F.count(F.lit(1)).over(minute)).withColumn("hour_count", F.count(F.lit(1)).over(hour)).drop("at")


def limit_flags(counted: DataFrame, limits: Limits) -> DataFrame:
    """Events of ``window_counts`` with whether the requests before them left room."""
    return counted.withColumn("allowed", (F.col("minute_count") <= limits.per_minute) & (F.col("hour_count") <= limits.per_hour)).withColumn("near_limit", F.col("minute_count") > 0.8 * limits.per_minute)


def per_minute(events: DataFrame, time: str = "ts", value: str = "value", kind: str = "event_type") -> DataFrame:
    """Tumbling minutes, of a batch or a stream."""
    grouped = events.groupBy(F.window(F.col(time).cast("timestamp"), "1 minute").alias("w"), kind)
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("minute"), kind, "n", "total")


def sliding_hours(stream: DataFrame, key: str, time: str = "ts", lateness: str = "1 hour", slide: str = "1 minute") -> DataFrame:
    """Requests per key of each hour that starts at a full ``slide``, with late events up to a watermark."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, lateness)
    return timed.groupBy(F.window(time, "1 hour", slide).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def sessions(events: DataFrame, key: str, gap: str = "30 minutes", time: str = "ts") -> DataFrame:
    """Runs of events of a key without a longer gap."""
    grouped = events.groupBy(F.session_window(F.col(time).cast("timestamp"), gap).alias("w"), key)
    return grouped.agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def distinct_events(stream: DataFrame, key: str, time: str = "ts", lateness: str = "1 hour") -> DataFrame:
    """A stream without events whose key came before within the watermark: a cache of seen keys that expires."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, lateness).dropDuplicatesWithinWatermark([key])


def admit(times: list[float], limits: Limits) -> list[str]:
    """Decision for each request of one key, in order of time: ``ok``, ``cooldown``, ``burst``, ``minute`` or ``hour``.

    Refused requests aren't recorded.  Each recorded one beyond 0.8 of a minute's
    limit adds to the burst, any other clears it; a full burst starts a cooldown.
    """
    state: tuple[list[float], int, float] = ([], 0, float("-inf"))
    out = []
    for now in times:
        decision, state = step(now, state, limits)
        out.append(decision)
    return out


def step(now: float, state: tuple[list[float], int, float], limits: Limits) -> tuple[str, tuple[list[float], int, float]]:
    recent, burst, until = state
    recent = [t for t in recent if t > now - 3_600]
    if now < until:
        return "cooldown", (recent, burst, until)
    if burst >= limits.burst:
        return "burst", (recent, burst, now + limits.cooldown_seconds)
    if sum(t > now - 60 for t in recent) >= limits.per_minute:
        return "minute", (recent, burst, until)
    if len(recent) >= limits.per_hour:
        return "hour", (recent, burst, until)
    recent = [*recent, now]
    near = sum(t > now - 60 for t in recent) > 0.8 * limits.per_minute
    return "ok", (recent, burst + 1 if near else 0, until)


def admissions(stream: DataFrame, key: str, limits: Limits, time: str = "ts") -> DataFrame:
    """(key, at, decision) of a stream of requests: the limiter's state lives in the state store, per key.

    A key's state holds at most one hour of admitted requests (``per_hour`` of them)
    and is dropped after an hour without a request.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    key_type = stream.schema[key].dataType.simpleString()

    def update(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = (list(state.get[0]), state.get[1], state.get[2]) if state.exists else ([], 0, float("-inf"))
        times = sorted(t for frame in frames for t in frame["at"])
        rows = []
        for now in times:
            decision, held = step(now, held, limits)
            rows.append((name[0], now, decision))
        state.update((held[0], held[1], held[2]))
        state.setTimeoutDuration(3_600_000)
        yield pd.DataFrame(rows, columns=[key, "at", "decision"])

    timed = stream.select(key, (F.unix_micros(F.col(time).cast("timestamp")) / 1e6).alias("at"))
    return timed.groupBy(key).applyInPandasWithState(update, f"{key} {key_type}, at double, decision string", "recent array<double>, burst int, until double", "append", GroupStateTimeout.ProcessingTimeTimeout)


def timings(events: DataFrame, name: str = "event_type", value: str = "value") -> DataFrame:
    """Count, total, least, most and mean of each operation."""
    return events.groupBy(name).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"))
