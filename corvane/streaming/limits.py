"""Limits on streams of requests: token buckets with keyed state, daily windows, last stage of a job."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corvane.functions import lookups as L
from corvane.runtime import ship


def take(tokens: float, last: float | None, now: float, per_hour: int) -> tuple[bool, int, float]:
    """(allowed, seconds to wait, tokens left) of one request at `now`, with the tokens left at `last`."""
    rate = per_hour / 3600.0
    tokens = float(per_hour) if last is None else min(per_hour, tokens + (now - last) * rate)
    return (True, 0, tokens - 1) if tokens >= 1 else (False, int((1 - tokens) / rate) + 1, tokens)


_OUT = pa.schema([("key", pa.string()), ("id", pa.int64()), ("at", pa.float64()), ("allowed", pa.bool_()), ("wait", pa.int64())])


def _bucket(per_hour: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tokens, last = None, 0.0, None
        for b in batches:
            keys, ids, ats = (c.to_pylist() for c in b.columns)
            allowed, waits = [], []
            for k, now in zip(keys, ats, strict=True):
                if k != key:
                    key, tokens, last = k, 0.0, None
                ok, wait, tokens = take(tokens, last, now, per_hour)
                last = now
                allowed.append(ok)
                waits.append(wait)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(ids, pa.int64()), pa.array(ats, pa.float64()), pa.array(allowed, pa.bool_()), pa.array(waits, pa.int64())], schema=_OUT)

    return run


def token_bucket(requests: DataFrame, per_hour: int = L.BUCKET_PER_HOUR) -> DataFrame:
    """key, id, at, allowed, wait of requests (key, id, at in seconds). A key's requests stream through one task in time order, holding one number."""
    ship(requests.sparkSession)
    rows = requests.select(F.col("key").cast("string"), F.col("id").cast("long"), F.col("at").cast("double"))
    return rows.repartition("key").sortWithinPartitions("key", "at", "id").mapInArrow(_bucket(per_hour), "key string, id long, at double, allowed boolean, wait long")


def _keyed_bucket(per_hour: int, ordered: bool):
    fill = 3600.0  # seconds in which an empty bucket is full again: it holds an hour's requests

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last, ids, ats = state.get if state.exists else (0.0, None, [], [])
        waiting = list(zip(ats, ids, strict=True))
        for f in frames:
            waiting += zip(f["at"].astype(float), f["id"].astype(int), strict=True)
        mark, out = state.getCurrentWatermarkMs() / 1000, []
        waiting.sort()
        due = [x for x in waiting if x[0] <= mark] if ordered else waiting
        for now, id_ in due:
            ok, wait, tokens = take(tokens, last, now, per_hour)
            last = max(now, last or now)
            out.append((key[0], id_, now, ok, wait))
        waiting = waiting[len(due) :]
        if not waiting and (last is None or mark >= last + fill):
            state.remove()
        else:
            state.update((tokens, last, [i for _, i in waiting], [a for a, _ in waiting]))
            state.setTimeoutTimestamp(int(max((waiting[0][0] if waiting else last + fill), mark) * 1000) + 1)
        yield pd.DataFrame(out, columns=["key", "id", "at", "allowed", "wait"]).astype({"id": "int64", "at": "float64", "allowed": "bool", "wait": "int64"})

    return step


def token_bucket_stream(requests: DataFrame, per_hour: int = L.BUCKET_PER_HOUR, late: str = "10 minutes", ordered: bool = False) -> DataFrame:
    """The same over a stream. Requests are decided as they arrive, or, ordered, once the watermark (`late` behind the newest) has passed them.

    Ordered, neither the order of arrival nor restarts matter, and a replay gives what token_bucket gives over a table. What comes later
    than `late` is dropped. State of a key: two numbers, and ordered the requests that wait. A key leaves the state when
    the watermark passes the time at which its bucket is full again, as it then is like one never seen.
    """
    ship(requests.sparkSession)
    rows = requests.select(F.col("key").cast("string"), F.col("id").cast("long"), F.col("at").cast("double"), F.timestamp_micros((F.col("at") * 1_000_000).cast("long")).alias("time")).withWatermark("time", late)
    held = "tokens double, last double, ids array<long>, ats array<double>"
    return rows.groupBy("key").applyInPandasWithState(_keyed_bucket(per_hour, ordered), "key string, id long, at double, allowed boolean, wait long", held, "append", GroupStateTimeout.EventTimeTimeout)


def sessions(events: DataFrame, days: int = 30) -> DataFrame:
    """who, began, ended, events: sessions of a table of events (who, at as a timestamp); a session ends when nothing happens for so many days."""
    s = events.groupBy("who", F.session_window("at", f"{days} days")).agg(F.count("*").alias("events"))
    return s.select("who", F.col("session_window.start").alias("began"), F.col("session_window.end").alias("ended"), "events")


def sessions_stream(events: DataFrame, days: int = 30, late: str = "1 day") -> DataFrame:
    """The same over a stream: a session is told once the watermark has passed its end, and leaves the state then."""
    return sessions(events.withWatermark("at", late), days)


def daily_usage_stream(requests: DataFrame, at: str = "ts", late: str = "1 day", limit: int = L.QUOTA["member"]) -> DataFrame:
    """who, day, n, over: requests by UTC day with a watermark; over tells whether the day's allowance is used up."""
    w = requests.withWatermark(at, late).groupBy("who", F.window(at, "1 day")).agg(F.count("*").alias("n"))
    return w.select("who", F.col("window.start").cast("date").alias("day"), "n", (F.col("n") >= limit).alias("over"))


def last_stage(progress: DataFrame) -> DataFrame:
    """job, stage, at: the latest stage of each job in a stream or table of progress (job, stage, at, seq)."""
    return progress.groupBy("job").agg(F.max_by("stage", F.struct("at", "seq")).alias("stage"), F.max("at").alias("at"))
