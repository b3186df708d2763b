"""Keyed state and timers: readings against their container's latest state, and collection
events of buckets that arrive in any order.

Both are stateful processors on a state store that keeps keys on disk (`use_disk_state`), so a
batch reads and writes what it touches, not a snapshot of all. Keys are dealt to groups by hash: a
call of Python costs milliseconds, so it takes the keys of a group at once, in numpy. They replace per-batch
snapshots where a stream's output is enough; the operators in `readings` and `history` are their
batch twins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from binflow.functions import times
from binflow.operators.history import PARTIAL_DROP, STRONG_DROP
from binflow.session import ship_package

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_FIRST = np.iinfo(np.int64).min
#: Groups that the keys of a stream are dealt to. The state of a group goes through memory whole.
GROUPS = 1024


def use_disk_state(spark: SparkSession) -> None:
    """Stateful processors need a store with column families."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    ship_package(spark)


def run_available(frame: DataFrame, out: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Work off what the source holds, as files in `out`; ends when all is done."""
    query = frame.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


READING = "container_id bigint, seq bigint, at bigint, level int, collected boolean, accepted boolean, level_old int, current_level int, last_at bigint, pickup_at bigint"
_COLUMNS = [c.split()[0] for c in READING.split(", ")]


class LatestState(StatefulProcessor):
    """Each container's level, newest reading and newest pickup. A reading counts if it is newer than
    all that counted before it; a late one goes out as such and changes nothing.

    A call takes the containers of a group together; the state is their rows, by container."""

    ROW = np.dtype([("key", "<i8"), ("level", "<i4"), ("last", "<i8"), ("pickup", "<i8")])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("latest", "rows binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # A container's readings of one batch, in the order of arrival.
        batch = pd.concat(list(rows))
        batch = batch.iloc[np.lexsort((batch["seq"].to_numpy(), batch["container_id"].to_numpy()))]
        ids, at, level = (batch[c].to_numpy(np.int64) for c in ("container_id", "at", "level"))
        begin = _begins(ids)
        part = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(ids))))
        held = np.frombuffer(self.state.get()[0], self.ROW) if self.state.exists() else np.empty(0, self.ROW)
        place, known = _found(held["key"], ids[begin])
        start = np.zeros(len(begin), self.ROW)
        start["last"] = start["pickup"] = _FIRST
        start[known] = held[place[known]]
        start["key"] = ids[begin]
        top = pd.Series(at).groupby(part).cummax().to_numpy()
        before = np.append(_FIRST, top[:-1])
        before[begin] = _FIRST
        accepted = at > np.maximum(before, start["last"][part])
        picked = accepted & batch["collected"].to_numpy(bool)
        # The last row that counted, up to each row and before it; -1 where none did in this batch.
        on, up = (np.maximum.accumulate(np.where(x, np.arange(len(at)), -1)) for x in (accepted, picked))
        on, up = (np.where(x >= begin[part], x, -1) for x in (on, up))
        earlier = np.append(-1, on[:-1])
        earlier[begin] = -1
        out = pd.DataFrame({"container_id": ids, "seq": batch["seq"].to_numpy(), "at": at, "level": level, "collected": batch["collected"].to_numpy(), "accepted": accepted})
        out["level_old"] = pd.array(np.where(earlier >= 0, level[earlier], start["level"][part]), "Int64")
        out.loc[(earlier < 0) & ~known[part], "level_old"] = pd.NA
        out["current_level"] = np.where(on >= 0, level[on], start["level"][part])
        out["last_at"] = np.maximum(top, start["last"][part])
        pickups = np.where(up >= 0, at[up], start["pickup"][part])
        out["pickup_at"] = pd.array(pickups, "Int64")
        out.loc[pickups == _FIRST, "pickup_at"] = pd.NA
        end = np.append(begin[1:], len(ids)) - 1
        for field, column in (("level", "current_level"), ("last", "last_at")):
            start[field] = out[column].to_numpy(np.int64)[end]
        start["pickup"] = pickups[end]
        self.state.update((_merged(held, start, place[known]).tobytes(),))
        yield out[_COLUMNS]

    def close(self) -> None:
        pass


def _begins(keys: np.ndarray) -> np.ndarray:
    """Where the runs of equal keys begin."""
    return np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))


def _found(held: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each key in the ascending `held`, and whether it is there."""
    place = np.minimum(np.searchsorted(held, keys), max(0, len(held) - 1))
    return place, held[place] == keys if len(held) else np.zeros(len(keys), bool)


def _merged(held: np.ndarray, new: np.ndarray, replaced: np.ndarray) -> np.ndarray:
    """Rows by key: `new` ones, and those of `held` but for the `replaced`."""
    both = np.concatenate([np.delete(held, replaced), new])
    return both[np.argsort(both["key"])]


def _group(key: str, groups: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(groups)).cast("int").alias("_group")


def followed_readings(readings: DataFrame, groups: int = GROUPS) -> DataFrame:
    """Readings with `accepted`, the level accepted before each, and the container's state after it.

    readings, a stream: container_id, seq (arrival), reading_date, level, collected. Readings
    without a container, a date or a level are left out; a null `collected` is false.
    """
    rows = readings.where("container_id IS NOT NULL AND reading_date IS NOT NULL AND level IS NOT NULL")
    typed = rows.select(
        _group("container_id", groups), F.col("container_id").cast("bigint").alias("container_id"), F.col("seq").cast("bigint").alias("seq"), times.epoch_micros(F.col("reading_date")).cast("bigint").alias("at"),
        F.col("level").cast("int").alias("level"), F.coalesce("collected", F.lit(False)).alias("collected"),
    )
    out = typed.groupBy("_group").transformWithStateInPandas(LatestState(), READING, "append", "none")
    stamp = lambda c: F.timestamp_micros(c).cast(times.NTZ)
    return out.select(
        "container_id", "seq", stamp("at").alias("reading_date"), "level", "collected", "accepted", "level_old", "current_level",
        stamp("last_at").alias("last_reading"), stamp("pickup_at").alias("last_pickup"),
    )


def latest_of(followed: DataFrame) -> DataFrame:
    """The state of each container from the stored output of `followed_readings`."""
    last = F.struct("seq")
    return followed.groupBy("container_id").agg(*[F.max_by(c, last).alias(c) for c in ("current_level", "last_reading", "last_pickup")])


EVENT = "site_id bigint, at bigint, previous_level double, current_level double, drop_points double, reason string, is_partial boolean"


class CollectionEvents(StatefulProcessor):
    """Holds buckets until the watermark has passed them, then takes those of each site in the order
    of time. A call takes the sites of a group together; the state is their buckets that wait and
    the level of each site's last one taken. A null site is kept as the least number."""

    WAITING = np.dtype([("key", "<i8"), ("at", "<i8"), ("level", "<f8"), ("collected", "?")])
    LAST = np.dtype([("key", "<i8"), ("level", "<f8")])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("sites", "waiting binary, last binary")

    def _held(self) -> tuple[np.ndarray, np.ndarray]:
        waiting, last = self.state.get() if self.state.exists() else (b"", b"")
        return np.frombuffer(waiting, self.WAITING), np.frombuffer(last, self.LAST)

    def _wake(self, waiting: np.ndarray) -> None:
        self.handle.registerTimer(-(-int(waiting["at"].min()) // 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        new = np.empty(len(batch), self.WAITING)
        new["key"] = [_FIRST if pd.isna(x) else x for x in batch["site_id"]] if batch["site_id"].isna().any() else batch["site_id"]
        for c in ("at", "level", "collected"):
            new[c] = batch[c]
        waiting, last = self._held()
        self.state.update((np.concatenate([waiting, new]).tobytes(), last.tobytes()))
        self._wake(new)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # The first timer that expires takes all that are due; the others find nothing.
        waiting, last = self._held()
        due = waiting["at"] <= timerValues.getCurrentWatermarkInMs() * 1000
        if not due.any():
            return
        rest, rows = waiting[~due], waiting[due]
        if len(rest):
            self._wake(rest)
        # In the order of time; of a bucket that came again the newest stays.
        rows = rows[np.lexsort((np.arange(len(rows)), rows["at"], rows["key"]))]
        rows = rows[np.append((rows["key"][1:] != rows["key"][:-1]) | (rows["at"][1:] != rows["at"][:-1]), True)]
        begin = _begins(rows["key"])
        place, known = _found(last["key"], rows["key"][begin])
        previous, has = np.append(np.nan, rows["level"][:-1]), np.ones(len(rows), bool)
        previous[begin], has[begin] = np.nan, known
        previous[begin[known]] = last["level"][place[known]]
        fall = previous - rows["level"]
        fall = np.where(fall > 0, fall, 0.0)
        ends = np.zeros(len(begin), self.LAST)
        ends["key"], ends["level"] = rows["key"][begin], rows["level"][np.append(begin[1:], len(rows)) - 1]
        self.state.update((rest.tobytes(), _merged(last, ends, place[known]).tobytes()))
        found = []
        for i in np.flatnonzero(rows["collected"] | (has & (fall >= PARTIAL_DROP - 0.01))).tolist():
            site, at, level, collected = rows[i].tolist()
            drop = round(float(fall[i]), 2) if has[i] else None
            if collected or drop >= PARTIAL_DROP:
                reason = "garbage_collection_alarm" if collected else "level_drop"
                found.append((None if site == _FIRST else site, at, float(previous[i]) if has[i] else None, level, drop, reason, drop is not None and drop < STRONG_DROP))
        if found:
            frame = pd.DataFrame(found, columns=[c.split()[0] for c in EVENT.split(", ")])
            yield frame.astype({"site_id": "Int64", "previous_level": "float64", "drop_points": "float64"})

    def close(self) -> None:
        pass


def collection_event_stream(buckets: DataFrame, lateness: str, groups: int = GROUPS) -> DataFrame:
    """Collection events of a stream of buckets (site_id, timestamp, level, collected) that arrive in
    any order, at most `lateness` behind; each goes out once the watermark has passed it.

    Buckets that come later still are dropped, a bucket that comes again replaces the one that
    waits. Times are whole milliseconds.
    """
    timed = buckets.withColumn("event_time", F.col("timestamp").cast("timestamp")).withWatermark("event_time", lateness)
    typed = timed.select(
        _group("site_id", groups), F.col("site_id").cast("bigint").alias("site_id"), "event_time", times.epoch_micros(F.col("timestamp")).cast("bigint").alias("at"), F.col("level").cast("double").alias("level"),
        F.coalesce("collected", F.lit(False)).alias("collected"),
    )
    out = typed.groupBy("_group").transformWithStateInPandas(CollectionEvents(), EVENT, "append", "eventTime")
    return out.select("site_id", F.timestamp_micros("at").cast(times.NTZ).alias("timestamp"), "previous_level", "current_level", "drop_points", "reason", "is_partial")
