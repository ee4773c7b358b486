"""Keyed state that outlives a batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

#: The state store that map state and timers need.
ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def open_state(events: DataFrame, toggle: str, reset: str) -> DataFrame:
    """Per user, after each batch: events seen, and open or closed when one type toggles and another closes.

    Events of a batch are put in order of (ts, event_id); the state is two numbers per user.
    """

    def fold(key, frames: Iterator[pd.DataFrame], state: GroupState):
        seen, is_open = state.get if state.exists else (0, False)
        batch = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        closed = (batch["event_type"] == reset).to_numpy()
        after = closed.nonzero()[0][-1] + 1 if closed.any() else 0
        flips = int((batch["event_type"].to_numpy()[after:] == toggle).sum())
        is_open = (flips % 2 == 1) != (is_open and not closed.any())
        state.update((seen + len(batch), is_open))
        yield pd.DataFrame({"user_id": [key[0]], "seen": [seen + len(batch)], "is_open": [is_open]})

    return events.groupBy("user_id").applyInPandasWithState(fold, "user_id long, seen long, is_open boolean", "seen long, is_open boolean", "update", GroupStateTimeout.NoTimeout)


#: In place of the day of an event without a time.
NO_DAY = -(2**31)


def _days_of(batch: pd.DataFrame, toggle: str, reset: str) -> np.ndarray:
    """A row (user, day, seen, tail, had) for each user and day of a batch, in this order."""
    order = np.lexsort([batch[c].to_numpy() for c in ("event_id", "ts", "day", "user_id")])
    user, day, kind = (batch[c].to_numpy()[order] for c in ("user_id", "day", "event_type"))
    place, toggles = np.arange(len(order)), np.cumsum(kind == toggle)
    starts = np.flatnonzero(np.r_[True, (user[1:] != user[:-1]) | (day[1:] != day[:-1])])
    ends = np.r_[starts[1:], len(order)] - 1
    last = np.maximum.reduceat(np.where(kind == reset, place, -1), starts)
    upto = np.maximum(last, starts - 1)
    tail = toggles[ends] - np.where(upto >= 0, toggles[upto], 0)
    return np.stack([user[starts], day[starts], ends - starts + 1, tail, last >= 0], axis=1).astype(np.int64)


def _go_on(old: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(all rows, those of new): the rows of new go on from those of old of the same user and day."""
    both = np.concatenate([old, new])
    fresh = np.arange(len(both)) >= len(old)
    order = np.lexsort([fresh, both[:, 1], both[:, 0]])
    both, fresh = both[order], fresh[order]
    same = np.flatnonzero((both[1:, :2] == both[:-1, :2]).all(axis=1))
    was, now = both[same], both[same + 1]
    both[same + 1, 2:] = np.stack([was[:, 2] + now[:, 2], now[:, 3] + np.where(now[:, 4] == 1, 0, was[:, 3]), was[:, 4] | now[:, 4]], axis=1)
    return np.delete(both, same, axis=0), both[fresh]


def open_state_by_day(events: DataFrame, toggle: str, reset: str, buckets: int = 64) -> DataFrame:
    """As open_state, for each user and day: seen, the number of toggles after the day's last reset, and whether it had one.

    A user with much of the data is as many keys as there are days; combine_days folds the days. Users and days are kept in
    buckets, five numbers each, so that one call of the function folds many of them; buckets should grow with the table,
    and are the state's keys, so that a stream that goes on has to go on with as many. Events without a user are ignored.
    """

    def fold(key, frames: Iterator[pd.DataFrame], state: GroupState):
        old = np.frombuffer(state.get[0], np.int64) if state.exists else np.empty(0, np.int64)
        kept, now = _go_on(old.reshape(-1, 5), _days_of(pd.concat(list(frames)), toggle, reset))
        state.update((kept.tobytes(),))
        day = pd.to_datetime(pd.Series(now[:, 1]).where(now[:, 1] != NO_DAY), unit="D").dt.date
        yield pd.DataFrame({"user_id": now[:, 0], "day": day, "seen": now[:, 2], "tail": now[:, 3], "had": now[:, 4] == 1})

    out = "user_id long, day date, seen long, tail long, had boolean"
    rows = events.where(F.col("user_id").isNotNull()).withColumn("day", F.coalesce(F.unix_date(F.to_date("ts")), F.lit(NO_DAY)))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("user_id", "day"), F.lit(buckets)))
    return rows.groupBy("bucket").applyInPandasWithState(fold, out, "days binary", "update", GroupStateTimeout.NoTimeout)


def combine_days(states: DataFrame) -> DataFrame:
    """(user_id, seen, is_open) from the last state of each user and day: a day with a reset forgets the days before it. Days are combined by grouping."""
    last = states.groupBy("user_id", "day").agg(F.max_by(F.struct("seen", "tail", "had"), "seen").alias("s")).select("user_id", "day", "s.*")
    reset = last.groupBy("user_id").agg(F.max(F.when(F.col("had"), F.col("day"))).alias("reset"), F.sum("seen").alias("total"))
    both = last.join(reset, "user_id").where(F.col("reset").isNull() | (F.col("day") >= F.col("reset")))
    return both.groupBy("user_id").agg(F.max("total").alias("seen"), (F.sum("tail") % 2 == 1).alias("is_open"))


SPELL = "zone long, depth string, started timestamp, ended timestamp, hours long, mean double, last double"
HOUR_MS = 3_600_000


class MoistureSpells(StatefulProcessor):
    """The spells of a bucket of zones: what each depth has had since its zone's spell began, and when the zone last spoke.

    The state is a row for each zone and depth of an open spell. A timer on event time stands where the zone
    that has been silent longest has been so for silence after its last hour; it gives out the spells that are over and
    drops their rows, so that silent zones hold none. An hour that comes after such
    a silence within one batch closes the spell itself, so batches may be cut anywhere.
    """

    COLUMNS = ("zone", "depth", "first", "last", "hours", "known", "total", "value")

    def __init__(self, silence_hours: int):
        self.silence = silence_hours * HOUR_MS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "rows binary")

    def _held(self) -> pd.DataFrame | None:
        return pa.ipc.open_stream(self.open.get()[0]).read_pandas() if self.open.exists() else None

    def _hold(self, spells: pd.DataFrame) -> None:
        """Keep the open spells, with a timer for the one that ends first."""
        if spells.empty:
            self.open.clear()
            return
        table = pa.Table.from_pandas(spells, preserve_index=False)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as to:
            to.write_table(table)
        self.open.update((sink.getvalue().to_pybytes(),))
        # An hour is known when it is over: the last one that can still belong to the spell ends an hour after its start.
        self.handle.registerTimer(int(spells["last"].min()) + self.silence + HOUR_MS)

    @staticmethod
    def _closed(spells: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"zone": spells["zone"], "depth": spells["depth"], "started": pd.to_datetime(spells["first"], unit="ms"), "ended": pd.to_datetime(spells["last"], unit="ms")})
        return out.assign(hours=spells["hours"], mean=spells["total"] / spells["known"], last=spells["value"])

    def _parts(self, batch: pd.DataFrame, held: pd.DataFrame | None) -> pd.DataFrame:
        """Spells by zone, in time, and depth; of each zone the last one is open. Those held are gone on with."""
        rows = pd.DataFrame({"zone": batch["zone"], "depth": batch["depth"], "first": batch["hour"].astype("datetime64[ms]").astype("int64"), "hours": 1, "known": batch["mean"].notna().astype("int64"), "total": batch["mean"], "value": batch["mean"]})
        rows["last"] = rows["first"]
        # Held rows stand before the hours that are new: all of a zone's rows begin where its spell did and end where it last spoke.
        rows = rows if held is None else pd.concat([held, rows], ignore_index=True)
        rows["at"] = rows["last"]
        rows = rows.sort_values(["zone", "at", "depth"], kind="stable", ignore_index=True)
        new = (rows["zone"] != rows["zone"].shift()) | (rows["first"] - rows["last"].shift() > self.silence)
        rows["spell"] = new.cumsum()
        span = rows.groupby("spell").agg(first=("first", "min"), last=("last", "max"))
        by = rows.groupby(["spell", "depth"], sort=False, dropna=False, as_index=False).agg(zone=("zone", "first"), hours=("hours", "sum"), known=("known", "sum"), total=("total", "sum"), value=("value", "last"))
        return by.join(span, on="spell")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        if pd.isna(key[0]):
            return  # heartbeats; a filter for them would go below the watermark and stop it
        # One row an hour and depth: a batch of them is bounded by the time that it spans and the zones of a bucket.
        spells = self._parts(pd.concat(list(rows)), self._held())
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        over = spells["spell"] < spells.groupby("zone")["spell"].transform("max")
        if over.any():
            yield self._closed(spells[over])
        self._hold(spells.loc[~over, list(self.COLUMNS)])

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._held()
        if held is not None:
            over = held["last"] + self.silence + HOUR_MS <= max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
            if over.any():
                yield self._closed(held[over])
            self._hold(held[~over])

    def close(self) -> None:
        pass


def moisture_spells(hours: DataFrame, silence_hours: int, buckets: int = 64) -> DataFrame:
    """Spells of zones between silences, by depth: hours is a stream of zone, depth, hour and mean, one row of each, appended by watermark.

    Zones share so many buckets, which should grow with the table; a stream that goes on has to go on with as many.
    """
    bucket = F.when(F.col("zone").isNotNull(), F.pmod(F.xxhash64("zone"), F.lit(buckets)))
    return hours.withColumn("bucket", bucket).groupBy("bucket").transformWithStateInPandas(MoistureSpells(silence_hours), SPELL, "Append", "EventTime")
