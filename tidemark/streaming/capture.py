"""The boundary operators on a live poll stream.

A session is the 24-hour event-time window that starts at the evening open, so its state is
dropped once the watermark has passed the next open. Cumulative counters make most late rows
harmless; the watermark only has to exceed the poll gap plus the grace period.
"""

from __future__ import annotations

import calendar
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions.sessions import is_closed
from tidemark.functions.symbology import boundary_slot
from tidemark.operators.boundary import _first_readings, _reading_rows, interim_windows, useful_polls
from tidemark.operators.sizing import shared_folder
from tidemark.operators.tape import window_slots
from tidemark.settings import COTTON, Market

WATERMARK = "10 minutes"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _timed(polls: DataFrame, watermark: str) -> DataFrame:
    """Adds the event time: the wall clock read as UTC, whatever the zone of the session."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    micros = F.timestamp_diff("MICROSECOND", epoch, F.col("snap_ts"))
    return polls.withColumn("event_time", F.timestamp_micros(micros)).withWatermark("event_time", watermark)


def _session_window(market: Market):
    hour, minute = market.session_open
    return F.window("event_time", "1 day", startTime=f"{hour * 60 + minute} minutes")


def session_readings(polls: DataFrame, market: Market = COTTON, watermark: str = WATERMARK) -> DataFrame:
    """Streaming aggregate per (session, contract): boundary readings and the latest counter."""
    timed = _timed(useful_polls(polls), watermark)
    latest = F.max_by("volume", F.when(F.col("volume").isNotNull(), F.col("snap_ts"))).alias("last_volume")
    return timed.groupBy(_session_window(market).alias("session"), "session_date", "contract").agg(
        *_first_readings(market), latest, F.max("snap_ts").alias("last_ts"))


def capture_stream(polls: DataFrame, market: Market = COTTON, watermark: str = WATERMARK) -> DataFrame:
    """Boundary readings as they are captured (update mode; append mode gives closed sessions)."""
    return _reading_rows(session_readings(polls, market, watermark), market)


def live_windows(polls: DataFrame, market: Market = COTTON, watermark: str = WATERMARK) -> DataFrame:
    """Night, day and full so far per contract (update mode)."""
    wide = interim_windows(session_readings(polls, market, watermark), market)
    return wide.select("session_date", "contract", "last_ts", "night", "day", "full")


def poll_totals(tape: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """A tape stream summed over strikes: one row per (session, poll, contract), with the columns of a tape.

    In update mode the last row of a key is its sum so far; ``latest_rows`` of it is a tape the window operators take.
    State is dropped a day after the poll, when its session is over.
    """
    timed = _timed(tape.filter(F.col("snap_ts").isNotNull()), watermark)
    return timed.groupBy(F.window("event_time", "1 day").alias("w"), "session_date", "snap_ts", "contract").agg(
        F.sum("call_vol").alias("call_vol"), F.sum("put_vol").alias("put_vol")).drop("w")


def followed_polls(tape: DataFrame, folder: str | None = None) -> DataFrame:
    """What a followed tape holds now, summed per poll and contract; call it again with the same ``folder`` for what came since.

    The sums are taken up from the folder, so each call reads only what was appended.
    """
    return latest_rows(run_available(poll_totals(tape), folder=folder), ["session_date", "snap_ts", "contract"])


def live_option_windows(tape: DataFrame, market: Market = COTTON, folder: str | None = None) -> DataFrame:
    """Windows per slot of ``followed_polls``. Before its end a window is that up to the latest poll, an interim night or day."""
    return window_slots(followed_polls(tape, folder), market)


def _completeness_processor(offsets: dict[str, int], grace_minutes: int) -> StatefulProcessor:
    """The state function, made here so that it travels by value to workers without this package."""

    class CompletenessProcessor(StatefulProcessor):
        """Remembers which boundaries of a session were read; a timer judges each one."""

        def __init__(self, offsets: dict[str, int], grace_minutes: int):
            self.offsets, self.grace = offsets, grace_minutes * 60

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.seen = handle.getValueState("seen", "names string")

        def _times(self, key) -> dict[str, int]:
            midnight = calendar.timegm(key[0].timetuple())
            return {name: midnight + minutes * 60 for name, minutes in self.offsets.items()}

        @staticmethod
        def _end(at: dict[str, int]) -> int:
            """The next open: the session can have no polls from here on, so its state can go."""
            return min(at.values()) + 24 * 3600

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            at = self._times(key)
            if self.seen.exists():
                names = set(self.seen.get()[0].split(","))
            else:
                names = set()
                for t in (*at.values(), self._end(at)):
                    self.handle.registerTimer((t + self.grace) * 1000)
            for pdf in rows:
                hit = pdf.loc[pdf["n"] > 0, "start"]
                names |= {name for name, t in at.items() if ((hit >= t) & (hit < t + self.grace)).any()}
            self.seen.update((",".join(sorted(filter(None, names))),))
            return iter(())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            at = self._times(key)
            names = set(self.seen.get()[0].split(",")) if self.seen.exists() else set()
            fired = expiredTimerInfo.getExpiryTimeInMs() // 1000 - self.grace
            late = [name for name, t in at.items() if t == fired and name not in names]
            if fired == self._end(at):
                self.seen.clear()
            if late:
                yield pd.DataFrame({"session_date": [key[0]] * len(late), "boundary": late})

        def close(self) -> None:
            pass

    return CompletenessProcessor(offsets, grace_minutes)


def heartbeat(ticks: DataFrame, market: Market = COTTON) -> DataFrame:
    """(session_date, snap_ts) of a stream of clock ticks ``tick`` (the market's wall clock): the session each falls in.

    A session runs from one evening open to the next. Ticks of closed dates are left out.
    """
    hour, minute = market.session_open
    shifted = F.col("tick") + F.expr(f"INTERVAL '{24 * 60 - hour * 60 - minute}' MINUTE")
    return ticks.select(shifted.cast("date").alias("session_date"), F.col("tick").cast("timestamp_ntz").alias("snap_ts")) \
        .filter(~is_closed(F.col("session_date"), market))


def clock_ticks(spark: SparkSession, zone: str, seconds: int = 60) -> DataFrame:
    """A stream of the wall clock of ``zone``, a tick every so many seconds, for ``heartbeat``. The engine gives the time."""
    rate = spark.readStream.format("rate").option("rowsPerSecond", 1).load().filter(F.col("value") % seconds == 0)
    local = F.convert_timezone(F.current_timezone(), F.lit(zone), F.col("timestamp").cast("timestamp_ntz"))
    return rate.select(local.alias("tick"))


def completeness_alerts(polls: DataFrame, market: Market = COTTON, watermark: str = WATERMARK, beats: DataFrame | None = None) -> DataFrame:
    """One row per boundary that no tracked contract was read at within the grace period.

    Polls are first counted per minute (partially before the shuffle), so the state function sees
    at most a day of minute counts per session, however many polls there are. A boundary was read
    if a minute from its time on, and before its grace period ends, has a poll. It is judged when the watermark
    passes its grace period.

    ``beats`` (``heartbeat``) is a second stream, merged with the polls before the watermark: a session has its timers
    from its first tick on and time goes on without polls, so a session without a single poll alerts all its boundaries.
    Ticks must keep pace with the polls: a tick is a statement that polls older than the watermark behind it have come.
    Without ``beats`` a session without a poll has no state; the batch check reports it as a missing file.

    The query must run with the RocksDB state store provider (``rocksdb_state``).
    """
    tracked = boundary_slot(F.col("contract"), F.col("session_date"), market).isNotNull()
    useful = F.col("volume").isNotNull() | F.col("oi").isNotNull()
    seen = polls.select("session_date", "snap_ts", F.coalesce(tracked & useful, F.lit(False)).alias("hit"))
    if beats is not None:
        seen = seen.unionByName(beats.select("session_date", "snap_ts", F.lit(False).alias("hit")))
    counts = _timed(seen, watermark).groupBy(
        F.window("event_time", "1 minute").alias("w"), "session_date"
    ).agg(F.count_if("hit").alias("n"))
    rows = counts.select("session_date", F.unix_seconds("w.start").alias("start"),
                         F.window_time("w").alias("event_time"), "n")
    return rows.groupBy("session_date").transformWithStateInPandas(
        statefulProcessor=_completeness_processor(_boundary_offsets(market), market.grace_minutes),
        outputStructType="session_date date, boundary string", outputMode="append", timeMode="EventTime")


def _boundary_offsets(market: Market) -> dict[str, int]:
    """Minutes of each boundary relative to midnight of the session date."""
    clock = (market.session_open, market.day_start, market.day_end)
    minutes = [h * 60 + m for h, m in clock]
    minutes[0] -= 24 * 60
    return dict(zip(market.boundaries, minutes))


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Queries started inside keep their state in RocksDB; the session's own setting is as before afterwards.

    A query takes the settings of its session when it is started.
    """
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def run_available(stream: DataFrame, mode: str = "update", folder: str | None = None) -> DataFrame:
    """Process what is there, one folder per micro-batch; replayed batches overwrite theirs.

    Returns the emitted rows with their ``batch`` number. With a ``folder`` of an earlier run of the same stream its
    state and offsets are taken up, and the rows are those of all runs.
    """
    spark = stream.sparkSession
    folder = folder or shared_folder(spark)

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    with rocksdb_state(spark):
        started = stream.writeStream.outputMode(mode).foreachBatch(save) \
            .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    started.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])
    return spark.read.schema(schema).parquet(f"{folder}/rows")


def latest_rows(emitted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last emitted row per key of an update-mode result."""
    rest = [c for c in emitted.columns if c not in (*keys, "batch")]
    last = F.max_by(F.struct(*rest), "batch").alias("r")
    return emitted.groupBy(*keys).agg(last).select(*keys, "r.*")
