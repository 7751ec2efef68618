"""Things that expire: timers of a stream over their touches, and the same from a table."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

HOUR_MS = 3_600_000
#: How long a thing of each kind lives after its last touch.
LIFETIMES_MS = {"job": 30 * 24 * HOUR_MS, "session": 90 * 24 * HOUR_MS, "file": 24 * HOUR_MS, "cache": 30 * 24 * HOUR_MS}
OUT_SCHEMA = "kind string, id string, touched_ms long, expired_ms long, touches long"
OUT = Row(*(c.split()[0] for c in OUT_SCHEMA.split(", ")))
#: Touches that are joined to lives at once.
AT_ONCE = 10_000


def _lifetime(lifetimes: dict[str, int]) -> Column:
    return F.create_map(*(F.lit(x) for p in lifetimes.items() for x in p))[F.col("kind")]


def timed_touches(touches: DataFrame, lifetimes: dict[str, int] | None = None) -> DataFrame:
    """(kind, id, at, at_ms) of touches (kind, id, at) that can expire: of a known kind, with an id and a time."""
    known = touches.select("kind", F.col("id").cast("string").alias("id"), F.col("at").cast("timestamp").alias("at")).where(F.col("kind").isin(list(lifetimes or LIFETIMES_MS)))
    return known.where("id IS NOT NULL AND at IS NOT NULL").withColumn("at_ms", F.unix_millis("at"))


class Expiry(StatefulProcessor):
    """Keeps when a thing was last touched, with one timer for its end, and emits a row when the timer goes off.

    A touch before the end moves the timer; a touch at or after the end, which may come in the same batch before the timer
    could go off, emits the ended life and starts another. Lives are kept as (first touch, last touch, touches): a batch's rows
    may come in any order, and only AT_ONCE touches of one thing and its lives are held.
    """

    def __init__(self, lifetimes: dict[str, int]):
        self.lifetimes = lifetimes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.life = handle.getValueState("life", "touched long, touches long")

    def _row(self, key: tuple, touched: int, touches: int) -> Row:
        return OUT(key[0], key[1], touched, touched + self.lifetimes[key[0]], touches)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        span = self.lifetimes[key[0]]
        lives: list[list[int]] = []  # (first, last, touches), in order, none reaching the next
        if self.life.exists():
            touched, touches = self.life.get()
            lives.append([touched, touched, touches])
            self.handle.deleteTimer(touched + span)
        while some := Counter(r["at_ms"] for r in islice(rows, AT_ONCE)):
            lives += [[at, at, n] for at, n in some.items()]
            lives.sort()
            joined: list[list[int]] = []
            for first, last, n in lives:
                if joined and first < joined[-1][1] + span:
                    joined[-1][1:] = [max(joined[-1][1], last), joined[-1][2] + n]
                else:
                    joined.append([first, last, n])
            lives = joined
        ended, (_, touched, touches) = lives[:-1], lives[-1]
        self.life.update((touched, touches))
        self.handle.registerTimer(touched + span)
        for _, last, n in ended:
            yield self._row(key, last, n)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        if self.life.exists():
            touched, touches = self.life.get()
            self.life.clear()
            yield self._row(key, touched, touches)

    def close(self) -> None:
        pass


def expiries(touches: DataFrame, lifetimes: dict[str, int] | None = None, late: str = "0 seconds") -> DataFrame:
    """A row (kind, id, touched_ms, expired_ms, touches) of a stream for each life that ended by the watermark.

    The watermark follows the greatest time of touch by `late`; a touch older than it is dropped, as its life may have been
    told already. A thing never touched again costs one row of state until its timer goes off, and nothing after.
    """
    lifetimes = lifetimes or LIFETIMES_MS
    keyed = timed_touches(touches, lifetimes).withWatermark("at", late).groupBy("kind", "id")
    return keyed.transformWithState(Expiry(lifetimes), outputStructType=OUT_SCHEMA, outputMode="append", timeMode="EventTime")


def expired_lives(touches: DataFrame, as_of_ms: int | Column | None = None, lifetimes: dict[str, int] | None = None) -> DataFrame:
    """What expiries() tells of all touches, from a table: the lives that ended by as_of_ms, which is the greatest time of touch
    where it isn't given.

    Touches are first counted by their millisecond, which bounds what a thing has by its time and not by its touches. Repeated
    touches count each; unknown kinds, null ids and null times take no part; an empty table gives no rows.
    """
    lifetimes = lifetimes or LIFETIMES_MS
    known = timed_touches(touches, lifetimes)
    if as_of_ms is None:
        as_of_ms = known.agg(F.max("at_ms")).first()[0]
    order = Window.partitionBy("kind", "id").orderBy("at_ms")
    counted = known.groupBy("kind", "id", "at_ms").agg(F.count("*").alias("n"))
    starts = F.coalesce((F.col("at_ms") >= F.lag("at_ms").over(order) + _lifetime(lifetimes)).cast("int"), F.lit(1))
    lives = counted.withColumn("starts", starts).withColumn("life", F.sum("starts").over(order))
    ended = lives.groupBy("kind", "id", "life").agg(F.max("at_ms").alias("touched_ms"), F.sum("n").alias("touches"))
    end = F.col("touched_ms") + _lifetime(lifetimes)
    until = as_of_ms if isinstance(as_of_ms, Column) else F.lit(as_of_ms).cast("long")
    return ended.select("kind", "id", "touched_ms", end.alias("expired_ms"), "touches").where(F.col("expired_ms") <= until)
