"""Subscriptions: cursors per key, demand per client, acknowledgement and redelivery after a timeout.

`Subscriptions` keeps its cursors as a table, so the number of keys is no matter of the driver's; take, acknowledge and expire are
joins over it. `Subscription` is the same state machine for a few keys in one process. Time is passed in.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import asdict, dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rillflow.errors import SubscriptionError
from rillflow.files import Files
from rillflow.operators.intervals import periods_and_gaps


@dataclass
class Cursor:
    """start > end: exhausted. committed: first offset not acknowledged. inflight_ms: when the oldest open delivery began."""

    start: int = 0
    end: int = -1
    committed: int = 0
    inflight_ms: int | None = None

    @property
    def backlog(self) -> int:
        return max(0, self.end - self.start + 1)


class Subscription:
    """The state machine over a dict of cursors, kept (with `path`) in one file of this machine."""

    def __init__(self, stream: str, timeout_ms: int = 500, path: str | os.PathLike | None = None, id: str | None = None):
        self.stream, self.timeout_ms, self.id = stream, timeout_ms, id or str(uuid.uuid4())
        self.cursors: dict[str, Cursor] = {}
        self.demand: dict[int, int] = {}
        self._out: dict[str, list[tuple[int, int]]] = {}
        self.path = Path(path) if path else None
        if self.path and self.path.exists():
            state = json.loads(self.path.read_text())
            self.stream, self.timeout_ms, self.id = state["stream"], state["timeout_ms"], state["id"]
            # What was in flight is delivered again: reading starts at what was acknowledged.
            self.cursors = {k: Cursor(c["committed"], c["end"], c["committed"]) for k, c in state["cursors"].items()}

    def save(self) -> None:
        """Write the cursors, replacing the file at once."""
        if self.path:
            temp = self.path.with_suffix(".tmp")
            temp.write_text(json.dumps({"stream": self.stream, "timeout_ms": self.timeout_ms, "id": self.id, "cursors": {k: asdict(c) for k, c in self.cursors.items()}}))
            os.replace(temp, self.path)

    def produced(self, key: str, end: int) -> None:
        """The key's log now ends at this offset; a key not seen before starts at 0."""
        c = self.cursors.setdefault(key, Cursor())
        c.end = max(c.end, end)

    def _in_order(self) -> list[tuple[str, Cursor]]:
        return sorted(((k, c) for k, c in self.cursors.items() if c.backlog), key=lambda x: (x[1].backlog, x[0]))

    def take(self, client: int, n: int, now_ms: int) -> list[tuple[str, int]]:
        """Add n to the client's demand and hand out what is there: (key, offset), keys by ascending backlog."""
        if n < 0:
            raise SubscriptionError("a demand can't be negative")
        self.demand[client] = self.demand.get(client, 0) + n
        return self.deliver(client, now_ms)

    def deliver(self, client: int, now_ms: int) -> list[tuple[str, int]]:
        """Hand out up to the client's open demand (after `produced`, or after a redelivery)."""
        out: list[tuple[str, int]] = []
        for key, c in self._in_order():
            n = min(c.backlog, self.demand.get(client, 0) - len(out))
            if n <= 0:
                break
            out += [(key, o) for o in range(c.start, c.start + n)]
            c.start += n
            c.inflight_ms = now_ms if c.inflight_ms is None else c.inflight_ms
            self._out.setdefault(key, []).append((client, n))
        self.demand[client] = self.demand.get(client, 0) - len(out)
        return out

    def ranges(self) -> list[tuple[str, int, int]]:
        """Whole readable ranges (key, first, last) by ascending backlog; exhausted keys are passed over, nothing is advanced."""
        return [(k, c.start, c.end) for k, c in self._in_order()]

    def acknowledge(self, key: str, start: int, end: int) -> None:
        """Acknowledge offsets start to end, inclusive. Refused, without any effect, for an unknown key, a range that leaves a
        hole after what is acknowledged, or offsets beyond the log."""
        if key not in self.cursors:
            raise SubscriptionError(f"no key {key!r}")
        c = self.cursors[key]
        if start > c.committed:
            raise SubscriptionError(f"key {key!r}: {start} leaves a hole after {c.committed - 1}")
        if end < start or end > c.end:
            raise SubscriptionError(f"key {key!r}: {start} to {end} isn't a range of its log")
        c.committed = max(c.committed, end + 1)
        c.start = max(c.start, c.committed)
        if c.committed >= c.start:
            c.inflight_ms = None
            self._out.pop(key, None)

    def acknowledge_all(self, ranges: list[tuple[str, int, int]]) -> list[SubscriptionError]:
        """Acknowledge several ranges; the errors of those refused."""
        errors = []
        for r in ranges:
            try:
                self.acknowledge(*r)
            except SubscriptionError as e:
                errors.append(e)
        return errors

    def expire(self, now_ms: int) -> list[str]:
        """Roll keys whose oldest delivery is open for the timeout back to what is acknowledged; the clients' demand comes back."""
        rolled = []
        for key, c in self.cursors.items():
            if c.inflight_ms is not None and now_ms - c.inflight_ms >= self.timeout_ms:
                open_ = c.start - c.committed
                for client, n in reversed(self._out.pop(key, [])):
                    back = min(n, open_)
                    self.demand[client] = self.demand.get(client, 0) + back
                    open_ -= back
                c.start, c.inflight_ms = c.committed, None
                rolled.append(key)
        return rolled

    def state(self) -> dict:
        return {"id": self.id, "stream": self.stream, "keys": {k: (c.start, c.end) for k, c in self.cursors.items()}, "demand": dict(self.demand)}


_CURSOR = "key string, start bigint, end bigint, committed bigint, inflight bigint, open array<struct<client:bigint,n:bigint>>, gave bigint"
_NAMES = ["key", "start", "end", "committed", "inflight", "open"]
#: Changes that are merged into one table of cursors.
MERGE = 12


class Subscriptions:
    """A subscription whose cursors are a table in a shared folder.

    A step writes the cursors it changes, under its number, and then commits that number by a file that only one writer can
    create; the newest change of a key counts. So a step costs what it changes (and a read of the cursors), one that dies
    before its commit changes nothing, and a subscription opened on the folder goes on where it was: what was in flight is then
    handed out again. A step with a `token` that was committed before isn't done again.
    """

    def __init__(self, spark: SparkSession, path: str, stream: str = "", timeout_ms: int = 500):
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark)
        self.stream, self.timeout_ms, self.id = stream, timeout_ms, uuid.uuid4().hex
        self.demand: dict[int, int] = {}
        self._steps: list[dict] = []
        for name in self.files.names(f"{self.path}/steps"):
            self._steps.append(json.loads(self.files.read(f"{self.path}/steps/{name}")))
        if self._steps:
            head = self._steps[-1]
            self.stream, self.timeout_ms, self.id = head["stream"], head["timeout_ms"], head["id"]
            again = self.cursors().where("start > committed").select("key", F.col("committed").alias("start"), "end", "committed", F.lit(None).cast("bigint").alias("inflight"), F.array().cast("array<struct<client:bigint,n:bigint>>").alias("open"))
            self._step(again)

    def _done(self, token: str | None) -> dict | None:
        return next((s for s in self._steps if token is not None and s["token"] == token), None)

    def _step(self, changed: DataFrame, token: str | None = None, merges: bool = False) -> DataFrame:
        """Write and commit the cursors that a step changes; they are read back."""
        n = len(self._steps)
        at = f"{self.path}/cursors/step={n}-{uuid.uuid4().hex[:8]}"
        gave = changed if "gave" in changed.columns else changed.withColumn("gave", F.lit(None).cast("bigint"))
        gave.select(*_NAMES, "gave").write.mode("overwrite").parquet(at)
        entry = {"n": n, "at": at.rpartition("/")[2], "merges": merges, "token": token, "stream": self.stream, "timeout_ms": self.timeout_ms, "id": self.id}
        if not self.files.put_new(f"{self.path}/steps/{n:012d}.json", json.dumps(entry)):
            raise SubscriptionError(f"another process has moved the subscription of {self.stream!r}; open it again")
        self._steps.append(entry)
        if not merges and sum(1 for _ in self._live()) > MERGE:
            self._step(self.cursors(), merges=True)
        return self.spark.read.schema(_CURSOR).parquet(at)

    def _live(self) -> list[dict]:
        last = max((i for i, s in enumerate(self._steps) if s["merges"]), default=0)
        return self._steps[last:]

    def cursors(self) -> DataFrame:
        """key, start, end, committed, inflight (ms at which the oldest open delivery began), open (deliveries by client)."""
        live = self._live()
        if not live:
            return self.spark.createDataFrame([], _CURSOR).select(*_NAMES)
        read = self.spark.read.schema(_CURSOR + ", step string").option("basePath", f"{self.path}/cursors").parquet(*[f"{self.path}/cursors/{s['at']}" for s in live])
        newest = read.groupBy("key").agg(F.max_by(F.struct(*_NAMES[1:]), F.split_part("step", F.lit("-"), F.lit(1)).cast("bigint")).alias("c"))
        return newest.select("key", "c.*")

    def produced(self, ends: DataFrame, token: str | None = None) -> None:
        """ends: (key, end). The logs of these keys now end there; a key not seen before starts at 0. Repeated keys count with their
        greatest end, nulls don't."""
        if self._done(token):
            return
        new = ends.where("key is not null and end is not null").groupBy("key").agg(F.max("end").alias("__end"))
        held = self.cursors()
        both = new.join(held, "key", "left").where("end is null or __end > end")
        none = F.array().cast("array<struct<client:bigint,n:bigint>>")
        self._step(both.select("key", F.coalesce("start", F.lit(0)).alias("start"), F.col("__end").alias("end"), F.coalesce("committed", F.lit(0)).alias("committed"), "inflight", F.coalesce("open", none).alias("open")), token)

    def take(self, client: int, n: int, now_ms: int, token: str | None = None) -> DataFrame:
        """Add n to the client's demand and hand out what is there: (key, offset), keys by ascending backlog, then by key."""
        if n < 0:
            raise SubscriptionError("a demand can't be negative")
        if not self._done(token):
            self.demand[client] = self.demand.get(client, 0) + n
        return self.deliver(client, now_ms, token)

    def deliver(self, client: int, now_ms: int, token: str | None = None) -> DataFrame:
        """Hand out up to the client's open demand (after `produced`, or after a redelivery).

        Every key in question has a record, so the `demand` keys of least backlog are enough: a top-n, and a running sum over
        these. A demand is what a client can take at once; its size is the client's choice, not the log's.
        """
        if done := self._done(token):
            return self._handed(self.spark.read.schema(_CURSOR).parquet(f"{self.path}/cursors/{done['at']}"))
        want = self.demand.get(client, 0)
        first = self.cursors().where("end >= start").withColumn("backlog", F.expr("end - start + 1")).orderBy("backlog", "key").limit(want)
        upto = W.orderBy("backlog", "key").rowsBetween(W.unboundedPreceding, -1)
        given = first.withColumn("before", F.coalesce(F.sum("backlog").over(upto), F.lit(0))).withColumn("gave", F.least("backlog", F.lit(want) - F.col("before"))).where("gave > 0")
        mine = F.array(F.struct(F.lit(client).cast("bigint").alias("client"), F.col("gave").alias("n")))
        step = self._step(given.select("key", (F.col("start") + F.col("gave")).alias("start"), "end", "committed", F.coalesce("inflight", F.lit(now_ms)).cast("bigint").alias("inflight"), F.concat("open", mine).alias("open"), "gave"), token)
        self.demand[client] = want - (step.agg(F.sum("gave")).first()[0] or 0)
        return self._handed(step)

    @staticmethod
    def _handed(step: DataFrame) -> DataFrame:
        return step.where("gave > 0").select("key", F.explode(F.expr("sequence(start - gave, start - 1)")).alias("offset"))

    def ranges(self) -> DataFrame:
        """Whole readable ranges (key, first, last, backlog) of the keys that aren't exhausted; nothing is advanced."""
        return self.cursors().where("end >= start").select("key", F.col("start").alias("first"), F.col("end").alias("last"), F.expr("end - start + 1").alias("backlog"))

    def acknowledge(self, ranges: DataFrame, token: str | None = None) -> DataFrame:
        """ranges: (key, first, last), inclusive, taken together. The rows refused, with `why`: an unknown key, no range of the key's log,
        or a hole after what is acknowledged. Those don't change anything; the others do.

        The ranges are merged by `periods_and_gaps`, so a key with any number of them gathers in no task.
        """
        held = self.cursors()
        seen = ranges.select("key", "first", "last").join(held.select(F.col("key").alias("__key"), "end", "committed"), F.col("key") == F.col("__key"), "left")
        bad = F.when(F.col("__key").isNull(), "unknown key").when(F.coalesce((F.col("last") < F.col("first")) | (F.col("first") < 0) | (F.col("last") > F.col("end")), F.lit(True)), "not a range of its log")
        spans = periods_and_gaps(seen.where(bad.isNull()), ["key"], "first", "last").where("span_kind = 'period'")
        far = spans.join(held.select(F.col("key").alias("__key"), "committed"), F.col("key") == F.col("__key")).where("span_start <= committed").groupBy("key").agg(F.max(F.col("span_end") + 1).alias("__far"))
        moved = held.join(far, "key").where("__far > committed").withColumn("start", F.greatest("start", "__far"))
        through = F.col("__far") >= F.col("start")
        step = moved.select("key", "start", "end", F.col("__far").alias("committed"), F.when(~through, F.col("inflight")).alias("inflight"), F.when(through, F.array().cast("array<struct<client:bigint,n:bigint>>")).otherwise(F.col("open")).alias("open"))
        if not self._done(token):
            self._step(step, token)
        now = self.cursors().select(F.col("key").alias("__now"), F.col("committed").alias("__committed"))
        hole = F.when(F.col("first") > F.col("__committed"), "leaves a hole")
        return seen.join(now, F.col("key") == F.col("__now"), "left").select("key", "first", "last", F.coalesce(bad, hole).alias("why")).where("why is not null")

    def expire(self, now_ms: int, token: str | None = None) -> DataFrame:
        """Roll keys whose oldest delivery is open for the timeout back to what is acknowledged; the clients' demand comes back. The
        keys rolled back."""
        if done := self._done(token):
            return self.spark.read.schema(_CURSOR).parquet(f"{self.path}/cursors/{done['at']}").select("key")
        late = self.cursors().where(F.col("inflight").isNotNull() & (F.lit(now_ms) - F.col("inflight") >= self.timeout_ms))
        # The newest deliveries are the ones still open.
        newest = late.select("key", F.expr("start - committed").alias("left"), F.posexplode("open").alias("place", "d"))
        after = W.partitionBy("key").orderBy(F.col("place").desc()).rowsBetween(W.unboundedPreceding, -1)
        back = newest.withColumn("n", F.greatest(F.lit(0), F.least(F.col("d.n"), F.col("left") - F.coalesce(F.sum("d.n").over(after), F.lit(0)))))
        for r in back.groupBy("d.client").agg(F.sum("n").alias("n")).collect():  # a row a client
            self.demand[r.client] = self.demand.get(r.client, 0) + r.n
        step = late.select("key", F.col("committed").alias("start"), "end", "committed", F.lit(None).cast("bigint").alias("inflight"), F.array().cast("array<struct<client:bigint,n:bigint>>").alias("open"))
        return self._step(step, token).select("key")

    def state(self) -> DataFrame:
        """Per key: start, end, committed and backlog (what isn't acknowledged)."""
        return self.cursors().select("key", "start", "end", "committed", F.greatest(F.expr("end + 1 - committed"), F.lit(0)).alias("backlog"))
