"""The nearest connection of each arriving flow, held in keyed state until nothing nearer can come."""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cipherlake.operators.asof import KEYS, both_orientations
from cipherlake.streaming.flows import LATE

#: The state store that keyed state with timers needs, a setting of the stream's session.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
COLUMNS = ("flow_id", "flow_ms", "uid", "ts_ms")
#: Shares of the keys.  Fixed, since a stream that goes on must find its state again.
SHARES = 64
#: State holds rows in chunks, so that a call to the store moves many.
CHUNK = "keys array<string>, ids array<string>, ms array<long>"
CHUNK_ROWS = 4096
Row = tuple[str, str | None, int]


class Nearest(StatefulProcessor):
    """Keeps the flows and connections of one share of the keys and stretch of time; one timer ends the next wait.

    Connections stay as long as a flow may still come that they are near to.
    """

    def __init__(self, tolerance: int):
        self.tolerance = tolerance

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.flows = handle.getListState("flows", CHUNK)
        self.conns = handle.getListState("conns", CHUNK)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        first = None
        for frame in rows:
            for is_flow, state, wait in ((True, self.flows, self.tolerance), (False, self.conns, 2 * self.tolerance)):
                part = frame[frame["is_flow"] == is_flow]
                if len(part):
                    self.add(state, list(zip(part["key"].tolist(), part["flow_id" if is_flow else "uid"].tolist(), part["ms"].tolist(), strict=True)))
                    end = int(part["ms"].min()) + wait
                    first = end if first is None else min(first, end)
        if first is not None and not any(t <= first for t in self.handle.listTimers()):
            self.handle.registerTimer(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        flows, conns = self.kept(self.flows), self.kept(self.conns)
        due = [f for f in flows if f[2] + self.tolerance <= now]
        out = self.matches(due, conns) if due else []
        open_ = [f for f in flows if f[2] + self.tolerance > now]
        near = [c for c in conns if c[2] + 2 * self.tolerance > now]
        for state, before, after in ((self.flows, flows, open_), (self.conns, conns, near)):
            if len(after) < len(before):
                state.clear()
                self.add(state, after)
        ends = [f[2] + self.tolerance for f in open_] + [c[2] + 2 * self.tolerance for c in near]
        if ends:
            self.handle.registerTimer(min(ends))
        if out:
            frame = pd.DataFrame(out, columns=list(COLUMNS))
            yield frame.astype({"ts_ms": "Int64"})

    def matches(self, flows: Iterable[Row], conns: Iterable[Row]) -> list[tuple]:
        """The nearest connection of each flow; of several at one time the last from before, the first from after."""
        of = defaultdict(list)
        for key, uid, at in conns:
            of[key].append((at, uid))
        times = {}
        for key, found in of.items():
            found.sort()
            times[key] = [at for at, _ in found]
        out = []
        for key, flow_id, ms in flows:
            found, i = of.get(key, ()), bisect_right(times.get(key, ()), ms)
            # Equally near ones go to the earlier.
            near = [(abs(at - ms), at, uid) for at, uid in found[max(i - 1, 0) : i + 1] if abs(at - ms) <= self.tolerance]
            _, at, uid = min(near) if near else (None, None, None)
            out.append((flow_id, ms, uid, at))
        return out

    @staticmethod
    def kept(state) -> list[Row]:  # noqa: ANN001
        return [row for keys, ids, ms in state.get() for row in zip(keys, ids, ms, strict=True)]

    @staticmethod
    def add(state, rows: list[Row]) -> None:  # noqa: ANN001
        for i in range(0, len(rows), CHUNK_ROWS):
            keys, ids, ms = zip(*rows[i : i + CHUNK_ROWS], strict=True)
            state.appendValue((list(keys), list(ids), [int(x) for x in ms]))

    def close(self) -> None:
        pass


def nearest_connections(flows: DataFrame, conn: DataFrame, tolerance_ms: int = 2000, flow_id: str = "event_id", late: str = LATE, bucket_ms: int | None = None) -> DataFrame:
    """``flow_id, flow_ms, uid, ts_ms`` of each arriving flow, matched or not, once the watermark is past its tolerance.

    The rule is that of the batch join.  Streams are keyed by shares of the flows'
    ends and by stretches of time: connections go to each stretch that they may
    match in, so that a key with many rows is split, and the state of a stretch
    goes away with the watermark.  A share holds many keys, since a call to the
    state takes longer than its rows.  Rows later than ``late`` are dropped, and so
    are flows without a time.  The session needs ``STATE_STORE``.
    """
    bucket = max(bucket_ms or 7200 * tolerance_ms, 2 * tolerance_ms, 1)
    kind = flows.schema[flow_id].dataType
    # One key without nulls; a row that lacks an end has a key that no connection has.
    key = F.concat_ws("|", *(F.coalesce(F.col(k).cast("string" if k.endswith("ip") else "long").cast("string"), F.lit("?")) for k in KEYS))
    timed = lambda df, ms: df.withColumn("at", F.timestamp_millis(ms)).withWatermark("at", late)
    stretch = lambda ms: F.floor(ms / bucket)

    def rows(df: DataFrame, is_flow: bool, the_id: Column, uid: Column, ms: str, places: Column) -> DataFrame:
        # Ids go through the state as text, since numbers with nulls among them become fractions in pandas.
        return timed(df, F.col(ms)).where("at is not null").withColumn("stretch", F.explode(places)).select(F.pmod(F.xxhash64(key), F.lit(SHARES)).alias("share"), "stretch", key.alias("key"), F.lit(is_flow).alias("is_flow"), the_id.cast("string").alias("flow_id"), uid.alias("uid"), F.col(ms).cast("long").alias("ms"), "at")

    start = "bidirectional_first_seen_ms"
    left = rows(flows, True, F.col(flow_id), F.lit(None).cast("string"), start, F.array(stretch(F.col(start))))
    zone = F.sequence(stretch(F.col("ts_ms") - tolerance_ms), stretch(F.col("ts_ms") + tolerance_ms))
    right = rows(both_orientations(conn), False, F.lit(None), F.col("uid"), "ts_ms", zone)
    grouped = left.union(right).groupBy("share", "stretch")
    found = grouped.transformWithStateInPandas(Nearest(tolerance_ms), "flow_id string, flow_ms long, uid string, ts_ms long", "Append", "EventTime")
    return found.withColumn("flow_id", F.col("flow_id").cast(kind))
