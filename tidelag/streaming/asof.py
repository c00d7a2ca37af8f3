"""The neighbour signal where edges stream too: an extension, not a reference operator."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DAY_MS = 86_400_000


class OpenDays(StatefulProcessor):
    """Weights by entity and returns by day of one source, until the watermark has passed the day.

    A day that ends takes, of each entity, the last weight of a date up to it. Weights that a later
    one has replaced by then go, so that state holds one weight for each pair, and what is open.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.weights = handle.getMapState("weights", "entity string", "days array<int>, ords array<bigint>, weights array<double>")
        self.days = handle.getMapState("days", "day int", "at bigint, r double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        closed = timerValues.getCurrentWatermarkInMs() // DAY_MS
        for batch in rows:
            fresh = batch[(batch.day >= closed) & batch.value.notna()]
            for r in fresh[fresh.entity.isna()].itertuples(index=False):
                self._return(int(r.day), int(r.ord), float(r.value))
            for entity, own in fresh[fresh.entity.notna()].groupby("entity"):
                self._weights(entity, own)
        return iter([])

    def _return(self, day: int, at: int, value: float) -> None:
        """The last row of a day counts; of rows of one time the largest."""
        held = self.days.getValue((day,)) if self.days.containsKey((day,)) else None
        if held is None:
            self.handle.registerTimer((day + 1) * DAY_MS)
        if held is None or (held[0], held[1]) < (at, value):
            self.days.updateValue((day,), (at, value))

    def _weights(self, entity: str, rows: pd.DataFrame) -> None:
        known = self._held(entity)
        for r in rows.itertuples(index=False):
            known[int(r.day)] = max(known.get(int(r.day), (int(r.ord), float(r.value))), (int(r.ord), float(r.value)))
        self._keep(entity, known)

    def _held(self, entity: str) -> dict[int, tuple[int, float]]:
        if not self.weights.containsKey((entity,)):
            return {}
        days, ords, weights = self.weights.getValue((entity,))
        return dict(zip(days, zip(ords, weights)))

    def _keep(self, entity: str, known: dict[int, tuple[int, float]]) -> None:
        days = sorted(known)
        self.weights.updateValue((entity,), (days, [known[d][0] for d in days], [known[d][1] for d in days]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        closed = timerValues.getCurrentWatermarkInMs() // DAY_MS
        ended = sorted(d for (d,) in self.days.keys() if d < closed)
        if not ended:
            return iter([])
        returns = {d: self.days.getValue((d,))[1] for d in ended}
        out, entities = [], [e for (e,) in self.weights.keys()]
        for entity in entities:
            known = self._held(entity)
            for d in ended:
                if before := [x for x in known if x <= d]:
                    out.append((key[0], entity, d, known[max(before)][1] * returns[d]))
            last = max((x for x in known if x < closed), default=None)
            if last is not None and any(x < last for x in known):
                self._keep(entity, {x: w for x, w in known.items() if x >= last})
        for d in ended:
            self.days.removeKey((d,))
        return iter([pd.DataFrame(out, columns=["source", "entity", "day", "value"])] if out else [])

    def close(self) -> None:
        pass


def streaming_asof(returns: DataFrame, edges: DataFrame, entity: str, source: str, name: str, delay: str = "5 days") -> DataFrame:
    """(entity, source, date, name): what each source adds to the signal of a day, from streamed
    (gvkey, ts, r) and streamed edges (customer_gvkey, supplier_gvkey, date, weight_wji, ord).

    Rows may come in any order within ``delay``; an edge may come as late as its day may. Each row
    comes once, when the watermark has passed its day, and their sums by entity and date are what
    ``operators.asof.signal`` gives. The session needs the RocksDB state store.
    """
    day = F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date"))
    one = returns.select(F.col("gvkey").alias("source"), "ts", F.lit(None).cast("string").alias("entity"), F.unix_micros("ts").alias("ord"), F.col("r").alias("value")).withWatermark("ts", delay)
    end = (F.col("date").cast("timestamp") + F.expr("interval 1 day") - F.expr("interval 1 millisecond")).alias("ts")
    two = edges.select(F.col(source).alias("source"), end, F.col(entity).alias("entity"), F.col("ord").cast("long").alias("ord"), F.col("weight_wji").alias("value")).withWatermark("ts", delay)
    both = one.unionByName(two).withColumn("day", day)
    found = both.groupBy("source").transformWithStateInPandas(OpenDays(), "source string, entity string, day int, value double", "append", "eventTime")
    return found.select(F.col("entity").alias(entity), F.col("source").alias(source), F.date_add(F.lit("1970-01-01").cast("date"), F.col("day")).alias("date"), F.col("value").alias(name))
