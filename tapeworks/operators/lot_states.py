"""Where partial sells close a lot because too little of it is left.

Whether such a sell closes its lot depends on what was bought and on all sells since,
and whether a later buy counts depends on that.  So a series is a chain of state
transitions: the state is nothing held, or the quantity that is left.

A chunk of the series is summarised as a map from the state before it to the state
after it.  From nothing held there is one outcome.  A quantity is multiplied by the
shares that partial sells leave until a full sell, or until it falls below the dust
level; from then on the outcome is that of starting with nothing behind that sell,
which only changes from one buy to the next.  The map is therefore a short table of
limits with an outcome each.  The maps of a series are composed in order, and every
chunk then finds its own closing sells from the state it starts with.

Quantities are logarithms, since shares multiply.  There is one shuffle of the fills,
one of the maps, and no loop over jobs.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import inf, isnan, log, nan

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.functions.numeric import floor_div
from tapeworks.plans.series import CHUNK, with_chunk
from tapeworks.plans.workers import reach

BUY, PARTIAL, FULL = 0, 1, 2
EVENTS = "events array<struct<step:bigint,kind:int,value:double>>"
MAPS = "empty double, falls array<double>, outcomes array<double>, full boolean, after_full double, share double"


class Chunk:
    """Orders of one chunk: ``value`` is the quantity of a buy, or the share that a partial sell leaves."""

    def __init__(self, step: np.ndarray, kind: np.ndarray, value: np.ndarray, dust: float):
        self.step, self.size = step, len(step)
        self.dust = log(dust) if dust > 0 else -inf
        self.buys, self.partial, self.full = (np.flatnonzero(kind == k) for k in (BUY, PARTIAL, FULL))
        self.left = np.zeros(self.size)
        self.left[self.partial] = np.log(value[self.partial])
        self.left = np.cumsum(self.left)
        with np.errstate(divide="ignore"):
            bought = np.log(np.maximum(value[self.buys], 0.0))
        self.bought = np.where(np.isnan(bought), inf, bought)
        self.closed, self.by_dust = self._closing(self.buys, self.bought - self.left[self.buys])
        self.next = np.searchsorted(self.buys, self.closed, "right")
        ends = np.full(len(self.buys) + 1, -1)
        closed, after = self.closed.tolist(), self.next.tolist()
        for k in range(len(self.buys) - 1, -1, -1):
            ends[k] = k if closed[k] == self.size else ends[after[k]]
        self.ends = ends

    def _following(self, places: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.append(places, self.size)[np.searchsorted(places, at, "right")]

    def _closing(self, at: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sell behind place ``at`` that ends a holding of ``base`` times the shares so far, and if it is by dust."""
        low = np.searchsorted(-self.left, base - self.dust, "right")
        low = self._following(self.partial, np.maximum(low - 1, at))
        full = self._following(self.full, at)
        return np.minimum(low, full), low < full

    def outcome(self, at: int) -> float:
        """State after the chunk if nothing is held behind place ``at``; NaN is nothing."""
        k = self.ends[np.searchsorted(self.buys, at, "right")]
        return nan if k < 0 else float(self.bought[k] + self.left[-1] - self.left[self.buys[k]])

    def summary(self) -> tuple:
        first = int(self.full[0]) if len(self.full) else self.size
        sells = self.partial[self.partial < first]
        group = np.searchsorted(self.buys, sells, "right")
        last = sells[np.append(group[1:] != group[:-1], True)] if len(sells) else sells
        full = first < self.size
        return (
            self.outcome(-1), self.left[last].tolist(), [self.outcome(int(j)) for j in last],
            full, self.outcome(first) if full else nan, float(self.left[-1]),
        )

    def closings(self, held: float) -> list[int]:
        """Steps of the partial sells that close a lot, if the chunk starts with ``held``."""
        out, k = [], 0
        if not isnan(held):
            at, dust = self._closing(np.array([-1]), np.array([held]))
            k = int(np.searchsorted(self.buys, at[0], "right"))
            if dust[0]:
                out.append(int(self.step[at[0]]))
        while k < len(self.buys):
            if self.by_dust[k] and self.closed[k] < self.size:
                out.append(int(self.step[self.closed[k]]))
            k = int(self.next[k])
        return out


def apply(held: float, m: dict, dust: float) -> float:
    """The state after a chunk with map ``m`` that starts with ``held``."""
    if isnan(held):
        return m["empty"]
    limit = (log(dust) if dust > 0 else -inf) - held
    at = int(np.searchsorted(-np.array(m["falls"]), -limit, "right"))
    if at < len(m["falls"]):
        return m["outcomes"][at]
    return m["after_full"] if m["full"] else held + m["share"]


def chunks_of(batch: pa.RecordBatch, dust: float) -> Iterator[Chunk]:
    events = batch.column("events")
    for i in range(batch.num_rows):
        e = events[i].values
        yield Chunk(*(e.field(n).to_numpy(zero_copy_only=False) for n in ("step", "kind", "value")), dust)


def dust_closings(fills: DataFrame, dust: float, width: int = CHUNK) -> DataFrame:
    """``run, sym, step`` of the partial sells that leave less than ``dust`` of a lot and so close it.

    A chunk holds at most ``width`` orders, for steps are unique in a series.  Buys without a
    quantity never fall to dust; a sell without a share leaves nothing.
    """
    reach(fills.sparkSession)
    keys = ["run", "sym"]
    buy = F.col("side") == "buy"
    kept = F.greatest(1.0 - F.col("pct"), F.lit(0.0))
    kind = F.when(buy, BUY).when((F.col("pct") >= 1.0) | (kept <= 0), FULL).otherwise(PARTIAL)
    event = F.struct("step", kind.alias("kind"), F.when(buy, F.coalesce("qty", F.lit(nan))).otherwise(kept).alias("value"))
    rows = fills.where(F.col("side").isin("buy", "sell")).select(*keys, F.col("step").cast("bigint").alias("step"), "side", "pct", "qty")
    rows = with_chunk(rows, keys, floor_div(F.col("step"), width))
    chunks = rows.groupBy(*keys, "_chunk").agg(F.sort_array(F.collect_list(event)).alias("events"))
    types = {f.name: f.dataType.simpleString() for f in chunks.schema.fields}
    part = [*keys, "_chunk"]
    head = ", ".join(f"{c} {types[c]}" for c in part)

    def maps(batches):
        for b in batches:
            found = list(zip(*(c.summary() for c in chunks_of(b, dust))))
            if found:
                kinds = [pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.bool_(), pa.float64(), pa.float64()]
                made = [pa.array(v, k) for v, k in zip(found, kinds)]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in part), *made], [*part, *(f.split()[0] for f in MAPS.split(", "))])

    def compose(batches):
        series, held = None, nan
        for b in batches:
            out, own = [], [b.column(c) for c in keys]
            for i, m in enumerate(b.select([f.split()[0] for f in MAPS.split(", ")]).to_pylist()):
                key = [c[i] for c in own]
                if key != series:
                    series, held = key, nan
                out.append(held)
                held = apply(held, m, dust)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in part), pa.array(out, pa.float64())], [*part, "held"])

    def closings(batches):
        for b in batches:
            held = b.column("held").to_pylist()
            steps = [c.closings(h) for c, h in zip(chunks_of(b, dust), held)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keys), pa.array(steps, pa.list_(pa.int64()))], [*keys, "steps"])

    summed = chunks.mapInArrow(maps, f"{head}, {MAPS}")
    before = summed.repartition(*keys).sortWithinPartitions(*part).mapInArrow(compose, f"{head}, held double")
    known = chunks.join(before, part).select(*keys, "events", "held")
    found = known.mapInArrow(closings, f"run {types['run']}, sym {types['sym']}, steps array<bigint>")
    return found.select(*keys, F.explode("steps").alias("step"))
