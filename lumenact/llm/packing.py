"""Problem 7: filling containers of a fixed capacity.

Only sizes matter, and there are at most ``capacity`` different ones. So the plan is made from the histogram of sizes,
whose length the capacity bounds whatever the number of items, as patterns with multiplicities; then every item looks
up its place by its size and its rank among the items of that size. No container is ever built by collecting items.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Items of one size ranked by one task; larger sizes are split by a hash and ranked with offsets.
RANKED = 1 << 18


class _Stock:
    """Counts of the sizes still to be placed, with the sums of pairs that were possible at the last look."""

    def __init__(self, counts: np.ndarray):
        self.c = counts.copy()
        self.pair_sums: np.ndarray | None = None

    def pairs(self) -> np.ndarray:
        if self.pair_sums is None:
            have = (self.c > 0).astype(float)
            n = 1 << (2 * len(have)).bit_length()
            f = np.fft.rfft(have, n)
            self.pair_sums = np.fft.irfft(f * f, n)[: len(have)] > 0.5
        return self.pair_sums

    def times(self, sizes: list[int]) -> int:
        """How often the stock holds all of ``sizes``."""
        return min(int(self.c[s]) // sizes.count(s) for s in set(sizes))

    def single(self, gap: int, head: int) -> list[int] | None:
        return [gap] if self.c[gap] > (gap == head) else None

    def pair(self, gap: int, head: list[int]) -> list[int] | None:
        """Two sizes that fill ``gap``, the most available ones."""
        if gap < 2:
            return None
        a = np.arange(1, gap // 2 + 1)
        least = np.minimum(self.c[a], self.c[gap - a])
        for i in np.argsort(-least, kind="stable"):
            if least[i] == 0:
                break
            if self.times([*head, int(a[i]), gap - int(a[i])]) > 0:
                return [gap - int(a[i]), int(a[i])]
        return None

    def triple(self, gap: int, head: list[int]) -> list[int] | None:
        if gap < 3:
            return None
        first = np.arange(1, gap - 1)
        for a in first[(self.c[first] > 0) & self.pairs()[gap - first]][::-1]:
            if (rest := self.pair(gap - int(a), [*head, int(a)])) and self.times([*head, int(a), *rest]) > 0:
                return [int(a), *rest]
        return None

    def take(self, sizes: list[int], times: int) -> None:
        for s in sizes:
            self.c[s] -= times
            if self.c[s] == 0:
                self.pair_sums = None


def plan(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Patterns of sizes and how many containers have them, for ``counts[size]`` items, sizes 1 to ``capacity``.

    Exact-complement hashing: for the largest size left, a single, pair or triple of sizes that fills the gap exactly is
    looked up under the counts and consumed as often as they last; every step uses up a size. What has no exact
    complement goes by decreasing size to the fullest container it fits.
    """
    stock, made, rest = _Stock(counts), [], np.zeros(capacity + 1, np.int64)
    if counts[capacity]:
        made.append(([capacity], int(counts[capacity])))
        stock.c[capacity] = 0
    for head in range(capacity - 1, 0, -1):
        gap = capacity - head
        while stock.c[head] > 0:
            found = stock.single(gap, head) or stock.pair(gap, [head]) or stock.triple(gap, [head])
            if not found:
                rest[head] = stock.c[head]  # left for the best fit, out of reach of smaller heads
                stock.take([head], int(stock.c[head]))
                break
            sizes = [head, *found]
            times = stock.times(sizes)
            made.append((sizes, times))
            stock.take(sizes, times)
    made += _best_fit(rest, capacity)
    return made


def _best_fit(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Best fit by decreasing size, with containers of one pattern kept together."""
    by_gap: dict[int, list[tuple[list[int], int]]] = {}
    open_gaps = np.zeros(capacity + 1, bool)

    def put(pattern: list[int], times: int, gap: int) -> None:
        by_gap.setdefault(gap, []).append((pattern, times))
        open_gaps[gap] = True

    for size in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[size])
        while left:
            fits = np.flatnonzero(open_gaps[size:])
            if not len(fits):  # new containers, as many as hold this size alone
                per = capacity // size
                if full := left // per:
                    put([size] * per, full, capacity - per * size)
                if left % per:
                    put([size] * (left % per), 1, capacity - (left % per) * size)
                break
            gap = size + int(fits[0])
            pattern, times = by_gap[gap].pop()
            used = min(times, left)
            if used < times:
                by_gap[gap].append((pattern, times - used))
            open_gaps[gap] = bool(by_gap[gap])
            put([*pattern, size], used, gap - size)
            left -= used
    return [x for group in by_gap.values() for x in group]


def pack(items: DataFrame, capacity: int, key: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """``container, key, piece, pieces, n_tokens``: every row of ``items(key, size)`` in containers of ``capacity``.

    * Only an item above ``capacity`` is split: into full pieces, which fill containers alone, and a remainder.
    * An item of size 0 or null takes no space and goes to an existing container (container 0 if there is none).
    * Rows with equal keys are items of their own; an empty table gives no rows. Containers are numbered from 0.
    """
    spark = items.sparkSession
    kind, name, key = items.schema[key].dataType.simpleString(), key, "_key"
    items = items.select(F.col(name).alias(key), F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).alias("n"))
    pieces = F.greatest(F.ceil(F.col("n") / capacity), F.lit(1)).cast("int")
    items = items.select(key, "n", pieces.alias("pieces"), F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece"))
    items = written(items.withColumn("s", F.least(F.col("n") - F.col("piece") * capacity, F.lit(capacity)).cast("int")).drop("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for r in items.groupBy("s").count().collect():  # at most capacity + 1 rows
        counts[r["s"]] = r["count"]
    empty, counts[0] = int(counts[0]), 0
    patterns = plan(counts, capacity)
    total = max(1, sum(times for _, times in patterns))
    # of each size the ranks of its items that go to a pattern: start, first container, items in one container
    spans, start, base = [], np.zeros(capacity + 1, np.int64), 0
    for sizes, times in patterns:
        for s in set(sizes):
            each = sizes.count(s)
            spans.append((s, int(start[s]), base, each))
            start[s] += each * times
        base += times
    spans.append((0, 0, 0, 0))
    spans = np.array(sorted(spans), np.int64)
    sent = spark.sparkContext.broadcast(spans)

    splits = spark.createDataFrame([(s, int(-(-c // RANKED))) for s, c in enumerate([empty, *counts[1:].tolist()]) if c] or [(0, 1)], "s int, splits int")
    salted = items.join(F.broadcast(splits), "s").withColumn("salt", F.pmod(F.xxhash64(key, "piece"), F.col("splits")).cast("int"))
    before = salted.groupBy("s", "salt").count()
    before = before.withColumn("before", F.sum("count").over(Window.partitionBy("s").orderBy("salt")) - F.col("count")).drop("count")
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("s", "salt").orderBy(key, "piece")) - 1)
    ranked = ranked.join(before, ["s", "salt"]).select(key, "piece", "pieces", "s", (F.col("rank") + F.col("before")).alias("rank"))

    def place(batches):
        spans = sent.value
        keys = (spans[:, 0] << 44) + spans[:, 1]
        for b in batches:
            s, rank = b.column("s").to_numpy().astype(np.int64), b.column("rank").to_numpy()
            at = np.searchsorted(keys, (s << 44) + rank, "right") - 1
            container = np.where(s > 0, spans[at, 2] + (rank - spans[at, 1]) // np.maximum(spans[at, 3], 1), rank % total)
            yield pa.RecordBatch.from_arrays([pa.array(container), b.column(key), b.column("piece"), b.column("pieces"), b.column("s")], ["container", key, "piece", "pieces", "n_tokens"])

    out = ranked.mapInArrow(place, f"container long, `{key}` {kind}, piece int, pieces int, n_tokens int")
    return out.withColumnRenamed(key, name)


def fill(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, items, tokens, the least number of containers any packing needs, and the share of space used."""
    own = packed.agg(F.max("container").alias("last"), F.count("*").alias("items"), F.sum("n_tokens").alias("tokens"))
    used = F.coalesce(F.col("last") + 1, F.lit(0))
    return own.select(
        used.alias("containers"), "items", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.ceil(F.coalesce("tokens", F.lit(0)) / capacity).alias("least"),
        (F.coalesce("tokens", F.lit(0)) / F.greatest(used * capacity, F.lit(1))).alias("filled"),
    )
