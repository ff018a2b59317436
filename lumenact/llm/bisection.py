"""Problem 2: exact percentiles by bisection, and day summaries that add up.

A value interval is kept for every group and percentile. A pass counts the rows of each interval below its midpoints
(``WAYS - 1`` of them, so that one pass does the work of several halvings), and the part that holds the target rank
becomes the next interval, shrunk to the values seen in it. An interval of one value is resolved. Counts are sums:
map tasks count first, and a group of any size sends one row a part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table, written
from .profiles import cells

WAYS = 64
#: Infinite values count as the largest finite ones.
_HUGE = 1.7976931348623157e308


def values(activity: DataFrame, obs: DataFrame, panel: DataFrame, tiers: list[str], value: str = "zscore") -> DataFrame:
    """``annotation, feature, day, v``: one row a result of a cell that has a label and a value.

    Results are unique by feature, sample and run; copies agree and count once (should they differ, the largest counts).
    They meet as the columns of one row a sample and run, so a hot sample leaves each map task as one row a run; the
    panel is a dimension of fixed size. Null and NaN are no values; null samples are no cells.
    """
    own = panel.where(F.col("tier").isin(tiers))
    features = [(r["pos"], r["feature"]) for r in own.select("pos", "feature").orderBy("pos").collect()]
    position = own.select("feature", F.col("pos").alias("_at"))
    v = F.when(~F.isnan(F.col(value)), F.col(value))
    rows = activity.where("sample is not null").select("sample", "run_id", "computed_at", "feature", v.alias("_v")).join(position, "feature")
    wide = rows.groupBy("sample", "run_id").agg(
        F.max("computed_at").alias("at"), *[F.max(F.when(F.col("_at") == p, F.col("_v"))).alias(f"v{i}") for i, (p, _) in enumerate(features)]
    )
    long = wide.join(cells(obs).where("annotation is not null"), "sample").select(
        "annotation", F.to_date("at").alias("day"), F.posexplode(F.array(*[F.col(f"v{i}") for i in range(len(features))] or [F.lit(None).cast("double")])).alias("_i", "v")
    )
    names = F.array(*[F.lit(f) for _, f in features] or [F.lit("")])
    return long.where("v is not null").select("annotation", F.element_at(names, F.col("_i") + 1).alias("feature"), "day", F.least(F.greatest("v", F.lit(-_HUGE)), F.lit(_HUGE)).alias("v"))


def _part(lo: str, hi: str, value: str = "r.v") -> Column:
    """Which of ``WAYS`` parts of an interval a value is in; its ends are in different parts."""
    # halves keep the difference of huge values finite; the part number never falls as v grows
    width = F.col(hi) / 2 - F.col(lo) / 2
    share = F.least(F.floor((F.col(value) / 2 - F.col(lo) / 2) / width * WAYS), F.lit(WAYS - 1))
    return F.when(width > 0, share).when(F.col(value) > F.col(lo), F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))


def percentiles(rows: DataFrame, keys: list[str], pcts: list[int], value: str = "v") -> DataFrame:
    """``keys, pct, value, n``: of each group the smallest value that at least ``pct`` % of its values do not exceed.

    Exact, for ties and repeated rows too. Groups without values have no row; null keys form groups of their own.
    No group is sorted or collected; a pass moves at most ``WAYS`` counts a group, percentile and map task.
    """
    own = [f"k{i}" for i in range(len(keys))]
    rows = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value))).select(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)], F.col(value).cast("double").alias("v"))
    rows = written(rows)
    rank = F.ceil(F.col("pct") * F.col("n") / 100)
    state = rows.groupBy(*own).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    state = state.withColumn("pct", F.explode(F.array(*[F.lit(p) for p in pcts]))).withColumn("r", F.greatest(rank, F.lit(1)))
    state = written(state.withColumn("below", F.lit(0).cast("long")))
    done, kept, passes = [], rows, 0
    while True:
        done.append(state.where("lo = hi"))
        state = state.where("lo < hi")
        if state.isEmpty():
            break
        same = [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in own]
        met = kept.alias("r").join(state.alias("s"), same).where("r.v between s.lo and s.hi")
        if passes == 1:  # by now few rows lie in an open interval; later passes read only these
            spans = state.groupBy(*own).agg(F.collect_list(F.struct("lo", "hi")).alias("open"))
            spanned = kept.alias("r").join(spans.alias("s"), same).where(F.exists("s.open", lambda o: F.col("r.v").between(o["lo"], o["hi"])))
            kept = written(spanned.select("r.*"))
            met = kept.alias("r").join(state.alias("s"), same).where("r.v between s.lo and s.hi")
        parts = met.groupBy(*[F.col(f"s.{c}").alias(c) for c in (*own, "pct", "n", "r", "below")], _part("s.lo", "s.hi").alias("part")).agg(
            F.count("*").alias("c"), F.min("r.v").alias("lo"), F.max("r.v").alias("hi")
        )
        upto = F.sum("c").over(Window.partitionBy(*own, "pct").orderBy("part"))
        parts = parts.withColumn("upto", F.col("below") + upto).where("upto >= r and upto - c < r")
        state = written(parts.select(*own, "n", "lo", "hi", "pct", "r", (F.col("upto") - F.col("c")).alias("below")))
        passes += 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select(*[F.col(o).alias(k) for o, k in zip(own, keys, strict=True)], F.col("pct").cast("int").alias("pct"), F.col("lo").alias("value"), "n")


def summaries(rows: DataFrame, keys: list[str], value: str = "v", step: float = 1 / 64, share: float = 0.01) -> DataFrame:
    """``keys, cell, count, least, most, split``: counts on a lattice of value intervals of width ``step``.

    An interval of more than ``share`` of its group is split, into parts of the ends seen in them, until every part has at
    most that share or one value; so at any value at most ``share`` of a group is of unknown side, in sums of summaries
    too. Summaries of separate runs or days are combined by ``combine``; no fit is shared between them.
    """
    own = [f"k{i}" for i in range(len(keys))]
    rows = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value))).select(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)], F.col(value).cast("double").alias("v"))
    rows = written(rows.withColumn("cell", F.floor(F.col("v") / step)))
    sums = [F.count("*").alias("count"), F.min("v").alias("least"), F.max("v").alias("most")]
    state = rows.groupBy(*own, "cell").agg(*sums).withColumn("n", F.sum("count").over(Window.partitionBy(*own)))
    state = written(state.withColumn("split", F.col("count") > share * F.col("n")))
    done = []
    while True:
        whole = ~F.col("split") | (F.col("count") <= share * F.col("n")) | (F.col("least") == F.col("most"))
        done.append(state.where(whole))
        state = state.where(~whole)
        if state.isEmpty():
            break
        same = [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in (*own, "cell")]
        met = rows.alias("r").join(state.alias("s"), same).where("r.v between s.least and s.most")
        parts = met.groupBy(*[F.col(f"s.{c}").alias(c) for c in (*own, "cell", "n")], F.col("s.least").alias("lo"), _part("s.least", "s.most").alias("part"))
        parts = parts.agg(F.count("*").alias("count"), F.min("r.v").alias("least"), F.max("r.v").alias("most"))
        state = written(parts.select(*own, "cell", "count", "least", "most", "n", F.lit(True).alias("split")))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select(*[F.col(o).alias(k) for o, k in zip(own, keys, strict=True)], "cell", "count", "least", "most", "split")


def combine(parts: DataFrame, keys: list[str], share: float = 0.01) -> DataFrame:
    """The summary of all rows from summaries of some of them: counts add, ends widen.

    Parts of a split interval stay apart, unless the interval has at most ``share`` of all rows of the group.
    """
    ends = [F.when(F.col("split"), F.col(c)).alias(f"_{c}") for c in ("least", "most")]
    sums = [F.sum("count").alias("count"), F.min("least").alias("least"), F.max("most").alias("most")]
    met = parts.groupBy(*keys, "cell", "split", *ends).agg(*sums)
    cell, group = (F.sum("count").over(Window.partitionBy(*k)) for k in ([*keys, "cell"], keys))
    met = met.withColumn("_n", group).withColumn("_c", cell).withColumn("split", F.col("split") & (F.col("_c") > share * F.col("_n")))
    return met.groupBy(*keys, "cell", "split", *ends).agg(*sums).select(*keys, "cell", "count", "least", "most", "split")


def from_summary(summary: DataFrame, keys: list[str], pcts: list[int]) -> DataFrame:
    """``keys, pct, value, n, rank_error``: percentiles of a summary.

    ``value`` is the smallest end of an interval by which surely ``pct`` % of the values have come; ``rank_error`` bounds
    the error in rank as a share of ``n``, by the intervals that ``value`` ends or parts (0 where these have one value).
    """
    ends = F.array(F.struct(F.col("least").alias("at"), F.col("count").alias("begun"), F.lit(0).cast("long").alias("ended")), F.struct(F.col("most").alias("at"), F.lit(0).cast("long").alias("begun"), F.col("count").alias("ended")))
    s = summary.select(*keys, F.explode(ends).alias("_e")).groupBy(*keys, F.col("_e.at").alias("at")).agg(F.sum("_e.begun").alias("begun"), F.sum("_e.ended").alias("ended"))
    w = Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*keys)
    s = s.withColumn("upto", F.sum("ended").over(w)).withColumn("open", F.sum("begun").over(w) - F.col("begun") - F.col("upto") + F.col("ended")).withColumn("n", F.sum("ended").over(whole))
    s = s.withColumn("pct", F.explode(F.array(*[F.lit(p) for p in pcts]))).withColumn("r", F.greatest(F.ceil(F.col("pct") * F.col("n") / 100), F.lit(1)))
    return s.where("upto >= r and upto - ended < r").select(*keys, F.col("pct").cast("int").alias("pct"), F.col("at").alias("value"), "n", (F.col("open") / F.col("n")).alias("rank_error"))


def cell_values(spark, sf_dir: str, tiers: list[str]) -> DataFrame:
    return values(table(spark, sf_dir, "activity"), table(spark, sf_dir, "obs"), table(spark, sf_dir, "panel"), tiers)
