"""Ordered-scan operators as window expressions. Every one is partitioned; none sorts a whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def ordered(keys: list[str], *by) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*by)


def running_key(value: Column, w: WindowSpec) -> Column:
    """The last non-null value so far: a current heading, header line or parent."""
    return F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def islands(change: Column, w: WindowSpec) -> Column:
    """Number of the run a row belongs to; change is true where a new run begins."""
    return F.sum(F.when(change, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))


def runs(df: DataFrame, keys: list[str], by: list, value: str, out: str = "island") -> DataFrame:
    """Runs of equal neighbouring values."""
    w = ordered(keys, *by)
    prev = F.lag(value).over(w)
    return df.withColumn(out, islands(prev.isNull() | (prev != F.col(value)), w))


def gap_clusters(df: DataFrame, keys: list[str], by: list, at: Column, gap: float, out: str = "cluster") -> DataFrame:
    """Clusters of rows whose neighbours are less than gap apart."""
    w = ordered(keys, *by)
    return df.withColumn("_at", at).withColumn(out, islands(F.coalesce(F.col("_at") - F.lag("_at").over(w) >= gap, F.lit(True)), w)).drop("_at")


def merged_intervals(df: DataFrame, keys: list[str], lo: str, hi: str, tie: str, tolerance: float = 0.0, out: str = "region") -> DataFrame:
    """Regions of transitively overlapping intervals, by a sweep over their starts."""
    w = ordered(keys, lo, tie)
    reached = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("_reached", reached).withColumn(out, islands(F.col("_reached").isNull() | (F.col("_reached") + tolerance < F.col(lo)), w)).drop("_reached")


def lead_ranges(at: Column, w: WindowSpec, end: Column) -> Column:
    """End of a range that begins at a row: where the next begins, or the given end."""
    return F.coalesce(F.lead(at).over(w), end)


def asof_parent(is_parent: Column, parent: Column, w: WindowSpec) -> Column:
    """The nearest preceding parent of each row, itself included."""
    return running_key(F.when(is_parent, parent), w)


def first_within(value: Column, wanted: Column, w: WindowSpec, ahead: int) -> Column:
    """The first wanted value among a row and the ahead rows after it."""
    return F.first(F.when(wanted, value), ignorenulls=True).over(w.rowsBetween(0, ahead))


def running_offset(size: Column, w: WindowSpec) -> Column:
    """Sum of the sizes before a row: byte offsets of members."""
    return F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def segments(df: DataFrame, keys: list[str], by: str, x: str, y: str) -> DataFrame:
    """Consecutive points as segments (x, y, x1, y1); the last point of a key begins none."""
    w = ordered(keys, by)
    return df.withColumns({"x1": F.lead(x).over(w), "y1": F.lead(y).over(w)}).where("x1 is not null")


def best(df: DataFrame, keys: list[str], *by) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_rank", F.row_number().over(ordered(keys, *by))).where("_rank = 1").drop("_rank")


def title_chain(df: DataFrame, keys: list[str], order: str, level: str, title: str, most: int = 6) -> DataFrame:
    """Outline items with the titles of the items above them and their own, from the outermost: (..., chain)."""
    w = ordered(keys, order)
    # The last item of a level counts only if no item of an outer level has come since.
    last = [running_key(F.when(F.col(level) == k, F.struct(F.col(order).alias("at"), F.col(title).alias("t"))), w) for k in range(most)]
    chain = F.array(*[F.when(F.col(level) >= k, F.struct(F.lit(k).alias("k"), c["at"].alias("at"), c["t"].alias("t"))) for k, c in enumerate(last)])
    df = df.withColumn("_c", F.filter(chain, lambda s: s.isNotNull() & s["at"].isNotNull()))
    fresh = F.filter("_c", lambda s: F.forall(F.filter(F.col("_c"), lambda o: o["k"] < s["k"]), lambda o: o["at"] <= s["at"]))
    return df.withColumn("chain", F.transform(fresh, lambda s: s["t"])).drop("_c")


def split_islands(df: DataFrame, keys: list[str], bucket: str, by: list[str], value: str, differs, out: str = "island") -> DataFrame:
    """Runs as of runs() and gap_clusters(), for keys with more rows than one task should hold.

    bucket: a column that never falls along the order (a day of a time stamp). Rows are numbered within a key's bucket;
    one row a bucket then carries the count, and the last value, over to the next. differs(previous, value): whether a new
    run begins; a null before begins one too.
    """
    previous = F.lag(F.struct(F.col(value).alias("v"))).over(ordered([*keys, bucket], *by))
    begins = lambda p, v: F.when(p.isNull() | F.coalesce(differs(p, v), F.lit(False)), 1).otherwise(0)
    rows = df.withColumn("_p", previous).withColumn("_new", F.when(F.col("_p").isNull(), 0).otherwise(begins(F.col("_p.v"), F.col(value))))
    rows = rows.withColumn("_own", F.sum("_new").over(ordered([*keys, bucket], *by).rowsBetween(Window.unboundedPreceding, 0)))
    at = F.struct(*by)
    held = rows.groupBy(*keys, bucket).agg(F.max("_own").alias("_n"), F.min_by(F.struct(F.col(value).alias("v")), at).alias("_first"), F.max_by(F.struct(F.col(value).alias("v")), at).alias("_last"))
    w = ordered(keys, bucket)
    start = F.when(F.col("_before").isNull(), 1).otherwise(begins(F.col("_before.v"), F.col("_first.v")))
    held = held.withColumn("_before", F.lag("_last").over(w)).withColumn("_start", start)
    base = F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = held.select(*keys, bucket, base.alias("_base"))
    return rows.join(held, [*keys, bucket]).withColumn(out, F.col("_base") + F.col("_own")).drop("_p", "_new", "_own", "_base")


def split_asof(df: DataFrame, keys: list[str], bucket: str, by: list[str], is_parent: Column, parent: Column, out: str = "parent") -> DataFrame:
    """asof_parent() for keys with more rows than one task should hold: see split_islands()."""
    rows = df.withColumn(out, asof_parent(is_parent, parent, ordered([*keys, bucket], *by)))
    last = F.max_by(F.when(is_parent, parent), F.when(is_parent & parent.isNotNull(), F.struct(*by)))
    held = df.groupBy(*keys, bucket).agg(last.alias("_last"))
    carried = F.last("_last", ignorenulls=True).over(ordered(keys, bucket).rowsBetween(Window.unboundedPreceding, -1))
    return rows.join(held.select(*keys, bucket, carried.alias("_carried")), [*keys, bucket]).withColumn(out, F.coalesce(out, "_carried")).drop("_carried")
