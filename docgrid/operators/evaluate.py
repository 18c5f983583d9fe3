"""Comparison of sources: two- and three-way differences, agreement, majority votes, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import agreeing, contains_each_other


def by_source(df: DataFrame, keys: list[str], source: str, sources: list[str], name: str) -> DataFrame:
    """One row a key with a column of names for each source: one shuffle in place of chained outer joins."""
    return df.groupBy(*keys).pivot(source, sources).agg(F.max(name))


def agreement(wide: DataFrame, sources: list[str]) -> DataFrame:
    """Columns present (number of sources), conflict, identical (in all sources, without conflict)."""
    names = F.array_distinct(F.array_compact(F.array(*[F.col(s) for s in sources])))
    present = sum((F.col(s).isNotNull().cast("int") for s in sources), F.lit(0))
    wide = wide.withColumns({"present": present, "conflict": (F.size(names) > 1) & ~contains_each_other(names)})
    return wide.withColumn("identical", (F.col("present") == len(sources)) & ~F.col("conflict"))


def two_way(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with side `added` (only right), `removed` (only left) or `both`."""
    l, r = (d.select(*keys).distinct().withColumn(f"_{n}", F.lit(1)) for d, n in ((left, "l"), (right, "r")))  # noqa: E741
    return l.join(r, keys, "full").select(*keys, F.when(F.col("_l").isNull(), "added").when(F.col("_r").isNull(), "removed").otherwise("both").alias("side"))


def majority(wide: DataFrame, sources: list[str]) -> DataFrame:
    """(pair, n): how often each pair of sources, and no third, agrees on a name."""
    pairs = [(a, b) for i, a in enumerate(sources) for b in sources[i + 1 :]]
    row = lambda a, b: F.struct(F.lit(f"{a}+{b}").alias("pair"), (F.col(a) == F.col(b)).alias("same"))
    return wide.select(F.explode(F.array(*[row(a, b) for a, b in pairs])).alias("p")).where("p.same").groupBy("p.pair").agg(F.count(F.lit(1)).alias("n"))


def after_vote(overlap: Column, total: Column, differing: Column) -> Column:
    return (overlap - total + differing) / overlap


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.round(100.0 * part / F.nullif(whole, F.lit(0)), digits)


def coverage(wanted: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Wanted keys that are missing."""
    return wanted.select(key).distinct().join(present.select(key).distinct(), key, "left_anti")


def fingerprint(*cols: Column) -> Column:
    """Aggregate: a canonical digest of a group's rows, whatever their order."""
    return F.sha2(F.to_json(F.sort_array(F.collect_list(F.struct(*cols)))), 256)


def named_sources(rows: DataFrame, keys: list[str], name: str, source: str) -> DataFrame:
    """(keys, names: map from each name to the sources that use it, joined by plus signs), of keys with several names."""
    each = rows.groupBy(*keys, name).agg(F.array_join(F.sort_array(F.collect_set(source)), "+").alias("_s"))
    wide = each.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(name, "_s"))).alias("_p")).where("size(_p) > 1")
    return wide.select(*keys, F.map_from_entries("_p").alias("names"))


def mixed(rows: DataFrame, keys: list[str], value: str, label: str) -> DataFrame:
    """Keys that stand under several values, with the values in order, joined by hyphens: (keys, label)."""
    found = rows.groupBy(*keys).agg(F.sort_array(F.collect_set(value)).alias("_v")).where("size(_v) > 1")
    return found.select(*keys, F.array_join(F.transform("_v", lambda v: v.cast("string")), "-").alias(label))


def index_by_source(df: DataFrame, keys: list[str], source: str, sources: list[str], value: str, order: list[str]) -> DataFrame:
    """One row a key with a column of values for each source; of several values, the one that comes last in order."""
    return df.groupBy(*keys).pivot(source, sources).agg(F.max_by(value, F.struct(*order)))


def whitelisted(differences: DataFrame, pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Differences without those whose two names, in either order, are listed as equivalent."""
    both = lambda df, x, y: df.withColumns({"_a": F.least(F.col(x), F.col(y)), "_b": F.greatest(F.col(x), F.col(y))})
    listed = both(pairs.toDF("_x", "_y"), "_x", "_y").select("_a", "_b").distinct()
    return both(differences, a, b).join(listed, ["_a", "_b"], "left_anti").drop("_a", "_b")


def totals(df: DataFrame, keys: list[str], ours: str, theirs: str, wrong: str) -> DataFrame:
    """(keys, all, correct, wrong, pct): pairs of counts summed up; all is the greater of both sides, correct what is not wrong."""
    whole = F.sum(F.greatest(ours, theirs))
    right = F.sum(F.greatest(F.greatest(ours, theirs) - F.col(wrong), F.lit(0)))
    return df.groupBy(*keys).agg(whole.alias("all"), right.alias("correct"), F.sum(wrong).alias("wrong"), F.round(100 * right / whole, 3).alias("pct"))


def driver_signals(signals: DataFrame, drivers: DataFrame, keys: list[str], signal: str, driver: str) -> tuple[DataFrame, DataFrame]:
    """Signals that start with one of their key's drivers, and the others, which are ignored.

    Signals are cut at each underscore and at their end, and joined on the cut, so no driver meets a signal it does not begin.
    """
    cuts = F.transform(F.sequence(F.lit(1), F.length(signal)), lambda n: F.substring(F.col(signal), F.lit(1), n))
    rows = signals.select(*keys, signal).distinct().withColumn("_cut", F.explode(cuts))
    kept = rows.join(drivers.select(*keys, F.col(driver).alias("_cut")).distinct(), [*keys, "_cut"], "left_semi").select(*keys, signal).distinct()
    return signals.join(kept, [*keys, signal], "left_semi"), signals.join(kept, [*keys, signal], "left_anti")


def driver_names(df: DataFrame, keys: list[str], driver: str, instances: str, renames: dict[str, str], dropped: list[str]) -> DataFrame:
    """(keys, driver): drivers under their other names and with their instances, without the dropped ones; I2S as such, where any has an instance of it."""
    name = F.col(driver)
    for old, new in renames.items():
        name = F.when(F.col(driver) == old, new).otherwise(name)
    rows = df.withColumn("_n", F.upper(name)).select(*keys, "_n", F.explode_outer(instances).alias("_i"))
    rows = rows.withColumn("driver", F.concat("_n", F.coalesce("_i", F.lit("")))).where(~F.col("driver").isin(*dropped))
    any_i2s = rows.where("driver like 'I2S%'").select(*keys).distinct().withColumn("driver", F.lit("I2S"))
    return rows.select(*keys, "driver").unionByName(any_i2s).distinct()


def _report(devices: DataFrame, items: str) -> DataFrame:
    """One row of totals and shares in per cent from (device, state, n, wrong, validated): states are missing, ok and wrong."""
    state = lambda s: F.count_if(F.col("state") == s)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    found = devices.agg(
        F.count(F.lit(1)).alias("total_devices"), state("missing").alias("missing_devices"), state("ok").alias("correct_devices"), state("wrong").alias("wrong_devices"),
        F.count_if((F.col("state") == "ok") | ((F.col("state") == "wrong") & F.col("validated"))).alias("validated_devices"),
        total("n").alias(f"total_{items}"), total(F.col("n") - F.col("wrong")).alias(f"correct_{items}"), total("wrong").alias(f"wrong_{items}"),
        total(F.col("n") - F.when(F.col("validated"), 0).otherwise(F.col("wrong"))).alias(f"validated_{items}"),
    )
    share = lambda a, b: F.round(F.try_divide(F.col(a) * 100.0, F.col(b)), 3)
    return found.withColumns({f"{a}_{x}_pct": share(f"{a}_{x}", f"total_{x}") for x in ("devices", items) for a in ("correct", "validated")})


def _agreed(a: Column, b: Column) -> Column:
    return F.contains(a, b) | F.contains(b, a)


def package_report(ours: DataFrame, theirs: DataFrame, pads: DataFrame, pairs: DataFrame, validated: DataFrame) -> DataFrame:
    """One row: how many devices and pins of ours (device, package, pin, name) agree with theirs (device, pin, name).

    A device that they lack is missing. Pins that one side lacks are wrong unless pads (package, pin) lists them, and pins
    of two names are unless one is part of the other or pairs (a, b) lists them. A device counts as many pins as the side
    with more. validated (device): those whose differences have been looked into and are the other side's.
    """
    mine = ours.groupBy("device").agg(F.first("package").alias("package"), F.count(F.lit(1)).alias("_a"))
    devices = mine.join(theirs.groupBy("device").agg(F.count(F.lit(1)).alias("_b")), "device", "left")
    both = devices.where("_b is not null").select("device", "package")
    a, b = ours.select("device", "pin", F.col("name").alias("_x")), theirs.select("device", "pin", F.col("name").alias("_y"))
    met = a.join(b, ["device", "pin"], "full").join(both, "device").where(~F.col("_x").eqNullSafe(F.col("_y")))
    alone = met.where("_x is null or _y is null").join(pads.select("package", "pin"), ["package", "pin"], "left_anti").select("device")
    other = whitelisted(met.where("_x is not null and _y is not null").where(~_agreed(F.col("_x"), F.col("_y"))), pairs, "_x", "_y").select("device")
    wrong = alone.union(other).groupBy("device").agg(F.count(F.lit(1)).alias("wrong"))
    rows = devices.join(wrong, "device", "left").join(validated.select("device", F.lit(True).alias("validated")).distinct(), "device", "left")
    n = F.when(F.col("_b").isNull(), 0).otherwise(F.greatest("_a", "_b"))
    state = F.when(F.col("_b").isNull(), "missing").when(F.col("wrong") > 0, "wrong").otherwise("ok")
    return _report(rows.select("device", state.alias("state"), n.alias("n"), F.coalesce("wrong", F.lit(0)).alias("wrong"), F.coalesce("validated", F.lit(False)).alias("validated")), "pins")


def interrupt_report(ours: DataFrame, theirs: DataFrame, pairs: DataFrame, left_out: list[str] | None = None) -> DataFrame:
    """One row: how many devices and vectors of ours (device, position, name) agree with theirs.

    Cores of their own (`device@core`) and devices that begin with one of the patterns left_out do not count. A vector that
    they lack is missing, one of another name is wrong, unless the names have all words of one in common or pairs (a, b)
    lists them. A device with either is wrong.
    """
    kept = ~F.col("device").contains("@")
    for pattern in left_out or []:
        kept &= ~F.col("device").rlike(f"^(?:{pattern})")
    mine = ours.where(kept)
    have = theirs.select("device").distinct().withColumn("_has", F.lit(True))
    devices = mine.groupBy("device").agg(F.count(F.lit(1)).alias("_n")).join(have, "device", "left")
    met = mine.select("device", "position", F.col("name").alias("_x")).join(have.select("device"), "device", "left_semi").join(theirs.select("device", "position", F.col("name").alias("_y")), ["device", "position"], "left")
    missing = met.where("_y is null").groupBy("device").agg(F.count(F.lit(1)).alias("missing"))
    other = met.where("_y is not null").where(~agreeing(F.col("_x"), F.col("_y")))
    wrong = whitelisted(other, pairs, "_x", "_y").groupBy("device").agg(F.count(F.lit(1)).alias("wrong"))
    rows = devices.join(missing, "device", "left").join(wrong, "device", "left")
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    # Devices all of whose differences are listed stay with the wrong ones only if a vector is wrong or missing.
    faulty = (F.coalesce("wrong", F.lit(0)) + F.coalesce("missing", F.lit(0))) > 0
    found = rows.agg(
        F.count(F.lit(1)).alias("total_devices"), F.count_if(F.col("_has").isNull()).alias("missing_devices"), F.count_if(F.col("_has") & ~faulty).alias("correct_devices"), F.count_if(F.col("_has") & faulty).alias("wrong_devices"),
        count(F.when(F.col("_has"), F.col("_n"))).alias("total_vectors"), count("missing").alias("missing_vectors"), count("wrong").alias("wrong_vectors"),
    ).withColumn("correct_vectors", F.expr("total_vectors - missing_vectors - wrong_vectors"))
    return found.withColumns({f"correct_{x}_pct": F.round(F.try_divide(F.col(f"correct_{x}") * 100.0, F.col(f"total_{x}")), 1) for x in ("devices", "vectors")})
