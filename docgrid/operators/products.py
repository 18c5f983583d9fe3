"""Product codes: option axes of ordering information, and package names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a header line of ordering information must hold to open an axis, the axis, and whether it must occur.
AXES = [
    ("count", "pin", True),
    ("size", "size", True),
    ("package", "package", True),
    ("temperature", "temperature", True),
    ("option|identification|dedicated +pinout|power pairs|specificity|packing", "variant", False),
]
#: Repairs of package names in the order they apply, as plain text,
REPAIRS = [
    ("UFBGA/TFBGA64", "UFBGA64/TFBGA64"),
    ("LPQF", "LQFP"),
    ("TSSPOP", "TSSOP"),
    ("UFBG100", "UFBGA100"),
    ("UBGA", "UFBGA"),
    ("UQFN", "UFQFPN"),
    ("WLCSP20L", "WLCSP20"),
    ("UFQFPN48E", "UFQFPN48+E"),
    ("UFQFN", "UFQFPN"),
    ("LQFP48 SMPS<br>UFQFPN48 SMPS", "LQFP48/UFQFPN48+SMPS"),
    ("LQFP<br>64", "LQFP64"),
    ("LQFP<br>48", "LQFP48"),
    ("UFQFPN<br>32", "UFQFPN32"),
    ("UFQFP<br>N48", "UFQFPN48"),
    ("WLCSP<br>25", "WLCSP25"),
]
#: and then as patterns.
PATTERNS = [
    (r"^BGA", "UFBGA"),
    (r"\(\d\)| ", ""),
    (r"[Ee]xt-?/?", ""),
    (r"<br>SMPS", "SMPS"),
    (r"SMSP", "SMPS"),
    (r"with|-|_", "+"),
    (r"or", "/"),
    (r"\(STM32L0.*?UxSonly\)", "+S"),
    (r"(\d+)SMPS", "$1+SMPS"),
    (r"\+GP", ""),
]


def axis_of(header: Column) -> Column:
    """The axis that a header line opens, by the first pattern that it holds; null for other lines."""
    out = F.lit(None).cast("string")
    for pattern, axis, _ in reversed(AXES):
        out = F.when(header.rlike(f"(?i){pattern}"), axis).otherwise(out)
    return out


def option_codes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Options (keys, header, value, descr) as (keys, axis, code, descr).

    Footnote marks go. Codes of several letters stand for any, so they become empty, but as a variant they count only if
    the description names the letter (`x = N`); every document with a variant has also the variant `normal`.
    """
    rows = rows.withColumns({"axis": axis_of(F.col("header")), "value": F.regexp_replace("value", r"\(\d\)", "")}).where("axis is not null")
    long, variant = F.length("value") > 1, F.col("axis") == "variant"
    named = F.nullif(F.regexp_extract("descr", r"x += +([NA])", 1), F.lit(""))
    coded = rows.withColumn("code", F.when(long & variant, named).when(long, "").otherwise(F.col("value"))).where("code is not null").select(*keys, "axis", "code", "descr")
    normal = rows.where(variant).select(*keys).distinct().select(*keys, F.lit("variant").alias("axis"), F.lit("").alias("code"), F.lit("normal").alias("descr"))
    return coded.unionByName(normal).distinct()


def option_products(stems: DataFrame, codes: DataFrame, keys: list[str], stem: str) -> DataFrame:
    """Each stem of a document with every choice of one code an axis: (keys, stem, code, options: map axis -> description).

    Axes are joined on the document, one after the other. A document that lacks a needed axis fails at run time.
    """
    needed = [axis for _, axis, must in AXES if must]
    seen = codes.groupBy(*keys).agg(F.collect_set("axis").alias("_axes"))
    found = stems.select(*keys, stem).distinct().join(seen, keys, "left")
    missing = F.array_except(F.array(*map(F.lit, needed)), F.coalesce("_axes", F.array().cast("array<string>")))
    checked = F.assert_true(F.size(missing) == 0, F.concat(F.lit("no axis "), F.array_join(missing, ", ")))
    found = found.where(checked.isNull()).drop("_axes").withColumns({"code": F.col(stem), "options": F.create_map().cast("map<string,string>")})
    for _, axis, _ in AXES:  # outer joins, so that a lacking axis fails the check and not the join
        own = codes.where(F.col("axis") == axis).select(*keys, F.col("code").alias("_c"), F.col("descr").alias("_d"))
        found = found.join(own, keys, "left")
        added = F.when(F.col("_d").isNull(), F.col("options")).otherwise(F.map_concat("options", F.create_map(F.lit(axis), F.col("_d"))))
        found = found.withColumns({"code": F.concat("code", F.coalesce("_c", F.lit(""))), "options": added}).drop("_c", "_d")
    return found


def repaired_package(name: Column) -> Column:
    """A package name after the repairs."""
    for wrong, right in REPAIRS:
        name = F.replace(name, F.lit(wrong), F.lit(right))
    for pattern, value in PATTERNS:
        name = F.regexp_replace(name, pattern, value)
    return name


def packages(df: DataFrame, domain: str) -> DataFrame:
    """Header domains as packages: (..., package, filters, family, pins), one row for each alternative of a domain.

    The last part of a domain is the name; what follows a `+` in it are filters, and devices named in the parts before
    are one more. Names that are no package (letters, then the number of pins) are left out.
    """
    last = F.element_at(F.split(F.col(domain), ":"), -1)
    devices = F.regexp_extract(domain, r":(STM32.*?):", 1)
    listed = F.array_join(F.transform(F.filter(F.transform(F.split(devices, " |,|/|<br>"), lambda x: F.trim(x)), lambda d: d != ""), lambda d: F.replace(d, F.lit("x"), F.lit("."))), "|")
    parts = F.split(repaired_package(last), r"\+")
    rows = df.withColumns({"_p": parts, "_d": listed})
    filters = F.concat(F.slice("_p", 2, F.greatest(F.size("_p") - 1, F.lit(0))), F.when(F.col("_d") != "", F.array("_d")).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("filters", filters).withColumn("package", F.explode(F.filter(F.split(F.get("_p", F.lit(0)), r"[/,]| or |<br>"), lambda p: p != ""))).drop("_p", "_d")
    pattern = r"^([A-Za-z]+)(\d+)"
    rows = rows.withColumns({"family": F.regexp_extract("package", pattern, 1), "pins": F.expr(r"try_cast(regexp_extract(package, '^([A-Za-z]+)(\\d+)', 2) as int)")})
    return rows.where("pins is not null")


def first_filled(df: DataFrame, keys: list[str], *sources: DataFrame) -> DataFrame:
    """For each key the rows of the first source that has any (a fallback chain), with its number as column source."""
    found = None
    for k, s in enumerate(sources):
        own = s.withColumn("source", F.lit(k))
        found = own if found is None else found.unionByName(own)
    found = found.join(df.select(*keys).distinct(), keys, "left_semi").withColumn("_first", F.min("source").over(Window.partitionBy(*keys)))
    return found.where("source = _first").drop("_first")
