"""Register maps: cleaning, types named by captions, arrays, links from instances, structures and field macros of headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import from_hex, linear_offset
from ..lineage import written
from .recursion import recursive, same
from .sequence import best, running_offset

#: Substitutions that clean the cells of register tables, in the order they apply.
OFFSET_RULES = [(r" +", ""), (r"0x000x00", "0x00"), (r"to", "-"), (r"×", "*"), (r"\(\d+\)", "")]
REGISTER_RULES = [
    (r" +|\.+", ""),
    (r"\(COM(\d)\)", "_COM$1"),
    (r"^[Rr]es$||0x[\da-fA-FXx]+|\(.*?\)|-", ""),
    (r"(?i)reserved|resetvalue.*", ""),
    (r"enabled", "_EN"),
    (r"disabled", "_DIS"),
    (r"(?i)Outputcomparemode", "_Output"),
    (r"(?i)Inputcapturemode", "_Input"),
    (r"mode", ""),
    (r"^TG_FS_", "OTG_FS_"),
    (r"toRTC", "RTC"),
    (r"SPI2S_", "SPI_"),
    (r"andTIM\d+_.*", ""),
    (r"x=[\d,]+", ""),
]
FIELD_RULES = [
    (r"\] +\d+(th|rd|nd|st)", "]"),
    (r" +|\.+|\[.*?\]|\[?\d+:\d+\]?|\(.*?\)|-|^[\dXx]+$|%|__|:0\]", ""),
    (r"Dataregister|Independentdataregister", "DATA"),
    (r"Framefilterreg0.*", "FRAME_FILTER_REG"),
    (r"[Rr]es(erved)?|[Rr]egular|x_x(bits)?|NotAvailable|RefertoSection\d+:Comparator", ""),
    (r"Sampletimebits|Injectedchannelsequence|channelsequence|conversioninregularsequencebits", ""),
    (r"conversioninsequencebits|conversionininjectedsequencebits|or|first|second|third|fourth", ""),
]
#: Sizes in bytes of the types that C structures are made of.
BUILTINS = {"uint8_t": 1, "uint16_t": 2, "uint32_t": 4, "uint64_t": 8, "int8_t": 1, "int16_t": 2, "int32_t": 4, "int64_t": 8, "char": 1, "short": 2, "int": 4}


def cleaned(text: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, value in rules:
        text = F.regexp_replace(text, pattern, value)
    return F.trim(text)


def register_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Cells (keys, register, offset, bits, field) as (keys, register, offset, bit, field), cleaned; rows that name no
    register, offset or field go. A range of bits holds all from its lower to its upper bound."""
    last = F.regexp_replace("bits", ".*:", "")
    ends = F.transform(F.filter(F.split(last, "-"), lambda p: p.rlike(r"^\s*\d+\s*$")), lambda p: F.trim(p).cast("int"))
    out = rows.withColumns({"register": cleaned(F.col("register"), REGISTER_RULES), "offset": cleaned(F.col("offset"), OFFSET_RULES), "field": cleaned(F.col("field"), FIELD_RULES), "_b": ends})
    out = out.where("register <> '' and offset <> '' and field <> '' and size(_b) > 0")
    return out.select(*keys, "register", "offset", F.explode(F.sequence(F.array_min("_b"), F.array_max("_b"))).alias("bit"), "field")


def peripheral_type(caption: Column, registers: Column) -> Column:
    """Name of the type that a register map (array of register names) describes: by its caption, or by the greatest of the
    words before the first `_` of its registers, families of timers, comparators and ports under one name."""
    firsts = F.array_sort(F.array_distinct(F.transform(registers, lambda r: F.split_part(r, F.lit("_"), F.lit(1)))))
    all_of = lambda p: F.forall(firsts, lambda n: n.startswith(p))
    name = F.element_at(firsts, -1)
    plain = F.when(all_of("COMP"), "COMP").when(all_of("OPAMP"), "OPAMP").when(name.startswith("LPTIM"), "LPTIM").when(name.startswith("TIM"), "TIM").when(name.contains("GPIOx"), "GPIO").otherwise(name)
    return F.when(caption.rlike("OTG_[FH]S"), "OTG").when(caption.contains("JPEG"), "JPEG").when(caption.contains("CCU "), "CANCCU").otherwise(plain)


def caption_filters(caption: Column) -> Column:
    """Map of filters (instances, devices) that a caption names, each an array of patterns.

    `TIM2 to TIM5` is a range, `TIM9/12` are alternatives; so are the devices of `STM32F405/415xx`; x stands for any character.
    """
    ends = F.array(*[F.regexp_extract(caption, r"TIM(\d+) +to +TIM(\d+)", k).try_cast("int") for k in (1, 2)])
    span = F.when(caption.rlike(r"TIM\d+ +to +TIM\d+"), F.array(F.concat(F.lit("TIM("), F.array_join(F.transform(F.sequence(F.array_min(ends), F.array_max(ends)), lambda i: i.cast("string")), "|"), F.lit(")")))).otherwise(F.array().cast("array<string>"))

    def listed(pattern: str, size: int, form: str) -> Column:
        each = F.regexp_extract_all(caption, F.lit(f"({pattern})"), F.lit(1))
        inner = lambda m: F.when(F.contains(m, F.lit("/")), F.concat(F.substring(m, F.lit(1), F.lit(size)), F.lit("("), F.replace(F.substring(m, F.lit(size + 1), F.length(m)), F.lit("/"), F.lit("|")), F.lit(")"))).otherwise(m)
        return F.transform(each, lambda m: F.concat(F.lit(form[0]), inner(m), F.lit(form[1])) if form else inner(m))

    instances = F.array_distinct(F.concat(span, listed(r"TIM\d+(?:/\d+)*", 3, "^$"), listed(r"GPIO[A-Z](?:[/A-Z]+)?", 4, "")))
    devices = F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(caption, F.lit(r"(STM32[\w/]+)"), F.lit(1)), device_patterns)))
    pair = lambda key, value: F.struct(F.lit(key).alias("key"), value.alias("value"))
    return F.map_from_entries(F.filter(F.array(pair("instances", instances), pair("devices", devices)), lambda e: F.size(e["value"]) > 0))


def chapter_filters(chapter: Column, type_name: Column) -> Column:
    """Map of filters (instances, devices) that a chapter's name and the type itself set, whatever the caption says."""
    # The product lines that some chapters are about.
    line = F.when(chapter.contains("connectivity line"), "STM32F10[57]").when(chapter.contains("low medium high and xl density"), "STM32F10[123]")
    delay = F.when(type_name.startswith("DLYB"), "DLYB")
    entry = lambda key, value: F.struct(F.lit(key).alias("key"), F.array(value).alias("value"))
    return F.map_from_entries(F.filter(F.array(entry("instances", delay), entry("devices", line)), lambda e: F.get(e["value"], F.lit(0)).isNotNull()))


def taken_name(caption: Column, registers: Column) -> Column:
    """What is taken off the names of a register map's registers: the name they share, none for comparators and amplifiers."""
    firsts = F.array_sort(F.array_distinct(F.transform(registers, lambda r: F.split_part(r, F.lit("_"), F.lit(1)))))
    all_of = lambda p: F.forall(firsts, lambda n: n.startswith(p))
    name = F.element_at(firsts, -1)
    plain = F.when(all_of("COMP") | all_of("OPAMP"), "").when(name.startswith("LPTIM"), "LPTIM").otherwise(name)
    return F.when(caption.rlike("OTG_[FH]S"), "OTG").when(caption.contains("JPEG"), "JPEG").when(caption.contains("CCU "), "FDCAN_CCU").otherwise(plain)


def single_register(register: Column, taken: Column) -> Column:
    """(name, instances, devices) of one register: its name without what is taken off it; a pattern of the instance that
    stands before the name instead; and a pattern of the product line that its name ends with."""
    core = F.when(taken == "OTG", F.regexp_extract(register, "^OTG_[FH]S", 0)).otherwise("")
    without = lambda part: F.replace(register, F.concat(part, F.lit("_")), F.lit(""))
    first = F.split_part(register, F.lit("_"), F.lit(1))
    short = F.when(core != "", without(core)).otherwise(without(taken))
    other = (taken != "") & (short == register) & register.contains("_")
    name = F.when(taken == "", register).when(other, without(first)).otherwise(short)
    instances = F.when(other, F.concat(first, F.lit("$"))).when(core != "", core)
    # The ends of names that tell product lines apart.
    ends = [("connectivitylinedevices", "STM32F10[57]"), ("low,medium,highandXLdensitydevices", "STM32F10[123]")]
    devices = F.lit(None).cast("string")
    for end, pattern in reversed(ends):
        devices = F.when(name.contains(end), pattern).otherwise(devices)
    bare = name
    for end, _ in ends:
        bare = F.when(F.instr(bare, end) > 0, F.substring_index(bare, end, 1)).otherwise(bare)
    return F.struct(bare.alias("name"), instances.alias("instances"), devices.alias("devices"))


def device_patterns(text: Column) -> Column:
    """`STM32F405/415xx` -> [STM32F405xx, STM32F415xx] with x as any character: later parts replace the end of the first's
    stem, and the letters after the last part follow each."""
    parts = F.split(text, "/")
    tail = F.regexp_extract(text, r"(x+)$", 1)
    stem = F.regexp_replace(F.get(parts, F.lit(0)), "x+$", "")
    one = lambda p: F.regexp_replace(p, "x+$", "")
    whole = F.transform(parts, lambda p, i: F.concat(F.when((i == 0) | p.startswith("STM32"), one(p)).otherwise(F.concat(F.substring(stem, F.lit(1), F.greatest(F.length(stem) - F.length(one(p)), F.lit(0))), one(p))), tail))
    return F.transform(whole, lambda d: F.replace(d, F.lit("x"), F.lit(".")))


#: Registers that stand for sequences although their offset is one number. What the peripheral's and the
#: register's names contain, the step in bytes, and how many there are.
SEQUENCES = [("CAN", "F1R2", 4, 51), ("GFXMMU", "LUT0L", 8, 1023), ("GFXMMU", "LUT0H", 8, 1023), ("HSEM", "R1", 4, 30)]


def sequence_name(peripheral: Column, name: Column, index: Column) -> Column:
    """The name of an element of a register array, by the custom of its peripheral: letters or numbers, in or behind the name."""
    letter, text = F.char(index + 65), index.cast("string")
    return (
        F.when(name.rlike(r"^BKP\d+R"), F.concat(F.lit("BKP"), text, F.lit("R")))
        .when(peripheral.contains("SAI"), F.concat(F.substring(name, F.lit(2), F.length(name)), letter))
        .when(peripheral.contains("HRTIM"), F.replace(name, F.lit("x"), letter))
        .when(peripheral.contains("CAN"), F.concat(F.lit("F"), F.floor((index + 3) / 2).cast("string"), F.lit("R"), ((index + 1) % 2 + 1).cast("string")))
        .when(peripheral.contains("GFXMMU"), F.concat(F.lit("LUT"), text, F.right(name, F.lit(1))))
        .when(peripheral.contains("HSEM"), F.concat(F.substring(name, F.lit(1), F.length(name) - 1), (index + 1).cast("string")))
        .when(name.contains("x"), F.replace(name, F.lit("x"), text))
        .otherwise(F.concat(name, F.lit("."), text))
    )


def expanded_offsets(df: DataFrame, offset: str, name: str, peripheral: str | None = None) -> DataFrame:
    """Register arrays one row an element: (..., index, byte_offset), the name's `x` replaced, or `.index` put behind.

    Offsets may be a number; a range `0x50-0x5C` (by 4); alternatives `0x10or0x20`; a list `0x28(x=A)0x30(x=B)`; a formula
    with a range `0x10+4*x(x=0..3)` (or `0-3`); a formula over `channelnumber` (0 to 15) or over the numbers of monitor
    units (1 to 5). Others give no row. peripheral: the column of the peripheral's name, which decides how elements are
    called and which single registers stand for SEQUENCES.
    """
    text = F.regexp_replace(offset, r"\s+", "")
    number = r"0[xX][0-9A-Fa-f]+"
    spans = F.split(text, "-")
    listed = F.regexp_extract_all(text, F.lit(rf"({number})\(x=\w+\)"), F.lit(1))
    bounds = lambda k: F.expr(f"try_cast(regexp_extract(`{offset}`, '\\\\(x=(\\\\d+)(?:-\\\\.?|\\\\.\\\\.)(\\\\d+)', {k}) as int)")
    formula = F.regexp_replace(F.split(text, r"\(x=|,").getItem(0), "channelnumber", "x")
    at = lambda values: F.transform(values, lambda v, i: F.struct(i.cast("int").alias("index"), v.cast("bigint").alias("byte_offset")))
    by_x = lambda lo, hi: F.transform(F.sequence(lo, hi), lambda x: F.struct(x.cast("int").alias("index"), linear_offset(formula, x.cast("bigint")).alias("byte_offset")))
    known = F.lit(None)
    for part, of, step, n in SEQUENCES if peripheral else []:
        from_ = from_hex(text)
        known = F.when(F.col(peripheral).contains(part) & F.col(name).contains(of) & text.rlike(f"^{number}$"), at(F.sequence(from_, from_ + step * (n - 1), F.lit(step).cast("bigint")))).otherwise(known)
    rows = (
        F.when(known.isNotNull() if peripheral else F.lit(False), known)
        .when(text.rlike(f"^{number}$"), F.array(F.struct(F.lit(None).cast("int").alias("index"), from_hex(text).alias("byte_offset"))))
        .when(text.rlike(f"^{number}-{number}$"), at(F.sequence(from_hex(F.get(spans, F.lit(0))), from_hex(F.get(spans, F.lit(1))), F.lit(4).cast("bigint"))))
        .when(text.rlike(f"^{number}(or{number})+$"), at(F.transform(F.split(text, "or"), from_hex)))
        .when(F.size(listed) > 0, at(F.transform(listed, from_hex)))
        .when(text.contains("channelnumber"), by_x(F.lit(0), F.lit(15)))
        .when(text.contains("moni-ringunitnumber") & text.contains("(x="), by_x(F.lit(1), F.lit(5)))
        .when(bounds(1).isNotNull() & bounds(2).isNotNull(), by_x(bounds(1), bounds(2)))
    )
    out = df.withColumn("_r", F.explode(rows)).select("*", "_r.index", "_r.byte_offset").drop("_r")
    if peripheral:
        return out.withColumn(name, F.when(F.col("index").isNull(), F.col(name)).otherwise(sequence_name(F.col(peripheral), F.col(name), F.col("index"))))
    indexed = F.when(F.contains(name, F.lit("x")), F.replace(name, F.lit("x"), F.col("index").cast("string"))).otherwise(F.concat(name, F.lit("."), F.col("index").cast("string")))
    return out.withColumn(name, F.when(F.col("index").isNull(), F.col(name)).otherwise(indexed))


def linked_types(instances: DataFrame, types: DataFrame) -> DataFrame:
    """Instances (name, sections) with the types (type, section) of the first level that has any: the same name; a type
    whose name is part of the instance's; one described in a section the instance refers to; USART for UARTs; RTC for BKP.

    Every level is a join by equality: the parts of a name are listed (names are short) and looked up as names of types.
    """
    name, size = F.col("name"), F.length("name")
    part = lambda i: F.transform(F.sequence(F.lit(1), size - i + 1), lambda n: F.substring(name, i, n))
    parts = F.when(size > 0, F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), size), part)))).otherwise(F.array().cast("array<string>"))
    keyed = lambda level, keys: F.transform(keys, lambda k: F.struct(F.lit(level).alias("level"), k.alias("_key")))
    only = lambda holds, key: F.when(holds, F.array(F.lit(key))).otherwise(F.array().cast("array<string>"))
    names = F.concat(keyed(0, F.array(name)), keyed(1, F.concat(F.array(F.lit("")), parts)), keyed(3, only(name.startswith("UART"), "USART")), keyed(4, only(name == "BKP", "RTC")))
    by_name = instances.withColumn("_k", F.explode(names)).select(*instances.columns, "_k.*").join(types, F.col("_key") == F.col("type"))
    by_section = instances.withColumn("_key", F.explode("sections")).withColumn("level", F.lit(2)).join(types, F.col("_key") == F.col("section"))
    found = by_name.unionByName(by_section).drop("_key")
    return best(found, ["name"], "level", "type", "section").select(*instances.columns, *types.columns, "level")


def instance_offsets(df: DataFrame, text: str, offset: str) -> DataFrame:
    """Offsets of instances that a global register map names: `ADC1 and ADC2` at `0x300-0x308` -> (ADC[1], 768), (ADC[2], 768)."""
    first = from_hex(F.split_part(offset, F.lit("-"), F.lit(1)))
    return df.select(F.explode(F.regexp_extract_all(text, F.lit(r"ADC(\d+)"), F.lit(1))).alias("_n"), first.alias("offset")).select(F.concat(F.lit("ADC["), "_n", F.lit("]")).alias("instance"), "offset")


def boundary_rows(df: DataFrame, names: str, addresses: str, bus: str, sections: str) -> DataFrame:
    """Rows of a memory boundary table: (name, lo, hi, bus, sections), one a name; rows that refer to no section go."""
    ends = F.transform(F.split(F.regexp_replace(addresses, r"\s+", ""), "-"), from_hex)
    refs = F.regexp_extract_all(sections, F.lit(r"Section\s+(\d+(?:\.\d+)*)"), F.lit(1))
    rows = df.select(F.explode(F.filter(F.transform(F.split(names, r" |,|/|<br>"), lambda x: F.trim(x)), lambda n: n != "")).alias("name"), F.array_min(ends).alias("lo"), F.array_max(ends).alias("hi"), F.col(bus).alias("bus"), refs.alias("sections"))
    return rows.where("size(sections) > 0 and lo is not null")


def device_define(devices: DataFrame, defines: DataFrame) -> DataFrame:
    """The define of each device (family, name, size, pin, variant): the only one of its name, else the first in order
    that is not below the name with the size (and variant), else the first not below the name with the pin.

    defines: (define). Joined on the first nine characters, which name the device."""
    stem = F.upper(F.concat(F.lit("STM32"), "family", "name"))
    stem = F.when((F.col("family") == "f7") & stem.endswith("8"), F.concat(F.left(stem, F.lit(8)), F.lit("7"))).otherwise(stem)
    size = F.when(F.col("family") == "h7", F.lit("xx")).otherwise(F.concat(F.lit("x"), F.upper("size")))
    option = F.when((F.col("family") == "l1") & F.col("pin").isin("q", "z") & (F.col("size") == "c"), "A").when(F.col("family").isin("l1", "h7"), F.upper(F.coalesce("variant", F.lit("")))).otherwise("")
    wanted = devices.withColumns({"_stem": stem, "_size": F.concat(stem, size, option), "_pin": F.concat(stem, F.upper("pin"), F.lit("x"))})
    own = defines.withColumn("_stem", F.left("define", F.lit(9)))
    met = wanted.join(own, "_stem").withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*devices.columns)))
    rank = F.when(F.col("_n") == 1, 0).when(F.col("_size") <= F.col("define"), 1).when(F.col("_pin") <= F.col("define"), 2)
    least = F.min(F.length("define")).over(Window.partitionBy(*devices.columns))
    met = met.withColumns({"_rank": rank, "_least": least}).where("_rank is not null")
    return best(met, devices.columns, "_rank", F.expr("left(define, _least)"), "define").select(*devices.columns, "define")


def type_sizes(members: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, type, size): bytes of each structure, those within it included. Unknown and cyclic types raise ValueError.

    Each structure is followed down to all it holds, with how often it holds it; sizes are sums over what is found.
    """
    m = members.withColumns({"_n": F.greatest("count", F.lit(1)).cast("bigint"), "_own": _builtin("member_type")})
    inner = m.where("_own is null").groupBy(*keys, "type", "member_type").agg(F.sum("_n").alias("_n"))
    start = m.select(*keys, F.col("type").alias("_root"), "type", F.lit(1).cast("bigint").alias("_times"), F.array("type").alias("_seen")).distinct()
    below = recursive(start, inner, f"{same(keys)} AND t.type = e.type AND NOT array_contains(slice(t._seen, 1, size(t._seen) - 1), t.type)", type="e.member_type", _times="t._times * e._n", _seen="concat(t._seen, array(e.member_type))")
    below = written(below)
    known = m.groupBy(*keys, "type").agg(F.coalesce(F.sum(F.col("_n") * F.col("_own")), F.lit(0)).cast("bigint").alias("_bytes"))
    cyclic = below.where("array_contains(slice(_seen, 1, size(_seen) - 1), type)")
    wrong = cyclic.select("type").union(below.join(known, [below[k].eqNullSafe(known[k]) for k in [*keys, "type"]], "left_anti").select("type")).first()
    if wrong:
        raise ValueError(f"unknown type {wrong.type}")
    found = below.alias("b").join(known.alias("k"), [F.col(f"b.{c}").eqNullSafe(F.col(f"k.{c}")) for c in [*keys, "type"]])
    return found.groupBy(*[F.col(f"b.{k}").alias(k) for k in keys], F.col("_root").alias("type")).agg(F.sum(F.col("_times") * F.col("_bytes")).alias("size"))


def _builtin(kind: str) -> Column:
    return F.create_map(*[F.lit(x) for pair in BUILTINS.items() for x in pair])[F.col(kind)]


def _elements(m: DataFrame, keys: list[str]) -> DataFrame:
    """Members of known size (_n times _each) one row an element, with its offset within its type."""
    m = m.withColumn("_at", running_offset(F.col("_n") * F.col("_each"), Window.partitionBy(*keys, "type").orderBy("ord")))
    each = m.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)))
    return each.select(*keys, "type", "ord", "name", "member_type", "_own", F.col("_i").cast("int").alias("_i"), F.when(F.col("count") > 0, F.concat("name", F.lit("."), "_i")).alias("_label"), (F.col("_at") + F.col("_i") * F.col("_each")).alias("_at"))


#: Elements that give a row: of a built-in type, and not reserved.
_LEAVES = "_own is not null and not startswith(upper(name), 'RESERVED')"


def _numbered(found: DataFrame, keys: list[str], *by: str) -> DataFrame:
    ord_ = F.row_number().over(Window.partitionBy(*keys, "type").orderBy(*by)) - 1
    return found.withColumn("_ord", ord_).select(*keys, "type", F.col("_ord").alias("ord"), "name", "byte_offset", "size")


def flattened(members: DataFrame, keys: list[str]) -> DataFrame:
    """Members of C structures with those of the structures within them: (keys, type, ord, name, byte_offset, size).

    members: (keys, type, ord, member_type, name, count; 0 for a single member). Arrays are one row an element, `name.index`;
    reserved members take room and give no row. Unknown types raise ValueError. Offsets are prefix sums within a type.
    Types that hold no structure are done with that; only the others, and what they hold, enter a recursion.
    """
    m = members.withColumns({"_n": F.greatest("count", F.lit(1)).cast("bigint"), "_own": _builtin("member_type")})
    held = written(m.where("_own is null").select(*keys, "type", "member_type").distinct())
    named = lambda kind: held.select(*[F.col(k).alias(f"_d{i}") for i, k in enumerate(keys)], F.col(kind).alias("_d"))
    same_type = [*(F.col(k).eqNullSafe(F.col(f"_d{i}")) for i, k in enumerate(keys)), F.col("type").eqNullSafe(F.col("_d"))]
    flat = held.isEmpty()
    plain = m if flat else m.join(named("type"), same_type, "left_anti")
    leaves = _elements(plain.withColumn("_each", F.col("_own").cast("bigint")), keys).where(_LEAVES)
    leaves = leaves.select(*keys, "type", "ord", "_i", F.coalesce("_label", "name").alias("name"), F.col("_at").alias("byte_offset"), F.col("_own").cast("int").alias("size"))
    out = _numbered(leaves, keys, "ord", "_i")
    if flat:
        return out
    involved = members.join(named("type").union(named("member_type")), same_type, "left_semi")
    return out.unionByName(_nested(involved, keys).join(named("type"), same_type, "left_semi"))


def _nested(members: DataFrame, keys: list[str]) -> DataFrame:
    """flattened() of any types: what lies in the structures within them is found by a recursive query, however deep."""
    sizes = type_sizes(members, keys).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("type").alias("_kind"), F.col("size").alias("_whole"))
    m = members.withColumns({"_n": F.greatest("count", F.lit(1)).cast("bigint"), "_own": _builtin("member_type")})
    m = m.join(sizes, [*(F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)), F.col("member_type") == F.col("_kind")], "left").withColumn("_each", F.coalesce("_own", "_whole").cast("bigint"))
    each = written(_elements(m, keys))
    start = each.select(*keys, F.col("type").alias("_root"), "type", F.lit(0).cast("bigint").alias("_base"), F.lit("").alias("_prefix"), F.array().cast("array<int>").alias("_place")).distinct()
    step = {"type": "e.member_type", "_base": "t._base + e._at", "_prefix": "concat(t._prefix, coalesce(concat(e._label, '.'), ''))", "_place": "concat(t._place, array(e.ord, e._i))"}
    within = recursive(start, each.where("_own is null"), f"{same(keys)} AND t.type = e.type", **step)
    leaves = each.where(_LEAVES)
    met = within.alias("w").join(leaves.alias("l"), [F.col(f"w.{k}").eqNullSafe(F.col(f"l.{k}")) for k in [*keys, "type"]])
    found = met.select(*[F.col(f"w.{k}").alias(k) for k in keys], F.col("_root").alias("type"), F.concat("_prefix", F.coalesce("_label", "name")).alias("name"), (F.col("_base") + F.col("_at")).alias("byte_offset"), F.col("_own").cast("int").alias("size"), F.concat("_place", F.array("ord", "_i")).alias("_place"))
    return _numbered(found, keys, "_place")


def matched_fields(registers: DataFrame, macros: DataFrame, keys: list[str]) -> DataFrame:
    """Fields of registers by header macros: (keys, register, field, position, width), for each PREFIX_FIELD that has a
    value, `_Pos` and `_Msk`.

    registers: (keys, register, prefix such as `ADC_CR1_`); macros: (keys, name, number). Macros are joined on the prefixes
    up to each of their underscores, never pair by pair. Registers grow with the macros and their names are computed, so the
    optimizer's estimate falls far below their size: neither side is ever broadcast.
    """
    words = F.split("name", "_")
    starts = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))), lambda n: F.concat(F.array_join(F.slice(words, F.lit(1), n), "_"), F.lit("_")))
    cut = macros.select(*keys, "name", "number", F.explode(starts).alias("prefix"))
    met = cut.join(registers.select(*keys, "register", "prefix").hint("merge"), [*keys, "prefix"]).withColumn("rest", F.expr("substring(name, length(prefix) + 1)"))
    part = F.when(F.col("rest").endswith("_Pos"), "pos").when(F.col("rest").endswith("_Msk"), "msk").otherwise("val")
    met = met.withColumns({"part": part, "field": F.regexp_replace("rest", "_(Pos|Msk)$", "")})
    wide = met.groupBy(*keys, "register", "field").pivot("part", ["pos", "msk", "val"]).agg(F.max(F.col("number").cast("bigint")))
    shifted = F.expr("shiftrightunsigned(msk, cast(pos as int))")
    return wide.where("pos is not null and msk is not null and val is not null").select(*keys, "register", "field", F.col("pos").cast("int").alias("position"), F.when(shifted == 0, 0).otherwise(F.length(F.bin(shifted))).alias("width"))


def interrupt_table(tables: DataFrame, device: Column, has_core: Column) -> Column:
    """Name of the interrupt table of a device, from an array of names in order: the first without filters (parts after
    colons) or whose `Device=` pattern fits; a `Core=` or `Categories=` filter before ends the search, as does a device with a core."""
    def verdict(name: Column) -> Column:
        filters = F.slice(F.split(name, ":"), 2, F.greatest(F.size(F.split(name, ":")) - 1, F.lit(0)))
        fits = lambda f: f.startswith("Device=") & F.regexp_like(device, F.concat(F.lit("(?i)^"), F.substring(f, F.lit(8), F.length(f))))
        stops = lambda f: f.startswith("Core=") | f.startswith("Categories=")
        first = F.get(F.filter(filters, lambda f: fits(f) | stops(f)), F.lit(0))
        return F.when((F.size(filters) == 0), 1).when(first.isNull(), 0).when(fits(first), 1).otherwise(-1)

    decided = F.get(F.filter(F.transform(tables, lambda t: F.struct(verdict(t).alias("v"), t.alias("t"))), lambda s: s["v"] != 0), F.lit(0))
    return F.when(~has_core & (decided["v"] == 1), decided["t"])


def device_map(rows: DataFrame, instances: DataFrame, keys: list[str]) -> DataFrame:
    """From register cells to fields of instances: cells cleaned, arrays expanded, bits of a name joined to fields, and
    registers placed at their instances' addresses. rows: (keys, type, section, register, offset, bits, field); instances: (name, address, sections)."""
    cells = register_rows(rows, [*keys, "type", "section"])
    fields = expanded_offsets(cells, "offset", "register").groupBy(*keys, "type", "section", "register", "byte_offset", "field").agg(F.min("bit").alias("position"), (F.max("bit") + 1 - F.min("bit")).alias("width"))
    linked = linked_types(instances, rows.select("type", "section").distinct())
    met = fields.join(linked.select("name", "address", "type", "section"), ["type", "section"])
    return met.select(*keys, F.col("name").alias("instance"), "type", "register", (F.col("address") + F.col("byte_offset")).alias("address"), "field", "position", "width")


def pin_rows(rows: DataFrame, keys: list[str], repairs: dict[str, str] | None = None) -> DataFrame:
    """Rows of a pin table (keys, name, type, structure, functions, positions: map package -> places) one a package and
    place: (keys, package, position, name, type, structure, functions). Footnote marks and what follows a blank or a
    bracket go from names; `-` stands for no place."""
    name = F.regexp_replace(F.regexp_replace(F.col("name"), r"\(\d+\)", ""), r"[ (\[].*$", "")
    for wrong, right in (repairs or {}).items():
        name = F.when(name == wrong, right).otherwise(name)
    listed = F.filter(F.transform(F.split("functions", r"[ ,]+|<br>"), lambda f: F.trim(f)), lambda f: ~f.isin("", "-"))
    out = rows.select(*keys, name.alias("name"), F.nullif(F.trim("type"), F.lit("-")).alias("type"), F.nullif(F.trim("structure"), F.lit("-")).alias("structure"), listed.alias("functions"), F.explode("positions").alias("package", "_p"))
    out = out.withColumn("position", F.explode(F.filter(F.split(F.regexp_replace("_p", r"\(\d+\)", ""), r"[ ,]+|<br>"), lambda p: ~p.isin("", "-"))))
    return out.select(*keys, "package", "position", "name", "type", "structure", "functions")


def vector_tables(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of interrupt tables (keys, caption, position, name) as (keys, table, position, names in order): the table is
    named by what its caption says of cores, devices or categories, `VectorTable` otherwise; only numbered positions count."""
    caption = F.col("caption")
    core, categories = F.regexp_extract(caption, r"(?i)cortex.?(m\d\+?)", 1), F.regexp_extract_all(caption, F.lit(r"(?i)categor(?:y|ies) (\d)"), F.lit(1))
    devices = F.flatten(F.transform(F.regexp_extract_all(caption, F.lit(r"(STM32[\w/]+)"), F.lit(1)), device_patterns))
    table = F.concat(F.lit("VectorTable"), F.when(core != "", F.concat(F.lit(":Core="), F.lower(core))).otherwise(""), F.when(F.size(devices) > 0, F.concat(F.lit(":Device="), F.array_join(devices, "|"))).otherwise(""), F.when(F.size(categories) > 0, F.concat(F.lit(":Categories="), F.array_join(categories, ","))).otherwise(""))
    kept = rows.where(F.col("position").rlike(r"^\s*\d+\s*$")).withColumns({"table": table, "position": F.trim("position").cast("int")})
    return kept.groupBy(*keys, "table", "position").agg(F.sort_array(F.collect_set("name")).alias("names"))


def device_family(heading: Column) -> Column:
    """`STM32F4` and the like, from a document's first heading; empty if it names none."""
    return F.regexp_extract(heading, r"STM32\w\w", 0)


def without_duplicates(peripherals: DataFrame, keys: list[str], name: str, address: str) -> DataFrame:
    """Peripherals without the `_COMMON` ones at the address of another, and without a shared one (OPAMP) beside its numbered parts."""
    at = peripherals.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys, address)))
    numbered = F.max(F.col(name).rlike(r"^OPAMP\d")).over(Window.partitionBy(*keys))
    kept = at.withColumn("_o", numbered).where(~(F.col(name).endswith("_COMMON") & (F.col("_n") > 1)) & ~((F.col(name) == "OPAMP") & F.col("_o")))
    return kept.drop("_n", "_o")


def selected_packages(devices: DataFrame, packages: DataFrame, keys: list[str], aliases: dict[str, str] | None = None) -> DataFrame:
    """For each device (keys, package) the longest of its document's packages (keys, name, filters: patterns that the device
    must hold) that fits, by name, by a part of it, or by another name of it. Filters must all hold."""
    other = F.col("package")
    for old, new in (aliases or {}).items():
        other = F.when(F.col("package").startswith(old), F.concat(F.lit(new), F.substring("package", F.lit(len(old) + 1), F.length("package")))).otherwise(other)
    met = devices.withColumn("_other", other).join(packages, keys)
    level = F.when(F.col("package") == F.col("name"), 0).when(F.contains("package", "name"), 1).when(F.col("_other") == F.col("name"), 2)
    met = met.withColumn("level", level).where(F.col("level").isNotNull() & F.forall(F.coalesce("filters", F.array().cast("array<string>")), lambda f: F.regexp_like(F.col("device"), F.concat(F.lit("(?i)"), f))))
    return best(met, [*keys, "device"], "level", F.length("name").desc(), "name").drop("_other")
