"""Sharding along a Hilbert curve [native].

Several metadata dimensions are quantised to a few bits, the cell they give is replaced by its index on a Hilbert
curve, rows are sorted by that index, and equal runs of the sorted rows become the shards. Neighbours on the curve are
neighbours in every dimension, so each shard (and each file of it) spans a narrow range of all of them and readers can
skip it by min/max statistics of any one.

Ranks are exact without a global window: rows are range-partitioned, sorted within partitions and written once with
their place in the partition; only one count a partition is summed up to offsets.

Defined results: a null text counts as empty (size 1, CRC 0); a null dimension is quantised as cell 0; ties on the
curve are ordered by id and then by the text's CRC; repeated rows each get a slot of their own; an empty table gives no
rows; columns other than the id and the dimensions are not read, so they may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import written

BITS = 4
SHARDS = 16


def curve_indices(dims: int, bits: int) -> list[int]:
    """Hilbert index of every cell of a grid of 2**bits cells along each of dims axes; cells in row-major order."""
    side = 1 << bits
    found = []
    for cell in range(side**dims):
        axes = [(cell // side ** (dims - 1 - d)) % side for d in range(dims)]
        # From the coarsest level down, undo the reflection and the exchange of axes that the curve makes in each octant.
        level = side >> 1
        while level > 1:
            low = level - 1
            for d in range(dims):
                if axes[d] & level:
                    axes[0] ^= low
                else:
                    swap = (axes[0] ^ axes[d]) & low
                    axes[0] ^= swap
                    axes[d] ^= swap
            level >>= 1
        for d in range(1, dims):
            axes[d] ^= axes[d - 1]
        flip, level = 0, side >> 1
        while level > 1:
            if axes[-1] & level:
                flip ^= level - 1
            level >>= 1
        axes = [a ^ flip for a in axes]
        index = 0
        for bit in range(bits - 1, -1, -1):
            for a in axes:
                index = index << 1 | (a >> bit) & 1
        found.append(index)
    return found


def quantised(df: DataFrame, dims: dict[str, Column], bits: int = BITS) -> dict[str, Column]:
    """A cell of 0 to 2**bits-1 for each dimension: numbers by quantiles of the whole table, strings by hash."""
    side = 1 << bits
    kinds = {name: df.select(c.alias("x")).schema["x"].dataType for name, c in dims.items()}
    numbers = [n for n, k in kinds.items() if isinstance(k, T.NumericType)]
    cuts: dict[str, list] = {}
    if numbers:
        shares = F.array(*[F.lit(i / side) for i in range(1, side)])
        row = df.agg(*[F.percentile_approx(dims[n], shares, 10_000).alias(n) for n in numbers]).first()
        cuts = {n: sorted(set(row[n] or [])) for n in numbers}
    out = {}
    for name, c in dims.items():
        if name in numbers:
            cell = sum((F.when(c > F.lit(cut), 1).otherwise(0) for cut in cuts[name]), F.lit(0))
        else:
            cell = F.pmod(F.xxhash64(c), F.lit(side)).cast("int")
        out[name] = F.coalesce(F.when(c.isNull(), 0).otherwise(cell), F.lit(0))
    return out


def curve_index(cells: list[Column], bits: int = BITS) -> Column:
    """The curve's index by look-up in a constant array of 2**(bits*dims) numbers, which is folded into the plan."""
    if len(cells) * bits > 16:
        raise ValueError("the curve's table is limited to 65,536 cells: use fewer bits or dimensions")
    cell = F.lit(0)
    for c in cells:
        cell = cell * (1 << bits) + c
    table = ",".join(map(str, curve_indices(len(cells), bits)))
    return F.get(F.split(F.lit(table), ",").cast("array<int>"), cell)


def hilbert_shards(
    df: DataFrame, id_col: str, dims: dict[str, Column], extra: dict[str, Column] | None = None, ties: list[str] | None = None, shards: int = SHARDS, bits: int = BITS
) -> DataFrame:
    """id_col, the extra columns, curve, shard (0 to shards-1, counts at most one apart) and slot (its place in the shard).

    Extra columns may have any name; one called curve, shard or slot, or as id_col, gives way to the operator's own.
    """
    extra = {n: c for n, c in (extra or {}).items() if n not in (id_col, "curve", "shard", "slot")}
    inner = {n: f"_c{k}" for k, n in enumerate([id_col, *extra])}  # under names of its own, whatever the columns are called
    cells = quantised(df, dims, bits)
    keyed = df.select(F.col(id_col).alias("_c0"), *[c.alias(inner[n]) for n, c in extra.items()], curve_index(list(cells.values()), bits).alias("_curve"))
    order = ["_curve", "_c0", *(inner[n] for n in ties or [])]
    placed = written(keyed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()), "hilbert")
    part, at = F.shiftright("_place", 33), F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    # One row a partition: a window over these few rows turns counts into offsets.
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n"))
    ahead = counts.select("_part", F.expr("coalesce(sum(n) over (order by _part rows between unbounded preceding and 1 preceding), 0)").alias("_ahead"), F.expr("sum(n) over ()").alias("_total"))
    ranked = placed.withColumn("_part", part).join(F.broadcast(ahead), "_part").withColumn("_rank", F.col("_ahead") + at)
    ranked = ranked.withColumn("_shard", F.expr(f"_rank * {shards} div _total").cast("int"))
    slot = F.expr(f"_rank - (_shard * _total + {shards - 1}) div {shards}")
    return ranked.select(*[F.col(c).alias(n) for n, c in inner.items()], F.col("_curve").alias("curve"), F.col("_shard").alias("shard"), slot.alias("slot"))


def document_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint")


def op1_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards under the law `rows`: runs of the Hilbert order over size, source and language."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    size = document_size(F.col("text"))
    found = hilbert_shards(
        docs,
        "doc_id",
        {"size": size, "source": F.col("source"), "lang": F.col("lang")},
        {"size": size, "text_crc32": F.crc32(F.coalesce("text", F.lit("")).cast("binary"))},
        ties=["text_crc32"],
    )
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("curve").alias("curve_index"))
