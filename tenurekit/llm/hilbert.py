"""Sharding along a Hilbert curve, in DataFrame functions.

Metadata dimensions are quantised to 2**BITS cells each, in the columns' order and of about equally many rows; a row's place on the curve through the cells is found bit by
bit with a table of the curve's states. Rows are ordered by that place and cut into runs of equal row counts, so each
shard covers a compact box of the dimensions and readers can skip shards by minimum and maximum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenurekit.llm.scratch import staged

DIMS = 3
BITS = 8
SHARDS = 24


def curve_table() -> list[int]:
    """For state (entry, direction) of the 3-dimensional curve and octant: 8 * next state + place of the octant.

    A cell is walked along the Gray code, turned so that it starts at its entry corner and ends along its direction;
    each octant's own entry and direction follow from its place on that walk.
    """
    full = (1 << DIMS) - 1

    def turn(x: int, by: int) -> int:
        by %= DIMS
        return ((x << by) | (x >> (DIMS - by))) & full

    place_of_code = {w ^ (w >> 1): w for w in range(1 << DIMS)}
    table = []
    for state in range(DIMS << DIMS):
        entry, direction = divmod(state, DIMS)
        for octant in range(1 << DIMS):
            w = place_of_code[turn(octant ^ entry, -(direction + 1))]
            corner = 0 if w == 0 else (lambda k: k ^ (k >> 1))(2 * ((w - 1) // 2))
            ends = w if w % 2 else w - 1
            along = 0 if w == 0 else ((~ends & (ends + 1)).bit_length() - 1) % DIMS
            after = (entry ^ turn(corner, direction + 1)) * DIMS + (direction + along + 1) % DIMS
            table.append(8 * after + w)
    return table


def hilbert_index(dims: list[Column]) -> Column:
    """Place on the curve of three integers below 2**BITS."""
    table = F.array(*[F.lit(x) for x in curve_table()])
    x, y, z = (d.cast("int") for d in dims)
    cell = F.struct(x.alias("x"), y.alias("y"), z.alias("z"))
    bits = F.sequence(F.lit(BITS - 1), F.lit(0), F.lit(-1))

    def bit(value: Column, place: Column) -> Column:
        return F.floor(value / F.pow(F.lit(2), place)).cast("int").bitwiseAND(1)

    start = F.struct(F.lit(0).alias("state"), F.lit(0).cast("bigint").alias("h"), cell.alias("c"))

    def step(acc: Column, place: Column) -> Column:
        octant = bit(acc.c.x, place) + 2 * bit(acc.c.y, place) + 4 * bit(acc.c.z, place)
        found = F.get(table, acc.state * 8 + octant)
        return F.struct(F.floor(found / 8).cast("int").alias("state"), (acc.h * 8 + found % 8).alias("h"), acc.c.alias("c"))

    return F.aggregate(bits, start, step, lambda acc: acc.h)


def _starts(counted: DataFrame, column: str) -> list[tuple]:
    """(value, cell) where the cells of a column begin; counted: values with their rows n.

    A value's cell is the share of rows with lesser values, so cells keep the column's order and hold about equally many
    rows, but for single values that have more. Running totals go from ranges to the whole; at most 2**BITS rows
    reach the driver.
    """
    values = counted.groupBy(F.col(column).alias("v")).agg(F.sum("n").alias("n"))
    laid = staged(values.repartitionByRange("v").withColumn("part", F.spark_partition_id()), "hilbert-values")
    parts = laid.groupBy("part").agg(F.sum("n").alias("of_part"))
    up_to = F.sum("of_part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
    parts = parts.select("part", (up_to - F.col("of_part")).alias("before"), F.sum("of_part").over(Window.partitionBy()).alias("all"))  # one row a partition
    inside = F.sum("n").over(Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    cells = laid.withColumn("inside", inside).join(parts, "part").selectExpr("v", f"(before + inside) * {1 << BITS} div all AS cell")
    return sorted((r.v, r.cell) for r in cells.groupBy("cell").agg(F.min("v").alias("v")).collect())


def _cell(value: Column, starts: list[tuple]) -> Column:
    if not starts:
        return F.lit(0)
    values, cells = (F.array(*[F.lit(x) for x in column]) for column in zip(*starts, strict=True))
    return F.get(cells, F.size(F.filter(values, lambda v: v <= value)) - 1).cast("int")


def in_curve_order(frame: DataFrame, ties: list[str], shards: int = SHARDS) -> DataFrame:
    """frame (with lang, source and size) and shard and slot: runs along the curve, row counts at most one apart.

    Rows of one cell are ordered by ``ties``; rows equal in those too may come in either order. One range exchange
    carries the rows, cut within a cell where one cell holds many. Numbers go from partitions to the whole by a table of
    one row a partition, which is broadcast.
    """
    dims = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("source", "lang")} | {"size": F.col("size")}
    counted = staged(frame.select(*[value.alias(c) for c, value in dims.items()]).groupBy(*dims).agg(F.count("*").alias("n")), "hilbert-dims")
    place = hilbert_index([_cell(value, _starts(counted, c)) for c, value in dims.items()])
    order = ["_place", *ties]
    laid = frame.withColumn("_place", place).repartitionByRange(*order).sortWithinPartitions(*order)
    laid = laid.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    laid = staged(laid, "hilbert", "zstd")  # whole rows: they lie on disk beside the exchange that they came from
    parts = laid.groupBy("_part").agg(F.count("*").alias("_n"))
    so_far = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0))
    parts = parts.withColumns({"_before": so_far - F.col("_n"), "_all": F.sum("_n").over(Window.partitionBy())}).drop("_n")
    ranked = laid.join(F.broadcast(staged(parts, "hilbert-parts")), "_part").withColumn("_rank", F.col("_before") + F.col("_at"))
    shard = F.expr(f"_rank * {shards} div _all")
    slot = F.col("_rank") - F.expr(f"(_rank * {shards} div _all * _all + {shards - 1}) div {shards}")
    return ranked.select(*frame.columns, shard.cast("int").alias("shard"), slot.alias("slot"))


def shard_numbers(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row for each row of docs: doc_id, size (UTF-8 bytes + 8), text_crc32, shard and slot.

    Null texts count as empty, null sources and languages as empty names. Repeated rows get neighbouring slots. An empty
    table gives no rows. Extra columns do not matter.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    light = docs.select("doc_id", "lang", "source", (F.octet_length(text) + 8).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("digest"))
    return in_curve_order(light, ["digest", "doc_id"], shards).select("doc_id", "size", "text_crc32", "shard", "slot")


def sharded_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """docs with shard and slot, written so that each shard is a run of the curve. Columns stay; clashing names are replaced."""
    own = [c for c in docs.columns if c not in ("shard", "slot")]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(*own, F.struct((F.octet_length(text) + 8).cast("bigint").alias("size"), F.md5(text).alias("digest")).alias("_keys"))
    names = {"lang": F.col("lang"), "source": F.col("source"), "size": F.col("_keys.size")}
    packed = keyed.select(F.struct(*own).alias("row"), *[c.alias(n) for n, c in names.items()], F.col("_keys.digest").alias("digest"), "doc_id")
    return in_curve_order(packed, ["digest", "doc_id"], shards).select("row.*", "shard", "slot")
