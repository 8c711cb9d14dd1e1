"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame functions.

All words are cut into ``BLOCKS`` blocks of nearly equal size (those of small sources into finer ones). Seats (blocks) go to sources by the highest quotients
``target / (2 k + 1)``, then each source's seats to its shards by the same rule on the shards' words. In a shard the
documents lie one after another in a seeded order, cut into equal blocks; with q seats on n blocks every block is
taken q // n times, and q % n of them, at even distances from a seeded start, once more. What a document gives is
the part of the taken blocks that it covers.

Quotients are listed one row a seat, at most BLOCKS plus one for each source or shard, whatever the input.
A source's documents are dealt into shards by the hash of their id, so running totals never span a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenurekit.llm.scratch import staged

BLOCKS = 65_536
#: A source whose target is under so many blocks is cut into blocks of its own, ten times as many for its target, and has its target's seats.
FINE = 100
#: A source's target is at most this many times its size.
MOST = 3
WEIGHTS = (1, 2, 3)
#: A source has a shard for so many documents, but no more shards than leave each so many blocks.
SHARD_DOCS, SHARD_BLOCKS = 1_000, 64
SEED = "mix-1"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def _place(*parts: Column | str) -> Column:
    """A seeded number below 2**60, the same in every engine that has MD5."""
    text = F.concat_ws("|", F.lit(SEED), *[F.col(p).cast("string") if isinstance(p, str) else p for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def targets(sizes: DataFrame) -> DataFrame:
    """Adds weight and target to (source, source_size): shares by weight, never above MOST times the size.

    Raising all targets evenly until sources hit their limit is done in one pass: a source is at its limit when even the
    share that is left for it and all with a higher ratio of limit to weight exceeds it. One row a source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    limit = MOST * F.col("source_size")
    everything = Window.partitionBy()
    ratio = Window.orderBy((F.col("limit") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    out = sizes.withColumn("weight", weight).withColumn("limit", limit).withColumns({
        "rest": F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0)),
        "rest_weight": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
    })
    out = out.withColumn("full", F.col("limit") * F.col("rest_weight") <= F.col("weight") * F.col("rest"))
    ratio_first = F.struct((F.col("limit") / F.col("weight")).alias("ratio"), F.col("rest").alias("rest"), F.col("rest_weight").alias("rest_weight"))
    out = out.withColumn("level", F.min(F.when(~F.col("full"), ratio_first)).over(everything))
    share = (F.col("weight") * F.col("level.rest")).cast("double") / F.col("level.rest_weight").cast("double")
    return out.select(*sizes.columns, "weight", F.when(F.col("full"), F.col("limit").cast("double")).otherwise(share).alias("target"))


def seats(claims: DataFrame, group: list[str], member: list[str], votes: str, total: str, limit: str) -> DataFrame:
    """Sainte-Laguë seats of the members of each group: (group, member, quota). limit: most seats of a member."""
    all_votes = F.sum(votes).over(Window.partitionBy(*group))
    # quotients are listed well beyond a member's share of the total; a member may win them until it is at its limit
    claims = claims.withColumn("_all", all_votes)
    most = F.least(F.col(limit), F.col(total), F.ceil(F.col(total) * MOST * F.col(votes) / F.col("_all")) + 1).cast("bigint")
    listed = claims.where(F.col(votes) > 0).withColumn("_most", most).where("_most > 0").withColumn("_k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_most") - 1)))
    rank = Window.partitionBy(*group).orderBy((F.col(votes) / (2 * F.col("_k") + 1)).desc(), *[F.col(m) for m in member], "_k")
    won = listed.withColumn("_rank", F.row_number().over(rank)).where(F.col("_rank") <= F.col(total))
    return won.groupBy(*group, *member).agg(F.count("*").alias("quota"))


def mix(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, source, size (words), source_size, target, taken, spin (a seeded number).

    taken is the words the mix takes of the row, repeats counted, and never above MOST times its size. Null and empty
    texts have no words and give none. Rows without a source are a source of their own, the last one. Repeated
    rows lie side by side in their shard and are taken each for itself. An empty table gives no rows. Extra columns
    do not matter.
    """
    key = F.when(F.col("source").isNull(), F.lit("~")).otherwise(F.concat(F.lit("="), "source"))
    text = F.col("text").cast("string")
    # rows without an id are told apart by their text, so they spread over the shards like others
    spin = F.when(F.col("doc_id").isNull(), _place(F.lit("~"), F.md5(F.coalesce(text, F.lit(""))))).otherwise(_place("doc_id"))
    light = docs.select("doc_id", F.col("source").cast("string"), n_words(text).alias("size"), key.alias("key"), spin.alias("spin"))
    light = staged(light, "mix-sizes")

    # one row a source
    sources = light.groupBy("key", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    sources = targets(sources).withColumn("all_words", F.sum("source_size").over(Window.partitionBy()))
    coarse = F.greatest(F.lit(1), F.ceil(F.col("all_words") / BLOCKS)).cast("bigint")
    sources = sources.withColumn("coarse", coarse).withColumn("small", (F.col("coarse") > 1) & (F.col("target") < FINE * F.col("coarse")))
    block = F.when(F.col("small"), F.greatest(F.lit(1), F.floor(F.col("target") / (10 * FINE))).cast("bigint")).otherwise(F.col("coarse"))
    sources = sources.withColumn("small_words", F.sum(F.when(F.col("small"), F.col("target")).otherwise(0.0)).over(Window.partitionBy()))
    n_shards = F.greatest(F.lit(1), F.least(F.ceil(F.col("n_docs") / SHARD_DOCS), F.expr(f"source_size div ({SHARD_BLOCKS} * block)"))).cast("bigint")
    sources = staged(sources.withColumn("block", block).withColumn("n_shards", n_shards), "mix-sources")

    # one row a shard of a source
    dealt = light.join(sources.select("key", "n_shards"), "key").withColumn("shard", F.pmod("spin", "n_shards"))
    shards = dealt.groupBy("key", "shard").agg(F.sum("size").alias("shard_size")).join(sources.select("key", "block", "target", "source_size"), "key")
    shards = shards.withColumn("n_blocks", F.ceil(F.col("shard_size") / F.col("block")).cast("bigint"))
    shards = staged(shards.withColumn("limit", MOST * F.col("n_blocks")), "mix-shards")
    claims = sources.join(shards.groupBy("key").agg(F.sum("limit").alias("limit")), "key")
    claims = claims.where("not small").withColumn("total", F.round((F.col("all_words") - F.col("small_words")) / F.col("block")).cast("bigint"))
    of_source = seats(claims, [], ["key"], "target", "total", "limit").withColumnRenamed("quota", "total")
    of_small = sources.where("small").select("key", F.round(F.col("target") / F.col("block")).cast("bigint").alias("total"), (F.col("n_shards") == 1).alias("single"))
    # a source's only shard has all its seats: none are listed, however many small sources there are
    single = shards.join(of_small.where("single"), "key").select("key", "shard", F.least("total", "limit").alias("quota"))
    of_source = of_source.union(of_small.where("not single").select("key", "total"))
    of_shard = seats(shards.join(of_source, "key"), ["key"], ["shard"], "shard_size", "total", "limit").union(single)
    quota, blocks = F.coalesce("quota", F.lit(0).cast("bigint")), F.greatest("n_blocks", F.lit(1).cast("bigint"))
    plan = shards.join(of_shard, ["key", "shard"], "left").select(
        "key", "shard", "block", "target", "source_size", "n_blocks",
        ((quota - quota % blocks) / blocks).cast("bigint").alias("rounds"), (quota % blocks).alias("extra"), F.pmod(_place("key", "shard"), blocks).alias("first"),
    )

    # documents side by side in their shard
    before = Window.partitionBy("key", "shard").orderBy("spin", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = dealt.withColumn("end", F.sum("size").over(before)).withColumn("begin", F.col("end") - F.col("size"))
    laid = laid.join(staged(plan, "mix-plan"), ["key", "shard"])
    return laid.withColumn("taken", _taken_before("end") - _taken_before("begin")).select("doc_id", "source", "size", "source_size", "target", "taken", "spin")


def _taken_before(word: str) -> Column:
    """Words taken of the first ``word`` words of a shard: whole rounds, chosen blocks before, and the part of the block it lies in.

    Block i is among the ``extra`` chosen ones when (i + first) * extra passes a multiple of n_blocks on the way to
    i + 1: exactly ``extra`` of any n_blocks in a row do.
    """
    chosen = "(({0} + first) * extra div greatest(n_blocks, 1) - first * extra div greatest(n_blocks, 1))"
    at = f"({word} div block)"
    here = f"({chosen.format(f'({at} + 1)')} - {chosen.format(at)})"
    return F.expr(f"rounds * {word} + {chosen.format(at)} * block + {here} * ({word} - {at} * block)")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """docs as the mix takes them: a row comes taken / size times, the fraction decided by its seeded number. Columns stay.

    Rows are told apart by doc_id and number of words, so repeated rows are taken alike.
    """
    taken = mix(docs).groupBy("doc_id", "size").agg(F.sum("taken").alias("taken"), F.count("*").alias("n_rows"), F.max("spin").alias("spin"))
    times = F.expr("(taken * 1000000 + size * n_rows * (spin % 1000000)) div (greatest(size, 1) * n_rows * 1000000)").cast("int")
    taken = staged(taken.select(F.col("doc_id").alias("_id"), F.col("size").alias("_size"), times.alias("_times")).where("_times > 0"), "mix-times")
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("_doc"), n_words(F.col("text").cast("string")).alias("_words"))
    met = packed.join(taken.hint("merge"), F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_words") == F.col("_size")))
    return met.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_times"))).select("row.*")
