"""Mixing sources to target weights, in DataFrame operations only.

Each source's words lie on one line, in a pseudorandom order of its documents, cut into blocks of BLOCK words. The mix has
one slot for each block it takes, in output shards of SHARD_SLOTS slots. A shard's source counts are drawn as multinomial
counts given each source's total. The totals come by inverse distribution: there are as many equal strata as slots, and each
draws a source once, so over all shards a source is off by two slots at most. One keyed pseudorandom permutation of all
slots then deals the draws over the shards, which is what independent draws of all slots are once their totals are known:
counts vary from shard to shard by n p (1 - p), less one part in the number of shards. A source's slots are numbered
through all shards, mapped to block numbers by a keyed permutation per pass over the source, and joined with the blocks by
number. A block is taken at most CAP times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, partitions

BLOCK, SHARD_SLOTS, CAP = 32, 8192, 3
CHUNK = 4096  # slots that one row makes
WHITE = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(F.filter(F.split(text, WHITE), lambda w: w != "")), F.lit(0)).cast("long")


def uniform(*columns) -> Column:
    """A number in [0, 1) that depends on the columns alone."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double") / F.lit(float(1 << 53))


def permuted(x: Column, n: Column, *key: Column) -> Column:
    """The place of x in a keyed pseudorandom permutation of 0 to n - 1.

    Rounds of adding a hash of one half to the other permute a rectangle of n cells or a few more; from one of those more
    the walk goes on to the next.
    """
    rows = F.ceil(F.sqrt(n)).cast("long")
    columns = F.ceil(n / rows).cast("long")

    def once(y: Column) -> Column:
        high, low = F.floor(y / columns).cast("long"), y % columns
        for turn in range(3):
            high = (high + F.pmod(F.xxhash64(low, F.lit(2 * turn), *key), rows)) % rows
            low = (low + F.pmod(F.xxhash64(high, F.lit(2 * turn + 1), *key), columns)) % columns
        return high * columns + low

    # fewer than `rows` cells lie outside, so 64 steps end every walk, for large n but for a chance of 1e-100
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(64)), once(x), lambda y, _: F.when(y < n, y).otherwise(once(y)))
    return F.when(once(x) < n, once(x)).otherwise(walk)


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) -> with s (rank by code point, null last) and target.

    Sources weigh 1, 2, 3, repeating, and share the sum of all sizes; none gets more than CAP times its own size, and
    the excess is reshared by weight: everyone has min(CAP * size, level * weight) for one level.
    """
    total = Window.partitionBy()
    ranked = sizes.withColumn("s", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).withColumn("w", (F.col("s") - 1) % 3 + 1)
    most = F.col("source_size") * CAP
    by_limit = Window.orderBy((most / F.col("w")), "s")
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.select(
        "*", (most / F.col("w")).alias("limit"),
        ((F.sum("source_size").over(total) - F.coalesce(F.sum(most).over(before), F.lit(0))) / (F.sum("w").over(total) - F.coalesce(F.sum("w").over(before), F.lit(0)))).alias("level"),
    )
    level = F.min(F.when(F.col("level") <= F.col("limit"), F.struct("limit", "s", "level"))).over(total)["level"]
    return ranked.select("source", "source_size", "s", F.least(most.cast("double"), F.coalesce(level, F.lit(0.0)) * F.col("w")).alias("target"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 1) -> DataFrame:
    """All rows as (id, source, print, size, source_size, target, taken, parts array<struct<start, length, times>>).

    size: words of the text (null: 0); parts: the stretches of words that the mix takes, and how often (at most CAP);
    taken: their words. A null source is a source of its own. Rows of size 0 take nothing. Rows that agree in id, size
    and text are interchangeable. Further columns are ignored; an empty table gives no rows. Equal input, equal output,
    however it is partitioned. The table of sources (a row each) is sorted in one task.
    """
    spark = docs.sparkSession
    sized = cut(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.xxhash64(F.col(text_col)).alias("print"), word_count(F.col(text_col)).alias("size")), "sizes")
    sources = cut(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))).withColumn("blocks", F.ceil(F.col("source_size") / BLOCK)), "sources")
    rows = sized.join(sources, sized["source"].eqNullSafe(sources["source"])).select("id", sized["source"], "print", "size", "s", "source_size", "target")

    n = sized.count()
    chunks = max(1, n // max(256, n // 65536))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("id", "print", F.lit(seed)), F.lit(chunks)))
    inner = Window.partitionBy("s", "chunk").orderBy(F.xxhash64("id", "print", F.lit(seed + 1)), "id", "size", "print")
    base = rows.groupBy("s", "chunk").agg(F.sum("size").alias("z"))
    base = cut(base.select("s", "chunk", F.coalesce(F.sum("z").over(Window.partitionBy("s").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base")), "bases")
    lined = rows.select("*", F.row_number().over(inner).alias("k"), F.coalesce(F.sum("size").over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    lined = cut(lined.join(base, ["s", "chunk"]).withColumn("at", F.col("base") + F.col("ahead")).drop("base", "ahead"), "lines")

    times = _times(sources, seed)
    b = F.col("block")
    in_blocks = lined.select("s", "chunk", "k", "at", "size", F.explode(F.when(F.col("size") > 0, F.sequence(F.expr(f"at div {BLOCK}"), F.expr(f"(at + size - 1) div {BLOCK}"))).otherwise(F.array().cast("array<bigint>"))).alias("block"))
    start = F.greatest(b * BLOCK, F.col("at")) - F.col("at")
    end = F.least((b + 1) * BLOCK, F.col("at") + F.col("size")) - F.col("at")
    # a shuffle, as expanded rows are estimated by the few they come from and would be broadcast whole
    parts = in_blocks.join(times.hint("merge"), ["s", "block"]).groupBy("s", "chunk", "k").agg(F.sort_array(F.collect_list(F.struct(start.alias("start"), (end - start).alias("length"), "times"))).alias("parts"))
    parts = parts.withColumn("taken", F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["length"] * p["times"]))
    none = F.array().cast("array<struct<start:bigint,length:bigint,times:bigint>>")
    return lined.join(parts, ["s", "chunk", "k"], "left").select(F.col("id").alias(id_col), F.col("source").alias(source_col), "print", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), F.coalesce("parts", none).alias("parts"))


def _drawn(sources: DataFrame, seed: int) -> DataFrame:
    """(s, blocks, shard, n): how many slots of each output shard draw the source."""
    # weights in blocks; sources at their limit come first, so that whole numbers bound them and they get all their slots
    full = F.col("target") >= CAP * F.col("source_size")
    weight = F.when(full, CAP * F.col("blocks").cast("double")).otherwise(F.col("target") * F.col("blocks") / F.col("source_size"))
    by = Window.orderBy(full.desc(), "s")
    ladder = sources.where("source_size > 0").select("s", "blocks", F.sum(weight).over(by.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), full.alias("full"))
    ladder = cut(ladder.select("s", "blocks", F.coalesce(F.lag("upto").over(Window.orderBy(F.col("full").desc(), "s")), F.lit(0.0)).alias("from"), "upto"), "mix-ladder")
    slots = -int(-(ladder.agg(F.max("upto")).first()[0] or 0.0) // 1)
    draw = lambda g: uniform(g, F.lit(seed + 2))  # noqa: E731  where in its stratum a slot draws
    first = lambda c: F.floor(c) + F.when(draw(F.floor(c)) < F.col(c) - F.floor(c), 1).otherwise(0)  # noqa: E731  the first stratum that draws beyond c
    runs = ladder.select("s", "blocks", first("from").alias("lo"), first("upto").alias("hi")).where("lo < hi")
    for step in (CHUNK * CHUNK, CHUNK):  # long runs in parts, so that no task makes all slots of a source
        runs = runs.select("s", "blocks", F.explode(F.sequence("lo", F.col("hi") - 1, F.lit(step).cast("long"))).alias("lo"), "hi")
        runs = runs.withColumn("hi", F.least("hi", F.col("lo") + step)).repartition(partitions(sources.sparkSession), "s", "lo")
    drawn = runs.select("s", "blocks", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("g"))
    shard = F.floor(permuted(F.col("g"), F.lit(slots), F.lit(seed + 4)) / SHARD_SLOTS)
    return drawn.groupBy("s", "blocks", shard.alias("shard")).agg(F.count(F.lit(1)).alias("n"))


def _times(sources: DataFrame, seed: int) -> DataFrame:
    """(s, block, times): how often the output shards take each block."""
    counts = cut(_drawn(sources, seed).withColumn("part", F.floor(F.col("shard") / CHUNK)), "mix-counts")
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = counts.groupBy("s", "part").agg(F.sum("n").alias("n")).select("s", "part", before(Window.partitionBy("s").orderBy("part")).alias("base"))
    runs = counts.withColumn("ahead", before(Window.partitionBy("s", "part").orderBy("shard"))).join(parts, ["s", "part"])
    runs = runs.select("s", "blocks", "shard", "n", (F.col("base") + F.col("ahead")).alias("first")).repartition(partitions(sources.sparkSession), "s", "shard")
    slots = runs.select("s", "blocks", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("slot")).where(F.col("slot") < CAP * F.col("blocks"))
    block = permuted(F.col("slot") % F.col("blocks"), F.col("blocks"), F.col("s"), F.floor(F.col("slot") / F.col("blocks")), F.lit(seed + 3))
    return slots.select("s", block.alias("block")).groupBy("s", "block").agg(F.count(F.lit(1)).alias("times"))
