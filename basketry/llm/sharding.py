"""Rows shuffled uniformly into shards of exact sizes.

Rows are dealt into blocks by a hash. How many rows of each block go to each shard is
drawn in advance: row by row of a communication matrix, the multivariate
hypergeometric counts that a uniform shuffle would have. Then every block is
permuted and cut by its row of the matrix, blocks are exchanged for shards, and every
shard is permuted again. So each row is equally likely to land in any place of any
shard, and sizes are exact: the shards' numbers of rows differ by one at most (law "rows").

Only the matrix is drawn on the driver: one row of counts per block of about ``block``
rows. Ranks within blocks and shards are window functions over bounded groups: a shard is
permuted in ranges of a second random key, whose counts are added up to
gapless slots. All of it is DataFrame functions. The counts come from a table of the rows'
random keys alone; the rows themselves, with all their columns, move twice, into blocks and
into shards, and ``write_shards`` keeps them in one folder a shard, in the order of slots.

Equal texts are no groups here: they are spread like any other rows, so a text with a third
of all rows does not matter. (A law that kept them together could not have equal sizes.)

Edge cases: null texts and ids are rows like any other. Fully equal rows are
interchangeable: each gets a place, whichever. With fewer rows than shards the last
shards are empty. An empty table gives an empty result. Columns named as the results get
underscores before the added ones' names.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.common import free_name, scratch_path, written

SHARDS = 40
BLOCK = 50_000
SEED = 20_24


def hypergeometric(good: int, bad: int, n: int, random: np.random.Generator) -> int:
    """How many of ``n`` drawn from good + bad are good; any population size.

    numpy draws up to 10^9 of each; beyond, by rejection from a table mountain around the
    mode (ratio of uniforms).
    """
    if n == 0 or good == 0 or bad == 0:
        return n if bad == 0 else 0
    if max(good, bad) < 10 ** 9:
        return int(random.hypergeometric(good, bad, n))
    low, high = max(0, n - bad), min(n, good)
    total = good + bad
    mean = n * (good / total)
    spread = math.sqrt(max((total - n) / max(total - 1, 1) * mean * (bad / total), 0.0) + 0.5)
    mode = (n + 1) * (good + 1) // (total + 2)

    def weight(k: int) -> float:
        return -(math.lgamma(k + 1) + math.lgamma(good - k + 1) + math.lgamma(n - k + 1)
                 + math.lgamma(bad - n + k + 1))
    top, width = weight(mode), 1.7155277699214135 * spread + 0.8989161620588988  # 2 sqrt(2/e), 3 - 2 sqrt(3/e)
    while True:
        u, v = 1 - random.random(), random.random()
        k = math.floor(mean + 0.5 + width * (v - 0.5) / u)
        if low <= k <= high and 2 * math.log(u) <= weight(k) - top:
            return k


def matrix(blocks: list[int], shards: list[int], seed: int = SEED) -> list[list[int]]:
    """Counts by block and shard with the given sums, as a uniform shuffle has them."""
    random = np.random.default_rng(seed)
    left, made = list(shards), []
    for size in blocks:
        row, rest, need = [], sum(left), size
        for i, room in enumerate(left):
            rest -= room
            row.append(hypergeometric(room, rest, need, random))
            need -= row[-1]
        left = [a - b for a, b in zip(left, row)]
        made.append(row)
    return made


def _hash(seed: int, columns: list[Column]) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


def shuffle(rows: DataFrame, shards: int = SHARDS, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """``rows`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard)."""
    spark = rows.sparkSession
    names = [f"`{c}`" for c in rows.columns]
    hashed = [F.col(f"`{f.name}`") for f in rows.schema.fields if "map<" not in f.dataType.simpleString()]
    shard, slot = free_name(rows, "shard"), free_name(rows, "slot")
    count = rows.count()
    n_blocks = max(1, math.ceil(count / block))
    ranges = max(1, math.ceil(count / shards / block))
    key = _hash(seed + 2, hashed)
    place = F.floor((F.shiftrightunsigned(key, 11).cast("double") / 2.0 ** 53) * ranges).cast("int")
    dealt = (rows.withColumn("\tblock", F.pmod(_hash(seed, hashed), F.lit(n_blocks)).cast("int"))
             .withColumn("\tfirst", _hash(seed + 1, hashed)).withColumn("\ttie", _hash(seed + 3, hashed))
             .withColumn("\tkey", key).withColumn("\trange", place))
    light = written(dealt.select("\tblock", "\tfirst", "\ttie", "\trange"), "shard-keys")
    sizes = dict(light.groupBy("\tblock").count().collect())  # one row per block
    order = sorted(sizes)
    drawn = matrix([sizes[b] for b in order],
                   [count // shards + (i < count % shards) for i in range(shards)], seed)
    ends = spark.createDataFrame(
        [(b, [int(x) for x in np.cumsum(row)]) for b, row in zip(order, drawn)], "`\tblock` int, ends array<long>")

    def sent(df: DataFrame, *ties: Column) -> DataFrame:
        """First permutation: a row's rank in its block says to which shard it goes."""
        rank = F.row_number().over(Window.partitionBy("\tblock").orderBy("\tfirst", "\ttie", *ties))
        return df.withColumn("\trank", rank).join(ends, "\tblock").withColumn(
            shard, F.size(F.filter("ends", lambda e: e < F.col("\trank"))))

    # Rows that tie in both keys have equal hashes throughout (equal rows, or nulls in other columns) and so
    # the same range: whichever of them goes to a shard, the counts are the same.
    counts = sent(light).groupBy(shard, "\trange").agg(F.count("*").alias("\tn"))
    before = Window.partitionBy(shard).orderBy("\trange").rowsBetween(Window.unboundedPreceding, -1)
    counts = written(counts.withColumn("\tbefore", F.coalesce(F.sum("\tn").over(before), F.lit(0))).drop("\tn"),
                     "shard-counts")
    # second permutation: in ranges of another random key
    rank = F.row_number().over(Window.partitionBy(shard, "\trange").orderBy("\tkey", *hashed))
    return (sent(dealt, *hashed).select(*names, shard, "\trange", "\tkey").withColumn("\trank", rank)
            .join(counts, [shard, "\trange"]).select(
                *names, shard, (F.col("\trank") - 1 + F.col("\tbefore")).cast("long").alias(slot)))


def write_shards(shuffled: DataFrame, shard: str, slot: str) -> DataFrame:
    """Keep shuffled rows in the shared folder, one folder a shard; gives a reader of them."""
    spark, path = shuffled.sparkSession, scratch_path(shuffled.sparkSession, "shards")
    shuffled.sortWithinPartitions(shard, slot).write.option("compression", "zstd").partitionBy(shard).parquet(path)
    return spark.read.schema(shuffled.schema).parquet(path)
