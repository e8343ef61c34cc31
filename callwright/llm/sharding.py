"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

* Equal rows are counted and numbered, so that each row has a key of its own, and dealt to parts by its
  hash.  How many rows of each part go to each shard is drawn from the
  multivariate hypergeometric law (row sums: part sizes, column sums: shard sizes, which differ by one
  at most): the matrix has the distribution that a uniform shuffle of all rows would give.
* Each part is permuted (order of a keyed hash); its first rows go to shard 0, the next to shard 1...
* After the exchange each shard is permuted again, in bins by a second keyed hash: a row's slot is the
  size of the bins before plus its rank in its bin.

The draw sees one count for each part, ``MAX_PARTS`` at most, however many rows there are; all rows
stay in DataFrame operations.  A part or bin has some ``ROWS`` rows; nothing depends on
keys of the data, so hot sources or copies do not gather.  The law is exact at any size: numpy's generator
up to 10**9 rows, beyond that inversion of the probabilities around their mode, which follow from
ratios of neighbours.

Defined results: a null text has size 1 and crc 0; null ids are dealt by the text; equal rows are
numbered and dealt each; every row gets one slot; an empty table has none; columns other than id and text
are not read.
"""
from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents_of, staged

ROWS = 100_000
MAX_PARTS = 65_536
SPREAD = 16


def matrix(sizes: list[int], shards: int, seed: int) -> np.ndarray:
    """Rows of each part (given by its size) that go to each shard."""
    draw = np.random.default_rng(seed)
    total = sum(sizes)
    room = np.array([total // shards + (j < total % shards) for j in range(shards)], np.int64)
    out = np.zeros((len(sizes), shards), np.int64)
    for i, n in enumerate(sizes):
        left, rest = n, int(room.sum())
        for j in range(shards - 1):  # the marginal law, one shard after the other
            rest -= int(room[j])
            out[i, j] = _hypergeometric(draw, int(room[j]), rest, left)
            left -= out[i, j]
        out[i, shards - 1] = left
        room -= out[i]
    return out


def _hypergeometric(draw, good: int, bad: int, n: int) -> int:
    if not n or not good:
        return 0
    if not bad:
        return n
    return int(draw.hypergeometric(good, bad, n)) if good + bad < 10**9 else _by_inversion(draw, good, bad, n)


def _by_inversion(draw, good: int, bad: int, n: int) -> int:
    """One draw of any size.  Probabilities relative to the mode's are products of ratios of neighbours;
    what lies more than ``SPREAD`` standard deviations off weighs less than a double can tell."""
    total = good + bad
    least, most = max(0, n - bad), min(n, good)
    mode = min(max((n + 1) * (good + 1) // (total + 2), least), most)
    sd = math.sqrt(n * (good / total) * (bad / total) * ((total - n) / (total - 1)))
    width = int(SPREAD * sd) + 100
    up = np.arange(mode, min(most, mode + width), dtype=np.int64)
    down = np.arange(mode, max(least, mode - width), -1, dtype=np.int64)
    rising = (good - up) / (up + 1.0) * ((n - up) / (bad - n + up + 1.0))
    falling = down / (good - down + 1.0) * ((bad - n + down) / (n - down + 1.0))
    logs = np.r_[np.cumsum(np.log(falling))[::-1], 0.0, np.cumsum(np.log(rising))]
    upto = np.cumsum(np.exp(logs))
    return mode - len(down) + int(np.searchsorted(upto, draw.random() * upto[-1], "right"))


def shuffle_into_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, rows: int = ROWS) -> DataFrame:
    """doc_id, size (UTF-8 bytes and one), text_crc32, shard, slot of every row."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    base = documents_of(docs, id_col, text_col).select("doc_id", (F.octet_length(text) + F.lit(1)).cast("bigint").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    key = ("doc_id", "size", "text_crc32")
    # equal rows, counted with a map-side combine, become rows with a number; many copies in blocks
    counted = base.groupBy(*key).agg(F.count(F.lit(1)).alias("copies"))
    blocks = counted.select(*key, "copies", F.explode(F.expr(f"sequence(0L, (copies - 1) div {rows})")).alias("block")).repartition(*key, "block")
    numbers = F.expr(f"sequence(block * {rows}, least(copies, (block + 1) * {rows}) - 1)")
    key = (*key, "copy")
    base = staged(blocks.select(*key[:-1], F.explode(numbers).alias("copy")), "shard-rows")
    parts = min(MAX_PARTS, max(1, math.ceil(base.count() / rows)))
    base = base.withColumn("part", F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(parts)).cast("int"))
    sizes = {r["part"]: r["count"] for r in base.groupBy("part").count().collect()}
    drawn = matrix([sizes.get(i, 0) for i in range(parts)], shards, seed)
    ends = np.cumsum(drawn, 1).tolist()
    table = spark.sql("SELECT posexplode(from_json(:m, 'array<array<bigint>>')) AS (part, ends)", {"m": str(ends)})  # parts x shards numbers
    order = Window.partitionBy("part").orderBy(F.xxhash64(*key, F.lit(seed + 1)), *key)
    local = base.withColumn("rank", F.row_number().over(order))
    shard = F.size(F.filter("ends", lambda e: e < F.col("rank"))).cast("int")
    sent = local.join(F.broadcast(table), "part").select(*key, shard.alias("shard"))
    second = F.xxhash64(*key, F.lit(seed + 2))
    bins = max(1, math.ceil(sum(sizes.values()) / shards / rows))
    sent = sent.withColumn("bin", F.pmod(F.shiftrightunsigned(second, 8), F.lit(bins)).cast("int"))
    sent = staged(sent, "sharded")
    upto = Window.partitionBy("shard").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # over counts of bins
    before = sent.groupBy("shard", "bin").count().select("shard", "bin", F.coalesce(F.sum("count").over(upto), F.lit(0)).alias("before"))
    inner = Window.partitionBy("shard", "bin").orderBy(second, *key)
    ranked = sent.withColumn("rank", F.row_number().over(inner))
    return ranked.join(before, ["shard", "bin"]).select(*key[:-1], "shard", (F.col("before") + F.col("rank") - 1).cast("bigint").alias("slot"))
