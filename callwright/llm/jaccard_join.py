"""N-gram Jaccard join by chosen paths.

Every text is the set of its five-word shingles.  A set takes part with a sequence of tokens sampled
from it by random orders (its minimum in each order); two sets choose the same token with the
probability of their Jaccard similarity.

* Run r puts every set into the bucket of its r-th token.  A bucket of more than ``LIMIT`` sets is
  split again: its sets follow ``BRANCHES`` further tokens, chosen by run and depth; after
  ``DEPTH`` splits, or when small, a bucket is compared by brute force.
* No two runs and no two depths share a token, so runs are independent.  They are repeated until a pair
  at the threshold is missed with a probability below ``MISS``, even if all its buckets are split.
* Brute force computes exact similarities of the sets, so no false link comes out.  A bucket that no
  split makes small is dealt out as pairs of blocks, so a task holds two blocks at most.
* A pair that meets in several buckets counts in the first of them only.  So links are counted, and
  joined into components, within buckets: pairs are never rows, nor are copies expanded.

Equal sets are collapsed before (map-side aggregation), then represented by their smallest id.

Defined results: a text of one to four words is one shingle; null or empty text has no shingle and
no link; rows without id come last (a class of such rows alone has no id; ids stay below 2**62); repeated
rows are copies like others; columns other than id and text are not read; each input row comes back once.
"""
from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NO_ID, arrow_map, as_bytes, documents_of, keyed, mix, own_back, own_columns, partitions, small_batches, staged, windows, word_hashes
from .components import components

WORDS = 5
THRESHOLD = 0.8
LIMIT = 256  # sets in a bucket that is compared as it is
BLOCK = 1024  # sets in a block of a bucket that stays large
DEPTH = 2
BRANCHES = 2
MISS = 1e-6
WITHOUT_ID = 2**62  # ids of sets that no row with an id holds start here


def runs_for(threshold: float, miss: float = MISS) -> int:
    """Runs after which a pair at the threshold is missed with probability ``miss`` at most.  In one run it
    must agree in the first token and, at each depth, in one of the branch tokens: all are different orders."""
    one = threshold * (1 - (1 - threshold) ** BRANCHES) ** DEPTH
    return max(1, math.ceil(math.log(miss) / math.log(1 - one)))


def branch_at(run, depth: int, branch, n_runs: int):
    """Place of a branch token; the first tokens of the runs come before all of them."""
    return n_runs + (run * DEPTH + depth) * BRANCHES + branch


def tokens_for(n_runs: int) -> int:
    return n_runs * (1 + DEPTH * BRANCHES)


def shingles(words: list[bytes], size: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the windows of ``size`` words; of all words if there are fewer."""
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(windows(word_hashes(words), min(size, len(words))) + np.uint64(min(size, len(words))))


def identity(s: np.ndarray) -> int:
    """64-bit identity of a set of hashes."""
    if not len(s):
        return 0
    return int((mix(mix(s) ^ np.uint64(len(s))).sum(dtype=np.uint64)).view(np.int64))


@functools.cache
def orders(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Constants of ``n`` unrelated orders."""
    flips, factors = mix(mix(mix(np.arange(1, 2 * n + 1, dtype=np.uint64)))).reshape(2, n, 1)
    return flips, factors | np.uint64(1)


def tokens(s: np.ndarray, n: int) -> np.ndarray:
    """The minima of a set in ``n`` random orders (32 bits each)."""
    flips, factors = orders(n)
    low = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 512):  # bounds the memory for long texts
        x = s[at : at + 512] ^ flips
        x *= factors
        np.minimum(low, x.min(1), out=low)
    return (low >> np.uint64(32)).astype(np.uint32).view(np.int32)


def signed(docs: DataFrame, size: int, n: int) -> DataFrame:
    """did, th, rid (identity of the shingle set, 0: no shingle), tokens."""
    schema = pa.schema([("did", pa.int64()), ("th", pa.int64()), ("rid", pa.int64()), ("tokens", pa.list_(pa.int32()))])

    def run(batch):
        out = {"did": batch.column("did"), "th": batch.column("th"), "rid": [], "tokens": []}
        for text in as_bytes(batch.column("text")):
            s = shingles(text.split(), size)
            out["rid"].append(identity(s))
            out["tokens"].append(tokens(s, n) if len(s) else [])
        return out

    small_batches(docs.sparkSession)
    return docs.select("did", "th", "text").mapInArrow(arrow_map(run, schema), "did bigint, th bigint, rid bigint, tokens array<int>")


# ---------------------------------------------------------------- buckets


def buckets(sets: DataFrame, n_runs: int, limit: int) -> DataFrame:
    """(rid, leaf, m): the buckets of two sets or more that each set ends in; m: their size."""
    rows = sets.select("rid", "tokens", F.posexplode(F.slice("tokens", 1, n_runs)).alias("run", "token"))
    own = F.slice("tokens", branch_at(F.col("run"), 0, 0, n_runs) + 1, DEPTH * BRANCHES)  # goes along: a split needs no join
    rows = rows.select("rid", F.xxhash64("run", "token").alias("node"), own.alias("own"))
    leaves = None
    for depth in range(DEPTH + 1):
        sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("m")).where("m >= 2")
        rows = staged(rows.join(sizes, "node").select("rid", F.col("node").alias("leaf"), "m", "own"), "buckets")
        large = F.lit(False) if depth == DEPTH else F.col("m") > limit
        ended = rows.where(~large).drop("own")
        leaves = ended if leaves is None else leaves.unionByName(ended)
        if depth == DEPTH or not rows.where(large).limit(1).count():
            return leaves
        branch = F.explode(F.sequence(F.lit(0), F.lit(BRANCHES - 1)))
        rows = rows.where(large).withColumn("branch", branch)
        at = branch_at(0, depth, F.col("branch"), 0)
        rows = rows.select("rid", F.xxhash64("leaf", "branch", F.get("own", at)).alias("node"), "own")


def in_blocks(leaves: DataFrame, block: int) -> DataFrame:
    """(rid, leaf, task, side, cross): a bucket of more than ``block`` sets becomes a task for each
    pair of its blocks; there only pairs across the two sides count (cross)."""
    n = F.ceil(F.col("m") / block).cast("int")
    own = F.pmod(F.xxhash64("rid"), F.col("n")).cast("int")
    rows = leaves.withColumn("n", n).withColumn("own", own).withColumn("mate", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    task = F.xxhash64("leaf", F.least("own", "mate"), F.greatest("own", "mate"))
    return rows.select("rid", "leaf", task.alias("task"), (F.col("own") > F.col("mate")).cast("int").alias("side"), (F.col("own") != F.col("mate")).alias("cross"))


def grouped(batches, key: str = "task"):
    """Frames of one ``key`` each, from batches sorted by it."""
    held = []
    for frame in batches:
        if not len(frame):
            continue
        keys = frame[key].to_numpy()
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        for part in np.split(np.arange(len(frame)), cuts):
            piece = frame.iloc[part]
            if held and held[0][key].iloc[0] != piece[key].iloc[0]:
                yield pd.concat(held, ignore_index=True)
                held = []
            held.append(piece)
    if held:
        yield pd.concat(held, ignore_index=True)


def incidence(rows: list[np.ndarray]) -> np.ndarray:
    """Rows x values that at least two rows hold (0 or 1)."""
    sizes = np.array([len(x) for x in rows])
    if not sizes.sum():
        return np.zeros((len(rows), 0), np.float32)
    values, code, n = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
    shared = n >= 2
    place = np.cumsum(shared) - 1
    who = np.repeat(np.arange(len(rows)), sizes)
    use = shared[code]
    out = np.zeros((len(rows), int(shared.sum())), np.float32)
    out[who[use], place[code[use]]] = 1
    return out


def overlaps(rows: list[np.ndarray], cells: int = 16_000_000) -> np.ndarray:
    """Sizes of all pairwise intersections, a share of the values at a time to bound the memory."""
    total = np.zeros((len(rows), len(rows)), np.float32)
    everything = sum(len(x) for x in rows)
    parts = max(1, -(-everything * len(rows) // (2 * cells))) if len(rows) > 2 else 1
    if parts == 1:
        a = incidence(rows)
        return a @ a.T
    for p in range(parts):  # values are hashes, so their remainders are even shares
        a = incidence([x[x.view(np.uint64) % np.uint64(parts) == p] for x in rows])
        total += a @ a.T
    return total


def pairs_here(frame: pd.DataFrame) -> np.ndarray:
    """True for the pairs of rows whose first common bucket is this one."""
    leaf = int(frame["leaf"].iloc[0])
    earlier = [np.asarray(x, np.int64)[np.asarray(x, np.int64) < leaf] for x in frame["leaves"]]
    out = overlaps(earlier) == 0
    if bool(frame["cross"].iloc[0]):
        side = frame["side"].to_numpy()
        out &= side[:, None] != side[None, :]
    np.fill_diagonal(out, False)
    return out


def _fresh(batches):
    """Rows of a task with at least one pair that counts here."""
    for frame in grouped(batches):
        if len(frame) > 1:
            frame = frame[pairs_here(frame).any(1)]
            if len(frame):
                yield frame


def _verify(threshold: float):
    def run(batches):
        for frame in grouped(batches):
            frame = frame.drop_duplicates("rid", ignore_index=True)
            if len(frame) < 2:
                continue
            sets = [np.frombuffer(x, np.uint64) for x in frame["shingles"]]
            n = np.array([len(x) for x in sets], np.float32)
            both = overlaps(sets)
            linked = (both >= threshold * (n[:, None] + n[None, :] - both) - 1e-4) & pairs_here(frame)
            if not linked.any():
                continue
            root = np.arange(len(frame))
            while True:
                low = np.minimum(root, np.where(linked, root[None, :], len(frame)).min(1))
                low = low[low]
                if (low == root).all():
                    break
                root = low
            use = linked.any(1)
            copies = frame["copies"].to_numpy()
            rep = frame["rep"].to_numpy()
            yield pd.DataFrame({"rid": frame["rid"].to_numpy()[use], "rep": rep[use], "root": rep[root][use], "links": linked.sum(1)[use], "rows": (linked * copies[None, :]).sum(1)[use].astype(np.int64)})

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, size: int = WORDS, limit: int = LIMIT, block: int = BLOCK, miss: float = MISS) -> DataFrame:
    """For every row: doc_id, class_id (smallest id of its component of links), n_links (other rows
    with a similarity of the threshold or more, copies included), n_text_links (as n_links, but
    each other shingle set counts once, the own none)."""
    text = keyed(documents_of(docs, id_col, text_col)).select("did", "th", "text")
    out = classes(text, threshold, size, limit, block, miss)
    own = lambda c: F.when(F.col(c) < WITHOUT_ID, F.col(c))
    return out.select(own("did").alias("doc_id"), own("cls").alias("class_id"), "n_links", "n_text_links")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, size: int = WORDS) -> DataFrame:
    """The rows of ``docs`` that represent their class; texts without any word stay."""
    own = own_columns(docs, id_col, text_col)
    chosen = classes(own.select("did", "th", "text"), threshold, size).where("chosen").select("did", "th", "rid").distinct()
    rows = own.join(chosen, ["did", "th"])
    nth = F.row_number().over(Window.partitionBy("did", "th").orderBy(F.lit(0)))  # repeated rows are equal here
    return own_back(rows.withColumn("nth", nth).where("nth = 1 or rid = 0"), docs)


def classes(text: DataFrame, threshold: float = THRESHOLD, size: int = WORDS, limit: int = LIMIT, block: int = BLOCK, miss: float = MISS) -> DataFrame:
    """did, th, rid, cls (id of the class), chosen (it represents the class), n_links, n_text_links for
    every row of (did, th, text)."""
    spark = text.sparkSession
    n_runs = runs_for(threshold, miss)
    rows = staged(signed(text, size, tokens_for(n_runs)), "signed")
    first = F.min(F.struct("did", "th", "tokens"))
    sets = rows.where("rid != 0").groupBy("rid").agg(first.alias("f"), F.count(F.lit(1)).alias("copies"))
    label = F.when(F.col("f.did") != NO_ID, F.col("f.did")).otherwise(F.lit(WITHOUT_ID) + F.pmod("rid", F.lit(WITHOUT_ID)))
    sets = staged(sets.select("rid", F.col("f.did").alias("did"), F.col("f.th").alias("th"), F.col("f.tokens").alias("tokens"), label.alias("rep"), "copies"), "sets")
    leaves = buckets(sets, n_runs, limit)
    of_set = leaves.groupBy("rid").agg(F.sort_array(F.collect_set("leaf")).alias("leaves"))
    n = partitions(spark)
    members = in_blocks(leaves, block).join(of_set, "rid").repartition(n, "task").sortWithinPartitions("task")
    fresh = members.mapInPandas(_fresh, members.schema)
    wanted = fresh.join(sets.select("rid", "rep", "did", "th", "copies"), "rid")
    wanted = wanted.groupBy("rid", "rep", "did", "th", "copies").agg(F.first("leaves").alias("leaves"), F.collect_list(F.struct("task", "leaf", "side", "cross")).alias("at"))
    holders = text.join(wanted, ["did", "th"]).select("text", "rid", "rep", "copies", "leaves", "at")
    small = ("task", pa.int64()), ("leaf", pa.int64()), ("side", pa.int32()), ("cross", pa.bool_())

    def spell(batches):
        for batch in batches:
            sent = [shingles(x.split(), size).tobytes() for x in as_bytes(batch.column("text"))]
            tasks = [(i, x) for i, at in enumerate(batch.column("at").to_pylist()) for x in at]
            for lo in range(0, len(tasks), 64):  # a set goes out once for each of its tasks
                part = tasks[lo : lo + 64]
                index = pa.array([i for i, _ in part], pa.int32())
                cols = {k: pa.array([x[k] for _, x in part], t) for k, t in small}
                cols |= {k: batch.column(k).take(index) for k in ("rid", "rep", "copies", "leaves")}
                cols["shingles"] = pa.array([sent[i] for i, _ in part], pa.binary())
                yield pa.RecordBatch.from_pydict(cols)

    shipped = holders.mapInArrow(spell, "task bigint, leaf bigint, side int, cross boolean, rid bigint, rep bigint, copies bigint, leaves array<bigint>, shingles binary")
    shipped = shipped.repartition(n, "task").sortWithinPartitions("task")
    links = staged(shipped.mapInPandas(_verify(threshold), "rid bigint, rep bigint, root bigint, links bigint, rows bigint"), "links")
    roots = components(links.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    counts = links.groupBy("rid").agg(F.sum("links").alias("links"), F.sum("rows").alias("others"))
    known = sets.select("rid", "rep", "copies", F.col("did").alias("rep_did"), F.col("th").alias("rep_th")).join(counts, "rid", "left").join(roots, F.col("rep") == F.col("node"), "left")
    known = known.select("rid", "rep", "rep_did", "rep_th", F.coalesce("root", "rep").alias("cls"), F.coalesce("links", F.lit(0)).alias("links"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("others"))
    out = rows.select("did", "th", "rid").join(known, "rid", "left")
    chosen = (F.col("rid") == 0) | ((F.col("rep") == F.col("cls")) & (F.col("did") == F.col("rep_did")) & (F.col("th") == F.col("rep_th")))
    zero = F.lit(0).cast("bigint")
    return out.select("did", "th", "rid", F.coalesce("cls", "did").alias("cls"), chosen.alias("chosen"), F.coalesce("others", zero).alias("n_links"), F.coalesce("links", zero).alias("n_text_links"))
