"""Line dedup on sharded cuckoo filters backed by exact reference counts.

State of a :class:`LineIndex` (all Spark tables in the shared folder, none on the driver):

* ``postings`` (k1, k2, did, th): one row for each line key of each live row; documents are told apart by
  ``did``, but what a row loses is collected by (did, th), so rows that share an id do not meet;
* ``refs`` (shard, k1, k2, n_docs, owner): exact number of documents holding a key, smallest id;
* ``filters`` (shard, filter): a cuckoo filter of the shard's keys.  It says at once that a key is
  new, so an insertion looks up only the remaining keys in the exact table; a deletion takes the
  fingerprint of a key out as soon as its count falls to zero.

``insert`` and ``delete`` return a new index; deleting what was inserted gives the former counts
back, and a line whose owner was deleted passes to the next smallest id.  Keys are 128-bit
hashes of the normalised line.  A shard holds ``SHARD_KEYS`` keys on average, whatever the input
size, so one shard always fits a task; a line that very many documents share is one row of
``refs`` after map-side aggregation.

Nulls, ties and repeated rows: a null text is one empty line; rows without id count as one
document with the largest id; rows with the same id count as one document; every input row is
returned once; columns other than id and text are not read.
"""
from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NO_ID, arrow_map, as_bytes, carried, documents_of, keyed, own_back, own_columns, small_batches, staged

MIN_CODE_POINTS = 10
SHARD_KEYS = 200_000
SLOTS = 4  # fingerprints in a bucket
LOAD = 0.85
MAX_KICKS = 400


# ---------------------------------------------------------------- cuckoo filter (numpy)


class CuckooFilter:
    """Buckets of ``SLOTS`` 32-bit fingerprints; partial-key hashing, so entries can move and go."""

    def __init__(self, table: np.ndarray):
        self.table = table
        self.mask = np.uint64(len(table) - 1)

    @classmethod
    def sized(cls, keys: int) -> "CuckooFilter":
        buckets = 1 << max(2, math.ceil(math.log2(max(1, keys) / (SLOTS * LOAD))))
        return cls(np.zeros((buckets, SLOTS), np.uint32))

    @classmethod
    def load(cls, data: bytes) -> "CuckooFilter":
        return cls(np.frombuffer(data, np.uint32).reshape(-1, SLOTS).copy())

    def dump(self) -> bytes:
        return self.table.tobytes()

    def places(self, k1: np.ndarray, k2: np.ndarray):
        prints = (k2.view(np.uint64) >> np.uint64(32)).astype(np.uint32)
        prints[prints == 0] = 1
        first = k1.view(np.uint64) & self.mask
        return prints, first, self.other(first, prints)

    def other(self, bucket, prints):
        step = prints.astype(np.uint64) * np.uint64(0x5BD1E9955BD1E995)
        return bucket ^ ((step >> np.uint64(17)) & self.mask)

    def contains(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        """True for every key that was inserted, and for few others."""
        if not len(k1):
            return np.zeros(0, bool)
        prints, a, b = self.places(k1, k2)
        return (self.table[a] == prints[:, None]).any(1) | (self.table[b] == prints[:, None]).any(1)

    def insert(self, k1: np.ndarray, k2: np.ndarray) -> bool:
        """All keys at once: each round every waiting fingerprint takes a free slot of its bucket, or
        else swaps with an entry there, which then waits for its other bucket.  False when full."""
        if not len(k1):
            return True
        prints, at, _ = self.places(k1, k2)
        for kick in range(MAX_KICKS):
            order = np.argsort(at, kind="stable")
            at, prints = at[order], prints[order]
            start = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            nth = np.arange(len(at)) - np.repeat(start, np.diff(np.r_[start, len(at)]))
            free = np.argsort(self.table[at] != 0, axis=1, kind="stable")  # free slots first
            n_free = (self.table[at] == 0).sum(1)
            fits = nth < n_free
            slot = free[np.arange(len(at)), np.minimum(nth, SLOTS - 1)]
            self.table[at[fits], slot[fits]] = prints[fits]
            at, prints, nth = at[~fits], prints[~fits], (nth - n_free)[~fits]
            if not len(at):
                return True
            swaps = nth == 0  # one swap for each full bucket and round, the others move on
            slot = (at[swaps] + np.uint64(kick)) % np.uint64(SLOTS)
            out = self.table[at[swaps], slot].copy()
            self.table[at[swaps], slot] = prints[swaps]
            prints[swaps] = out
            at = self.other(at, prints)
        return False

    def delete(self, k1: np.ndarray, k2: np.ndarray) -> None:
        """Takes one copy of each key's fingerprint out; the keys must have been inserted."""
        prints, a, b = self.places(k1, k2)
        for p, i, j in zip(prints, a, b):
            for bucket in (i, j):
                slots = np.flatnonzero(self.table[bucket] == p)
                if len(slots):
                    self.table[bucket, slots[0]] = 0
                    break


def filter_of(k1: np.ndarray, k2: np.ndarray) -> CuckooFilter:
    room = len(k1)
    while True:
        made = CuckooFilter.sized(room)
        if made.insert(k1, k2):
            return made
        room = room * 2 + 8


# ---------------------------------------------------------------- lines


def line_key(line: bytes) -> bytes:
    """White space off both ends, A-Z lower-cased (bytes.strip and bytes.lower are ASCII only)."""
    return line.strip().lower()


def counts(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode()) >= least)


def key_hash(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


PAIRS = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("did", pa.int64()), ("th", pa.int64())])


def line_pairs(docs: DataFrame, least: int = MIN_CODE_POINTS) -> DataFrame:
    """(k1, k2, did, th): the distinct line keys of each row."""

    def pairs(batch):
        hashes, dids, ths = [], [], []
        for text, did, th in zip(as_bytes(batch.column("text")), batch.column("did").to_pylist(), batch.column("th").to_pylist()):
            keys = {key_hash(k) for k in {line_key(x) for x in text.split(b"\n")} if counts(k, least)}
            hashes += keys
            dids += [did] * len(keys)
            ths += [th] * len(keys)
        both = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
        return {"k1": both[:, 0], "k2": both[:, 1], "did": np.array(dids, np.int64), "th": np.array(ths, np.int64)}

    small_batches(docs.sparkSession)
    return docs.select("text", "did", "th").mapInArrow(arrow_map(pairs, PAIRS), "k1 bigint, k2 bigint, did bigint, th bigint")


@dataclass(frozen=True)
class LineIndex:
    postings: DataFrame
    refs: DataFrame
    filters: DataFrame
    shards: int
    least: int = MIN_CODE_POINTS

    @classmethod
    def empty(cls, spark: SparkSession, shards: int, least: int = MIN_CODE_POINTS) -> "LineIndex":
        return cls(
            spark.createDataFrame([], "k1 bigint, k2 bigint, did bigint, th bigint"),
            spark.createDataFrame([], REFS),
            spark.createDataFrame([], "shard int, filter binary"),
            shards,
            least,
        )

    @classmethod
    def build(cls, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_CODE_POINTS, shard_keys: int = SHARD_KEYS) -> "LineIndex":
        """The index of ``docs``; its shard count follows the number of line keys."""
        pairs = staged(line_pairs(keyed(documents_of(docs, id_col, text_col)), least), "line-postings")
        shards = max(1, math.ceil(pairs.count() / shard_keys))
        return cls.empty(docs.sparkSession, shards, least)._merge(pairs, 1)

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> "LineIndex":
        """Adds documents whose ids the index does not hold yet."""
        return self._merge(staged(line_pairs(keyed(documents_of(docs, id_col, text_col)), self.least), "line-postings"), 1)

    def delete(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> "LineIndex":
        """Takes documents out that were inserted with the same texts."""
        return self._merge(staged(line_pairs(keyed(documents_of(docs, id_col, text_col)), self.least), "line-postings"), -1)

    def _merge(self, pairs: DataFrame, sign: int) -> "LineIndex":
        rows, pairs = pairs, pairs.select("k1", "k2", "did").distinct()  # rows that repeat an id are one document
        if sign > 0:
            postings = self.postings.unionByName(rows)
            change = pairs
            gone = None
        else:
            postings = self.postings.join(pairs, ["k1", "k2", "did"], "left_anti")
            change = pairs.join(self.postings, ["k1", "k2", "did"], "left_semi")  # what was never inserted cannot go
            gone = postings.join(change.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.min("did").alias("heir"))
        delta = change.groupBy("k1", "k2").agg((F.lit(sign) * F.count(F.lit(1))).alias("n_docs"), F.min("did").alias("owner"))
        delta = delta.withColumn("heir", F.lit(NO_ID)) if gone is None else delta.join(gone, ["k1", "k2"], "left").withColumn("heir", F.coalesce("heir", F.lit(NO_ID)))
        delta = delta.select(self._shard().alias("shard"), "k1", "k2", "n_docs", "owner", "heir", F.lit(None).cast("binary").alias("filter"), F.lit(1).alias("kind"))
        nothing = F.lit(0).cast("bigint")  # not null: pandas would make the 64-bit keys floats
        held = self.refs.select("shard", "k1", "k2", "n_docs", "owner", nothing.alias("heir"), F.lit(None).cast("binary").alias("filter"), F.lit(0).alias("kind"))
        held = held.unionByName(self.filters.select("shard", nothing.alias("k1"), nothing.alias("k2"), nothing.alias("n_docs"), nothing.alias("owner"), nothing.alias("heir"), "filter", F.lit(2).alias("kind")))
        merged = staged(held.unionByName(delta).groupBy("shard").applyInPandas(_merge_shard, REFS + ", filter binary"), "line-refs")
        return LineIndex(
            postings,
            merged.where("filter is null").drop("filter"),
            merged.where("filter is not null").select("shard", "filter"),
            self.shards,
            self.least,
        )

    def _shard(self):
        return F.pmod(F.shiftrightunsigned("k1", 20), F.lit(self.shards)).cast("int")

    def dropped(self) -> DataFrame:
        """(did, th, k1, k2): the keys that a row loses, since a smaller id holds them."""
        repeated = self.refs.where("n_docs >= 2").select("k1", "k2", "owner")
        return self.postings.join(repeated, ["k1", "k2"]).where("did != owner").select("did", "th", "k1", "k2")

    def resolve(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """doc_id, kept (text), n_lines, n_dropped of indexed documents; a kept text is null only if
        the text is."""
        rows = keyed(documents_of(docs, id_col, text_col)).withColumnRenamed("doc_id", "own_id")
        return self._rest(rows).withColumnRenamed("own_id", "doc_id")

    def rewrite(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``docs`` with the kept text in place of the text."""
        return own_back(self._rest(own_columns(docs, id_col, text_col)), docs, text_col)

    def _rest(self, rows: DataFrame) -> DataFrame:
        """own_* columns, kept, n_lines, n_dropped of rows with did, th, text."""
        drop = self.dropped().groupBy("did", "th").agg(F.collect_set(F.struct("k1", "k2")).alias("drop"))  # a set: equal rows
        drop = drop.select("did", "th", F.col("drop.k1").alias("k1"), F.col("drop.k2").alias("k2"))
        least = self.least

        def rest(batch):
            out = {"kept": [], "n_lines": [], "n_dropped": []}
            cols = [batch.column(c) for c in ("k1", "k2")]
            nulls = batch.column("text").is_null().to_pylist()
            for i, text in enumerate(as_bytes(batch.column("text"))):
                lines = text.split(b"\n")
                kept = lines
                if cols[0][i].is_valid:
                    bad = {x.tobytes() for x in np.stack([c[i].values.to_numpy() for c in cols], 1)}
                    kept = [x for x in lines if not (counts(k := line_key(x), least) and key_hash(k) in bad)]
                out["kept"].append(None if nulls[i] else b"\n".join(kept).decode())
                out["n_lines"].append(len(lines))
                out["n_dropped"].append(len(lines) - len(kept))
            return out

        schema = pa.schema([("kept", pa.string()), ("n_lines", pa.int64()), ("n_dropped", pa.int64())])
        small_batches(rows.sparkSession)
        carry, ddl = carried(rows)
        joined = rows.join(drop, ["did", "th"], "left").select(*carry, "text", "k1", "k2")
        return joined.mapInArrow(arrow_map(rest, schema, carry), ddl + "kept string, n_lines bigint, n_dropped bigint")


REFS = "shard int, k1 bigint, k2 bigint, n_docs bigint, owner bigint"


def _merge_shard(rows: pd.DataFrame) -> pd.DataFrame:
    """One shard: held counts and filter with the changes of a batch.  Only keys that the filter
    may hold are looked up in the exact table."""
    shard = int(rows["shard"].iloc[0])
    held, delta, blobs = (rows[rows["kind"] == k] for k in (0, 1, 2))
    numbers = lambda frame: [np.ascontiguousarray(frame[c].to_numpy(), np.int64) for c in ("k1", "k2", "n_docs", "owner")]
    h1, h2, hn, ho = numbers(held)
    d1, d2, dn, do = numbers(delta)
    made = CuckooFilter.load(blobs["filter"].iloc[0]) if len(blobs) else None
    maybe = made.contains(d1, d2) if made is not None else np.zeros(len(d1), bool)
    at = {key: i for i, key in enumerate(zip(h1.tolist(), h2.tolist()))} if maybe.any() else {}
    spot = np.full(len(d1), -1)
    for i in np.flatnonzero(maybe):
        spot[i] = at.get((int(d1[i]), int(d2[i])), -1)
    known = spot >= 0
    hn[spot[known]] += dn[known]
    heir = delta["heir"].to_numpy()
    for i in np.flatnonzero(known):
        ho[spot[i]] = min(ho[spot[i]], do[i]) if dn[i] > 0 else heir[i]
    new = ~known & (dn > 0)
    live = hn > 0
    if made is not None and not live.all():
        made.delete(h1[~live], h2[~live])
    k1, k2 = np.r_[h1[live], d1[new]], np.r_[h2[live], d2[new]]
    if made is None or not made.insert(d1[new], d2[new]):
        made = filter_of(k1, k2)
    n = len(k1)
    out = pd.DataFrame({"shard": np.full(n, shard, np.int32), "k1": k1, "k2": k2, "n_docs": np.r_[hn[live], dn[new]], "owner": np.r_[ho[live], do[new]], "filter": [None] * n})
    last = pd.DataFrame({"shard": [np.int32(shard)], "k1": [0], "k2": [0], "n_docs": [0], "owner": [0], "filter": [made.dump()]})
    return pd.concat([out, last], ignore_index=True) if n else last


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_CODE_POINTS) -> DataFrame:
    """Line dedup of one corpus: doc_id, kept, n_lines, n_dropped for every row."""
    return LineIndex.build(docs, id_col, text_col, least).resolve(docs, id_col, text_col)


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_CODE_POINTS) -> DataFrame:
    """``docs`` with the kept lines as text."""
    return LineIndex.build(docs, id_col, text_col, least).rewrite(docs, id_col, text_col)
