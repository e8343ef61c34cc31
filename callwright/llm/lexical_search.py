"""Ranked lexical search by scanning the documents with an automaton of the items' terms.

No index of the documents is made.  The terms of a block of items form one Aho-Corasick automaton,
each guarded by a boundary sign on both sides, which is sent to all tasks.  A document's bytes are
mapped in one pass (ASCII letters to lower case, all other ASCII but digits to the boundary
sign), then one run of the automaton counts how often each term occurs.  Outputs are term
numbers; a list of term numbers for each item maps them to the items that hold them.

1. ``scan``: doc_id, n (terms of the document), terms and tfs (of the items' terms), staged;
2. N, L and df by one aggregation, at most one row for each term of the block;
3. ``_ranked``: each task scores its documents against all items of the block and keeps the k best of
   each item, so k rows an item and task are left, which two windows (salted, then whole) merge.

Items are dealt to blocks of about ``BLOCK_BYTES`` bytes of text, counted beforehand, so what is sent to
the tasks is bounded for any number of items; each block is a scan of its own.

Defined results: null texts hold no terms; documents or items without terms are in no row; rows with
the same item id are one item; documents are rows, so repeated rows rank each; a null doc id sorts
last and a null item id is an item; columns other than id and text are not read.
"""
from __future__ import annotations

import functools
import math
from collections import Counter
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NO_ID, arrow_map, as_bytes, documents_of, small_batches, staged

BLOCK_BYTES = 4 << 20  # text of the items in one automaton
SLAB_BYTES = 16 << 20  # numbers held while a slab of documents is scored
SALTS = 64
K = 10

_SIGN = 32
_DIGIT_OR_LETTER = [*range(48, 58), *range(65, 91), *range(97, 123)]
#: byte -> lower-case byte of a term, or the boundary sign
_MAP = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or b in _DIGIT_OR_LETTER else _SIGN for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_MAP).split()


class Automaton:
    def __init__(self, terms: list[bytes]):
        import ahocorasick

        self.empty = not terms
        self.machine = ahocorasick.Automaton()
        for i, t in enumerate(terms):
            self.machine.add_word(f" {t.decode('latin-1')} ", i)  # one sign for each byte
        if terms:
            self.machine.make_automaton()

    def count(self, text: bytes) -> tuple[int, Counter]:
        """(number of terms of the text, occurrences of each known term number)."""
        plain = b" " + text.translate(_MAP) + b" "
        inside = np.frombuffer(plain, np.uint8) != _SIGN
        n = int(np.count_nonzero(inside[1:] & ~inside[:-1]))
        if self.empty or not n:
            return n, Counter()
        return n, Counter(map(itemgetter(1), self.machine.iter(plain.decode("latin-1"))))


@functools.lru_cache(maxsize=2)
def _automaton(key: int, terms: tuple[bytes, ...]) -> Automaton:
    return Automaton(list(terms))


def scan(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """doc_id, n, terms, tfs of ``documents_of`` rows; ``terms`` are distinct."""
    sent = docs.sparkSession.sparkContext.broadcast(tuple(terms))
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int64()))])

    def run(batch):
        machine = _automaton(len(sent.value), sent.value)
        found = [machine.count(t) for t in as_bytes(batch.column("text"))]
        return {
            "doc_id": batch.column("doc_id"),
            "n": [n for n, _ in found],
            "terms": [[*c.keys()] for _, c in found],
            "tfs": [[*c.values()] for _, c in found],
        }

    small_batches(docs.sparkSession)
    return docs.mapInArrow(arrow_map(run, schema), "doc_id bigint, n bigint, terms array<int>, tfs array<bigint>")


class _Best:
    """The k best (score, document) of each item, equal scores by smaller id."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.score = [np.empty(0, np.int64)] * items
        self.doc = [np.empty(0, np.int64)] * items
        self.floor = np.ones(items, np.int64)

    def add(self, scores: np.ndarray, docs: np.ndarray) -> None:
        for i in np.flatnonzero(scores.max(1) >= self.floor).tolist():
            take = scores[i] >= self.floor[i]
            score, doc = np.r_[self.score[i], scores[i, take]], np.r_[self.doc[i], docs[take]]
            order = np.lexsort((doc, -score))[: self.k]
            self.score[i], self.doc[i] = score[order], doc[order]
            if len(order) == self.k:
                self.floor[i] = self.score[i][-1]


def _ranked(scanned: DataFrame, items: list[tuple[int | None, list[int]]], weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """item_id, did, score: the k best documents of each item and task."""
    sizes = [len(t) for _, t in items]
    sent = scanned.sparkSession.sparkContext.broadcast((weights, np.concatenate([np.array(t, np.int64) for _, t in items]), np.r_[0, np.cumsum(sizes)[:-1]], [i for i, _ in items]))
    slab = max(1, SLAB_BYTES // 8 // max(len(weights), sum(sizes)))
    schema = pa.schema([("item_id", pa.int64()), ("did", pa.int64()), ("score", pa.int64())])

    def run(batches):
        weight, postings, starts, ids = sent.value
        best = _Best(len(ids), k)
        for batch in batches:
            docs = np.array([NO_ID if d is None else d for d in batch.column("doc_id").to_pylist()], np.int64)
            n = batch.column("n").to_numpy()
            term, tf = batch.column("terms"), batch.column("tfs")
            edge = np.r_[0, np.cumsum(np.array(term.value_lengths().to_pylist(), np.int64))]
            term, tf = term.flatten().to_numpy(), tf.flatten().to_numpy()
            for a in range(0, len(docs), slab):
                b = min(a + slab, len(docs))
                t, f = term[edge[a] : edge[b]], tf[edge[a] : edge[b]]
                column = np.repeat(np.arange(b - a), np.diff(edge[a : b + 1]))
                m = 100 - 90 + (90 * n[a:b] * n_docs) // n_terms
                part = np.zeros((len(weight), b - a), np.int64)
                part[t, column] = weight[t] * ((1_000_000_000 * f) // (1000 * f + 8 * m[column]))
                best.add(np.add.reduceat(part[postings], starts), docs[a:b])
        rows = [(i, d, s) for i, ds, ss in zip(ids, best.doc, best.score) for d, s in zip(ds.tolist(), ss.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else ([], [], []), schema)], schema=schema)

    return scanned.where("n > 0").mapInArrow(run, "item_id bigint, did bigint, score bigint")


def _top(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "did"))
    return rows.withColumn("rank", nth).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank (from 1), doc_id, score of each item's ``k`` best documents with a score above 0."""
    docs, items = documents_of(docs, id_col, text_col), documents_of(items, item_col, item_text_col)
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    out = None
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)) == block) if blocks > 1 else items
        held: dict[int | None, set[bytes]] = {}
        for r in part.toLocalIterator():
            held.setdefault(r.doc_id, set()).update(terms_of((r.text or "").encode()))
        held = {i: t for i, t in held.items() if t}
        terms = sorted(set().union(*held.values()))
        if not terms:
            continue
        number = {t: i for i, t in enumerate(terms)}
        scanned = staged(scan(docs, terms), f"lexical-scan-{block}")
        total = scanned.where("n > 0").agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
        if not total.docs:
            break
        weights = np.zeros(len(terms), np.int64)
        for term, df in scanned.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            weights[term] = math.floor(1000 * math.log((2 * total.docs + 2) / (2 * df + 1)))
        wanted = [(i, sorted(number[t] for t in ts)) for i, ts in held.items()]
        rows = _ranked(scanned, wanted, weights, total.docs, total.terms, k)
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        out = items.sparkSession.createDataFrame([], "item_id bigint, did bigint, score bigint")
    salted = _top(out.withColumn("salt", F.pmod(F.xxhash64("did"), F.lit(SALTS))), ["item_id", "salt"], k)
    best = _top(salted.drop("rank", "salt"), ["item_id"], k)
    return best.select("item_id", F.col("rank").cast("int").alias("rank"), F.nullif("did", F.lit(NO_ID)).alias("doc_id"), "score")
