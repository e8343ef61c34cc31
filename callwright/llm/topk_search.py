"""Exact top-k search by inner product: norm-sorted blocks, rotated partial sums, residual bounds.

* Components become integers (floor of ``scale`` times the component).  The vectors are rotated by the
  right singular vectors of the whole table (eigenvectors of the Gram matrix, summed by Spark), which
  moves most of a product into the first coordinates.
* Candidates are cut into blocks by descending length.  Each query first meets the block of the
  longest vectors, which gives a score that its k-th best cannot fall below.
* A block is skipped for a query whose length times the block's longest length is below that score
  (Cauchy-Schwarz).  In the blocks left, the partial sum over the first coordinates plus the product of
  the lengths of the residuals bounds each score; only vectors whose bound reaches the score so
  far get their exact integer product.

A task holds a group of candidate blocks and streams a group of query blocks past them, longest vectors
first; the k best so far raise a query's score from block to block.  So a block's bytes are sent once for each
group that meets it.  Nothing is broadcast but the rotation and the first block, both of fixed size.

Defined results: vectors that are null, empty or hold a null or non-finite component take no part, nor
do rows without id; vectors of different dimension are not compared; rows with the query's own id
are no candidates for it; equal query rows are answered once; other repeated rows are candidates each;
ties go to the smaller id; a score beyond 64 bits is an error; columns other than id and vector are not read.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, staged

SCALE = 64
TOP = 20
BLOCK = 4096
SPAN = 16  # candidate blocks that a task holds
QUERY_SPAN = 16  # query blocks that it streams past them
QUERY_BLOCK = 1024
HEAD = 16  # coordinates in the partial sum
EXACT = 2**53  # integer products stay exact in doubles below


def integers(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """vec_id, dim, x (integers as doubles), norm2 of the rows that take part."""
    raw = F.transform(F.col(f"`{vector_col}`"), lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("double"))
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    rows = vectors.where(F.col(f"`{id_col}`").isNotNull() & (F.size(F.col(f"`{vector_col}`")) > 0) & F.forall(F.col(f"`{vector_col}`"), fine))
    rows = rows.select(F.col(f"`{id_col}`").cast("bigint").alias("vec_id"), raw.alias("x"))
    return rows.select("vec_id", F.size("x").alias("dim"), "x", F.aggregate("x", F.lit(0.0), lambda s, c: s + c * c).alias("norm2"))


def rotation(rows: DataFrame) -> dict[int, np.ndarray]:
    """The right singular vectors for each dimension; dim * dim numbers of each come to the driver."""

    def gram(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            x, dims = batch.column("x"), batch.column("dim").to_numpy()
            for d in np.unique(dims):
                a = _matrix(x.filter(pa.array(dims == d)), int(d))
                sums[int(d)] = sums.get(int(d), 0) + a.T @ a
        for d, g in sums.items():
            yield pa.RecordBatch.from_pydict({"dim": pa.array(np.full(d * d, d, np.int32)), "i": pa.array(np.arange(d * d, dtype=np.int32)), "g": pa.array(g.ravel())})

    cells = rows.select("dim", "x").mapInArrow(gram, "dim int, i int, g double").groupBy("dim", "i").agg(F.sum("g").alias("g")).collect()
    out = {}
    for d in {c["dim"] for c in cells}:
        g = np.zeros(d * d)
        for c in cells:
            if c["dim"] == d:
                g[c["i"]] = c["g"]
        out[d] = np.linalg.eigh(g.reshape(d, d))[1][:, ::-1].copy()  # largest first
    return out


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """block, dim, longest (norm), ids, data: rows of one dimension by descending length, ``size`` in a
    block (ids and integer components as bytes)."""

    def cut(batches):
        held: dict[int, list] = {}
        count = 0

        def out(d):
            nonlocal count
            ids, x, norms = zip(*held.pop(d))
            count += 1
            yield pa.RecordBatch.from_pydict({"dim": pa.array([d], pa.int32()), "longest": pa.array([float(np.sqrt(max(norms)))]), "ids": pa.array([np.array(ids, np.int64).tobytes()]), "data": pa.array([np.stack(x).tobytes()])})

        for batch in batches:
            ids, norms, dims = (batch.column(c).to_numpy() for c in ("vec_id", "norm2", "dim"))
            x = batch.column("x")
            starts = x.offsets.to_numpy()
            values = x.values.to_numpy(zero_copy_only=False)
            for i in range(len(ids)):
                d = int(dims[i])
                held.setdefault(d, []).append((ids[i], values[starts[i] : starts[i + 1]], norms[i]))
                if len(held[d]) == size:
                    yield from out(d)
        for d in list(held):
            yield from out(d)

    total = rows.count()
    n = max(1, min(partitions(rows.sparkSession), -(-total // size)))
    dealt = rows.repartitionByRange(n, "dim", F.desc("norm2"), "vec_id").sortWithinPartitions("dim", F.desc("norm2"), "vec_id")
    made = staged(dealt.mapInArrow(cut, "dim int, longest double, ids binary, data binary"), "vector-blocks")
    return made.withColumn("block", F.xxhash64("ids", "data"))


def best(q_ids, q, c_ids, c, k: int, floor: np.ndarray, turn: np.ndarray | None):
    """(row of q, id, score) of the k best candidates of each query with a score of ``floor`` at least."""
    big = len(q) and len(c) and np.abs(q).max() * np.abs(c).max() * q.shape[1] >= EXACT
    rows, cols, scores = [], [], []
    if turn is not None and not big:
        qr, cr = q @ turn, c @ turn
        head = min(HEAD, q.shape[1])
        rest = lambda a: np.sqrt(np.maximum(0, (a[:, head:] ** 2).sum(1)))
        bound = qr[:, :head] @ cr[:, :head].T + rest(qr)[:, None] * rest(cr)[None, :]
        slack = 1e-9 * (np.abs(bound).max(initial=1) + 1)
        may = (bound + slack >= floor[:, None]) & (q_ids[:, None] != c_ids[None, :])
    else:
        may = q_ids[:, None] != c_ids[None, :]
    for i in np.flatnonzero(may.any(1)):
        pick = np.flatnonzero(may[i])
        s = np.array([sum(int(a) * int(b) for a, b in zip(q[i], c[j])) for j in pick], object) if big else c[pick] @ q[i]
        if len(pick) > k:
            near = s >= np.sort(s)[len(s) - k]
            pick, s = pick[near], s[near]
        order = sorted(range(len(pick)), key=lambda j: (-s[j], c_ids[pick[j]]))[:k]
        order = [j for j in order if s[j] >= floor[i]]
        rows += [i] * len(order)
        cols += [int(c_ids[pick[j]]) for j in order]
        scores += [int(s[j]) for j in order]
    return rows, cols, scores


def _decode(ids: bytes, data: bytes, dim: int):
    return np.frombuffer(ids, np.int64), np.frombuffer(data, np.float64).reshape(-1, dim)


def search(vectors: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = TOP, scale: int = SCALE, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of each row for which ``is_query`` (a column over the
    input) holds."""
    rows = integers(vectors, id_col, vector_col, scale)
    asked = integers(vectors.where(is_query), id_col, vector_col, scale).dropDuplicates(["vec_id", "x"])
    turns = rotation(rows)
    cand, ask = blocks(rows, block), blocks(asked, query_block)
    rename = lambda df, p: df.select("dim", *[F.col(c).alias(f"{p}_{c}") for c in ("block", "longest", "ids", "data")])
    first = cand.groupBy("dim").agg(F.max_by(F.struct("block", "longest", "ids", "data"), "longest").alias("b")).select("dim", "b.*")

    def start(frames):
        for f in frames:
            for r in f.itertuples(index=False):
                q_ids, q = _decode(r.q_ids, r.q_data, r.dim)
                c_ids, c = _decode(r.c_ids, r.c_data, r.dim)
                floor = np.full(len(q), -np.inf)
                got, _, scores = best(q_ids, q, c_ids, c, k, floor, None)
                if got:
                    low = np.full(len(q), np.inf)
                    np.minimum.at(low, got, np.array(scores, float))
                    floor = np.where(np.bincount(got, minlength=len(q)) == k, low, -np.inf)
                length = np.sqrt((q**2).sum(1))
                need = float(np.min(np.where(length > 0, floor / np.where(length > 0, length, 1), -np.inf), initial=np.inf))
                yield pd.DataFrame({"dim": [r.dim], "q_block": [r.q_block], "q_ids": [r.q_ids], "q_data": [r.q_data], "floors": [floor.tobytes()], "need": [need]})

    started = staged(rename(ask, "q").join(F.broadcast(rename(first, "c")), "dim").mapInPandas(start, "dim int, q_block bigint, q_ids binary, q_data binary, floors binary, need double"), "query-blocks")
    # which groups of blocks can hold a result for which groups of queries: a table of group numbers
    asked_n, held_n = started.count(), cand.count()
    q_groups = max(1, -(-asked_n // QUERY_SPAN))
    # groups of SPAN blocks, or smaller ones while there are fewer tiles than tasks
    c_groups = max(1, -(-held_n // SPAN), min(held_n, -(-partitions(vectors.sparkSession) // q_groups)))
    started = started.withColumn("q_group", F.pmod(F.xxhash64("q_block"), F.lit(q_groups)))
    cand = rename(cand, "c").withColumn("c_group", F.pmod(F.xxhash64("c_block"), F.lit(c_groups)))
    needs = started.groupBy("dim", "q_group").agg(F.min("need").alias("need"))
    lengths = cand.groupBy("dim", "c_group").agg(F.max("c_longest").alias("longest"))
    wanted = needs.join(lengths, "dim").where(F.col("longest") * (1 + 1e-9) >= F.col("need")).select("dim", "q_group", "c_group")
    # each side of a tile with names of its own, since both stem from the same blocks
    asked_in = wanted.join(started, ["dim", "q_group"]).select("dim", "q_group", "c_group", "q_block", "q_ids", "q_data", "floors").groupBy("dim", "q_group", "c_group")
    mine = wanted.join(cand, ["dim", "c_group"])
    own = [F.col(c).alias(a) for c, a in (("dim", "h_dim"), ("q_group", "h_q"), ("c_group", "h_c"), ("c_ids", "h_ids"), ("c_data", "h_data"), ("c_longest", "h_longest"))]
    held_in = mine.select(*own).groupBy("h_dim", "h_q", "h_c")

    def rank(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        """One tile: its query blocks meet its candidate blocks, longest first, under rising floors."""
        out = [pd.DataFrame({"query_id": np.empty(0, np.int64), "q_row": np.empty(0, object), "vec_id": np.empty(0, np.int64), "score": np.empty(0, np.int64)})]
        held = held.sort_values("h_longest", ascending=False)
        for r in asked.itertuples(index=False):
            q_ids, q = _decode(r.q_ids, r.q_data, r.dim)
            kept = _Kept(q, np.frombuffer(r.floors, np.float64).copy(), k)
            for c in held.itertuples(index=False):
                if c.h_longest * (1 + 1e-9) < kept.need():
                    break
                kept.add(*best(q_ids, q, *_decode(c.h_ids, c.h_data, r.dim), k, kept.floor, turns[r.dim]))
            rows = [(i, d, s) for i, found in kept.found.items() for s, d in ((-m, d) for m, d in found)]
            if rows:
                got, ids, scores = zip(*rows)
                out.append(pd.DataFrame({"query_id": q_ids[list(got)], "q_row": [f"{r.q_block}:{g}" for g in got], "vec_id": np.array(ids, np.int64), "score": np.array(scores, np.int64)}))
        return pd.concat(out, ignore_index=True)

    found = asked_in.cogroup(held_in).applyInPandas(rank, "query_id bigint, q_row string, vec_id bigint, score bigint")
    order = Window.partitionBy("q_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


class _Kept:
    """The k best (score, candidate) of each query of a block so far, and the floors that follow."""

    def __init__(self, q: np.ndarray, floor: np.ndarray, k: int):
        self.floor, self.k, self.found = floor, k, {}
        self.length = np.sqrt((q**2).sum(1))

    def add(self, rows: list, ids: list, scores: list) -> None:
        for i, d, s in zip(rows, ids, scores):
            self.found.setdefault(i, []).append((-s, d))
        for i in set(rows):
            self.found[i] = sorted(self.found[i])[: self.k]
            if len(self.found[i]) == self.k:  # just below, as a score may not be a double
                self.floor[i] = max(self.floor[i], np.nextafter(float(-self.found[i][-1][0]), -np.inf))

    def need(self) -> float:
        """Length below which no candidate reaches the floor of any query."""
        some = self.length > 0
        return float(np.min(np.where(some, self.floor / np.where(some, self.length, 1), -np.inf), initial=np.inf))
