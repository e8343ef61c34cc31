"""Substring dedup by level-wise doubling of repeated windows.

A window of ``length`` words can only repeat in another document if every shorter window inside it
does.  So the search begins with short windows (``base`` words), keeps those that repeat, extends
the survivors to twice the length, and so on up to ``length``; without survivors nothing is left to
extend.  As registered (``BASE`` 7, ``LENGTH`` 13) that is two levels, 7 and 13 words, without a doubling
in between: more levels (4, 8, 13) needed more disk than the budget.

* Level 1 does not take every start: in each window of ``length`` words it takes the inner window
  with the smallest hash (a minimiser).  Equal windows choose equal inner windows, so none is lost,
  and about one start in four is looked at.
* Each later level checks one longer window around the survivor, inside the window in question.
* A document asks once for each hash, and of the documents in one Arrow batch only the smallest id
  asks: the others have their answer within the batch.  So a passage in a third of all documents is
  one row of the shuffle for each batch.  Answers go back to the documents by id.
* Whole texts ask along at level 1: a copy of a text with a smaller id needs no further window.

The text is shuffled by id in one exchange that all levels use again.

Defined results: null or empty text has no words; rows with equal ids count as one document and never
remove each other's words; rows without id come after all ids, each text of them a document of its own
(real ids stay below 2**62); a text shorter than a window loses nothing; every input row comes back
once; columns other than id and text are not read.  Windows are compared by 64-bit hashes.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NO_ID, arrow_map, as_bytes, carried, documents_of, keyed, mix, own_back, own_columns, small_batches, windows, word_hashes

LENGTH = 13
BASE = 7

WITHOUT_ID = 2**62
ASK, WITNESS, KNOWN, TEXT = 0, 1, 2, 3  # TEXT: as ASK, for a whole text
ROWS = pa.schema([("part", pa.int64()), ("h", pa.int64()), ("did", pa.int64()), ("kind", pa.int32())])
ROWS_SQL = "part bigint, h bigint, did bigint, kind int"


def numbered(rows: DataFrame) -> DataFrame:
    """Rows without id get a number from their text.  ``did`` is never null, also to the planner: a null
    check on some joins only would keep them from sharing the exchange of the texts."""
    number = F.when(F.col("did") != NO_ID, F.col("did")).otherwise(F.lit(WITHOUT_ID) + F.pmod("th", F.lit(WITHOUT_ID - 1)))
    return rows.withColumn("did", F.coalesce(number, F.lit(WITHOUT_ID)))


def levels(length: int, base: int) -> list[int]:
    """Window lengths: ``base``, doubled while shorter than ``length``, then ``length`` itself."""
    out = [min(base, length)]
    while out[-1] < length:
        out.append(min(out[-1] * 2, length))
    return out


def anchors(one: np.ndarray, length: int, base: int) -> np.ndarray:
    """For each window of ``length`` words, the start of its inner window with the smallest hash."""
    inner, span = windows(one, base), length - base + 1
    if len(inner) < span:
        return np.empty(0, np.int64)
    return sliding_window_view(inner, span).argmin(1) + np.arange(len(inner) - span + 1)


def inside(anchor: np.ndarray, length: int, size: int) -> np.ndarray:
    """For each window of ``length`` words, the start of its inner window of ``size`` words around the
    anchor: at the anchor, or as far right as the window goes."""
    return np.minimum(anchor, np.arange(len(anchor)) + length - size)


def questions(h: np.ndarray, did: np.ndarray, smaller: bool) -> np.ndarray:
    """Kinds of the rows that a batch sends for (hash, document) pairs.

    ASK: is the hash in another document (``smaller``: in one with a smaller id)?  WITNESS: as ASK, and
    several documents of the batch hold it.  KNOWN: the answer is yes."""
    if not len(h):
        return np.empty(0, np.int32)
    order = np.lexsort((did, h))
    sh, sd = h[order], did[order]
    first = np.r_[True, sh[1:] != sh[:-1]]
    group = np.cumsum(first) - 1
    later = sd != sd[first][group]
    several = np.bincount(group, later) > 0
    kind = np.where(later, KNOWN, ASK if smaller else np.where(several[group], WITNESS, ASK))
    out = np.empty(len(h), np.int32)
    out[order] = kind
    return out


def _sent(h: np.ndarray, did: np.ndarray, kind: np.ndarray) -> dict:
    """Questions go to their hash, KNOWN rows are dealt evenly."""
    spread = mix(h + mix(did.view(np.uint64)))
    return {"part": np.where(kind == KNOWN, spread, h).view(np.int64), "h": h.view(np.int64), "did": did, "kind": kind}


def _level(length: int, sizes: list[int], k: int):
    """Asks for the windows of level ``k`` around the survivors (``hs``) of the level before."""
    size, before, last = sizes[k], sizes[k - 1] if k else 0, k == len(sizes) - 1

    def run(batch):
        dids = batch.column("did").to_numpy()
        names = batch.column("th").to_numpy().view(np.uint64)
        hs, of, texts, copies = [], [], [], []
        for i, text in enumerate(as_bytes(batch.column("text"))):
            words = text.split()
            if len(words) < length:
                continue
            alive = batch.column("hs")[i].values.to_numpy().view(np.uint64) if k else None
            if k and names[i] in alive:
                copies.append(i)
                continue
            one = word_hashes(words)
            anchor = anchors(one, length, sizes[0])
            if k:
                had = windows(one, before)[inside(anchor, length, before)]
                start = inside(anchor, length, size)[np.isin(had, alive)]
            else:
                start = anchor
                texts.append(i)
            h = np.unique(windows(one, size)[np.unique(start)])
            hs.append(h)
            of.append(np.full(len(h), i))
        h = np.concatenate([*hs, np.empty(0, np.uint64)])
        did = dids[np.concatenate([*of, np.empty(0, np.int64)]).astype(np.int64)]
        kind = questions(h, did, last)
        own = np.array(texts + copies, np.int64)  # never both
        kinds = questions(names[own], dids[own], True) if texts else np.full(len(own), KNOWN, np.int32)
        kinds = np.where(kinds == ASK, TEXT, kinds).astype(np.int32)
        return _sent(np.r_[h, names[own]], np.r_[did, dids[own]], np.r_[kind, kinds])

    return arrow_map(run, ROWS)


def _answers(rows: DataFrame, last: bool) -> DataFrame:
    """(did, hs): each document's hashes with the answer yes."""
    w = Window.partitionBy("part")
    smaller = F.col("least") < F.col("did")
    other = F.when(F.col("kind") == TEXT, smaller).otherwise((F.col("most") != F.col("least")) | (F.col("seen") == WITNESS))
    over = {"least": F.min("did").over(w)}
    if not last:
        over |= {"most": F.max("did").over(w), "seen": F.max(F.when(F.col("kind") == WITNESS, WITNESS)).over(w)}
    judged = rows.withColumns(over).where((F.col("kind") == KNOWN) | (smaller if last else other))
    return judged.groupBy("did").agg(F.collect_set("h").alias("hs"))


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, base: int = BASE) -> DataFrame:
    """(did, hs): for each document (see ``numbered``) the hashes of its windows that a document with a
    smaller id holds as well; for a copy of a whole text the hash of that text."""
    return _repeated(numbered(keyed(documents_of(docs, id_col, text_col))).select("did", "th", "text"), length, base)


def _repeated(text: DataFrame, length: int, base: int) -> DataFrame:
    small_batches(text.sparkSession)
    sizes = levels(length, base)
    sizes = sizes if len(sizes) > 1 else sizes * 2
    found = None
    for k in range(len(sizes)):
        rows = text if found is None else text.join(found, "did")
        found = _answers(rows.mapInArrow(_level(length, sizes, k), ROWS_SQL), k == len(sizes) - 1)
    return found


def covered(words: list[bytes], hs: np.ndarray, length: int) -> np.ndarray:
    """True for each word inside a window whose hash is in ``hs``."""
    starts = np.flatnonzero(np.isin(windows(word_hashes(words), length), hs))
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + length, -1)
    return np.cumsum(edge[:-1]) > 0


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, base: int = BASE) -> DataFrame:
    """doc_id, kept (the words left, joined by one space; null stays null), n_words, n_removed of every
    row."""
    text = numbered(keyed(documents_of(docs, id_col, text_col))).select("did", "th", "text")
    out = _rest(text, _repeated(text, length, base), length, ("did",), "did bigint, ", False)
    return out.select(F.when(F.col("did") < WITHOUT_ID, F.col("did")).alias("doc_id"), "kept", "n_words", "n_removed")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, base: int = BASE) -> DataFrame:
    """``docs`` without the repeated words: a text that loses nothing stays as it is, words left in others
    keep the white space before them."""
    rows = numbered(own_columns(docs, id_col, text_col))
    found = _repeated(rows.select("did", "th", "text"), length, base)
    return own_back(_rest(rows, found, length, *carried(rows), True), docs, text_col)


def _rest(rows: DataFrame, found: DataFrame, length: int, carry: tuple, ddl: str, layout: bool) -> DataFrame:
    def rest(batch):
        out = {"kept": [], "n_words": [], "n_removed": []}
        names = batch.column("th").to_numpy()
        nulls = batch.column("text").is_null().to_pylist()
        for i, data in enumerate(as_bytes(batch.column("text"))):
            words, hs, n = data.split(), batch.column("hs")[i], 0
            kept = data if layout else b" ".join(words)
            if hs.is_valid:
                found = hs.values.to_numpy()
                copy = len(words) >= length and names[i] in found
                gone = np.ones(len(words), bool) if copy else covered(words, found.view(np.uint64), length)
                n = int(gone.sum())
                kept = _with_layout(data, words, gone) if layout else b" ".join([w for w, g in zip(words, gone.tolist()) if not g])
            out["kept"].append(None if nulls[i] else kept.decode())
            out["n_words"].append(len(words))
            out["n_removed"].append(n)
        return out

    schema = pa.schema([("kept", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64())])
    joined = rows.join(found, "did", "left").select(*carry, "th", "text", "hs")
    return joined.mapInArrow(arrow_map(rest, schema, carry), ddl + "kept string, n_words bigint, n_removed bigint")


def _with_layout(data: bytes, words: list[bytes], gone: np.ndarray) -> bytes:
    """The white space before each word left; what is left of the ends is stripped."""
    out, at = [], 0
    for word, g in zip(words, gone.tolist()):
        end = data.index(word, at) + len(word)
        if not g:
            out.append(data[at:end])
        at = end
    return b"".join(out).strip()
