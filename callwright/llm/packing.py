"""Hierarchical packing of documents into windows of several lengths.

* Route: whole windows are cut off a document's front; the rest goes to the smallest tier (context
  size) that holds it.  A fixed share of the documents (``FILLERS``) is cut into powers of two, as
  material for gaps; other rests stay whole.
* Pack each tier: the plan works on the number of pieces of each length, at most the window's length
  many numbers, so it is one small table for any input.  A window starts with the longest piece left
  and takes the longest piece that still fits, again and again.
* Fill: gaps of long windows take pieces of all shorter tiers.  What cannot fill a short window
  wholly moves up to the longest tier, so all windows but the last few are full.
* Balance: the windows of a tier are dealt in turn to step groups of about ``STEP_TOKENS`` tokens,
  so groups of a tier differ by one window at most.

A piece finds its place by its rank among the pieces of its length.  Ranks are counted within
(length, salt), so a length that a third of all pieces have is spread over many tasks.

Defined results: a null text is empty; an empty document is the end id alone; equal rows are packed
each; columns other than id and text are not read.
"""
from __future__ import annotations

import functools
import math
import os
import unicodedata
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NO_ID, arrow_map, as_bytes, documents_of, keyed, small_batches, staged

WINDOW = 2048
TIERS = (256, 512, 1024, 2048)
FILLERS = 32  # one document in so many is cut into powers of two
STEP_TOKENS = 16 * WINDOW
RANK_ROWS = 200_000
MEMO_WORDS = 500_000
END_ID = 1


class WordIds:
    """Ids of texts by the tokenizer file; the ids of words between white space are remembered.  The
    file's pattern drops white space and matches nothing across it, so words stand alone; ``whole``
    is the library's way, for files of another kind."""

    def __init__(self, data: bytes):
        import json

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark deals out the work
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(data.decode())
        self.by_word = _drops_space(json.loads(data))
        self.memo: dict[bytes, bytes] = {}

    def whole(self, texts: list[bytes]) -> list[np.ndarray]:
        got = self.tokenizer.encode_batch([t.decode() for t in texts], add_special_tokens=False)
        return [np.array(e.ids, "<u4") for e in got]

    def ids(self, texts: list[bytes]) -> list[np.ndarray]:
        if not self.by_word:
            return self.whole(texts)
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        split = [t.split() for t in texts]
        hard = [w for w in set().union(*split) if w not in self.memo and not self._simple(w)]
        for w, ids in zip(hard, self.whole(hard) if hard else []):
            self.memo[w] = ids.tobytes()
        return [np.frombuffer(b"".join(map(self.memo.__getitem__, words)), "<u4") for words in split]


    def _simple(self, word: bytes) -> bool:
        """Learns a word of Latin letters with punctuation behind it: the file's pattern cuts it into just
        these two, so the merges can run on them at once.  False for any other word."""
        text = word.decode()
        if not text.isascii() and (max(text) >= "\u0250" or not unicodedata.is_normalized("NFC", text)):
            return False
        low = text.lower()
        core = low.rstrip(".,!?;:")
        if not core.isalpha():
            return False
        ids = self._merged(core)
        self.memo[word] = ids + self._merged(low[len(core) :]) if len(core) < len(low) else ids
        return True

    def _merged(self, part: str) -> bytes:
        key = part.encode()
        ids = self.memo.get(key)
        if ids is None:
            shown = part if part.isascii() else key.decode("latin-1").translate(_BYTE_LEVEL)
            ids = self.memo[key] = np.array([t.id for t in self.tokenizer.model.tokenize(shown)], "<u4").tobytes()
        return ids


#: How byte-level files show bytes: those without a sign of their own follow 255 in order.
_BYTE_LEVEL = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}


def _drops_space(spec: dict) -> bool:
    """True for files that make one space of white space and split by a pattern that matches none."""
    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    joins = any(s.get("type") == "Replace" and s.get("pattern") == {"Regex": r"\s+"} for s in steps)
    cuts = any(s.get("type") == "Split" and s.get("behavior") == "Removed" and s.get("invert") and r"[^\s\p{L}\p{N}]+" in s.get("pattern", {}).get("Regex", "") for s in splits)
    own = all(t["content"].split() == [t["content"]] for t in spec.get("added_tokens", []))
    return joins and cuts and own and all(s.get("type") in ("NFC", "Replace", "Lowercase") for s in steps)


@functools.lru_cache(maxsize=4)
def word_ids(data: bytes) -> WordIds:
    return WordIds(data)


# ---------------------------------------------------------------- pieces


def cuts(n: int, window: int, filler: bool) -> list[int]:
    """Lengths of the pieces of a document of ``n`` ids."""
    out, rest = [window] * (n // window), n % window
    if filler and rest:
        size = 1
        while rest > size:
            out.append(size)
            rest -= size
            size *= 2
    return out + [rest] if rest else out


def pieces(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """did, th, start, length, ids_crc32, doc_tokens (and ids) of each piece."""
    with open(path, "rb") as f:
        data = f.read()
    fields = [("did", pa.int64()), ("th", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())]
    ddl = "did bigint, th bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    if with_ids:
        fields.append(("ids", pa.list_(pa.uint32())))
        ddl += ", ids array<bigint>"
        fields[-1] = ("ids", pa.list_(pa.int64()))
    schema = pa.schema(fields)
    end = np.array([end_id], "<u4")

    def run(batch):
        out = {f.name: [] for f in schema}
        dids, ths = batch.column("did").to_pylist(), batch.column("th").to_pylist()
        for did, th, ids in zip(dids, ths, word_ids(data).ids(as_bytes(batch.column("text")))):
            ids, at = np.r_[ids, end], 0
            for size in cuts(len(ids), window, th % FILLERS == 0):
                part = ids[at : at + size]
                for k, v in zip(out, (did, th, at, size, zlib.crc32(part.tobytes()), len(ids))):
                    out[k].append(v)
                if with_ids:
                    out["ids"].append(part.astype(np.int64))
                at += size
        return out

    small_batches(docs.sparkSession)
    return docs.select("did", "th", "text").mapInArrow(arrow_map(run, schema), ddl)


# ---------------------------------------------------------------- plan


def plan(counts: dict[int, int], tiers=TIERS) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """[(tier, how many windows, [(length, times)])] for the given number of pieces of each length."""
    left = {k: v for k, v in counts.items() if v}
    lengths = sorted(left)
    window, out = max(tiers), []

    def longest(most: int, used: dict[int, int]) -> int:
        i = bisect_right(lengths, most)
        while i:
            if left[lengths[i - 1]] > used.get(lengths[i - 1], 0):
                return lengths[i - 1]
            i -= 1
        return 0

    def fill(size: int, first: int) -> tuple[dict[int, int], int]:
        used, gap = {first: 1}, size - first
        while gap and (take := longest(gap, used)):
            times = max(1, min(gap // take, left[take] - used.get(take, 0)))
            used[take] = used.get(take, 0) + times
            gap -= take * times
        return used, gap

    def settle(size: int, used: dict[int, int], windows: int) -> None:
        out.append((size, windows, sorted(used.items(), reverse=True)))
        for k, v in used.items():
            left[k] -= v * windows
            if not left[k]:
                lengths.remove(k)

    for size, below in zip(sorted(tiers, reverse=True), [*sorted(tiers, reverse=True)[1:], 0]):
        waiting = window + 1  # pieces from here on up did not fill a window of this tier
        while first := longest(min(size, waiting - 1), {}):
            if first <= below:
                break
            used, gap = fill(size, first)
            if gap and size < window:
                waiting = first  # moves up: see below
                continue
            settle(size, used, min(left[k] // v for k, v in used.items()))
    while lengths:  # what is left of the shorter tiers fills long windows
        used, _ = fill(window, lengths[-1])
        settle(window, used, min(left[k] // v for k, v in used.items()))
    return out


def places(planned, step_tokens: int = STEP_TOKENS) -> dict[int, dict[str, np.ndarray]]:
    """For each length: ranks from which a part of the plan holds, and what to do there."""
    windows, taken, table = {}, {}, {}
    for tier, n, _ in planned:
        windows[tier] = windows.get(tier, 0) + n
    groups = {t: max(1, math.ceil(n * t / step_tokens)) for t, n in windows.items()}
    first_group, at = {}, 0
    for t in sorted(groups, reverse=True):
        first_group[t], at = at, at + groups[t]
    sequence, nth = 0, dict.fromkeys(windows, 0)
    for tier, n, parts in planned:
        offset = 0
        for length, times in parts:
            rank = taken.get(length, 0)
            table.setdefault(length, []).append((rank, times, sequence, offset, tier, nth[tier], groups[tier], first_group[tier]))
            taken[length] = rank + n * times
            offset += length * times
        sequence += n
        nth[tier] += n
    return {k: np.array(v, np.int64) for k, v in table.items()}


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tiers=TIERS, end_id: int = END_ID, with_ids: bool = False, rank_rows: int = RANK_ROWS) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier (window length),
    step_group of each piece (and its ids)."""
    rows = staged(pieces(keyed(documents_of(docs, id_col, text_col)), path, max(tiers), end_id, with_ids), "pieces")
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each length
    planned = plan(counts, tiers)
    table = places(planned)
    salts = max(1, math.ceil(max(counts.values(), default=0) / rank_rows))
    salt = F.pmod(F.xxhash64("did", "th", "start"), F.lit(salts))
    rows = rows.withColumn("salt", salt)
    w = Window.partitionBy("length", "salt").orderBy("did", "th", "start", "ids_crc32")
    ranked = rows.withColumn("rank", F.row_number().over(w).cast("bigint") - 1)
    before = rows.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("length", "salt", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    ranked = ranked.join(before, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before")).drop("salt", "before")
    plain = ["did", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
    made = [("sequence_id", pa.int64()), ("offset", pa.int64()), ("tier", pa.int32()), ("step_group", pa.int64())]

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            out = np.zeros((4, len(rank)), np.int64)
            for size in np.unique(length):
                rows_ = np.flatnonzero(length == size)
                part = table[int(size)]
                p = part[np.searchsorted(part[:, 0], rank[rows_], "right") - 1].T
                i = rank[rows_] - p[0]
                which, slot = i // p[1], i % p[1]
                out[:, rows_] = p[2] + which, p[3] + slot * size, p[4], p[7] + (p[5] + which) % p[6]
            dids = batch.column("did").to_numpy()
            cols = [pa.array(dids, mask=dids == NO_ID)] + [batch.column(c) for c in plain[1:]]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(x, t) for x, (_, t) in zip(out, made)], names=["doc_id", *plain[1:], *(n for n, _ in made)])

    ddl = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids array<bigint>" * with_ids
    return ranked.select(*plain, "rank").mapInArrow(place, ddl + ", sequence_id bigint, offset bigint, tier int, step_group bigint")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, tier, step_group, ids, n_tokens, doc_ids, lengths: one row for each window, of the
    output of ``pack(..., with_ids=True)``; a window is at most the longest tier."""
    rows = F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id", "length")))
    out = packed.groupBy("sequence_id", "tier", "step_group").agg(rows.alias("r"))
    return out.select("sequence_id", "tier", "step_group", F.flatten("r.ids").alias("ids"), F.size(F.flatten("r.ids")).alias("n_tokens"), F.col("r.doc_id").alias("doc_ids"), F.col("r.length").alias("lengths"))
