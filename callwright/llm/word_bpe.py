"""BPE encoding over a contiguous rank array, and decoding.

A word is a row of parts (token ids, contiguous) and a row with the rank of each pair of neighbours.
Again and again the smallest rank is looked for (the first of equal ones), its boundary is deleted
and the ranks of the two neighbours of the new part are looked up anew.  The words of a batch that
are not known yet are the rows of one matrix, which loses one column with every step; a row
without a known pair is done and leaves it.  Words of more than ``SHORT`` parts, where repeated scans
would cost the square of the length, keep their ranks in a heap instead.

Text rules are those of the tokenizer file: added tokens are cut out first, the rest is normalised
and split by the file's pattern.  For files that drop white space (checked) words between white space
stand alone and are remembered; words of Latin letters, digits and ASCII signs are split here, all other
words by the library's own normaliser and pattern.

Defined results: null reads as empty, an empty text has no id and decodes to an empty text; equal
rows give equal rows; columns other than id and text are not read; unknown ids decode to nothing.
"""
from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, as_bytes, documents_of, small_batches
from .packing import _drops_space

SHORT = 64
NONE = np.int32(2**31 - 1)  # rank of a pair that no merge knows
MATRIX_PARTS = 1 << 20  # cells of one matrix
MEMO_WORDS = 400_000
MEMO_LENGTH = 200  # bytes; longer words are encoded each time

#: ASCII signs and the letters U+00C0 to U+017E whose lower case is one letter
_LATIN = re.compile("[!-~À-ÖØ-öø-įı-ž]+")
#: The file's pattern (CLIP_PATTERN) for such words in lower case
_LATIN_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ž]+|[0-9]|[^a-z0-9ß-öø-ž]+")
CLIP_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: How byte-level files show bytes: those without a sign of their own follow 255 in order.
_SHOWN = [chr(b) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174 else None for b in range(256)]
for _b, _n in zip((b for b in range(256) if _SHOWN[b] is None), range(256, 512)):
    _SHOWN[_b] = chr(_n)
_BYTE = {c: b for b, c in enumerate(_SHOWN)}


class Merges:
    """Rank and result of each pair of ids, as sorted arrays."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        rows = np.array([(vocab[a] << 32 | vocab[b], rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)], np.int64).reshape(-1, 3)
        rows = rows[np.lexsort((-rows[:, 1], rows[:, 0]))]  # of a repeated pair the last line counts
        rows = rows[np.r_[True, rows[1:, 0] != rows[:-1, 0]]] if len(rows) else rows
        self.pair = np.r_[rows[:, 0], np.int64(2**63 - 1)]
        self.rank = np.r_[rows[:, 1], NONE].astype(np.int32)
        self.made = np.r_[rows[:, 2], -1].astype(np.int32)

    def look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, new id) of pairs; ``NONE`` for unknown ones and where an id is -1 (no part)."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = np.searchsorted(self.pair, key)
        at[at == len(self.pair)] = len(self.pair) - 1
        known = (self.pair[at] == key) & (left >= 0) & (right >= 0)
        return np.where(known, self.rank[at], NONE), self.made[at]

    def short(self, parts: np.ndarray) -> list[np.ndarray]:
        """Ids of the words in the rows of ``parts``; -1 fills rows behind the word."""
        out: list[np.ndarray] = [np.empty(0, np.int32)] * len(parts)
        word = np.arange(len(parts))
        rank, made = self.look(parts[:, :-1], parts[:, 1:])
        while len(word):
            row, best = np.arange(len(word)), rank.argmin(1) if rank.shape[1] else np.zeros(len(word), np.int64)
            done = rank[row, best] == NONE if rank.shape[1] else np.ones(len(word), bool)
            if done.any():
                for i in np.flatnonzero(done).tolist():
                    out[word[i]] = parts[i][parts[i] >= 0]
                word, parts, rank, made, best = (x[~done] for x in (word, parts, rank, made, best))
                if not len(word):
                    break
                row = np.arange(len(word))
            parts[row, best] = made[row, best]
            column = np.arange(parts.shape[1] - 1)
            parts = np.take_along_axis(parts, column + (column > best[:, None]), 1)
            keep = column[:-1] + (column[:-1] >= best[:, None])
            rank, made = np.take_along_axis(rank, keep, 1), np.take_along_axis(made, keep, 1)
            for at in (best - 1, best):  # the pairs on either side of the new part
                here = np.flatnonzero((at >= 0) & (at < rank.shape[1]))
                spot = at[here]
                rank[here, spot], made[here, spot] = self.look(parts[here, spot], parts[here, spot + 1])
        return out

    @functools.cached_property
    def _dict(self) -> dict[int, tuple[int, int]]:
        return dict(zip(self.pair.tolist(), zip(self.rank.tolist(), self.made.tolist())))

    def long(self, parts: np.ndarray) -> np.ndarray:
        """The same for one long word: candidate ranks in a heap, neighbours by links."""
        pairs, ids, n = self._dict, parts.tolist(), len(parts)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        now = [-1] * n  # rank of the part with the one behind it

        def rank_at(i: int) -> int:
            j = after[i]
            now[i] = -1 if j < 0 else pairs.get(ids[i] << 32 | ids[j], (-1, -1))[0]
            return now[i]

        heap = [r << 40 | i for i in range(n) if (r := rank_at(i)) >= 0]
        heapify(heap)
        while heap:
            top = heappop(heap)
            i = top & (1 << 40) - 1
            if now[i] != top >> 40:
                continue
            j = after[i]
            ids[i] = pairs[ids[i] << 32 | ids[j]][1]
            ids[j] = now[j] = -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and (r := rank_at(k)) >= 0:
                    heappush(heap, r << 40 | k)
        kept = np.array(ids, np.int32)
        return kept[kept >= 0]


class Codec:
    def __init__(self, data: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark deals out the work
        from tokenizers import Tokenizer

        spec = json.loads(data)
        model = spec["model"]
        splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if model["type"] != "BPE" or model.get("unk_token") or model.get("byte_fallback") or model.get("continuing_subword_prefix") or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError("only plain byte-level BPE files are read")
        if not any(s.get("type") == "ByteLevel" and not s.get("add_prefix_space") for s in splits) or spec.get("decoder"):
            raise ValueError("only files with a byte-level split and no decoder are read")
        vocab = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merges = Merges(vocab, merges)
        end = model.get("end_of_word_suffix") or ""
        self.inner = np.array([vocab[c] for c in _SHOWN], np.int32)
        self.last = np.array([vocab[c + end] for c in _SHOWN], np.int32)
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if any(t[k] for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("only added tokens that stand for their plain text are read")
        self.added = added
        self.cut_added = re.compile("(" + "|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.shown = {i: t.encode() for t, i in (vocab | added).items()}
        self.by_word = _drops_space(spec)
        self.latin = self.by_word and any(s.get("type") == "Split" and s["pattern"].get("Regex") == CLIP_PATTERN for s in splits)
        tokenizer = Tokenizer.from_str(data.decode())
        self.normalise = tokenizer.normalizer.normalize_str if tokenizer.normalizer else str
        self.split = tokenizer.pre_tokenizer.pre_tokenize_str
        self.parts: dict[bytes | int, tuple[bytes, bytes]] = {}
        self.words: dict[bytes, tuple[bytes, bytes]] = {}

    # -------------------------------------------------------- text to parts

    def pieces_of(self, word: bytes) -> list[bytes | int]:
        """The pattern's matches as bytes, added tokens as ids."""
        text = word.decode()
        if self.latin and _LATIN.fullmatch(text) and "<|" not in text:
            return [p.encode() for p in _LATIN_PARTS.findall(text.lower())]
        out: list[bytes | int] = []
        for i, segment in enumerate(self.cut_added.split(text) if self.cut_added else [text]):
            if i % 2:
                out.append(self.added[segment])
            elif segment:
                out += [bytes(map(_BYTE.__getitem__, p)) for p, _ in self.split(self.normalise(segment))]
        return out

    def merge(self, pieces: list[bytes]) -> None:
        """Encodes distinct pieces into ``self.parts``."""
        pieces = sorted(pieces, key=len)
        at = 0
        while at < len(pieces) and len(pieces[at]) <= SHORT:
            stop = at + max(1, MATRIX_PARTS // SHORT)
            stop = min(len(pieces), stop)
            while len(pieces[stop - 1]) > SHORT:
                stop -= 1
            some = pieces[at:stop]
            for p, ids in zip(some, self.merges.short(self._matrix(some))):
                self._keep(p, ids)
            at = stop
        for p in pieces[at:]:
            row = self.inner[np.frombuffer(p, np.uint8)]
            row[-1] = self.last[p[-1]]
            self._keep(p, self.merges.long(row))

    def _matrix(self, pieces: list[bytes]) -> np.ndarray:
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        out = np.full((len(pieces), int(lengths.max())), -1, np.int32)
        data = np.frombuffer(b"".join(pieces), np.uint8)
        row = np.repeat(np.arange(len(pieces)), lengths)
        ends = np.cumsum(lengths)
        out[row, np.arange(len(data)) - np.repeat(ends - lengths, lengths)] = self.inner[data]
        out[np.arange(len(pieces)), lengths - 1] = self.last[data[ends - 1]]
        return out

    # -------------------------------------------------------- words

    def learn(self, words: set[bytes]) -> dict[bytes, tuple[bytes, bytes]]:
        """word -> (ids as little-endian numbers, shown tokens joined by spaces), of new words."""
        if len(self.parts) > MEMO_WORDS:
            self.parts.clear()
        cut = [*map(self.pieces_of, words)]
        new = set().union(*cut).difference(self.parts)
        self.merge([p for p in new if isinstance(p, bytes)])
        for p in new:
            if not isinstance(p, bytes):
                self.parts[p] = np.array([p], "<u4").tobytes(), self.shown[p]
        parts = self.parts
        made = {}
        for w, pieces in zip(words, cut):
            if len(pieces) == 1:
                made[w] = parts[pieces[0]]
            else:
                found = [parts[p] for p in pieces]
                made[w] = b"".join([f[0] for f in found]), b" ".join([f[1] for f in found])
        return made

    def _keep(self, piece: bytes, ids: np.ndarray) -> None:
        self.parts[piece] = ids.astype("<u4").tobytes(), b" ".join([self.shown[i] for i in ids.tolist()])

    def encode(self, texts: list[bytes]) -> list[list[tuple[bytes, bytes]]]:
        """For each text its words' (ids, shown tokens)."""
        split = [t.split() if self.by_word else [t] if t else [] for t in texts]
        if len(self.words) > MEMO_WORDS:
            self.words.clear()
        made = self.learn(set().union(*split).difference(self.words))
        for w, found in made.items():
            if len(w) <= MEMO_LENGTH:
                self.words[w] = found
        known = self.words if all(len(w) <= MEMO_LENGTH for w in made) else {**self.words, **made}
        return [[*map(known.__getitem__, ws)] for ws in split]

    def decode(self, ids) -> str:
        return b" ".join([self.shown[i] for i in ids if i in self.shown]).decode()


@functools.lru_cache(maxsize=4)
def codec(data: bytes) -> Codec:
    return Codec(data)


def _file(path: str) -> bytes:
    """Read by the driver, sent with the tasks: executors need no such file."""
    with open(path, "rb") as f:
        return f.read()


def _encoded(docs: DataFrame, path: str, schema: pa.Schema, ddl: str, row) -> DataFrame:
    data = _file(path)

    def run(batch):
        out = {f.name: [] for f in schema}
        out["doc_id"] = batch.column("doc_id")
        for words in codec(data).encode(as_bytes(batch.column("text"))):
            for k, v in row(words).items():
                out[k].append(v)
        return out

    small_batches(docs.sparkSession, 256)
    return docs.mapInArrow(arrow_map(run, schema), ddl)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
    row = lambda words: {"ids": np.frombuffer(b"".join([w[0] for w in words]), "<u4").astype(np.int32)}
    return _encoded(documents_of(docs, id_col, text_col), path, schema, "doc_id bigint, ids array<int>", row)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text of lists of ids (null or empty: empty text)."""
    data = _file(path)
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batch):
        return {"doc_id": batch.column("doc_id"), "text": [codec(data).decode(x or []) for x in batch.column("ids").to_pylist()]}

    return encoded.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"`{ids_col}` ids").mapInArrow(arrow_map(run, schema), "doc_id bigint, text string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encoding and decoding without carrying the ids along: doc_id, n_tokens, ids_sha256 (ids as
    little-endian unsigned 32-bit numbers), decoded_sha256."""

    def row(words):
        ids = b"".join([w[0] for w in words])
        return {
            "n_tokens": len(ids) // 4,
            "ids_sha256": hashlib.sha256(ids).hexdigest(),
            "decoded_sha256": hashlib.sha256(b" ".join([w[1] for w in words if w[1]])).hexdigest(),
        }

    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    return _encoded(documents_of(docs, id_col, text_col), path, schema, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string", row)
