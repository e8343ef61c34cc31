"""Alignment of two tokenizers' encodings of the same texts by lockstep merging.

Both encodings of a text cover the same bytes (a space and the text).  For all texts of a batch one
state vector holds the place in the A tokens and one the place in the B tokens.  Every step emits the
pair of current tokens of each text as a link (their byte ranges overlap), compares their ends, advances
the one that ends first, and emits a cut where both end together; texts that are through leave the
vectors.  Texts of more than ``LANE_CHUNKS`` chunks take part as several lanes, so that one very long text
does not leave the vectors nearly empty.

A chunk starts at a single space before a visible sign.  Neither encoding crosses such a place
(checked for the files), so chunks are encoded once, many in one call of the libraries, and remembered.
Other files, and texts that hold such places nowhere, are encoded whole.

Corpus-wide counts of linked id pairs (``digests``): each task keeps the links of a block of
documents as codes into the block's own list of distinct pairs and writes both to the checkpoint
folder.  Only the lists are summed by pair and joined back to their blocks; a common pair is one row for each
block.  Then each block's documents meet their block's counts.

Defined results: texts that are null, empty, or that an encoding does not give back byte by byte (U+2581 in
the text) have no tokens, zeros and an empty digest; equal rows give equal rows; a null id stays null;
columns other than id and text are not read.
"""
from __future__ import annotations

import functools
import hashlib
import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, as_bytes, documents_of, partitions, small_batches, staged
from .sentencepiece_codec import Codec as Pieces

LANE_CHUNKS = 256
UNIT_CHUNKS = 1 << 17  # chunks of one document that are aligned at a time
PASS_CHUNKS = 1 << 18  # chunks of all documents that are aligned at a time
BLOCK_BYTES = 8 << 20  # text whose links share a list of pairs
CALL_BYTES = 1 << 15  # text of one string given to the libraries
MEMO_CHUNKS = 300_000
MEMO_IDS = 6_000_000

META = "▁".encode()
#: lead bytes of signs that are surely no white space
_SIGN = rb"[!-~\xc3-\xdf\xe4-\xe9]"
_STARTS = re.compile(_SIGN)
_ODD_SPACE = re.compile(rb" (?!" + _SIGN + rb")")
_CUT = re.compile(rb"(?<! )(?= " + _SIGN + rb")")

#: How byte-level files show bytes: those without a sign of their own follow 255 in order.
_OWN_SIGN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE = {chr(b): b for b in _OWN_SIGN} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in _OWN_SIGN)}


class _Flat:
    """Lists of ids, one behind the other, by slot."""

    def __init__(self):
        self.values, self.used = np.empty(1 << 16, np.int32), 0
        self.start, self.size = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)

    def put(self, slot: int, values: np.ndarray, sizes: np.ndarray) -> None:
        """Lists of the given sizes for the slots from ``slot`` on."""
        need, slots = self.used + len(values), slot + len(sizes)
        if need > len(self.values):
            self.values = np.resize(self.values, max(need, 2 * len(self.values)))
        if slots > len(self.start):
            self.start, self.size = (np.resize(x, max(slots, 2 * len(x))) for x in (self.start, self.size))
        self.values[self.used : need] = values
        self.size[slot:slots] = sizes
        self.start[slot:slots] = self.used + np.cumsum(sizes) - sizes
        self.used = need

    def get(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.size[slots]
        at = np.repeat(self.start[slots] - (np.cumsum(size) - size), size)
        return self.values[at + np.arange(len(at))], size


class TwoTokenizers:
    def __init__(self, a_file: bytes, b_file: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark deals out the work
        import sentencepiece.sentencepiece_model_pb2 as model
        from tokenizers import Tokenizer

        spec = json.loads(a_file)
        self.a = Tokenizer.from_str(a_file.decode())
        self.a.encode_special_tokens = True
        split = spec.get("pre_tokenizer") or {}
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not spec.get("normalizer")
        if split.get("type") != "ByteLevel":
            raise ValueError("A must be a byte-level file")
        vocab = self.a.get_vocab()
        a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            a_bytes[i] = bytes(map(_BYTE.__getitem__, token)) if all(c in _BYTE for c in token) else token.encode()
        proto = model.ModelProto()
        proto.ParseFromString(b_file)
        pieces = Pieces(b_file)
        self.b = pieces.sp
        kind = proto.SentencePiece.BYTE
        b_bytes = [bytes([int(p.piece[3:5], 16)]) if p.type == kind else p.piece.replace("▁", " ").encode() for p in proto.pieces]
        self.bytes_of = a_bytes, b_bytes
        self.width = tuple(np.array([*map(len, x)], np.int64) for x in self.bytes_of)
        self.in_chunks = plain and pieces.in_chunks
        self.forget()

    def forget(self) -> None:
        self.slot: dict[bytes, int] = {}
        self.ids = _Flat(), _Flat()
        self.whole = np.empty(1 << 14, bool)  # both encodings give the chunk back

    # -------------------------------------------------------- encoding

    def chunks(self, text: bytes) -> list[bytes]:
        """The chunks of space+text, each without its space in front."""
        if not self.in_chunks or META in text:
            return [text]
        if not _ODD_SPACE.search(b" " + text):
            return text.split(b" ")
        return [c[1:] for c in _CUT.split(b" " + text) if c]

    def learn(self, chunks: set[bytes]) -> None:
        """Encodes new chunks: plain ones many in one string, others by themselves."""
        groups, size = [[]], 0
        for c in chunks:
            alone = not self.in_chunks or not _STARTS.match(c) or c.endswith(b" ") or META in c
            if alone:
                groups.insert(0, [c])
                continue
            if size > CALL_BYTES:
                groups.append([])
                size = 0
            groups[-1].append(c)
            size += len(c) + 1
        self._encode([g for g in groups if g])

    def _encode(self, groups: list[list[bytes]]) -> None:
        texts = [b" " + b" ".join(g) for g in groups]
        a_ids = [e.ids for e in self.a.encode_batch([t.decode() for t in texts], add_special_tokens=False)]
        b_ids = self.b.encode([t[1:].decode() for t in texts], num_threads=1) if texts else []
        for group, text, *ids in zip(groups, texts, a_ids, b_ids):
            whole = all(b"".join(map(of.__getitem__, i)) == text for of, i in zip(self.bytes_of, ids))
            if not whole and len(group) > 1:
                self._encode([[c] for c in group])
                continue
            first = len(self.slot)
            self.slot.update(zip(group, range(first, first + len(group))))
            if len(self.slot) > len(self.whole):
                self.whole = np.resize(self.whole, 2 * len(self.slot))
            self.whole[first : len(self.slot)] = whole
            ends = np.cumsum([len(c) + 1 for c in group])
            for flat, width, i in zip(self.ids, self.width, ids):
                i = np.array(i if whole else [], np.int32)
                upto = np.searchsorted(np.cumsum(width[i]), ends) + 1 if whole else np.zeros(1, np.int64)
                flat.put(first, i, np.diff(upto, prepend=0))

    def slots(self, texts: list[bytes]) -> list[np.ndarray]:
        """For each text the slots of its chunks; none where the text has no tokens."""
        if len(self.slot) > MEMO_CHUNKS or max(f.used for f in self.ids) > MEMO_IDS:
            self.forget()
        cut = [self.chunks(t) if t else [] for t in texts]
        self.learn(set().union(*cut).difference(self.slot))
        out = [np.fromiter(map(self.slot.__getitem__, c), np.int64, len(c)) for c in cut]
        return [s if self.whole[s].all() else s[:0] for s in out]


@functools.lru_cache(maxsize=2)
def tokenizers_of(a_file: bytes, b_file: bytes) -> TwoTokenizers:
    return TwoTokenizers(a_file, b_file)


# ---------------------------------------------------------------- merging


def lockstep(a_end: np.ndarray, b_end: np.ndarray, a: np.ndarray, b: np.ndarray, a_stop: np.ndarray):
    """(A tokens, B tokens) of all links, and which A and B tokens end at a cut.  ``a`` and ``b`` are the
    first tokens of each lane, ``a_stop`` the A token behind it; ends are byte offsets."""
    link_a, link_b = [], []
    cut_a, cut_b = np.zeros(len(a_end), bool), np.zeros(len(b_end), bool)
    while len(a):
        link_a.append(a)
        link_b.append(b)
        x, y = a_end[a], b_end[b]
        step_a, step_b = x <= y, x >= y
        cut_a[a] = cut_b[b] = step_a & step_b
        a, b = a + step_a, b + step_b
        through = a == a_stop
        if through.any():
            a, b, a_stop = a[~through], b[~through], a_stop[~through]
    none = [np.empty(0, np.int64)]
    return np.concatenate(link_a or none), np.concatenate(link_b or none), cut_a, cut_b


class Aligned:
    """Links and cuts of some units (documents or parts of them), each a list of chunk slots."""

    def __init__(self, two: TwoTokenizers, units: list[np.ndarray]):
        chunks = np.array([*map(len, units)], np.int64)
        slots = np.concatenate(units) if units else np.empty(0, np.int64)
        (self.a, n_a), (self.b, n_b) = (flat.get(slots) for flat in two.ids)
        a_at, b_at = np.r_[0, np.cumsum(n_a)], np.r_[0, np.cumsum(n_b)]
        edge = np.r_[0, np.cumsum(chunks)]
        lanes = np.concatenate([np.arange(s, e, LANE_CHUNKS) for s, e in zip(edge[:-1], edge[1:])] or [edge[:0]])
        self.a_end, self.b_end = np.cumsum(two.width[0][self.a]), np.cumsum(two.width[1][self.b])
        link_a, link_b, self.cut_a, self.cut_b = lockstep(self.a_end, self.b_end, a_at[lanes], b_at[lanes], np.r_[a_at[lanes[1:]], a_at[-1:]][: len(lanes)])
        self.group_a = np.cumsum(self.cut_a) - self.cut_a  # cuts before each token
        self.group_b = np.cumsum(self.cut_b) - self.cut_b
        # each step without a cut advances one pointer, one with a cut both: the links' order in the text
        order = link_a + link_b - self.group_a[link_a]
        self.link_a, self.link_b = np.empty_like(link_a), np.empty_like(link_b)
        self.link_a[order], self.link_b[order] = link_a, link_b
        self.unit_a, self.unit_b = a_at[edge], b_at[edge]
        groups = np.r_[self.group_a, self.cut_a.sum()]
        self.unit_group = groups[self.unit_a]
        self.unit_link = self.unit_a + self.unit_b - self.unit_group

    def pairs(self) -> np.ndarray:
        """The id pair of each link, as one number."""
        return self.a[self.link_a].astype(np.int64) << 32 | self.b[self.link_b]

    def spelled(self) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of each unit."""
        groups = int(self.cut_a.sum())
        a_before = np.r_[0, np.cumsum(np.bincount(self.group_a, minlength=groups))]
        b_before = np.r_[0, np.cumsum(np.bincount(self.group_b, minlength=groups))]
        words = np.empty(len(self.a) + len(self.b), np.uint64)
        words[np.arange(len(self.a)) + b_before[self.group_a]] = _SPELLED.get(self.a, np.where(self.cut_a, 1, 0))
        words[np.arange(len(self.b)) + a_before[self.group_b + 1]] = _SPELLED.get(self.b, np.where(self.cut_b, 2, 0))
        signs = words.view(np.uint8)
        edge = 8 * (self.unit_a + self.unit_b)
        parts = [signs[s:e] for s, e in zip(edge[:-1], edge[1:])]
        return [p[p != 0][:-1].tobytes() for p in parts]


class _Spelled:
    """Ids in decimals with a separator behind them, as eight bytes filled with zeros."""

    def __init__(self):
        self.table = np.empty((3, 0), np.uint64)

    def get(self, ids: np.ndarray, sep: np.ndarray) -> np.ndarray:
        top = int(ids.max()) + 1 if len(ids) else 0
        if top > 10_000_000:
            raise ValueError("ids of up to seven digits are spelled")
        if top > self.table.shape[1]:
            self.table = np.array([[int.from_bytes(b"%d%c" % (i, s), "little") for i in range(top)] for s in b",|;"], np.uint64)
        return self.table[sep, ids]


_SPELLED = _Spelled()


def _units(slots: list[np.ndarray]) -> list[list[tuple[int, np.ndarray]]]:
    """Passes of (document, chunk slots) of bounded size; long documents are in several units."""
    passes, size = [[]], 0
    for doc, s in enumerate(slots):
        for at in range(0, len(s), UNIT_CHUNKS):
            unit = s[at : at + UNIT_CHUNKS]
            if size + len(unit) > PASS_CHUNKS and passes[-1]:
                passes.append([])
                size = 0
            passes[-1].append((doc, unit))
            size += len(unit)
    return [p for p in passes if p]


def _files(a_path: str, b_path: str) -> tuple[bytes, bytes]:
    """Read by the driver, sent with the tasks: executors need no such files."""
    with open(a_path, "rb") as a, open(b_path, "rb") as b:
        return a.read(), b.read()


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, a_ids, b_ids, link_a and link_b (places in these lists of each link's tokens), cuts (byte offsets
    in space+text where A and B tokens both end)."""
    files = docs.sparkSession.sparkContext.broadcast(_files(a_path, b_path))
    lists = ("a_ids", "b_ids", "link_a", "link_b", "cuts")
    schema = pa.schema([("doc_id", pa.int64()), *[(n, pa.list_(pa.int64())) for n in lists]])

    def run(batch):
        two = tokenizers_of(*files.value)
        out = {"doc_id": batch.column("doc_id"), **{n: [] for n in lists}}
        for s in two.slots(as_bytes(batch.column("text"))):
            x = Aligned(two, [s] if len(s) else [])
            for n, v in zip(lists, (x.a, x.b, x.link_a, x.link_b, x.a_end[x.cut_a])):
                out[n].append(v)
        return out

    small_batches(docs.sparkSession, 256)
    return documents_of(docs, id_col, text_col).mapInArrow(arrow_map(run, schema), "doc_id bigint, " + ", ".join(f"{n} array<bigint>" for n in lists))


# ---------------------------------------------------------------- corpus-wide counts

_COUNTS = ("n_a", "n_b", "n_groups", "n_links")
_BLOCK = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), *[(n, pa.int64()) for n in _COUNTS], ("groups_sha256", pa.string()), ("codes", pa.binary()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])
_BLOCK_DDL = "block bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, codes binary, pairs array<bigint>, times array<bigint>"


class _Block:
    """Documents that share one list of pairs."""

    def __init__(self, number: int):
        self.number, self.size = number, 0
        self.ids: list = []
        self.counts: list[list[int]] = []
        self.sums: list = []
        self.links: list[list[tuple[int, int, int]]] = []  # (pass, from, to) of each document's links
        self.passes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # distinct pairs, their number, each link's

    def add(self, two: TwoTokenizers, ids: list, texts: list[bytes]) -> None:
        first = len(self.ids)
        self.ids += ids
        self.size += sum(map(len, texts))
        self.counts += [[0, 0, 0, 0] for _ in ids]
        self.sums += [None] * len(ids)
        self.links += [[] for _ in ids]
        for units in _units(two.slots(texts)):
            x = Aligned(two, [s for _, s in units])
            pairs, inverse, times = np.unique(x.pairs(), return_inverse=True, return_counts=True)
            steps = np.stack([np.diff(e) for e in (x.unit_a, x.unit_b, x.unit_group, x.unit_link)], 1).tolist()
            for i, ((doc, _), step, text) in enumerate(zip(units, steps, x.spelled())):
                doc += first
                self.counts[doc] = [p + q for p, q in zip(self.counts[doc], step)]
                if self.sums[doc] is None:
                    self.sums[doc] = hashlib.sha256(text)
                else:
                    self.sums[doc].update(b";" + text)
                self.links[doc].append((len(self.passes), int(x.unit_link[i]), int(x.unit_link[i + 1])))
            self.passes.append((pairs, times, inverse.astype(np.int32)))

    def rows(self) -> pa.RecordBatch:
        """A row for each document and a last one with the list of pairs, commonest first."""
        every = np.concatenate([p for p, _, _ in self.passes] or [np.empty(0, np.int64)])
        pairs, at = np.unique(every, return_inverse=True)
        times = np.bincount(at, np.concatenate([t for _, t, _ in self.passes] or [np.empty(0)]), len(pairs)).astype(np.int64)
        order = np.argsort(-times, kind="stable")
        code = np.empty(len(pairs), np.uint32)
        code[order] = np.arange(len(pairs), dtype=np.uint32)
        edge = np.r_[0, np.cumsum([len(p) for p, _, _ in self.passes], dtype=np.int64)]
        local = [code[at[s:e]][inverse] for s, e, (_, _, inverse) in zip(edge[:-1], edge[1:], self.passes)]
        n = len(self.ids)
        planes = [np.concatenate([local[p][s:e] for p, s, e in parts]).view(np.uint8).reshape(-1, 4).T.tobytes() if parts else b"" for parts in self.links]
        columns = {
            "block": [self.number] * (n + 1),
            "doc_id": [*self.ids, None],
            **{c: [*[x[i] for x in self.counts], None] for i, c in enumerate(_COUNTS)},
            "groups_sha256": [*[s.hexdigest() if s else "" for s in self.sums], None],
            "codes": [*planes, None],
            "pairs": [None] * n + [pairs[order]],
            "times": [None] * n + [times[order]],
        }
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in _BLOCK], schema=_BLOCK)


def _blocks(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    files = docs.sparkSession.sparkContext.broadcast(_files(a_path, b_path))

    def run(batches):
        two = tokenizers_of(*files.value)
        number = TaskContext.get().partitionId() << 32
        block = _Block(number)
        for batch in batches:
            block.add(two, batch.column("doc_id").to_pylist(), as_bytes(batch.column("text")))
            if block.size >= BLOCK_BYTES:
                yield block.rows()
                number += 1
                block = _Block(number)
        if block.ids:
            yield block.rows()

    small_batches(docs.sparkSession, 256)
    return docs.mapInArrow(run, _BLOCK_DDL)


_SCORED = pa.schema([("doc_id", pa.int64()), *[(n, pa.int64()) for n in _COUNTS], ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups_sha256", pa.string())])


def _scored(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """The documents of one block with the counts of the block's pairs."""
    code = pairs.column("code").to_numpy()
    total, best = np.zeros(len(code), np.int64), np.zeros(len(code), np.int64)
    total[code], best[code] = pairs.column("total").to_numpy(), pairs.column("best").to_numpy()
    n_best, count_sum = [], []
    for planes in docs.column("codes").to_pylist():
        c = np.frombuffer(planes, np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel()
        n_best.append(int(best[c].sum()))
        count_sum.append(int(total[c].sum()))
    made = {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64())}
    return pa.Table.from_arrays([made.get(f.name, docs.column(f.name) if f.name in docs.column_names else None) for f in _SCORED], schema=_SCORED)


def digests(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is the commonest of its B id), count_sum
    (how often each link's pair is linked in all documents, summed), groups_sha256."""
    blocks = staged(_blocks(documents_of(docs, id_col, text_col), a_path, b_path), "token-links")
    zipped = F.arrays_zip("pairs", "times")
    held = blocks.where("pairs is not null").select("block", F.posexplode(zipped).alias("code", "x")).select("block", "code", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    totals = held.groupBy("pair").agg(F.sum("times").alias("total"))
    of_b = Window.partitionBy(F.col("pair").bitwiseAND(F.lit(2**32 - 1)))  # at most one row for each A id
    totals = totals.withColumn("best", (F.col("total") == F.max("total").over(of_b)).cast("bigint"))
    counts = held.select("block", "code", "pair").join(totals, "pair").select(F.col("block").alias("of_block"), "code", "total", "best")
    rows = blocks.where("pairs is null").drop("pairs", "times")
    tasks = max(partitions(docs.sparkSession), blocks.where("pairs is not null").count())  # about one block in a task, however many there are
    rows, counts = rows.repartition(tasks, "block"), counts.repartition(tasks, "of_block")
    return rows.groupBy("block").cogroup(counts.groupBy("of_block")).applyInArrow(_scored, "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string")
