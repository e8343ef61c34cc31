"""SentencePiece encoding that keeps offsets, and decoding.

The text is normalised as the model's file says: at each place the longest prefix that the compiled
character map knows is replaced, then come white-space rules, the dummy prefix and the meta symbol.
Each byte of the normalised text records the byte of the source that it stems from.  Pieces are
consecutive parts of the normalised text, so every piece projects to a span of source bytes.

Ids are exactly the library's.  Where no piece of the vocabulary holds a meta symbol behind
another character (checked), merges never cross the start of a run of spaces; then chunks from one run
of spaces to the next are encoded on their own and remembered, else whole texts are encoded.

Defined results: null reads as empty, an empty text has no piece; equal rows give equal rows; columns
other than id and text are not read.
"""
from __future__ import annotations

import functools
import hashlib
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import as_bytes, arrow_map, documents_of, small_batches

META = "▁".encode()
MEMO_CHUNKS = 300_000
_CHUNK = re.compile(rb" *[^ ]+| +")


class CharMap:
    """The compiled character map: a double-array trie over UTF-8 bytes whose values point into a
    pool of replacements, each ended by a zero byte."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.pool = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes taken, replacement) of the longest known prefix of ``data[at:]``."""
        if not self.units:
            return None
        node, best = self._child(0), None
        for i in range(at, len(data)):
            spot = node ^ data[i]
            unit = self.units[spot]
            if unit & 0x800000FF != data[i]:
                break
            node = spot ^ self._child(spot)
            if unit >> 8 & 1:
                best = i + 1 - at, self.units[node] & 0x7FFFFFFF
        if best is None:
            return None
        return best[0], self.pool[best[1] : self.pool.index(b"\0", best[1])]

    def _child(self, spot: int) -> int:
        unit = self.units[spot]
        return (unit >> 10) << ((unit & 0x200) >> 6)


def _char_length(lead: int) -> int:
    return 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


class Codec:
    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        self.rules = proto.normalizer_spec
        self.map = CharMap(self.rules.precompiled_charsmap)
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        kinds = proto.SentencePiece
        self.fixed = [p.piece.encode() for p in proto.pieces if p.type == kinds.USER_DEFINED]
        self.width = np.array([1 if p.type == kinds.BYTE else len(p.piece.encode()) for p in proto.pieces], np.int64)
        self.no_unknown = any(p.type == kinds.BYTE for p in proto.pieces)
        plain = not self.map.units and not self.fixed and self.rules.add_dummy_prefix and self.rules.escape_whitespaces
        plain = plain and not self.rules.remove_extra_whitespaces and not proto.trainer_spec.treat_whitespace_as_suffix
        crossing = re.compile("[^▁]▁")
        # 2: byte-pair merges, whose order depends on the merged piece alone
        self.in_chunks = plain and self.no_unknown and proto.trainer_spec.model_type == 2 and not any(crossing.search(p.piece) for p in proto.pieces)
        self.plain = plain
        self.memo: dict[bytes, tuple[list[int], bytes]] = {}

    # -------------------------------------------------------- normalisation

    def normalise(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """(normalised text, source byte of each of its bytes and of its end)."""
        if not data:
            return b"", np.zeros(1, np.int64)
        if self.plain:
            each = np.where(np.frombuffer(data, np.uint8) == 32, 3, 1)
            source = np.repeat(np.arange(len(data)), each)
            return (b" " + data).replace(b" ", META), np.r_[np.zeros(3, np.int64), source, len(data)]
        pieces: list[tuple[bytes, int]] = []  # replacement, place in the source
        at = 0
        while at < len(data):
            own = max((f for f in self.fixed if data.startswith(f, at)), key=len, default=b"")
            found = (len(own), own) if own else self.map.longest(data, at)
            taken, new = found or (_char_length(data[at]), data[at : at + _char_length(data[at])])
            pieces.append((new, at))
            at += taken
        end = len(data)
        rules = self.rules
        if rules.remove_extra_whitespaces:
            while pieces and not pieces[0][0].strip(b" "):
                pieces.pop(0)
            while pieces and not pieces[-1][0].strip(b" "):
                end = pieces.pop()[1]
        space = META if rules.escape_whitespaces else b" "
        out, source = bytearray(), []
        if rules.add_dummy_prefix and pieces:
            out += space
            source += [pieces[0][1]] * len(space)
        after_space = rules.remove_extra_whitespaces
        for new, place in pieces:
            if after_space:
                new = new.lstrip(b" ")
            for byte in new:
                part = space if byte == 32 else bytes((byte,))
                out += part
                source += [place] * len(part)
            if new and rules.remove_extra_whitespaces:
                after_space = new.endswith(b" ")
        if rules.remove_extra_whitespaces:
            while out.endswith(space) and len(out) > len(space):
                end = source[len(out) - len(space)]
                del out[len(out) - len(space) :], source[len(out) :]
        return bytes(out), np.array([*source, end], np.int64)

    # -------------------------------------------------------- pieces

    def learn(self, texts: list[bytes]) -> None:
        """Encodes the chunks of a batch that are not known yet, in one call of the library."""
        if len(self.memo) > MEMO_CHUNKS:
            self.memo.clear()
        new = [c for c in {c for t in texts for c in _CHUNK.findall(b" " + t)} if c not in self.memo]
        inner = [c[1:].decode() for c in new]  # the library adds one space
        for chunk, ids in zip(new, self.sp.encode(inner, num_threads=1) if inner else []):
            ids = ids or [self.sp.piece_to_id("▁")]  # one space at the end
            self.memo[chunk] = ids, b",".join(b"%d" % i for i in ids)

    def chunks(self, data: bytes) -> list | None:
        """[(ids, ids as decimals)], or None where chunks can't be taken."""
        if not self.in_chunks or META in data:
            return None
        found = _CHUNK.findall(b" " + data) if data else []
        try:
            return [self.memo[c] for c in found]
        except KeyError:
            self.learn([data])
            return [self.memo[c] for c in found]

    def ids(self, data: bytes) -> list[int]:
        parts = self.chunks(data)
        return self.sp.encode(data.decode()) if parts is None else list(chain.from_iterable(p[0] for p in parts))

    def spans(self, data: bytes, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Start and end byte, in the source, of each piece."""
        normal, source = self.normalise(data)
        if self.no_unknown:
            width = self.width[np.fromiter(ids, np.int64, len(ids))]
        else:  # an unknown piece is as long as its surface
            width = np.array([len(p.encode()) for p in self.sp.encode(data.decode(), out_type=str)], np.int64)
        ends = np.cumsum(width)
        if len(ends) and ends[-1] != len(normal):
            raise ValueError(f"pieces have {ends[-1]} bytes, the normalised text {len(normal)}")
        return source[ends - width], source[ends]

    def decode(self, ids: list[int]) -> str:
        return self.sp.decode(ids)


@functools.lru_cache(maxsize=4)
def codec(model: bytes) -> Codec:
    return Codec(model)


def model_bytes(path: str) -> bytes:
    """Read by the driver, sent with the tasks: executors need no such file."""
    with open(path, "rb") as f:
        return f.read()


def _batches(docs: DataFrame, model: bytes, schema: pa.Schema, ddl: str, row) -> DataFrame:
    def run(batch):
        c = codec(model)
        texts = as_bytes(batch.column("text"))
        if c.in_chunks:
            c.learn(texts)
        out = {f.name: [] for f in schema}
        out["doc_id"] = batch.column("doc_id")
        for data in texts:
            for k, v in row(c, data).items():
                out[k].append(v)
        return out

    small_batches(docs.sparkSession, 256)
    return docs.mapInArrow(arrow_map(run, schema), ddl)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, starts, ends (bytes of the source text, one of each for every piece)."""

    def row(c, data):
        ids = c.ids(data)
        starts, ends = c.spans(data, ids)
        return {"ids": ids, "starts": starts, "ends": ends}

    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])
    return _batches(documents_of(docs, id_col, text_col), model_bytes(path), schema, "doc_id bigint, ids array<int>, starts array<bigint>, ends array<bigint>", row)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text of lists of ids (null or empty: empty text)."""
    model = model_bytes(path)
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batch):
        return {"doc_id": batch.column("doc_id"), "text": [codec(model).decode(x or []) for x in batch.column("ids").to_pylist()]}

    return encoded.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"`{ids_col}` ids").mapInArrow(arrow_map(run, schema), "doc_id bigint, text string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encoding and decoding without carrying the ids along: doc_id, n_tokens, ids_sha256 (decimals
    joined by commas), decoded_sha256, n_span_bytes (source bytes that the spans cover)."""

    def row(c, data):
        parts = c.chunks(data)
        if parts is None:
            ids = c.ids(data)
            joined = ",".join(map(str, ids)).encode()
        else:
            ids = list(chain.from_iterable([p[0] for p in parts]))
            joined = b",".join([p[1] for p in parts])
        starts, ends = c.spans(data, ids)
        return {
            "n_tokens": len(ids),
            "ids_sha256": hashlib.sha256(joined).hexdigest(),
            "decoded_sha256": hashlib.sha256(c.decode(ids).encode()).hexdigest(),
            "n_span_bytes": int(ends[-1] - starts[0]) if len(ids) else 0,
        }

    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("n_span_bytes", pa.int64())])
    return _batches(documents_of(docs, id_col, text_col), model_bytes(path), schema, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, n_span_bytes bigint", row)
