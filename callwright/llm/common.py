"""Helpers that several operators of this subpackage share.

Rows are identified by (doc id, hash of the text).  A null id reads as ``NO_ID``: it is larger
than every other id, and all rows without an id count as one document.
"""
from __future__ import annotations

import functools
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

NO_ID = 2**63 - 1
#: Documents in one Arrow batch: bounds the memory of a Python worker when texts are long.
BATCH_ROWS = 512
#: Words kept in a worker's memo before it starts afresh.
MEMO_WORDS = 400_000


def documents_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, as ``doc_id`` and ``text``: no other column can clash."""
    return df.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def keyed(docs: DataFrame) -> DataFrame:
    """Adds the row key: ``did`` (id, never null) and ``th`` (hash of the text, never null)."""
    return docs.withColumn("did", F.coalesce("doc_id", F.lit(NO_ID))).withColumn("th", F.xxhash64("text"))


def own_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` as own_0, own_1... (no clash with working columns) and ``did``, ``th``, ``text``."""
    names = docs.columns
    own = docs.toDF(*[f"own_{i}" for i in range(len(names))])
    did, text = (F.col(f"own_{names.index(c)}") for c in (id_col, text_col))
    rows = own.select("*", did.cast("bigint").alias("doc_id"), text.cast("string").alias("text"))
    return keyed(rows).drop("doc_id")


def own_back(rows: DataFrame, docs: DataFrame, text_col: str | None = None, n_chars_col: str = "n_chars") -> DataFrame:
    """The columns of ``docs`` again; with ``text_col`` that one is ``kept``, and a column of its length
    follows."""
    out = []
    for i, n in enumerate(docs.columns):
        c = F.col(f"own_{i}")
        if n == text_col:
            c = F.col("kept")
        elif text_col and n == n_chars_col:
            c = F.char_length("kept").cast(docs.schema[n].dataType)
        out.append(c.alias(n))
    return rows.select(*out)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Arrow batches of at most ``rows`` rows, unless the session asks for fewer."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once to the shared checkpoint folder and reads it back: cuts the lineage and
    survives the loss of executors.  The schema is kept, so an empty table reads back as well."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def carried(rows: DataFrame, prefix: str = "own_") -> tuple[tuple[str, ...], str]:
    """Names and DDL of the columns with the prefix."""
    fields = [f for f in rows.schema.fields if f.name.startswith(prefix)]
    return tuple(f.name for f in fields), "".join(f"{f.name} {f.dataType.simpleString()}, " for f in fields)


# ---------------------------------------------------------------- words and windows (numpy)

_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xC2B2AE3D27D4EB4F)
_memo: dict[bytes, int] = {}


def as_bytes(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes, null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words; each distinct word is hashed once while the memo holds it."""
    if len(_memo) > MEMO_WORDS:
        _memo.clear()
    try:
        return np.fromiter(map(_memo.__getitem__, words), np.uint64, len(words))
    except KeyError:
        for w in set(words):
            if w not in _memo:
                _memo[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(_memo.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * _A
    return x ^ (x >> np.uint64(29))


def windows(one: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` words from each start, by doubling: a window of twice the length is
    the pair of its halves, one of any other length two overlapping windows of a power of two."""
    if len(one) < length:
        return np.empty(0, np.uint64)
    have, h = 1, one
    while have * 2 <= length:
        h = mix(h[: len(h) - have] * _B + mix(h[have:]) + np.uint64(have))
        have *= 2
    if have < length:
        gap = length - have
        h = mix(h[: len(h) - gap] * _B + mix(h[gap:]) + np.uint64(length))
    return h


def arrow_map(function, schema: pa.Schema, carry: tuple[str, ...] = ()):
    """``function(batch) -> dict of columns`` as a mapInArrow function; ``carry``: columns of the input
    that come first, as they are."""

    @functools.wraps(function)
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                out = function(batch)
                made = [pa.array(out[f.name], f.type) for f in schema]
                yield pa.RecordBatch.from_arrays([*map(batch.column, carry), *made], names=[*carry, *schema.names])

    return run
