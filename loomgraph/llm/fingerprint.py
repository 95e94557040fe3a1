"""Document fingerprints as quartile bucket digests.

Byte triplets inside a sliding window of five bytes are hashed into ``BUCKETS`` counters; each counter is encoded by the
quartile of the counts it falls into (two bits), with a byte for the logarithm of the length in front. Two digests are
compared by a bounded difference: the sum of differences of quartiles and of lengths, over the largest that digests with
these quartiles could have; likeness is 1 less that.

The query compares each text with an edited one that borrows from the next document in ascending doc_id. Rows are dealt
by ranges of (doc_id, hash of the text, row), so a repeated doc_id is spread over ranges, and each range is a stream of
neighbours. A range's first and last rows are told apart, and each last one meets the next range's first in a join of one
row a range. Text is shuffled once.

Defined results: null is the empty text, whose digest has length 0 and empty buckets; two empty digests are alike by 1;
a null doc_id comes first; rows of one doc_id follow each other by a hash of their text; a single row is its own next.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_arrow, materialise, slices, table

BUCKETS = 256
#: Positions of the second and third byte of a triplet after its first.
SHAPES = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))
_SEEDS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def bucket_counts(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    counts = np.zeros(BUCKETS, np.int64)
    first, second, third = (_MIXED[k][raw] for k in range(3))
    for k, (b, c) in enumerate(SHAPES):
        if raw.size > c:
            n = raw.size - c
            h = first[:n] ^ second[b : b + n] ^ third[c : c + n] ^ _SALT[k]
            counts += np.bincount(h, minlength=BUCKETS)
    return counts


def _mixed() -> tuple[np.ndarray, np.ndarray]:
    """A random byte for each byte value at each place of a triplet, from a multiplicative hash (tabulation hashing)."""
    x = np.arange(256, dtype=np.uint32) + np.uint32(1)
    tables = []
    for seed in _SEEDS:
        h = x * seed
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(12)
        h *= np.uint32(0x297A2D39)
        tables.append((h >> np.uint32(20) & np.uint32(BUCKETS - 1)).astype(np.uint8))
    return np.stack(tables), np.array([(k * 0x9D + 0x3B) & (BUCKETS - 1) for k in range(len(SHAPES))], np.uint8)


_MIXED, _SALT = _mixed()


def length_code(n: int) -> int:
    return min(255, int(round(16 * np.log2(n + 1)))) if n else 0


def digest(data: bytes) -> bytes:
    """The length's code, then the quartiles of the buckets, one a byte."""
    counts = bucket_counts(data)
    order = np.sort(counts)
    quarter = BUCKETS // 4
    q = [order[quarter * k - 1] for k in (1, 2, 3)]
    codes = (counts > q[0]).astype(np.uint8) + (counts > q[1]) + (counts > q[2])
    return bytes([length_code(len(data))]) + codes.astype(np.uint8).tobytes()


def to_text(codes: bytes) -> str:
    """Hexadecimal, four buckets a byte."""
    q = np.frombuffer(codes, np.uint8)[1:].reshape(-1, 4)
    return codes[:1].hex() + (q[:, 0] << 6 | q[:, 1] << 4 | q[:, 2] << 2 | q[:, 3]).astype(np.uint8).tobytes().hex()


def likeness(a: bytes, b: bytes) -> float:
    if a == b:
        return 1.0
    x, y = np.frombuffer(a, np.uint8).astype(np.int32), np.frombuffer(b, np.uint8).astype(np.int32)
    length = min(48, abs(int(x[0]) - int(y[0])))
    apart = np.abs(x[1:] - y[1:]).sum() + length
    return float(1 - apart / (np.maximum(x[1:], y[1:]).sum() + length))


def edit(text: str, following: str) -> str:
    n = len(text) // 4
    return text[: len(text) - n] + following[:n] if n else text


_OUT = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
#: The first and the last row of a partition, whose neighbours are in others.
_EDGE = [("part", pa.int32()), ("is_last", pa.bool_()), ("edge_id", pa.int64()), ("text", pa.string())]
_EDGE_SQL = "part int, is_last boolean, edge_id bigint, text string"
_OUT_SQL = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id and its fingerprint. Equal texts have equal fingerprints."""

    def run(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([to_text(digest((t or "").encode())) for t in batch.column(1).to_pylist()], pa.string())], ["doc_id", "fingerprint"])

    chosen = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return in_arrow(chosen, run, "doc_id bigint, fingerprint string")


def query(spark, sf_dir: str) -> DataFrame:
    return compare_with_next(table(spark, sf_dir, "documents"))


def compare_with_next(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its digest, that of its edited text, and their likeness and the next document's."""
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(1 << 63)).cast("bigint")).alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # rows that are equal in id and text may lie in several ranges: which of them is where makes no difference
    order = ["key", "tie", "row"]
    dealt = texts.withColumn("tie", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches):
        held = None  # the row that waits for its next one: doc_id, text, its digest
        part = TaskContext.get().partitionId()
        for batch in slices(batches):
            rows, edges = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = digest(text.encode())
                if held is None:
                    edges.append((part, False, doc_id, text))
                else:
                    rows.append(_row(*held, text, own))
                held = doc_id, text, own
            yield _batch(rows, edges)
        if held is not None:
            yield _batch([], [(part, True, held[0], held[1])])

    found = materialise(in_arrow(dealt, run, f"{_OUT_SQL}, {_EDGE_SQL}"))
    edges = found.where("part is not null").select("part", "is_last", F.col("edge_id").alias("doc_id"), "text")
    # one row a partition
    firsts = edges.where("not is_last").select("part", F.col("text").alias("next_text"))
    ends = edges.where("is_last").select("part", "doc_id", "text")
    turn = firsts.select("part", F.lead("part").over(Window.orderBy("part")).alias("then"), F.first("part").over(Window.orderBy("part")).alias("very_first")).select(F.col("part"), F.coalesce("then", "very_first").alias("then"))
    met = ends.join(turn, "part").join(firsts.withColumnRenamed("part", "then"), "then").select("doc_id", "text", "next_text")

    def close(batches):
        for batch in slices(batches, 64):
            yield _batch([_row(i, t, digest(t.encode()), n, digest(n.encode())) for i, t, n in zip(*(c.to_pylist() for c in batch.columns), strict=True)], []).select([c for c, _ in _OUT])

    columns = [c for c, _ in _OUT]
    return found.where("part is null").select(*columns).unionByName(in_arrow(met, close, _OUT_SQL))


def _row(doc_id: int, text: str, codes: bytes, following: str, next_codes: bytes) -> tuple:
    edited = edit(text, following).encode()
    other = digest(edited)
    return doc_id, len(text), hashlib.sha256(edited).hexdigest(), to_text(codes), to_text(other), likeness(codes, other), likeness(codes, next_codes)


def _batch(rows: list[tuple], edges: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array([r[k] for r in rows] + [None] * len(edges), t) for k, (_, t) in enumerate(_OUT)]
    columns += [pa.array([None] * len(rows) + [e[k] for e in edges], t) for k, (_, t) in enumerate(_EDGE)]
    return pa.RecordBatch.from_arrays(columns, [c for c, _ in _OUT + _EDGE])
