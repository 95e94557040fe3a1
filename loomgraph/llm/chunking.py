"""Substring dedup by content-defined chunking with a gear rolling hash.

A gear hash over the last ``WINDOW`` bytes marks about one position in 2**``BITS``; a chunk ends at a marked position that
has no other within ``APART`` bytes before it, and after ``longest`` bytes at the latest. Both rules look at nearby bytes only, so
chunks resist shifts: some bytes after an insertion the cuts are the same again. Chunks end between code points.

Chunks are told apart by 128-bit digests. Digests are counted with partial sums before the shuffle; chunks meet the
repeated ones in a join that adaptive execution can split, so a chunk that a third of the documents share does not land in one
task. The first occurrence, in ascending doc_id, is the one that stays; runs of adjacent repeated chunks become spans, those
of less than ``least`` bytes are left alone. Only a document's own chunks are brought together, never a chunk's documents.

Defined results: null and empty texts have no chunks and no spans; a null doc_id comes before all others; repeats inside
one text count like those across texts; of rows with one doc_id the one that is read first is the first; other columns are not read.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_pass, as_bytes, materialise, table

WINDOW, BITS, APART, LONGEST = 16, 5, 16, 512
#: Bytes of a repeated run that counts.
LEAST = 48
_LOWEST = -(1 << 63)


def _gear() -> np.ndarray:
    """A random 32-bit number for each byte value, by a multiplicative mixer."""
    x = (np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)).astype(np.uint32)


_GEAR = _gear()


def gear_hashes(raw: np.ndarray) -> np.ndarray:
    """At each byte, the sum of its window's gear values, each shifted by its distance; windows double in each step."""
    h, width = _GEAR[raw], 1
    while width < WINDOW:
        longer = h.copy()
        longer[width:] += h[:-width] << np.uint32(width)
        h, width = longer, 2 * width
    return h


def cuts(data: bytes, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the chunks of ``data`` in bytes and in code points, each with 0 in front."""
    raw = np.frombuffer(data, np.uint8)
    starts = np.append((raw & 0xC0) != 0x80, True)  # where a code point may start, or the end
    marked = np.flatnonzero(gear_hashes(raw) >> np.uint32(32 - BITS) == 0) + 1
    if marked.size:
        marked = marked[np.diff(marked, prepend=-APART) >= APART]
    ends = np.unique(np.concatenate(([0], marked[starts[marked]], [raw.size])))
    wide = np.flatnonzero(np.diff(ends) > longest)
    if wide.size:
        at = np.flatnonzero(starts)
        forced = np.concatenate([np.arange(ends[k] + longest, ends[k + 1], longest) for k in wide])
        ends = np.unique(np.concatenate((ends, at[np.searchsorted(at, forced)])))
    return ends, np.concatenate(([0], np.cumsum(starts[:-1])))[ends]


_CHUNKS = [("hi", pa.int64()), ("lo", pa.int64()), ("doc_id", pa.int64()), ("row", pa.int64()), ("k", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("n_bytes", pa.int32())]
_CHUNKS_SQL = "hi bigint, lo bigint, doc_id bigint, row bigint, k int, start int, end int, n_bytes int"


def chunks(rows: DataFrame, longest: int = LONGEST) -> DataFrame:
    """One row per chunk of ``rows`` (doc_id, row, text): its digest and place."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        digests, docs, counts, bounds, sizes = [], [], [], [], []
        for k, data in enumerate(as_bytes(part.column(2))):
            if not data:
                continue
            at, chars = cuts(data, longest)
            digests.extend(xxhash.xxh3_128_digest(data[a:b]) for a, b in pairwise(at.tolist()))
            docs.append(k)
            counts.append(at.size - 1)
            bounds.append(np.stack((chars[:-1], chars[1:])))
            sizes.append(np.diff(at))
        counts = np.array(counts, np.int64)
        of = pa.array(np.repeat(np.array(docs, np.int64), counts))
        halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
        places = np.concatenate(bounds, axis=1).astype(np.int32) if bounds else np.empty((2, 0), np.int32)
        order = np.concatenate([np.arange(n) for n in counts]).astype(np.int32) if len(counts) else np.empty(0, np.int32)
        widths = np.concatenate(sizes).astype(np.int32) if sizes else np.empty(0, np.int32)
        columns = [pa.array(halves[:, 0]), pa.array(halves[:, 1]), part.column(0).take(of), part.column(1).take(of), pa.array(order), pa.array(places[0]), pa.array(places[1]), pa.array(widths)]
        return pa.RecordBatch.from_arrays(columns, [c for c, _ in _CHUNKS])

    return arrow_pass(rows.select("doc_id", "row", "text"), run, _CHUNKS_SQL, 256)


def _spans(rows: DataFrame, least: int, longest: int) -> DataFrame:
    """Spans of ``rows``, which have a column ``row`` that stays the same when they are read again."""
    cut = materialise(chunks(rows, longest))
    place = F.struct(F.coalesce("doc_id", F.lit(_LOWEST).cast("bigint")).alias("doc"), "row", "k")
    repeated = cut.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n_copies"), F.min(place).alias("first")).where("n_copies > 1")
    found = cut.join(repeated, ["hi", "lo"]).withColumn("dropped", (F.col("row") != F.col("first.row")) | (F.col("k") != F.col("first.k")))
    here = Window.partitionBy("row").orderBy("k")
    breaks = F.coalesce(F.col("k") - F.lag("k").over(here) != 1, F.lit(True))
    turns = F.coalesce(F.col("dropped") != F.lag("dropped").over(here), F.lit(True))
    runs = found.withColumn("breaks", breaks.cast("int")).withColumn("turns", (breaks | turns).cast("int")).withColumn("run", F.sum("breaks").over(here)).withColumn("piece", F.sum("turns").over(here)).withColumn("whole", F.sum("n_bytes").over(Window.partitionBy("row", "run"))).where(F.col("whole") >= least)
    return runs.groupBy("row", "piece").agg(
        F.first("doc_id").alias("doc_id"), F.min("start").cast("bigint").alias("start"), F.max("end").cast("bigint").alias("end"), F.sum("n_bytes").alias("n_bytes"),
        F.count(F.lit(1)).alias("n_chunks"), F.max("n_copies").alias("n_copies"), F.first("dropped").alias("dropped"),
    ).drop("piece")


def repeated_spans(docs: DataFrame, *, least: int = LEAST, longest: int = LONGEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per repeated span of a text: doc_id, start and end (code points, end exclusive), n_bytes, n_chunks, n_copies
    (of its most frequent chunk) and dropped, false for first occurrences. A document without repeats has no row."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).cast("string").alias("text"))
    return _spans(rows, least, longest).drop("row")


def remove_repeats(docs: DataFrame, *, least: int = LEAST, longest: int = LONGEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all spans but first occurrences cut from their texts; every row and column stays."""
    held = materialise(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")))
    rows = held.select(F.col(f"doc.{id_col}").cast("bigint").alias("doc_id"), "row", F.col(f"doc.{text_col}").cast("string").alias("text"))
    gone = _spans(rows, least, longest).where("dropped").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("gone"))
    text = F.col(f"doc.{text_col}").cast("string")
    last = F.lit(0).cast("bigint")
    pieces = F.aggregate("gone", F.struct(F.lit("").alias("made"), last.alias("at")), lambda a, s: F.struct(F.concat(a["made"], F.substring(text, a["at"] + 1, s["start"] - a["at"])).alias("made"), s["end"].alias("at")))
    kept = F.when(F.col("gone").isNull(), text).otherwise(F.concat(pieces["made"], F.substring(text, pieces["at"] + 1, F.length(text))))
    return held.join(gone, "row", "left").select(*(kept.alias(c) if c == text_col else F.col(f"doc.`{c}`").alias(c) for c in docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents"))
