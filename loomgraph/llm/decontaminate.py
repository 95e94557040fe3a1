"""Benchmark decontamination with one Aho-Corasick automaton.

Benchmark texts are cut into windows of ``width`` consecutive normalised words (an item with fewer words, but
not none, is one window). All windows go into one automaton that scans each normalised document once; matches
are mapped back to word positions and to code-point offsets of the original text.

Words are runs of ASCII letters and digits and of any code point from U+0080, with A-Z lower-cased. That is a
property of bytes, so texts are normalised as UTF-8 without decoding.

Defined results: null and empty texts have no words and no hits; a repeated row is reported as often as it
occurs; an empty benchmark hits nothing; a window that several items contain reports every one of them; an item whose
identifier is null hits like others, but has no identifier to be listed by.

The automaton is broadcast, so its size is checked: windows beyond ``block_bytes`` are dealt by hash over several
automata, each within the bound, and the hits of the passes are united per document. It holds a number for each window; the
items of the windows that were hit are joined afterwards, so a window of very many items weighs no more than another.
"""

from __future__ import annotations

import re
import uuid

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_pass, as_bytes, held, in_arrow, materialise, slices, table

WIDTH = 10
#: Bytes of distinct windows in one automaton; a trie node takes about 40 bytes of memory.
BLOCK_BYTES = 4_000_000

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def windows_of(text: bytes | None, width: int) -> set[bytes]:
    words = words_of(text)
    return {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def build_automaton(windows: list[tuple[str, int]]) -> ahocorasick.Automaton:
    """Numbered windows are latin-1 readings of UTF-8 bytes, padded by spaces: matches fall on word bounds only."""
    automaton = ahocorasick.Automaton()
    for window, number in windows:
        automaton.add_word(f" {window} ", (window.count(" ") + 1, number))
    if len(automaton):
        automaton.make_automaton()
    return automaton


def scan_text(text: bytes | None, automaton: ahocorasick.Automaton) -> tuple[int, list[tuple[int, int]], set]:
    """Number of words, merged runs of hit words [start, end), and the numbers of the windows that occur."""
    words = words_of(text)
    if not words or not len(automaton):
        return len(words), [], set()
    normal = b" " + b" ".join(words) + b" "
    found = list(automaton.iter(normal.decode("latin-1")))
    if not found:
        return len(words), [], set()
    spaces = np.flatnonzero(np.frombuffer(normal, np.uint8) == 32)
    ends = np.searchsorted(spaces, [end for end, _ in found])
    edge, numbers = np.zeros(len(words) + 1, np.int64), set()
    for end, (_, (n, number)) in zip(ends.tolist(), found, strict=True):
        edge[end - n] += 1
        edge[end] -= 1
        numbers.add(number)
    hit = np.diff(np.concatenate(([0], (np.cumsum(edge) > 0).astype(np.int8), [0])))
    return len(words), list(zip(np.flatnonzero(hit == 1).tolist(), np.flatnonzero(hit == -1).tolist(), strict=True)), numbers


def original_spans(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of words as code-point offsets of the original text, end exclusive."""
    where = [m.span() for m in _WORD.finditer(text.lower())]
    points = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
    return [(int(points[where[a][0]]), int(points[where[b - 1][1]])) for a, b in runs]


def _windows(benchmark: DataFrame, item_col: str, text_col: str, width: int) -> tuple[DataFrame, DataFrame]:
    """The distinct windows (w, number) and their items (number, item), both written."""

    def cut(part: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(w.decode("latin-1"), i) for i, t in zip(part.column(0).to_pylist(), as_bytes(part.column(1)), strict=True) for w in windows_of(t, width)]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], ["w", "item"])

    cuts = materialise(arrow_pass(benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")), cut, "w string, item string", 64))
    windows = materialise(cuts.select("w").distinct().withColumn("number", F.monotonically_increasing_id()))
    return windows, materialise(cuts.where("item is not null").distinct().join(windows, "w").select("number", "item"))


_FOUND = "doc_id bigint, text_key bigint, n_words bigint, runs array<struct<start:int,end:int>>, spans array<struct<start:int,end:int>>, windows array<bigint>"
_RUN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _scan(docs: DataFrame, windows: list[tuple[str, int]], only_hits: bool) -> DataFrame:
    sent, name = docs.sparkSession.sparkContext.broadcast(windows), uuid.uuid4().hex

    def scan(part: pa.RecordBatch) -> pa.RecordBatch:
        automaton = held(name, lambda: build_automaton(sent.value))
        texts, rows = as_bytes(part.column(1)), []
        for i, text in enumerate(texts):
            n, runs, numbers = scan_text(text, automaton)
            if runs or not only_hits:
                rows.append((i, n, runs, original_spans(text, runs) if runs else [], sorted(numbers)))
        pick = pa.array([r[0] for r in rows], pa.int64())
        pairs = lambda k: pa.array([[{"start": a, "end": b} for a, b in r[k]] for r in rows], _RUN)
        return pa.RecordBatch.from_arrays(
            [part.column(0).take(pick), part.column(2).take(pick), pa.array([r[1] for r in rows], pa.int64()), pairs(2), pairs(3), pa.array([r[4] for r in rows], pa.list_(pa.int64()))],
            ["doc_id", "text_key", "n_words", "runs", "spans", "windows"],
        )

    return arrow_pass(docs, scan, _FOUND)


def _covered(runs: Column) -> Column:
    return F.aggregate(runs, F.lit(0).cast("bigint"), lambda n, r: n + r["end"] - r["start"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit (words inside any window's occurrence), items (array of item ids
    as strings, sorted), spans (hit runs as offsets of the original text)."""
    windows, items = _windows(benchmark, item_col, item_text_col, width)
    total = windows.agg(F.sum(F.length("w") + 2)).first()[0] or 0
    blocks = -(-total // block_bytes) or 1
    keyed = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    key = ["doc_id", "text_key"]
    if blocks == 1:
        found = materialise(_scan(keyed, _of_block(windows, 0, 1), only_hits=False))
        base = found.select(*key, "n_words", _covered(F.col("runs")).alias("n_hit"), "spans")
        hit = found.where(F.size("windows") > 0).select(*key, "windows").dropDuplicates(key)
    else:
        hits = None
        for block in range(blocks):
            one = _scan(keyed, _of_block(windows, block, blocks), only_hits=True).dropDuplicates(key)
            hits = one if hits is None else hits.unionByName(one)
        positions = lambda c: F.flatten(F.collect_list(F.flatten(F.transform(c, lambda r: F.sequence(r["start"], r["end"] - 1)))))
        united = materialise(hits.groupBy(*key).agg(
            F.size(F.array_distinct(positions(F.col("runs")))).cast("bigint").alias("n_hit"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"), F.flatten(F.collect_list("windows")).alias("windows"),
        ))
        words = _scan(keyed, [], only_hits=False).select(*key, "n_words")
        base = words.alias("b").join(united.alias("u"), _same(key), "left").select("b.doc_id", "b.text_key", "n_words", F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"), F.coalesce("spans", F.expr("array()").cast("array<struct<start:int,end:int>>")).alias("spans"))
        hit = united.select(*key, "windows")
    listed = hit.select(*key, F.explode("windows").alias("number")).join(items, "number").groupBy(*key).agg(F.array_sort(F.collect_set("item")).alias("items"))
    # documents that nothing hits needn't move
    told = base.where("n_hit > 0").alias("b").join(listed.alias("u"), _same(key), "left").select("b.doc_id", "n_words", "n_hit", F.coalesce("items", F.expr("array()").cast("array<string>")).alias("items"), "spans")
    return told.unionByName(base.where("n_hit = 0").select("doc_id", "n_words", "n_hit", F.expr("array()").cast("array<string>").alias("items"), "spans"))


def _of_block(windows: DataFrame, block: int, blocks: int) -> list[tuple[str, int]]:
    """The windows of one automaton, within its bound."""
    return [(r["w"], r["number"]) for r in windows.where(F.pmod(F.xxhash64("w"), F.lit(blocks)) == block).collect()]


def _same(key: list[str]) -> Column:
    a, b = key
    return F.col(f"b.{a}").eqNullSafe(F.col(f"u.{a}")) & (F.col(f"b.{b}") == F.col(f"u.{b}"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, whole, in whose text no window occurs. Windows beyond one automaton's bound go through it in
    turn; each pass keeps what the ones before kept."""
    windows, _ = _windows(benchmark, item_col, item_text_col, width)
    total = windows.agg(F.sum(F.length("w") + 2)).first()[0] or 0
    blocks, at = -(-total // block_bytes) or 1, docs.columns.index(text_col)
    for block in range(blocks):
        docs = in_arrow(docs, _keeper(docs, _of_block(windows, block, blocks), at), docs.schema)
    return docs


def _keeper(docs: DataFrame, windows: list, at: int):
    sent, name = docs.sparkSession.sparkContext.broadcast(windows), uuid.uuid4().hex

    def run(batches):
        automaton = held(name, lambda: build_automaton(sent.value))
        for part in slices(batches):
            yield part.filter(pa.array([not scan_text(t, automaton)[1] for t in as_bytes(part.column(at))], pa.bool_()))

    return run


def query(spark, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


_WORDS_SQL = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
with d as (select doc_id, coalesce({_WORDS_SQL}, []) w from documents),
b as (select item_id, {_WORDS_SQL} w from benchmark where text is not null),
bw as (select distinct item_id, least(len(w), 10) n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') win
       from (select item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) i from b where len(w) > 0)),
sizes as (select distinct n from bw),
dw as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') win
       from (select doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) i from d, sizes where len(w) >= n)),
hits as (select doc_id, item_id, i, n from dw join bw using (n, win)),
hw as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(generate_series(i, i + n - 1)) p from hits) group by doc_id),
it as (select doc_id, count(*) n_items, string_agg(s, ',' order by s) ids from (select distinct doc_id, item_id::varchar s from hits) group by doc_id)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
       sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join hw using (doc_id) left join it using (doc_id)
"""
