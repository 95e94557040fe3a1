"""Byte-level BPE with word ends: exact encoding, decoding and token counting, read from a tokenizer's JSON file.

Supported files: NFC, white-space and lower-case normalisers, one split expression, byte-level letters, BPE with an
end-of-word suffix, and special tokens recognised in the raw text. Nothing here calls the library that made the file.

Encoding holds, per pre-token, a contiguous array of parts and one of the ranks of adjacent pairs; it repeatedly scans
for the least rank, deletes that boundary and refreshes the two neighbouring ranks. Pre-tokens of one length that aren't
known yet go through this together, as the rows of two matrices. Pre-tokens of more than ``LONG_PARTS`` parts use a heap
over a linked list instead, with the same result (the scan is quadratic).

Counting takes the whole-token shortcut: it is proved beforehand, by encoding each vocabulary string on its own, which
strings are one token; pre-tokens among them count 1 without merging.

Defined results: null is read as the empty text, which has no tokens and decodes to the empty text.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
import unicodedata
import uuid
from collections import defaultdict
from functools import cache
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BoundedCache, arrow_pass, held, table

LONG_PARTS = 64
#: Entries that a Python worker keeps of pre-tokens it has seen.
CACHE_LIMIT = 400_000
#: Bytes of texts whose pre-tokens are held at once; as objects of their own they take some twenty times as much.
PASS_BYTES = 1_000_000
#: Texts without later code points are split by an expression over these alone, which is faster.
NEAR_END = 0x250
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_NONE = 1 << 60
NO_RANK = np.int32(2**31 - 1)


def byte_letters() -> list[str]:
    """A printable letter for each byte: printable Latin-1 stands for itself, the others follow from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


@cache
def ranges(category: str, end: int) -> str:
    """The code points below ``end`` of a general category, as the inside of a character class."""
    out, start = [], None
    for c in range(end + 1):
        inside = c < end and unicodedata.category(chr(c))[0] == category
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


def split_expression(pattern: str, end: int) -> re.Pattern:
    """The file's split expression with its classes of letters, numbers and white space spelt out."""
    for name, inside in (("\\p{L}", ranges("L", end)), ("\\p{N}", ranges("N", end)), ("\\s", _SPACE)):
        pattern = pattern.replace(name, inside)
    return re.compile(pattern)


class PairTable:
    """Ranks of pairs of ids by open addressing, for whole arrays of pairs at once."""

    def __init__(self, pairs: dict[int, int]):
        bits = max(10, (8 * len(pairs)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NO_RANK, np.int32)
        self.merged = np.zeros(max((v >> 20 for v in pairs.values()), default=0) + 1, np.int32)
        for key, at in zip(pairs, self.slot(np.fromiter(pairs, np.int64, len(pairs))).tolist(), strict=True):
            while self.keys[at] >= 0:
                at = (at + 1) & self.mask
            self.keys[at], self.values[at] = key, pairs[key] >> 20
            self.merged[pairs[key] >> 20] = pairs[key] & 0xFFFFF

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = ((left.astype(np.int64) << 20) | right).ravel()
        at = self.slot(keys)
        there = self.keys[at]
        out = self.values[at]
        away = np.flatnonzero(there != keys)
        out[away] = NO_RANK
        away = away[there[away] >= 0]
        while away.size:  # the few that another pair's slot sends on
            at[away] = (at[away] + 1) & self.mask
            there = self.keys[at[away]]
            same = there == keys[away]
            out[away[same]] = self.values[at[away[same]]]
            away = away[~same & (there >= 0)]
        return out.reshape(left.shape)


class Codec:
    def __init__(self, spec: str, cache_limit: int = CACHE_LIMIT):
        made = json.loads(spec)
        model = made["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        special = {t["content"]: t["id"] for t in made["added_tokens"]}
        self.names = {i: s for s, i in [*self.vocab.items(), *special.items()]}
        #: (left id, right id) packed -> (rank, merged id), as rank << 20 | id
        self.pairs = {}
        for rank, (a, b) in enumerate(x if isinstance(x, list) else x.split(" ") for x in model["merges"]):
            self.pairs.setdefault(self.vocab[a] << 20 | self.vocab[b], rank << 20 | self.vocab[a + b])
        self.letters = byte_letters()
        self.first = [self.vocab[c] for c in self.letters]
        self.last = [self.vocab[c + self.suffix] for c in self.letters]
        steps = made["normalizer"]["normalizers"]
        if [s["type"] for s in steps] != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("only NFC, white space and lower case are known")
        pattern = made["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.near, self.far = split_expression(pattern, NEAR_END), split_expression(pattern, sys.maxunicode + 1)
        self.beyond = re.compile(f"[^\\x00-\\U{NEAR_END - 1:08x}]")
        self.table = PairTable(self.pairs)
        self.special = special
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.word_ids = BoundedCache(lambda w: np.array(self.merge(w), "<u4").tobytes(), cache_limit)
        self.counts = BoundedCache(lambda w: len(self.merge(w)), cache_limit)

    def words(self, normal: str) -> list[str]:
        """The pre-tokens of a normalised text."""
        return (self.near if normal.isascii() or not self.beyond.search(normal) else self.far).findall(normal)

    @staticmethod
    def normal(text: str) -> str:
        if text.isascii():
            return text.lower()
        # lower case by code point: a final sigma isn't special
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def merge(self, word: str) -> list[int]:
        raw = word.encode()
        ids = [self.first[b] for b in raw]
        ids[-1] = self.last[raw[-1]]
        return self._by_scan(ids) if len(ids) <= LONG_PARTS else self._by_heap(ids)

    def _by_scan(self, ids: list[int]) -> list[int]:
        look = self.pairs.get
        ranks = [look(a << 20 | b, _NONE) for a, b in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == _NONE:
                break
            i = ranks.index(best)
            ids[i] = best & 0xFFFFF
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = look(ids[i - 1] << 20 | ids[i], _NONE)
            if i < len(ranks):
                ranks[i] = look(ids[i] << 20 | ids[i + 1], _NONE)
        return ids

    def _by_heap(self, ids: list[int]) -> list[int]:
        look, n = self.pairs.get, len(ids)
        after, before, heap = [*range(1, n), -1], [*range(-1, n - 1)], []
        for i in range(n - 1):
            if (r := look(ids[i] << 20 | ids[i + 1], _NONE)) != _NONE:
                heap.append((r >> 20, i, ids[i], ids[i + 1], r & 0xFFFFF))
        heapq.heapify(heap)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = made, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0 and (r := look(ids[left] << 20 | ids[right], _NONE)) != _NONE:
                    heapq.heappush(heap, (r >> 20, left, ids[left], ids[right], r & 0xFFFFF))
        return [i for i in ids if i >= 0]

    def merge_all(self, words: list[str]):
        """(word, number of ids, ids as little-endian bytes) for words not known yet, a length at a time."""
        by_length = defaultdict(list)
        for word in words:
            by_length[len(raw := word.encode())].append((word, raw))
        first, last = np.array(self.first, np.int32), np.array(self.last, np.int32)
        for n, some in by_length.items():
            if n > LONG_PARTS:
                for word, _ in some:
                    ids = self.merge(word)
                    yield word, len(ids), np.array(ids, "<u4").tobytes()
                continue
            raw = np.frombuffer(b"".join(r for _, r in some), np.uint8).reshape(len(some), n)
            ids = first[raw]
            ids[:, -1] = last[raw[:, -1]]
            sizes = self._by_matrix(ids)
            flat, width = ids.astype("<u4").tobytes(), 4 * n
            for k, (word, size) in enumerate(zip((w for w, _ in some), sizes.tolist(), strict=True)):
                yield word, size, flat[k * width : k * width + 4 * size]

    def _by_matrix(self, ids: np.ndarray) -> np.ndarray:
        """Merge each row of ``ids`` in place, as ``_by_scan`` does one word; the number of ids left in each row."""
        rows, n = ids.shape
        sizes = np.full(rows, n)
        if n == 1:
            return sizes
        own, size, home = ids.copy(), sizes.copy(), np.arange(rows)
        ranks = np.full((rows, n), NO_RANK, np.int32)  # the last column stays empty
        ranks[:, :-1] = self.table.ranks(ids[:, :-1], ids[:, 1:])
        cols = np.arange(n, dtype=np.int32)
        while True:
            at = ranks.argmin(1)
            best = ranks[np.arange(len(at)), at]
            over = best == NO_RANK
            if over.any():
                ids[home[over]], sizes[home[over]] = own[over], size[over]
                going = ~over
                own, ranks, size, home, at, best = own[going], ranks[going], size[going], home[going], at[going], best[going]
                if not len(at):
                    return sizes
            line, beyond = np.arange(len(at)), cols >= at[:, None]
            # deletes the boundary after part ``at``: later parts and ranks move up by one
            own[:, 1:-1] = np.where(beyond[:, :-2], own[:, 2:], own[:, 1:-1])
            ranks[:, :-1] = np.where(beyond[:, :-1], ranks[:, 1:], ranks[:, :-1])
            own[line, at] = self.table.merged[best]
            size -= 1
            for side in (at - 1, at):
                ok = np.flatnonzero((side >= 0) & (side < size - 1))
                c = side[ok]
                ranks[ok, c] = self.table.ranks(own[ok, c], own[ok, c + 1])
            ranks[line, size - 1] = NO_RANK

    def pieces(self, text: str) -> list[tuple[int | None, list[str]]]:
        """(special id, []) or (None, pre-tokens) in the order of the text."""
        if self.specials is None or "<|" not in text:
            return [(None, self.words(self.normal(text)))]
        parts = self.specials.split(text)
        return [(self.special[p], []) if k % 2 else (None, self.words(self.normal(p))) for k, p in enumerate(parts)]

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        cut = [self.pieces(t or "") for t in texts]
        get = self._filled(self.word_ids, cut, lambda n, ids: ids)
        return [b"".join(np.uint32(i).astype("<u4").tobytes() if i is not None else b"".join(map(get, w)) for i, w in pieces) for pieces in cut]

    def count_all(self, texts: list[str | None]) -> list[int]:
        """Whole tokens count at once; only the other pre-tokens are merged."""
        cut = [self.pieces(t or "") for t in texts]
        get = self._filled(self.counts, cut, lambda n, ids: n)
        return [sum(1 if i is not None else sum(map(get, w)) for i, w in pieces) for pieces in cut]

    def count(self, text: str | None) -> int:
        return self.count_all([text])[0]

    def _filled(self, known: BoundedCache, cut: list, value):
        """Look-ups for all pre-tokens of ``cut``; ``known`` gets those it lacks."""
        lacking = lambda: set().union(*(filterfalse(known.__contains__, words) for pieces in cut for _, words in pieces))
        new = lacking()
        if known.make_room(len(new), sum(map(len, new))):
            new = lacking()
        known.update((w, value(n, ids)) for w, n, ids in self.merge_all(new))
        return known.__getitem__

    def decode(self, ids: bytes) -> str:
        """The file names no decoder: tokens joined by spaces."""
        return " ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def single_tokens(self) -> list[str]:
        """The strings that, as a pre-token of their own, are proved to encode as exactly one token."""
        back = {c: b for b, c in enumerate(self.letters)}
        proved = []
        for token, i in self.vocab.items():
            if token.endswith(self.suffix) and len(token) > len(self.suffix):
                raw = bytes(back[c] for c in token[: -len(self.suffix)])
                try:
                    word = raw.decode()
                except UnicodeDecodeError:
                    continue
                if self.words(self.normal(word)) == [word] and self.merge(word) == [i]:
                    proved.append(word)
        return proved


def default_spec() -> str:
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        return file.read()


def _codec(sent, name: str) -> Codec:
    """The worker's codec; the vocabulary file came by broadcast (its size is fixed), with the proved words if any."""

    def build() -> Codec:
        spec, proved = sent.value
        codec = Codec(spec)
        codec.counts = BoundedCache(codec.counts._compute, CACHE_LIMIT, dict.fromkeys(proved, 1))
        return codec

    return held(name, build)


def _prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def encode_documents(docs: DataFrame, *, spec: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit), decoded (text)."""
    sent, name = docs.sparkSession.sparkContext.broadcast((spec or default_spec(), [])), uuid.uuid4().hex

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        codec = _codec(sent, name)
        ids = codec.encode_all(part.column(1).to_pylist())
        decoded = [codec.decode(x) for x in ids]
        return pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    return arrow_pass(_prepared(docs, id_col, text_col), run, "doc_id bigint, n_tokens bigint, ids binary, decoded string", 2048, PASS_BYTES)


def count_tokens(docs: DataFrame, *, spec: str | None = None, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit."""
    spec = spec or default_spec()
    sent, name = docs.sparkSession.sparkContext.broadcast((spec, Codec(spec).single_tokens())), uuid.uuid4().hex

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        codec = _codec(sent, name)
        counts = codec.count_all(part.column(2).to_pylist())
        return pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    texts = _prepared(docs, id_col, text_col).select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), "text")
    return arrow_pass(texts, run, "doc_id bigint, n_bytes bigint, n_tokens bigint", 2048, PASS_BYTES).withColumn("over_limit", F.col("n_tokens") > limit)


def count_query(spark, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


def digests(encoded: DataFrame, *, keep_ids: bool = False) -> DataFrame:
    return encoded.select("doc_id", "n_tokens", *(["ids"] if keep_ids else []), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def encode_query(spark, sf_dir: str) -> DataFrame:
    return digests(encode_documents(table(spark, sf_dir, "documents")))
