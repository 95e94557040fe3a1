"""Exact Jaccard join of documents' word n-gram sets, by set-relation skipping.

Index. A set's hashed shingles, in hash order, are cut into segments by ranges of the hash space. Two sets within the
threshold differ in at most K shingles (K follows from their sizes), and each differing shingle touches one segment, so of
K + 1 + m segments at least m + 1 are the same in both. Sets of one band of sizes are therefore indexed by the content of
their segments, and again with the next band where a partner may be there. An index list holds the sets that share a
segment; single common shingles (a licence line, a frequent passage) don't make long lists, as a whole segment must agree.
A set with more than m empty segments goes through another salt of the hash, in which any such partner meets it too.

Skipping by position. Lists are sorted by place: a set's size, the shingles before the segment, those inside. Postings of
equal place form a block, and pairs of blocks, not of postings, are tested: where min(before) + min(inside) + min(after)
stays below the overlap that the threshold asks for, both blocks' postings are skipped for each other as a whole. Lists of
a few sets propose the pairs of the blocks that are left.

Deriving answers. Partners share many lists, so each set leaves as many of its longest lists as it can spare. In a list
that is still long no pairs are formed. Every set x is compared with one member only, the hub of most lists, and stands from
then on for what it differs by from the hub's group: the shingles added to and removed from the pivot, the hub corrected
by what most of the group has otherwise. As |x ^ y| is the difference of these differences, the answers of x follow from
them alone. Sets whose differences together don't exceed K are all linked with the one of the least excess; any other
partners share one of the first K + 1 differences, added ones first, by the prefix bound. So the differences (hub, shingle)
make the next lists, each of half the group at most (from the second round on a group is one list, so rounds are few), and the same two kinds of skipping go on in them: a block there is an
equal (size, added, removed, position), and removed shingles, which are the frequent ones, are only listed for blocks that
could have a partner without a common added shingle. Lists that are long once more get a hub of their own. What is already
in one component needs no further comparison.

Candidates that are left go past parity sketches (a bit for each residue of the hashes, flipped by each shingle; sketches
differ in no more bits than sets in shingles) before sets are moved and compared by their full 64-bit hashes.

Exact copies share one set, told apart by 98 bits of two hashes of it (64 are the key; if two sets ever had one key all is
done again with other hashes), and are never expanded. No list, group or component is held by one task: lists are streamed
in sorted order, and groups only meet through joins that adaptive execution can split.

Defined results: texts without words and null texts have empty sets, linked with nothing; a text of fewer than ``width``
words is one shingle; rows of one doc_id are rows like others; a null doc_id stays its own component if it is alone.
"""

from __future__ import annotations

import uuid
from functools import lru_cache
from itertools import count
from math import exp, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BoundedCache, as_bytes, drop, forget, in_arrow, materialise, scratch, shared_dir, slices, table

#: Sets of a list whose blocks are paired: of segments, and of differences, whose pairs are nearly all refuted in place.
SMALL_LIST, SMALL_DIFFERENCE_LIST = 6, 64
SALTS = 8
CACHE_LIMIT = 400_000
SIZE_BITS = 28
#: Set ids that a task remembers, so as to index copies once.
SEEN_LIMIT = 200_000
#: Edges that a task joins up at a time.
FOREST_EDGES = 150_000
#: 64-bit words of the Bloom filter that preselects rows for the second reading; its size is fixed.
BLOOM_WORDS = 1 << 17
#: So many ids of documents that go are broadcast at most; beyond, both sides of that join are shuffled.
BROADCAST_IDS = 1 << 20
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_SHIFT, _HALF = np.uint64(33), np.uint64(32)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> _SHIFT)) * _M1
    x = (x ^ (x >> _SHIFT)) * _M2
    return x ^ (x >> _SHIFT)


class Shingler:
    def __init__(self, width: int, seed: int = 0):
        self.width = width
        self.words = BoundedCache(lambda w: xxhash.xxh3_64_intdigest(w, seed), CACHE_LIMIT)

    def __call__(self, text: bytes | None) -> np.ndarray:
        """The distinct shingles' hashes, sorted."""
        words = text.lower().split() if text else []
        if not words:
            return np.empty(0, np.uint64)
        h = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        width = min(self.width, len(words))
        n = len(words) - width + 1
        out = np.full(n, width, np.uint64)
        for k in range(width):
            out = mixed(out * _ODD[k % len(_ODD)] + h[k : k + n])
        return np.unique(out)


def set_id(shingles: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes()))))


def check(shingles: np.ndarray) -> int:
    """Another 34 bits of hash, packed with the set's size."""
    return (xxhash.xxh3_64_intdigest(shingles.tobytes(), 1) & (1 << 34) - 1) << SIZE_BITS | shingles.size


@lru_cache(maxsize=None)
def bands(num: int, den: int, top: int) -> list[int]:
    """Lower bounds of the bands of sizes, until one is over ``top``; the next band's is over 1/t times a band's sizes."""
    out = [1]
    while out[-1] <= top:
        out.append(out[-1] * den * den // (num * num) + 1)
    return out


def spare_segments(segments: int, least: float) -> int:
    """So many that hardly a set of ``least`` shingles or more leaves more segments empty."""
    spare = 0
    for _ in range(3):
        empty = (segments + spare) * exp(-least / (segments + spare))
        spare = int(empty + 3 * sqrt(empty)) + 2
    return spare


@lru_cache(maxsize=1 << 16)
def schemes(n: int, num: int, den: int) -> tuple[tuple[int, int, int], ...]:
    """(band, segments, m) of every index that a set of ``n`` shingles takes part in."""
    low = bands(num, den, 1 << max(1, n.bit_length() + 2))
    own = next(i for i in range(len(low)) if low[i + 1] > n)
    out = []
    for band in (own, own + 1):
        if band > own and n * den < num * low[band]:
            continue
        differing = 2 * (low[band + 1] - 1) * (den - num) // (den + num)
        # the least sets only link with equal ones: with one shingle more or less they miss the threshold
        if differing and (n * den >= num * (n + 1) or (band == own and (n - 1) * den >= num * n)):
            spare = min(spare_segments(differing + 1, low[band] * num / den), differing)
            out.append((band, differing + 1 + spare, spare))
    return tuple(out)


BAND = np.uint64(255)
#: A place that tells nothing: of a set too large to pack, or of the list of sets that all salts left too empty.
NOWHERE = -1


def packed_places(n: int, before: np.ndarray, inside: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Size, shingles before the segment and inside it, and how many lists of the band the set shares at least with any
    partner."""
    if n >= 1 << 20:
        return np.full(before.size, NOWHERE)
    return np.where(inside < 1 << 11, n << 42 | before << 22 | inside << 11 | np.minimum(shared, (1 << 11) - 1), NOWHERE)


def postings(shingles: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a set's segments (the band in their low bits) and its places in their lists."""
    n, keys, places = len(shingles), [], []
    low = bands(num, den, 1 << max(1, n.bit_length() + 2))
    for band, segments, spare in schemes(n, num, den) if n else ():
        for salt in range(SALTS + 1):
            if salt == SALTS:  # all salts left too much empty: one list of all such sets
                keys.append(mixed(np.array([band << 8 | 0xFF], np.uint64)))
                places.append(np.array([NOWHERE]))
                break
            values = shingles if salt == 0 else np.sort(mixed(shingles + np.uint64(salt * int(_ODD[0]) % (1 << 64))))
            segment = ((values >> _HALF) * np.uint64(segments)) >> _HALF
            starts = np.searchsorted(segment, np.arange(segments, dtype=np.uint64))
            ends = np.append(starts[1:], n)
            full = np.flatnonzero(ends > starts)
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(values ^ _ODD[1]))))
            content = sums[ends[full]] - sums[starts[full]]
            key = mixed(content + mixed(full.astype(np.uint64) + np.uint64(band << 40 | salt << 32)))
            keys.append(key & ~BAND | np.uint64(band & 255))
            # every differing shingle spoils one segment at most; through salts a partner may be met in one list only
            largest = min(n * den // num, low[band + 1] - 1)
            shared = max(1, full.size - (n + largest) * (den - num) // (den + num)) if salt == 0 and segments - full.size <= spare else 1
            places.append(packed_places(n, starts[full], (ends - starts)[full], np.full(full.size, shared)))
            if segments - full.size <= spare:
                break
    if not keys:
        return (np.empty(0, np.int64),) * 2
    return np.concatenate(keys).view(np.int64), np.concatenate(places).astype(np.int64)


def may_link(a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sets with these places in one list can reach the threshold."""
    wide, narrow = (1 << 20) - 1, (1 << 11) - 1
    (na, pa_, la), (nb, pb, lb) = ((x >> 42, x >> 22 & wide, x >> 11 & narrow) for x in (a, b))
    common = np.minimum(pa_, pb) + np.minimum(la, lb) + np.minimum(na - pa_ - la, nb - pb - lb)
    return (a < 0) | (b < 0) | (common * (den + num) >= num * (na + nb))


def may_link_apart(a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sets with these differences from one hub (size, added, removed), whose first common difference is at these
    places in their order, can reach the threshold, other than by differing little from the pivot both."""
    wide = (1 << 20) - 1
    (na, xa, ra), (nb, xb, rb) = ((x >> 40, x >> 20 & wide, x & wide) for x in (a, b))
    da, db = xa + ra, xb + rb
    least = np.maximum(da + db - 2 * np.minimum(da - at_a, db - at_b), np.abs(xa - xb) + np.abs(ra - rb))
    room = (den - num) * (na + nb)
    return (a < 0) | (b < 0) | ((least * (den + num) <= room) & ((da + db) * (den + num) > room))


class ListReader:
    """Reads postings sorted by (key, place, spot, set), each with its set's root, in batches that may cut lists. Gives the pairs of lists of up to
    ``small`` sets, by blocks of equal (place, spot), and the members of longer ones."""

    def __init__(self, small: int, may):
        self.small, self.may, self.rest, self.going, self.last = small, may, None, None, None

    def read(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of rows [key, place, spot, set, root]: pairs [x, y] of different roots and members [list, set, place]."""
        if self.rest is not None:
            rows = np.concatenate((self.rest, rows), 1)
        new = np.concatenate(([True], (rows[:, 1:] != rows[:, :-1]).any(0)))
        if self.rest is None and self.last is not None:
            new[0] = (rows[:, 0] != self.last).any()
        self.last, self.rest = rows[:, -1].copy(), None
        rows, members = rows[:, new], []
        if self.going is not None and rows.shape[1]:  # the long list of the batch before goes on
            n = int(np.searchsorted(rows[0] != self.going, True))
            members.append(rows[:, :n])
            rows = rows[:, n:]
            if rows.shape[1]:
                self.going = None
        if not rows.shape[1]:
            return np.empty((2, 0), np.int64), self._members(members)
        tail = int(np.flatnonzero(np.concatenate(([True], rows[0, 1:] != rows[0, :-1])))[-1])
        pairs, more = self._closed(rows[:, :tail])
        members += more
        if rows.shape[1] - tail > self.small:
            self.going = rows[0, -1]
            members.append(rows[:, tail:])
        else:
            self.rest = rows[:, tail:]
        return pairs, self._members(members)

    def finish(self) -> tuple[np.ndarray, np.ndarray]:
        rows, self.rest = self.rest if self.rest is not None else np.empty((4, 0), np.int64), None
        pairs, members = self._closed(rows)
        return pairs, self._members(members)

    @staticmethod
    def _members(parts: list[np.ndarray]) -> np.ndarray:
        return np.concatenate([p[[0, 3, 1]] for p in parts], 1) if parts else np.empty((3, 0), np.int64)

    def _closed(self, rows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Rows of whole lists."""
        start = np.flatnonzero(np.concatenate(([True], rows[0, 1:] != rows[0, :-1]))) if rows.shape[1] else np.empty(0, np.int64)
        size = np.diff(np.append(start, rows.shape[1]))
        small = np.repeat((size > 1) & (size <= self.small), size)
        long = np.repeat(size > self.small, size)
        return self._pairs(rows[:, small]), [rows[:, long]] if long.any() else []

    def _pairs(self, rows: np.ndarray) -> np.ndarray:
        if not rows.shape[1]:
            return np.empty((2, 0), np.int64)
        block = np.flatnonzero(np.concatenate(([True], (rows[:3, 1:] != rows[:3, :-1]).any(0))))
        size, key, place, spot = np.diff(np.append(block, rows.shape[1])), *(rows[k, block] for k in range(3))
        out = []
        for gap in range(min(self.small, key.size)):
            a = np.flatnonzero(key[gap:] == key[: len(key) - gap])
            b = a + gap
            able = self.may(place[a], spot[a], place[b], spot[b]) & ((size[a] > 1) | (gap > 0))
            a, b = a[able], b[able]
            if not a.size:
                continue
            # all postings of one block with all of the other, or those of one block with each other
            times = size[a] * size[b]
            of = np.repeat(np.arange(a.size), times)
            k = np.arange(of.size) - np.repeat(np.cumsum(times) - times, times)
            x, y = block[a][of] + k // size[b][of], block[b][of] + k % size[b][of]
            apart = rows[4, x] != rows[4, y]
            apart &= (x < y) | (gap > 0)
            x, y = x[apart], y[apart]
            out.append(np.stack((rows[3, x], rows[3, y])))
        found = np.concatenate(out, 1) if out else np.empty((2, 0), np.int64)
        found = np.stack((found.max(0), found.min(0))) if found.size else found
        return np.unique(found[:, found[0] != found[1]], axis=1)


#: place: of a document, -2 less its set's check value and size; doc_id: of a document only.
_INDEX = "key bigint, set_id bigint, place bigint, doc_id bigint"


def _index(docs: DataFrame, width: int, num: int, den: int, seed: int) -> DataFrame:
    """A row for each document and one for each posting of each set new to the task."""

    def run(batches):
        shingler, seen = Shingler(width, seed), set()
        for part in slices(batches, 512):
            ids, sets, checks, keys, owners, places = part.column(0), [], [], [], [], []
            for text in as_bytes(part.column(1)):
                shingles = shingler(text)
                me = set_id(shingles)
                sets.append(me)
                checks.append(-2 - check(shingles))
                if me not in seen:
                    if len(seen) >= SEEN_LIMIT:
                        seen.clear()
                    seen.add(me)
                    k, p = postings(shingles, num, den)
                    keys.append(k)
                    owners.append(np.full(k.size, me))
                    places.append(p)
            k = np.concatenate(keys) if keys else np.empty(0, np.int64)
            n = len(sets)
            spread = mixed(np.arange(n, dtype=np.uint64) + np.uint64(len(seen) << 20)).view(np.int64)
            columns = (np.concatenate([spread, k]), np.concatenate([np.array(sets, np.int64), *owners]), np.concatenate([np.array(checks, np.int64), *places]))
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.concat_arrays([ids, pa.nulls(k.size, pa.int64())])], ["key", "set_id", "place", "doc_id"])
        forget()

    return in_arrow(docs, run, _INDEX)


#: kind 0: a document (a: doc_id, b: set, c: check value and size); 1: a pair of sets; 2: a set (b) in a long list (a), c: its place.
_FOUND = "kind int, a bigint, b bigint, c bigint"


def _told(pairs: np.ndarray, members: np.ndarray) -> pa.RecordBatch:
    n, m = pairs.shape[1], members.shape[1]
    columns = [np.repeat(np.array([1, 2], np.int32), (n, m)), np.concatenate((pairs[0], members[0])), np.concatenate((pairs[1], members[1])), np.concatenate((np.zeros(n, np.int64), members[2]))]
    return pa.RecordBatch.from_arrays([*map(pa.array, columns)], ["kind", "a", "b", "c"])


def _lists(index: DataFrame, num: int, den: int) -> DataFrame:
    def run(batches):
        reader = ListReader(SMALL_LIST, lambda a, _, b, __: may_link(a, b, num, den))
        for batch in batches:
            key, sets, place = (batch.column(k).to_numpy() for k in range(3))
            doc = place < NOWHERE
            if doc.any():
                ids = batch.column(3).filter(pa.array(doc))
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(ids), np.int32)), ids, pa.array(sets[doc]), pa.array(-2 - place[doc])], ["kind", "a", "b", "c"])
            rows = np.stack((key, place, np.zeros_like(key), sets, sets))[:, ~doc]
            if rows.shape[1]:
                yield _told(*reader.read(rows))
        yield _told(*reader.finish())

    parts = max(1, int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return index.repartition(parts, "key").sortWithinPartitions("key", "place", "set_id").mapInArrow(run, _FOUND)


def _bloom(ids: DataFrame) -> np.ndarray:
    """Bits of two hashes of each id; of a fixed size, and only ever a preselection."""
    bits = F.explode(F.array(F.xxhash64("id"), F.xxhash64("id", F.lit(1))))
    at = ids.select(bits.alias("h")).select(F.pmod("h", F.lit(BLOOM_WORDS * 64)).alias("bit"))
    words = at.groupBy(F.shiftright("bit", 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("bit", F.lit(64)).cast("int"))).alias("v"))
    out = np.zeros(BLOOM_WORDS, np.int64)
    for r in words.toLocalIterator():
        out[r["w"]] = r["v"]
    return out


def sketched(shingles: np.ndarray) -> bytes:
    """A bit for each residue, of 1 to 2 residues a shingle (64 at least), that is the parity of the shingles there."""
    bits = max(64, 1 << int(shingles.size).bit_length())
    parity = np.bincount((mixed(shingles) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8)).tobytes()


def sketch_distance(a: bytes, b: bytes) -> int:
    """At most the number of shingles in which the sets differ; the longer sketch is folded to the other's residues."""
    a, b = (np.frombuffer(x, np.uint8) for x in ((a, b) if len(a) <= len(b) else (b, a)))
    folded = np.bitwise_xor.reduce(b.reshape(-1, a.size), axis=0)
    return int(np.bitwise_count(a ^ folded).sum())


def _sets(docs: DataFrame, needed: DataFrame, width: int, seed: int, name: str) -> DataFrame:
    """(set_id, shingles as bytes, n, sketch) of the needed sets, read again from the one document ``doc_id`` that stands for each; a
    few others that the Bloom filter lets through, and a set from a few tasks, do no harm. A table in buckets of set_id."""
    held = docs.sparkSession.sparkContext.broadcast(_bloom(needed.select(F.col("doc_id").alias("id"))).tobytes())

    def run(batches):
        shingler, bits, seen = Shingler(width, seed), np.frombuffer(held.value, np.int64), set()
        for part in slices(batches, 2048):
            spots = [part.column(k).to_numpy() % (BLOOM_WORDS * 64) for k in (1, 2)]
            there = np.logical_and(*((bits[s >> 6] >> (s & 63)) & 1 == 1 for s in spots))
            part = part.filter(pa.array(there))
            made = {}
            for shingles in map(shingler, as_bytes(part.column(0))):
                if (me := set_id(shingles)) not in seen:
                    seen.add(me)
                    made[me] = shingles.astype("<u8").tobytes(), shingles.size, sketched(shingles)
            if len(seen) > SEEN_LIMIT:
                seen.clear()
            columns = list(zip(*made.values(), strict=True)) or [[], [], []]
            kinds = (pa.binary(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(list(made), pa.int64()), *map(pa.array, columns, kinds)], ["set_id", "shingles", "n", "sketch"])
        forget()

    spark = docs.sparkSession
    keyed = docs.select("text", F.xxhash64("doc_id").alias("h1"), F.xxhash64("doc_id", F.lit(1)).alias("h2"))
    read = in_arrow(keyed, run, "set_id bigint, shingles binary, n bigint, sketch binary")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    read.repartition(parts, "set_id").write.bucketBy(parts, "set_id").sortBy("set_id").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def _moved(pairs: DataFrame, sets: DataFrame, *more: str) -> DataFrame:
    """The pairs (x, y) with both sets' shingles and further columns of their own."""
    left, right = (sets.select(F.col("set_id").alias(k), F.col("shingles").alias(f"s{k}")) for k in "xy")
    # the sets on the right are first cut down to those asked for, which the buckets do without moving them
    right = right.join(pairs.select("y").distinct(), "y", "left_semi")
    return pairs.select("x", "y", *more).join(left, "x").join(right, "y").select("x", "y", "sx", "sy", *more)


def _linked_sets(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    a, b = (a, b) if a.size <= b.size else (b, a)
    both = int((b[np.minimum(np.searchsorted(b, a), b.size - 1)] == a).sum())
    return both * den >= (a.size + b.size - both) * num


def _links(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Those of the pairs (x, y) that are linked."""

    def run(batches):
        for part in slices(batches, 1024):
            keep = [_linked_sets(np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8"), num, den) for a, b in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
            yield part.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

    return in_arrow(_moved(pairs, sets), run, "x bigint, y bigint")


#: What x differs by from its group's hub: sorted shingles added and removed; n: the size of x. hub: the group's key.
_DIFFERENCES = "x bigint, hub bigint, root bigint, n bigint, added binary, removed binary"


def _differences(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the sets x and the hubs y of their groups ``hub``; a hub belongs to its own group."""

    def run(batches):
        for part in slices(batches, 1024):
            n, added, removed = [], [], []
            for a, b in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                a, b = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
                n.append(a.size)
                added.append(np.setdiff1d(a, b, True).tobytes())
                removed.append(np.setdiff1d(b, a, True).tobytes())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(4), part.column(5), pa.array(n, pa.int64()), pa.array(added, pa.binary()), pa.array(removed, pa.binary())], ["x", "hub", "root", "n", "added", "removed"])

    return in_arrow(_moved(pairs, sets, "hub", "root"), run, _DIFFERENCES)


def _usual(found: DataFrame) -> DataFrame:
    """(hub, more, fewer): shingles that more than half of a hub's group adds, and removes; at most twice the mean number of
    differences."""

    def run(batches):
        for part in slices(batches, 1024):
            sides = [[np.frombuffer(b, "<i8") for b in part.column(k).to_pylist()] for k in (1, 2)]
            hubs = part.column(0).to_numpy()
            hub = np.concatenate([np.repeat(hubs, [v.size for v in side]) for side in sides])
            e, added = np.concatenate([v for side in sides for v in side]), np.arange(hub.size) < sum(v.size for v in sides[0])
            # what many of a batch's sets share is one row
            order = np.lexsort((added, e, hub))
            hub, e, added = hub[order], e[order], added[order]
            first = np.flatnonzero(np.concatenate(([True], (hub[1:] != hub[:-1]) | (e[1:] != e[:-1]) | (added[1:] != added[:-1])))) if hub.size else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(hub[first]), pa.array(e[first]), pa.array(added[first]), pa.array(np.diff(np.append(first, hub.size)))], ["hub", "e", "added", "k"])

    told = found.select("hub", "added", "removed").mapInArrow(run, "hub bigint, e bigint, added boolean, k bigint").groupBy("hub", "e", "added").agg(F.sum("k").alias("k"))
    sizes = found.groupBy("hub").agg(F.count(F.lit(1)).alias("m"))
    most = told.join(sizes, "hub").where("2 * k > m")
    return most.groupBy("hub").agg(F.collect_list(F.when(F.col("added"), F.col("e"))).alias("more"), F.collect_list(F.when(~F.col("added"), F.col("e"))).alias("fewer"))


#: kind 0: a set of a hub's group, place: its excess; 1: an added shingle of x; 2: a removed one.
_POSTED = "kind int, x bigint, hub bigint, root bigint, key bigint, place bigint, spot bigint"


def posted(x: int, hub: int, root: int, n: int, added: np.ndarray, removed: np.ndarray, more: np.ndarray, fewer: np.ndarray, num: int, den: int) -> np.ndarray:
    """Rows of _POSTED of a set from the pivot, its hub with ``more`` and without ``fewer``: its first K + 1 differences, K
    being the most in which any partner differs from it, and its excess: two sets whose excesses are not over 0 together
    differ by no more than the threshold allows."""
    if more.size or fewer.size:
        added, removed = (
            np.concatenate((np.setdiff1d(added, more, True), np.setdiff1d(fewer, removed, True))),
            np.concatenate((np.setdiff1d(removed, fewer, True), np.setdiff1d(more, added, True))),
        )
        added.sort()
        removed.sort()
    most = (n + n * den // num) * (den - num) // (den + num) + 1
    first, then = added[:most], removed[: max(0, most - added.size)]
    e = np.concatenate((first, then))
    key = mixed(e ^ mixed(np.array([hub]).view(np.uint64))).view(np.int64)
    kind = np.repeat([0, 1, 2], (1, first.size, then.size))
    place = NOWHERE if max(n, n - added.size + removed.size) >= 1 << 20 else n << 40 | added.size << 20 | removed.size
    excess = (added.size + removed.size) * (den + num) - (den - num) * n
    return np.stack((kind, *(np.full(kind.size, v) for v in (x, hub, root)), np.append(0, key), np.append(excess, np.full(e.size, place)), np.append(0, np.arange(e.size))))


def _posted(found: DataFrame, num: int, den: int) -> DataFrame:
    def run(batches):
        for part in slices(batches, 1024):
            x, hub, root, n, added, removed, more, fewer = (part.column(k).to_pylist() for k in range(8))
            whole = [np.frombuffer(v, "<u8") for v in added], [np.frombuffer(v, "<u8") for v in removed]
            usual = [[np.sort(np.array(v or [], np.int64).view(np.uint64)) for v in side] for side in (more, fewer)]
            rows = [posted(*of, num, den) for of in zip(x, hub, root, n, *whole, *usual, strict=True)]
            rows = np.concatenate(rows, 1) if rows else np.empty((7, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0].astype(np.int32)), *map(pa.array, rows[1:])], ["kind", "x", "hub", "root", "key", "place", "spot"])

    return found.join(_usual(found), "hub", "left").select("x", "hub", "root", "n", "added", "removed", "more", "fewer").mapInArrow(run, _POSTED)


def _derived(told: DataFrame) -> DataFrame:
    """Links (x, y) of sets with those of the least excess in their groups; they connect all that need no comparison."""
    groups = told.where("kind = 0").select("hub", "x", F.col("place").alias("excess"))
    least = groups.groupBy("hub").agg(F.min_by("x", F.struct("excess", "x")).alias("y"), F.min("excess").alias("low"))
    return groups.join(least, "hub").where("x <> y and excess + low <= 0").select("x", "y")


#: Beyond so many blocks of a hub all count as able to have a partner, and no more are held: more lists are read, none is lost.
BLOCKS = 4096


def able_blocks(places: np.ndarray, several: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which blocks (size, added, removed) of one hub may hold a set with a partner without a common added shingle, not
    both of little excess."""
    if (places < 0).any():
        return np.ones(places.size, bool)
    n, a, r = places >> 40, places >> 20 & (1 << 20) - 1, places & (1 << 20) - 1
    out = np.zeros(places.size, bool)
    for k in range(places.size):
        room = (den - num) * (n[k] + n)
        near = ((a[k] + a + np.abs(r[k] - r)) * (den + num) <= room) & ((a[k] + r[k] + a + r) * (den + num) > room)
        near[k] &= several[k]
        out[k] = near.any()
    return out


def _able(found: DataFrame, num: int, den: int) -> DataFrame:
    """(hub, place) of the blocks of removed shingles that are listed."""

    def run(batches):
        held: list[tuple[int, bool]] = []  # the blocks of the hub that is being read
        at, many = None, False

        def able():
            own = np.array([place for place, _ in held], np.int64)
            kept = own if many else own[able_blocks(own, np.array([several for _, several in held], bool), num, den)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.full(kept.size, at, np.int64)), pa.array(kept)], ["hub", "place"])

        for batch in batches:
            for hub, place, several in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if hub != at:
                    if held:
                        yield able()
                    at, many = hub, False
                held.append((place, several))
                if len(held) > BLOCKS:
                    many = True
                    yield able()
        if held:
            yield able()

    parts = max(1, int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    blocks = found.where("kind = 2").groupBy("hub", "place").agg((F.min("x") != F.max("x")).alias("several"))
    return blocks.repartition(parts, "hub").sortWithinPartitions("hub").mapInArrow(run, "hub bigint, place bigint")


def _difference_lists(found: DataFrame, num: int, den: int, paired: int) -> DataFrame:
    def run(batches):
        reader = ListReader(paired, lambda *of: may_link_apart(*of, num, den))
        for batch in batches:
            if batch.num_rows:
                yield _told(*reader.read(np.stack([batch.column(k).to_numpy() for k in range(5)])))
        yield _told(*reader.finish())

    listed = found.where("kind = 1").unionByName(found.where("kind = 2").join(_able(found, num, den), ["hub", "place"], "left_semi"))
    parts = max(1, int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return listed.select("key", "place", "spot", "x", "root").repartition(parts, "key").sortWithinPartitions("key", "place", "spot", "x").mapInArrow(run, _FOUND)


def _possible(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (x, y) that their sketches don't refute."""

    def run(batches):
        for part in slices(batches, 4096):
            most = ((part.column(4).to_numpy() + part.column(5).to_numpy()) * (den - num) // (den + num)).tolist()
            keep = [sketch_distance(a, b) <= m for a, b, m in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), most, strict=True)]
            yield part.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

    left, right = (sets.select(F.col("set_id").alias(k), F.col("sketch").alias(f"s{k}"), F.col("n").alias(f"n{k}")) for k in "xy")
    both = pairs.join(left, "x").join(right, "y").where(F.least("nx", "ny") * den >= F.greatest("nx", "ny") * num)
    return both.select("x", "y", "sx", "sy", "nx", "ny").mapInArrow(run, "x bigint, y bigint")


def forest(edges: DataFrame, roots: bool = False) -> DataFrame:
    """Edges (x, y) that connect what ``edges`` do: for ``FOREST_EDGES`` of a task at a time, each node with the least one
    that they reach; with ``roots`` that one with itself, too."""

    def run(batches):
        parent: dict[int, int] = {}
        taken = 0

        def top(v):
            while (up := parent.setdefault(v, v)) != v:
                parent[v] = v = parent.setdefault(up, up)
            return v

        def stars():
            rows = [(v, top(v)) for v in parent]
            x, y = np.array(rows, np.int64).reshape(-1, 2).T
            parent.clear()
            kept = np.ones(x.size, bool) if roots else x != y
            return pa.RecordBatch.from_arrays([pa.array(x[kept]), pa.array(y[kept])], ["x", "y"])

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = top(a), top(b)
                parent[max(a, b)] = min(a, b)
            taken += batch.num_rows
            if taken >= FOREST_EDGES:
                yield stars()
                taken = 0
        yield stars()

    return edges.select(F.col("x").cast("bigint").alias("x"), F.col("y").cast("bigint").alias("y")).mapInArrow(run, "x bigint, y bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the nodes of ``edges`` (x, y): the least node that links reach. Each task first joins what its own
    edges connect; what is left, if it is no more than a task joins up at a time, is joined by one, else large-star and
    small-star steps alternate until every node has one edge, to a root. Every round is written, and each needs only minima and
    joins."""
    now = materialise(forest(edges))
    if now.count() > FOREST_EDGES:
        now = materialise(now.distinct())
    while True:
        if now.count() <= FOREST_EDGES:
            return forest(now.coalesce(1), roots=True).select(F.col("x").alias("node"), F.col("y").alias("root"))
        # done if every node is the lower end only, or the upper end of one edge only
        ends = now.select(F.col("x").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("low")).unionByName(now.select(F.col("y").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("low")))
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("low").alias("low")).where("up + low > 1").isEmpty():
            return now.select(F.col("x").alias("node"), F.col("y").alias("root")).unionByName(now.select(F.col("y").alias("node"), F.col("y").alias("root")).distinct())
        both = now.unionByName(now.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        # as y > x >= m, each row is already directed downwards
        large = materialise(both.where("y > x").join(least, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct())
        low = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(low, "x").where("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y")).unionByName(low.select("x", F.col("m").alias("y")))
        now = materialise(forest(small).distinct())


def join(docs: DataFrame, *, width: int = 5, threshold: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text", paired: int = SMALL_DIFFERENCE_LIST) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (the least doc_id that links reach, itself included).
    Lists of differences of up to ``paired`` sets are paired in place, longer ones take a round of their own: more pairs are
    refuted in place, or more rounds are made; the result is the same."""
    spark, name = docs.sparkSession, f"loomgraph_sets_{uuid.uuid4().hex}"
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    with scratch(spark):
        try:
            return materialise(_classes(docs, width, *threshold, name, paired), keep=True)
        finally:
            spark.sql(f"drop table if exists {name}")
            drop(spark, f"{shared_dir(spark)}/{name}")


def _classes(docs: DataFrame, width: int, num: int, den: int, name: str, paired: int) -> DataFrame:
    for seed in count():
        found = materialise(_lists(_index(docs, width, num, den, seed), num, den))
        rows = found.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("set_id"), F.col("c").bitwiseAND(F.lit((1 << SIZE_BITS) - 1)).alias("n_shingles"), F.col("c").alias("whole"))
        first = materialise(rows.where("n_shingles > 0").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), (F.min("whole") != F.max("whole")).alias("mixed")))
        if first.where("mixed").isEmpty():
            break
    members = materialise(_rare_lists(found))
    close = found.where("kind = 1").select(F.col("a").alias("x"), F.col("b").alias("y"))
    starred = members.join(_hubs(members), "list").where("x <> hub").select("x", F.col("hub").alias("y"))
    pairs = materialise(close.unionByName(starred).groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")))
    if pairs.isEmpty():
        return _labelled(rows, first, None)
    nodes = pairs.select(F.col("x").alias("set_id")).unionByName(pairs.select(F.col("y").alias("set_id"))).distinct()
    sets = _sets(docs, first.join(nodes, "set_id", "left_semi"), width, seed, name)
    # first each set with the one that it shares most lists with
    near = materialise(pairs.groupBy("x").agg(F.max_by("y", F.struct("n", -F.col("y"))).alias("y")))
    roots = materialise(components(materialise(_links(materialise(_possible(near, sets, num, den)), sets, num, den))))
    left, merged = close.join(near, ["x", "y"], "left_anti").distinct(), True
    while True:
        # what small lists propose and what hubs tell of long ones, but for pairs that are in one component already
        found = materialise(_posted(materialise(_differences(_with_hubs(members, roots, merged), sets)), num, den))
        lists = materialise(_difference_lists(found, num, den, paired))
        proposed = lists.where("kind = 1").select(F.col("a").alias("x"), F.col("b").alias("y"))
        apart = _apart(proposed if left is None else left.unionByName(proposed), roots).distinct()
        rest = materialise(_possible(apart, sets, num, den))
        links = roots.where("node <> root").select(F.col("node").alias("x"), F.col("root").alias("y")).unionByName(_derived(found)).unionByName(_links(rest, sets, num, den))
        roots = materialise(components(materialise(links)))
        longer = lists.where("kind = 2").select(F.col("a").alias("list"), F.col("b").alias("x"))
        if longer.isEmpty():
            return _labelled(rows, first, roots)
        members = materialise(longer.join(longer.groupBy("x").agg(F.count(F.lit(1)).alias("lists")), "x"))
        left, merged = None, False


def _rare_lists(found: DataFrame) -> DataFrame:
    """Long lists' members (list, x) with the number of long lists of x. Partners share at least d lists of a band,
    so they still meet if each set leaves its d - 1 longest lists: what a whole group shares is skipped, and sets that share
    fewer with anything drop out."""
    shared = F.when(F.col("c") < 0, 1).otherwise(F.col("c").bitwiseAND(F.lit((1 << 11) - 1)))
    rows = found.where("kind = 2").select(F.col("a").alias("list"), F.col("b").alias("x"), shared.alias("d"))
    sized = rows.join(rows.groupBy("list").agg(F.count(F.lit(1)).alias("n")), "list").withColumn("band", F.col("list").bitwiseAND(F.lit(255)))
    of_set = Window.partitionBy("x")
    ranked = sized.withColumn("rank", F.row_number().over(Window.partitionBy("x", "band").orderBy(F.desc("n"), "list"))).withColumn("lists", F.count(F.lit(1)).over(of_set))
    # d is the same for all of a set's places in a band but those that tell nothing
    return ranked.where("rank >= d").select("list", "x", "lists")


def _hubs(members: DataFrame) -> DataFrame:
    return members.groupBy("list").agg(F.max_by("x", F.struct("lists", "x")).alias("hub"))


def _with_root(df: DataFrame, roots: DataFrame, of: str) -> DataFrame:
    return df.join(roots.select(F.col("node").alias(of), F.col("root").alias("_known")), of, "left").withColumn(f"{of}_root", F.coalesce("_known", of)).drop("_known")


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    return _with_root(_with_root(pairs, roots, "x"), roots, "y").where("x_root <> y_root").select("x", "y")


def _with_hubs(members: DataFrame, roots: DataFrame, merged: bool) -> DataFrame:
    """Each member x of a list that holds several components, and the hub itself, with the list's hub y, and its group: all
    lists of one hub if ``merged``, else the list."""
    rooted = _with_root(members, roots, "x")
    several = rooted.groupBy("list").agg(F.min("x_root").alias("lo"), F.max("x_root").alias("hi"), F.max_by("x", F.struct("lists", "x")).alias("y")).where("lo <> hi").select("list", "y")
    return rooted.join(several, "list").select("x", "y", F.col("y" if merged else "list").alias("hub"), F.col("x_root").alias("root")).distinct()


def _labelled(rows: DataFrame, first: DataFrame, linked: DataFrame | None) -> DataFrame:
    owner = first.select("set_id", F.col("doc_id").alias("least"))
    if linked is not None:
        known = first.select("set_id", "doc_id").join(linked.withColumnRenamed("node", "set_id"), "set_id")
        least = known.groupBy("root").agg(F.min("doc_id").alias("reached"))
        reached = known.join(least, "root").select("set_id", "reached")
        owner = owner.join(reached, "set_id", "left").select("set_id", F.coalesce("reached", "least").alias("least"))
    empty = F.col("n_shingles") == 0
    return rows.join(owner, "set_id", "left").select("doc_id", "n_shingles", F.when(empty, F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def one_of_each(docs: DataFrame, *, width: int = 5, threshold: tuple[int, int] = (80, 100), id_col: str = "doc_id") -> DataFrame:
    """``docs`` without those that links tie to a document of a lesser id: one document of each group stays, and every
    document with an empty set. Rows that repeat the kept doc_id are told apart by nothing and all stay."""
    classes = join(docs, width=width, threshold=threshold, id_col=id_col)
    gone = classes.where(F.col("component_id") != F.col("doc_id")).select(F.col("doc_id").alias("gone"))
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.alias("d").join(gone.alias("g"), F.col(f"d.`{id_col}`") == F.col("g.gone"), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"), width=4, threshold=(85, 100), paired=400)
