"""Folds over a total order against plain loops, over several ranges; label files; batches."""

import hashlib
import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import ordered as O
from loomgraph.operators import supervision as S
from loomgraph.sinks.workspace import shared_folder
from loomgraph.sources import tables as X


def written(spark):
    """Bytes in the shared folder."""
    return sum(p.stat().st_size for p in Path(shared_folder(spark).removeprefix("file:")).rglob("*") if p.is_file())


def test_state_is_carried_over_ranges(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice([None, None, None, "a", "b"]), rng.choice([None, k])) for k in range(300)]
    shuffled = spark.createDataFrame(rng.sample(rows, len(rows)), "k int, v string, w int").repartition(7)
    got = O.carried(shuffled, ["k"], last={"state": F.col("v")}, before={"prev": F.col("w")}).orderBy("k").collect()
    state, prev = None, None
    for r, (k, v, w) in zip(got, rows, strict=True):
        state = v if v is not None else state
        assert (r.k, r.v, r.w, r.state, r.prev) == (k, v, w, state, prev)
        prev = w
    assert O.carried(shuffled.limit(0), ["k"], last={"state": F.col("v")}).count() == 0


def test_families_and_the_text_before(spark):
    rng = random.Random(8)
    texts = ["  ", "Oak", "Elm", "—— Ada says", "—— Ed", "plain text", None]
    rows = [(k, rng.choice(texts)) for k in range(200)]
    want, family, emitted, previous = [], None, None, None
    for k, text in rows:
        if not (text or "").strip():
            continue
        family = text if text in ("Oak", "Elm") else family
        if text.startswith("——") and family is not None:
            if emitted != family:
                want.append((k, family, 0, previous.strip()))
            want.append((k, family, 1, text.strip()))
            emitted = family
        previous = text
    df = spark.createDataFrame(rows, "k int, text string").repartition(5)
    mark = F.when(F.col("text").isin("Oak", "Elm"), F.col("text"))
    got = O.family_rows(df, ["k"], mark, F.startswith("text", F.lit("——"))).orderBy("k", "part").collect()
    assert [tuple(r) for r in got] == want and any(p == 0 for _, _, p, _ in want[5:])


def test_masks_in_turn(spark):
    rows = [(1, ["a", "b", "a", "c"], [("a", "b"), ("a", "a"), ("z", "c")]), (2, ["x", "x"], [("x", "x"), ("x", "y")]), (3, ["q"], []), (4, [], [("q", "q")])]
    df = spark.createDataFrame(rows, "k int, w array<string>, ends array<struct<head:string,tail:string>>")
    got = {r.k: r for r in O.masked_in_turn(df, "w", "ends").collect()}
    for k, words, ends in rows:
        words, found = list(words), []
        for head, tail in ends:
            at = []
            for end, mark in ((head, " head "), (tail, " tail ")):
                at.append(words.index(end) if end in words else -1)
                if at[-1] >= 0:
                    words[at[-1]] = mark
            found.append((head, tail, *at))
        assert [tuple(x) for x in got[k].found] == found and got[k].masked == words and got[k].w == rows[k - 1][1]


@pytest.mark.parametrize("seed", [None, 3])
def test_batches_are_full_and_repeatable(spark, seed):
    rows = spark.range(1000).withColumn("v", F.col("id") % 7)
    batches = [O.mini_batches(df, ["id"], 64, seed).collect() for df in (rows.repartition(3), rows.repartition(8))]
    assert sorted(batches[0]) == sorted(batches[1]) and len(batches[0]) == 1000
    sizes = [sum(r.batch == b for r in batches[0]) for b in range(16)]
    assert sizes == [64] * 15 + [40] and sorted(r.place for r in batches[0] if r.batch == 3) == list(range(64))
    in_order = [r.id for r in sorted(batches[0], key=lambda r: (r.batch, r.place))]
    assert (in_order == list(range(1000))) == (seed is None)
    assert O.mini_batches(rows.limit(0), ["id"]).count() == 0


def test_classes_are_split_alike_whatever_their_size(spark):
    rows = spark.createDataFrame([(k, "big" if k % 3 else None if k % 2 else f"c{k % 5}") for k in range(600)], "k int, c string")
    got = O.stratified_split(rows, "c", "k").groupBy("c", "split").count().collect()
    sizes = {r["c"]: r["count"] for r in rows.groupBy("c").count().collect()}
    for c, n in sizes.items():
        mine = {r["split"]: r["count"] for r in got if r["c"] == c}
        assert mine == {"train": int(n * 0.7), "dev": int(n * 0.8) - int(n * 0.7), "eval": n - int(n * 0.8)}


def test_the_last_line_wins_over_files_and_splits(spark, tmp_path):
    lines = {"a.tsv": ["1\t5", "2\t6 7", *(f"x{k}\t0" for k in range(20_000)), "9\t1"], "b.tsv": ["1\t8 9", "3\t4", *(f"x{k}\t1" for k in range(20_000)), "1\t2", "9\t3"]}
    for name, rows in lines.items():
        (tmp_path / name).write_text("\n".join(rows) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        found = X.labels(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
        got = {(r.id, r.label) for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {p for p in got if not p[0].startswith("x")} == {("1", 2), ("2", 6), ("2", 7), ("3", 4), ("9", 3)}
    assert {label for i, label in got if i.startswith("x")} == {1}


def test_readers_of_candidates_and_statements(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"s": "e:\\"A\\"", "r": "r:likes ", "o": "\\"x\\" .", "candidate_entity": ["e:B", "C"]}\n')
    assert [tuple(r) for r in X.candidates(spark, str(tmp_path / "c.jsonl")).collect()] == [("A", "likes", "x", ["B", "C"])]
    (tmp_path / "s.jsonl").write_text('{"text": "AB", "postag": [{"word": "AB", "pos": "n"}], "spo_list": []}\n{"text": "C", "postag": [], "spo_list": [{"predicate": "p", "subject": "s", "object": "o", "subject_type": "t", "object_type": "u"}]}\n')
    assert {(r.sentence, r.spo and r.spo.predicate) for r in X.statements(spark, str(tmp_path / "s.jsonl")).collect()} == {("ab", None), ("c", "p")}
    assert [r.content for r in X.long_items(spark, ["x" * 20, "y" * 21]).collect()] == ["y" * 21]


def test_a_split_writes_only_rows_near_its_cuts(spark):
    """Places in the order of the digests, by brute force, and few bytes written; keys that are equal or null are counted too."""
    rows = [(k, "big" if k % 3 else None if k % 2 else f"c{k % 5}") for k in range(30_000)] + [(7, "same")] * 50 + [(None, "same")] * 3
    df = spark.createDataFrame(rows, "k int, c string").repartition(4)
    before = written(spark)
    got = {}
    for r in O.stratified_split(df, "c", "k").collect():
        got.setdefault((r.c, r.k), []).append(r.split)
    assert written(spark) - before < 300_000
    for c in {c for _, c in rows}:
        mine = sorted((k for k, x in rows if x == c), key=lambda k: "" if k is None else hashlib.md5(str(k).encode()).hexdigest())
        for k in set(mine):
            places = [n for n, x in enumerate(mine, 1) if x == k]
            assert sorted(got[c, k]) == sorted("train" if n <= int(len(mine) * 0.7) else "dev" if n <= int(len(mine) * 0.8) else "eval" for n in places)


def test_mentions_of_sentences_are_those_of_rows(spark):
    sentences = spark.createDataFrame([(1, 0, "The Winter, snow of Hamburgo winter无 无 X"), (1, 1, "nothing here"), (2, 0, ""), (3, 0, "snow SNOW winter. Winterly ABCDEFG"), (4, 0, None)], "doc_id bigint, sid int, text string")
    vocab = spark.createDataFrame([("winter", "true_entity"), ("snow", "candidate_entity"), ("无", "true_entity"), ("x", "nrx")], "name string, tag string")
    rows = S.mentions(S.tagged(sentences, vocab)).collect()
    want = {}
    for r in sorted(rows, key=lambda r: r.position):
        want.setdefault((r.doc_id, r.sid), []).append((r.position, r.name, r.tag))
    for most in (None, 0):
        known = X.small(vocab) if most is None else X.small(vocab, rows=most)
        assert X.is_broadcast(known) == (most is None)
        assert {(r.doc_id, r.sid): [tuple(m) for m in r.ms] for r in S.sentence_mentions(sentences, known).collect()} == want
    assert len(want[3, 0]) == 4 and S.sentence_mentions(sentences, X.small(vocab.limit(0))).count() == 2


def test_masks_of_a_sentence_with_very_many_ends(spark):
    """Grows with the words and the ends, not with their product; marks that are ends themselves are found again."""
    rng = random.Random(2)
    words = [rng.choice(["a", "b", "c", "d", " head "]) for _ in range(20_000)]
    ends = [(rng.choice("abz"), rng.choice(["a", "c", " head ", " tail "])) for _ in range(6_000)]
    left, found = list(words), []
    for pair in ends:
        at = []
        for end, mark in zip(pair, (" head ", " tail "), strict=True):
            at.append(left.index(end) if end in left else -1)
            if at[-1] >= 0:
                left[at[-1]] = mark
        found.append((*pair, *at))
    df = spark.createDataFrame([(words, ends), ([None, "a"], [(None, "a")])], "w array<string>, ends array<struct<head:string,tail:string>>")
    began = time.time()
    got = {len(r.w): r for r in O.masked_in_turn(df, "w", "ends").collect()}
    assert time.time() - began < 20
    assert [tuple(x) for x in got[20_000].found] == found and got[20_000].masked == left
    assert [tuple(x) for x in got[2].found] == [(None, "a", None, 1)] and got[2].masked == [None, " tail "]
