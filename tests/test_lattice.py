"""Many texts cut at once against the plain lattice of one text; the segmenter's counts against those of tokens as rows."""

import random
import time

import numpy as np
import pytest

from loomgraph.operators import language as L
from loomgraph.operators import supervision as S
from loomgraph.operators.lattice import Lattice, blocks
from loomgraph.sources.tables import dealt, table

DATA = "/root/testdata/sf0.001"


def packed(model):
    return Lattice(model.words, model.moves, model.unknown, model.unseen, L.OTHER, L.START)


def joined(texts):
    lengths = [len(t.encode()) for t in texts]
    return np.frombuffer("".join(texts).encode(), np.uint8), np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def cut(lattice, texts, **sizes):
    data, bounds = joined(texts)
    at, tags, _ = lattice.cut(data, bounds, **sizes)
    raw, out = data.tobytes(), [[] for _ in texts]
    for a, z, t, k in zip(at, np.append(at, len(data))[1:], tags, np.searchsorted(bounds, at, side="right") - 1, strict=True):
        out[k].append((raw[a:z].decode(), lattice.tags[t]))
    return out


@pytest.mark.parametrize("sizes", [{}, {"chunk": 16, "warm": 4}, {"chunk": 1, "warm": 1}])
def test_many_texts_have_the_paths_of_each(sizes):
    """Also of texts in several pieces, of equal costs, words of several tags, characters of one to four bytes."""
    rng = random.Random(7)
    for _ in range(120):
        letters = "ab阿é𝄞"[: rng.randrange(1, 6)]
        tags = rng.choice([["x"], ["x", "nr"], ["nr", "v", "z"]])
        words = {"".join(rng.choices(letters, k=rng.randrange(1, 5))): [(t, rng.randrange(1, 6)) for t in rng.sample(tags, rng.randrange(1, len(tags) + 1))] for _ in range(rng.randrange(9))}
        moves = {(a, b): rng.randrange(4) for a in (L.START, L.OTHER, *tags) for b in (L.OTHER, *tags) if rng.random() < 0.9}
        model = L.Segmenter(words, moves, rng.choice([2, 5, 12]), 3)
        texts = ["".join(rng.choices(letters + "q", k=rng.choice([0, 1, 3, 10, 60, 300]))) for _ in range(rng.randrange(1, 7))]
        assert cut(packed(model), texts, **sizes) == [model.segment(t) for t in texts]


def test_texts_whose_pieces_never_agree_are_cut_whole():
    """Only pairs of a letter are known: which letters make a pair is told by the text's begin alone."""
    model = L.Segmenter({"aa": [("x", 1)]}, {}, 50, 0)
    for n in (4001, 4002):
        assert cut(packed(model), ["a" * n, "b" + "a" * n]) == [model.segment("a" * n), model.segment("b" + "a" * n)]


def test_many_texts_take_a_fraction_of_the_time():
    """The plain lattice, a text and a character at a time, did not end in time on 1 GB."""
    rng = random.Random(2)
    words = sorted({"".join(rng.choices("etaoinshrdlu", k=rng.randrange(2, 8))) for _ in range(20_000)})
    model = L.Segmenter({w: [(rng.choice("xn"), rng.randrange(3000, 12_000))] for w in words}, {}, 25_000, 700)
    lattice, texts = packed(model), ["".join(rng.choices(words, k=40)) for _ in range(2500)]
    began = time.process_time()
    found = cut(lattice, texts)
    many = time.process_time() - began
    began = time.process_time()
    assert found[::10] == [model.segment(t) for t in texts[::10]]
    assert many < 3 * (time.process_time() - began)  # the plain one has a tenth of the texts


def test_blocks_hold_every_text_once():
    offsets = np.array([3, 3, 10, 50, 51, 52, 400, 400])
    for size in (1, 8, 40, 1000):
        found = list(blocks(offsets, size))
        assert [k for a, z in found for k in range(a, z)] == list(range(7)) and all(z == a + 1 or offsets[z] - offsets[a] <= size for a, z in found)


ODD = ["The Winterfell of Abcdefg, abcdefg. ABCDEFG", "x\ty\x0bz\x0cq\rw", " , . ", "", None, "Éclair naïf Abcdefg  abcdefgé", "İstanbul ΑΣ straße Abcdef\u0085", "Abcdefg"]


def test_counts_of_sentences_are_those_of_tokens(spark):
    rows = [(d, d % 2, ODD[d % len(ODD)]) for d in range(40)]
    odd = spark.createDataFrame(rows, "doc_id long, sid int, text string")
    vocab = spark.createDataFrame([("abcdefg", "true_entity"), ("éclair", "candidate_entity"), ("ας", "true_entity"), ("the", None), (None, "x")], "name string, tag string")
    real = S.sentences(table(spark, DATA, "documents"))
    for sentences, known in ((odd, vocab), (odd, vocab.union(vocab)), (odd.limit(0), vocab), (real, S.vocabulary(table(spark, DATA, "benchmark")))):
        for words in (3, L.MODEL_ROWS):
            assert L.learn_from_sentences(sentences, known, words) == L.learn_segmenter(S.tagged(sentences, known), words)


def test_sentences_are_segmented_as_each_is(spark):
    sentences = spark.createDataFrame([(d, 3, t and t[: d + 2]) for d, t in enumerate(ODD * 3)], "doc_id int, sid int, text string")
    model = L.learn_from_sentences(sentences, spark.createDataFrame([("abcdefg", "true_entity")], "name string, tag string"))
    found = {}
    for r in L.segment(sentences, model).orderBy("doc_id", "position").collect():
        assert r.sid == 3 and r.position == len(found.setdefault(r.doc_id, []))
        found[r.doc_id].append((r.token, r.tag))
    assert found == {r.doc_id: m for r in sentences.collect() if (m := model.segment(r.text))}


def test_a_file_of_one_part_is_dealt_out(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(f"{tmp_path}/t")
    one = spark.read.parquet(f"{tmp_path}/t")
    out = dealt(one)
    assert out.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and out.count() == 1000
    even = spark.range(0, 1000, 1, 8)
    assert dealt(even) is even and dealt(one.where("false")).count() == 0
