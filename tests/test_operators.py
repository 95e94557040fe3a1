import random
from pathlib import Path

from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import graph as G
from loomgraph.operators import ordered as O
from loomgraph.operators import supervision as S
from loomgraph.operators import candidates as C
from loomgraph.sinks.workspace import shared_folder
from loomgraph.sources import tables as R


def written(spark):
    """Bytes in the shared folder."""
    return sum(p.stat().st_size for p in Path(shared_folder(spark).removeprefix("file:")).rglob("*") if p.is_file())


def test_strip_and_segments(spark):
    row = spark.createDataFrame([('e:"A" .', "r: x ", "abcde；abcd\nabcde\n fghij ")], "s string, r string, t string")
    got = row.select(T.strip_entity(F.col("s")), T.strip_relation(F.col("r")), T.segments(F.col("t"))).first()
    assert tuple(got) == ("A", "x", ["abcde", "fghij"])


def test_offsets_and_similarity(spark):
    row = spark.createDataFrame([("abcd", "xbcy", ["a", "b"])], "a string, b string, i array<string>")
    got = row.select(T.char_offset(F.col("a"), F.lit("z")), T.item_offset(F.col("i"), F.lit("b")), T.common_substring_length(F.col("a"), F.col("b")), T.levenshtein_ratio(F.col("a"), F.col("b"))).first()
    assert tuple(got) == (-1, 1, 2, 0.5)


def test_literal_candidates_whatever_the_first_letters(spark):
    entities = spark.createDataFrame([("old anvil",), ("cold bolt",), ("zzzz",), ("qz",)], "name string")
    triples = spark.createDataFrame([("cold anvil", "r1", "bold anvil"), ("q123456", "r2", "q98765"), ("xxx", "r3", "yyy")], "s string, r string, o string")
    got = {(x.s, x.r, x.o, x.e, x.sim_o, x.sim_s, x.tier) for x in C.literal_candidates(triples, entities).collect()}
    near = round(1 - 1 / 10 + 9 / 19, 6)
    assert {x for x in got if x[3] == "old anvil"} == {("cold anvil", "r1", "bold anvil", "old anvil", near, near, "candidate")}
    assert {x[1:4] + x[6:] for x in got} == {("r1", "bold anvil", "old anvil", "candidate"), ("r1", "bold anvil", "cold bolt", "candidate"), ("r2", "q98765", "qz", "fallback")}


def test_closure_of_chain_and_cycle(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (7, 8), (8, 7), (9, 9)], "a int, b int")
    assert {tuple(r) for r in G.closure(edges).collect()} == {(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4), (7, 8), (8, 7)}


def test_closure_of_paths_writes_nodes_only(spark):
    """Paths and cycles of many lengths: right pairs, and what is written doesn't grow with their number."""
    want, edges, at = set(), [], 0
    for n in (1, 2, 3, 5, 8, 33, 400):
        path = [at + (k * 7919) % n for k in range(n)]
        want |= {(a, b) for k, a in enumerate(path) for b in path[k + 1 :]}
        edges, at = edges + list(zip(path, path[1:], strict=False)), at + n
    for n in (2, 3, 6, 64, 65):
        ring = [at + (k * 7919) % n for k in range(n)]
        want |= {(a, b) for a in ring for b in ring if a != b}
        edges, at = edges + list(zip(ring, ring[1:] + ring[:1], strict=True)), at + n
    before = written(spark)
    got = [tuple(r) for r in G.closure(spark.createDataFrame(edges, "a int, b int")).collect()]
    assert len(got) == len(want) and set(got) == want
    assert written(spark) - before < 1_000_000
    assert G.closure(spark.createDataFrame([], "a int, b int")).count() == 0


def test_closure_of_branching_graphs(spark):
    rng = random.Random(5)
    for n, m in ((12, 14), (30, 33), (9, 40)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(100 + k, 101 + k) for k in range(9)] + [(100, 200)]
        want = {(a, b) for a, b in edges if a != b}
        while more := {(a, d) for a, b in want for c, d in want if b == c and a != d} - want:
            want |= more
        got = [tuple(r) for r in G.closure(spark.createDataFrame(edges, "a int, b int")).collect()]
        assert len(got) == len(want) and set(got) == want


def test_directions_and_tiers(spark):
    found = spark.createDataFrame([(1, 0, x, y, 0, 1) for x, y in (("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"))], "doc_id int, sid int, e1 string, e2 string, p1 int, p2 int")
    true = spark.createDataFrame([("a", "r", "b"), ("b", "q", "a"), ("c", "r", "b")], "e1 string, r string, e2 string")
    potential = spark.createDataFrame([("c", "r", "d"), ("a", "z", "b")], "e1 string, r string, e2 string")
    got = {(r.e1, r.label, r.tier) for r in S.supervised(found, true, potential).collect()}
    assert got == {("a", "r(e1,e2)", "true"), ("a", "q(e2,e1)", "true"), ("b", "r(e2,e1)", "true"), ("c", "r(e1,e2)", "potential"), ("d", None, "none")}


def test_split_sizes(spark):
    rows = spark.createDataFrame([(c, i) for c, n in ((1, 1), (2, 2), (3, 3), (10, 10)) for i in range(n)], "c int, k int")
    got = {(r.c, r.split): r["count"] for r in O.stratified_split(rows, "c", "k").groupBy("c", "split").count().collect()}
    assert got == {(1, "eval"): 1, (2, "train"): 1, (2, "eval"): 1, (3, "train"): 2, (3, "eval"): 1, (10, "train"): 7, (10, "dev"): 1, (10, "eval"): 2}


def test_readers(spark, tmp_path):
    (tmp_path / "t.ttl").write_text('@prefix e: <x> .\n@prefix r: <y> .\ne:A\tr:R\te:B.\ne:A\tr:名\t"x y".\n', encoding="utf-8")
    assert [tuple(r) for r in R.triples(spark, str(tmp_path / "t.ttl")).collect()] == [("A", "R", "B"), ("A", "名", "x y")]
    (tmp_path / "l.tsv").write_text("a\t3\nb\t3 7\na\t5\n")
    assert sorted(tuple(r) for r in R.labels(spark, str(tmp_path / "l.tsv")).collect()) == [("a", 5), ("b", 3), ("b", 7)]
    (tmp_path / "v.txt").write_bytes(b"true_entity:a:b\r\ncandidate_entity:c\r\n")
    assert sorted(tuple(r) for r in R.vocabulary(spark, str(tmp_path / "v.txt")).collect()) == [("candidate_entity", "c"), ("true_entity", "a:b")]


def test_longest_terms(spark):
    from loomgraph.operators import supervision as S

    words = "the red deer saw the red deer park and the red".split()
    tokens = spark.createDataFrame([(1, 0, k, w) for k, w in enumerate(words)] + [(1, 1, 0, "red")], "doc_id bigint, sid bigint, pos bigint, tok string")
    terms = spark.createDataFrame([("red", "c"), ("red deer", "b"), ("red deer park", "a"), ("deer saw the", "d")], "name string, tag string")
    got = sorted((r.sid, r.pos, r.n, r.name, r.tag) for r in S.longest_terms(tokens, terms).collect())
    assert got == [(0, 1, 2, "red deer", "b"), (0, 5, 3, "red deer park", "a"), (0, 10, 1, "red", "c"), (1, 0, 1, "red", "c")]


def test_early_stopping_with_delta(spark):
    from loomgraph.operators import metrics as M

    scores = [5.0, 5.5, 5.9, 6.0, 5.0, 5.1, 9.0]
    df = spark.createDataFrame([("a", k, s) for k, s in enumerate(scores)], "run string, epoch int, score double")
    got = [(r.epoch, r.best, r.waited, r.stopped) for r in sorted(M.early_stopping(df, "run", "epoch", "score", patience=2, delta=1.0).collect(), key=lambda r: r.epoch)]
    assert got == [(0, 5.0, 0, False), (1, 5.0, 1, False), (2, 5.0, 2, True), (3, 6.0, 0, True), (4, 6.0, 1, True), (5, 6.0, 2, True), (6, 9.0, 0, True)]
    best = M.best_epoch(df, "run", "epoch", "score").first()
    assert (best.epoch, best.score) == (6, 9.0)


def test_metrics_of_absent_classes(spark):
    from loomgraph.operators import metrics as M

    rows = spark.createDataFrame([(0, 0), (1, 1), (1, 0), (2, 1)], "y_true int, y_pred int")
    counts = M.class_counts(rows, spark.range(4).withColumnRenamed("id", "c"))
    assert sorted(tuple(r) for r in counts.collect()) == [(0, 1, 2, 1), (1, 2, 2, 1), (2, 1, 0, 0), (3, 0, 0, 0)]
    assert M.macro(counts).first().macro_p == 0.25
    assert M.macro(counts, without=0).first().macro_p == round(0.5 / 3, 6)


def test_model_is_read_back(spark):
    from loomgraph.operators import relation_model as R
    from loomgraph.sinks.workspace import new_path

    rows = spark.createDataFrame([(f"the {w} word", f"e{k}", "x", "place", "place", y) for k in range(20) for w, y in (("blue", 0), ("green", 1))], "text string, e1 string, e2 string, tag1 string, tag2 string, label int")
    samples = rows.withColumn("words", R.marked_words(rows.text, rows.e1, rows.e2))
    model = R.load(R.save(R.fit(samples), new_path(spark, "model")))
    assert R.predict(model, samples).where("label <> y_pred").count() == 0
    book = spark.createDataFrame([(1, "is")], "y_pred int, r string")
    assert R.scored_triples(R.predict(model, samples), book).count() == 20
    moved = R.fit(samples, start=model)
    assert moved.stages[1].uid == model.stages[1].uid


def test_numbers_are_gapless(spark):
    from loomgraph.operators import supervision as S

    rows = spark.createDataFrame([(k * 7919 % 503,) for k in range(503)], "v bigint").repartition(5)
    assert sorted((r.v, r.n) for r in S.numbered(rows, ["v"]).collect()) == [(k, k) for k in range(503)]
    assert S.numbered(rows.limit(0), ["v"]).count() == 0
