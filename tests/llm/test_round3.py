"""Content sort, source divergence and vector codes against brute force, on odd, empty and skewed tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from loomgraph.llm import common, contentsort, decontaminate, divergence, langid, pii, toxicity, vectorcodes

DOCS = "doc_id bigint, text string, lang string, source string, kept boolean, key string, bucket int, term string, n int, value int"
MORE = (True, "k", 1, "t", 1, 1)


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, *MORE) for r in rows], DOCS)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


ODD = [
    (1, None, "en", "a"), (2, "", None, None), (3, "Straße ABC", "de", "a"), (3, "Straße ABC", "de", "a"), (None, "straße abc", "de", "b"), (4, "STRAßE abc", "de", "b"),
    (5, "STRASSE abc", "de", "b"), (None, "alone", "en", ""), (6, "long " * 60_000, "en", "c"), (7, "LONG " * 60_000, "en", "c"), (-(2**63), "edge", "en", "c"), (None, "edge", "en", "c"), (2**63 - 1, "Edge", "en", "c"), (9, "É", "en", "c"), (8, "é", "en", "c"),
]


def plain_dedup(rows, keep):
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[lower(r[1])].append((r[0], i))
    found = []
    for text, members in groups.items():
        ids = [d for d, _ in members if d is not None]
        stays = (min if keep == "least" else max)(ids) if ids else None
        kept = next(i for d, i in members if d == stays)
        found += [(d, stays, len(members), i == kept, hashlib.sha256(text.encode()).hexdigest()) for d, i in members]
    return Counter(found)


@pytest.mark.parametrize("keep", ["least", "largest"])
def test_content_sort_of_odd_rows(spark, keep):
    got = contentsort.dedup(docs_of(spark, ODD), keep=keep)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == plain_dedup(ODD, keep)
    assert contentsort.dedup(docs_of(spark, []), keep=keep).count() == 0


@pytest.mark.parametrize("keep", ["least", "largest"])
def test_large_groups_are_cut_between_tasks(spark, keep, monkeypatch):
    """A third of all rows are copies, some hundred repeat one identifier; their group lies in many buckets."""
    spread = []
    real = contentsort.bucket_of

    def watched(key, cuts):
        spread.append(cuts)
        return real(key, cuts)

    monkeypatch.setattr(contentsort, "bucket_of", watched)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    rng = random.Random(3)
    rows = [(i, rng.choice(["Copy", "COPY", "copy"]), "en", "a") for i in range(600)] + [(5, "copy", "en", "a")] * 300 + [(1000 + i, f"t{rng.randrange(800)}", "en", "a") for i in range(1200)]
    rng.shuffle(rows)
    try:
        got = contentsort.dedup(docs_of(spark, rows), keep=keep).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert Counter(tuple(r) for r in got) == plain_dedup(rows, keep)
    copies = hashlib.sha256(b"copy").hexdigest()
    assert len(spread[0]) == 15 and sum(copies in cut for cut in spread[0]) >= 4


def test_content_sort_runs_no_python(spark):
    plan = contentsort.dedup(docs_of(spark, ODD))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|Cartesian", plan)


def test_bisection_counts_splitters(spark):
    cuts = sorted({f"{x:04d}" for x in random.Random(1).sample(range(10_000), 37)})
    keys = ["", "0000", "9999", *cuts, *(c + "x" for c in cuts)]
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    got = {r.key: r.b for r in df.select("key", contentsort.bucket_of(df.key, cuts).alias("b")).collect()}
    assert got == {k: sum(c <= k for c in cuts) for k in keys}


TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain_audit(rows, least_docs, top):
    tf, df, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        own = Counter(TERM.findall(lower(text)))
        groups.add((lang, source))
        tf[lang, source].update(own)
        df[lang].update(own.keys())
    found = set()
    for lang in {g for g, _ in groups}:
        kept = {t for t, n in df[lang].items() if n >= least_docs}
        sources = sorted(s for g, s in groups if g == lang)
        counts = {s: {t: tf[lang, s][t] for t in kept} for s in sources}
        counts[None] = {t: sum(counts[s][t] for s in sources) for t in kept}
        level = {s: {t: 1 + 1_000_000_000 * (n + 5) // (sum(c.values()) + 5 * len(kept)) for t, n in c.items()} for s, c in counts.items()}
        for s in sources:
            pairs = sorted(((-sum(abs(level[s][t] - level[o][t]) for t in kept), o.encode()) for o in sources if o != s))
            terms = sorted((level[None][t] - level[s][t], t.encode()) for t in kept if counts[s][t] and level[s][t] > level[None][t])[:top]
            found |= {(lang, s, part, o.decode(), -v, k) for part, items in (("pair", pairs), ("term", terms)) for k, (v, o) in enumerate(items, 1)}
    return found


@pytest.mark.parametrize(("entries", "least_docs", "top"), [(200_000, 3, 50), (7, 2, 4), (7, 1000, 50)])
def test_divergence_equals_a_plain_version(spark, entries, least_docs, top, monkeypatch):
    monkeypatch.setattr(divergence.counted, "__defaults__", (entries, divergence.ENTRY_CHARS))
    rng = random.Random(entries)
    words = ["The", "the", "of", "Straße", "ÉTÉ", "été", "x1y", "a_b", "𝔘", "Z", "ﬁ"] + [f"w{chr(97 + i)}" for i in range(12)]
    weights = [rng.random() ** 3 + 0.01 for _ in words]
    rows = [(i, " ".join(rng.choices(words, weights, k=rng.randrange(25))), rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "big", "big", "big", "é", None])) for i in range(260)]
    rows += [(900, None, "en", "silent"), (901, "123 !!", "en", "mute"), (902, None, "xx", "only"), (903, "", "yy", "p"), (904, None, "yy", "q"), *[(905, "the " * 3000 + "rare", "en", "a")] * 3]
    got = divergence.audit(docs_of(spark, rows), least_docs=least_docs, top=top).collect()
    assert len(got) == len({tuple(r) for r in got})
    assert {tuple(r) for r in got} == plain_audit(rows, least_docs, top)
    assert divergence.audit(docs_of(spark, [])).count() == 0


def test_terms_of_long_texts_come_in_pieces():
    data = ("Ünï-" * 10 + "ab cd-E9f " * 400).encode()
    for most in (1, 7, 1000, 10**6):
        assert [t for p in divergence.pieces(data, most) for t in p] == [t.encode() for t in TERM.findall(lower(data.decode()))]
    assert list(divergence.pieces(b"")) == []


VECTORS = "vec_id bigint, embedding array<float>, label int, code string, error int"


def plain_codes(rows, parts=8, entries=16, rounds=6):
    import math

    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    width = len(kept[0][1]) // parts
    cut = [[[math.floor(4096 * x) for x in v[p * width : (p + 1) * width]] for p in range(parts)] for _, v, _ in kept]
    books = [[cut[k][p] for k in range(min(entries, len(kept)))] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda u, book: min(range(len(book)), key=lambda e: (far(u, book[e]), e))
    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for c in cut:
                members[near(c[p], books[p])].append(c[p])
            books[p] = [[sum(x) // len(members[e]) for x in zip(*members[e], strict=True)] if e in members else entry for e, entry in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    chosen = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [min(sum(far(c[p], books[p][e]) for p, e in enumerate(ch)), 2**63 - 1) for c, ch in zip(cut, chosen, strict=True)]
    total = Counter()
    for (_, _, lab), e in zip(kept, errors, strict=True):
        total[lab] += e
    return [(i, "".join(f"{e:02x}" for e in ch), e, min(total[lab], 2**63 - 1), digest) for (i, _, lab), ch, e in zip(kept, chosen, errors, strict=True)]


def some_vectors(n, width, seed, scale=1.0):
    rng = np.random.default_rng(seed)
    values = np.round(rng.normal(size=(n, width)) * scale * 8) / 8 if seed % 2 else rng.normal(size=(n, width)) * scale
    return [(int(i), [float(x) for x in np.float32(v)], [None, 0, 1, int(i) + 5][int(i) % 4]) for i, v in zip(rng.permutation(n), values, strict=True)]


@pytest.mark.parametrize(("n", "width", "scale"), [(300, 16, 1.0), (90, 64, 0.1), (9, 8, 1.0), (120, 24, 40_000.0), (60, 16, 1e12)])
def test_vector_codes_equal_a_plain_version(spark, n, width, scale):
    rows = some_vectors(n, width, n, scale)
    rows += [(None, rows[0][1], 1), (3, rows[5][1], 0), (3, rows[5][1], 0), (n + 1, None, 1), (n + 2, [None, *rows[0][1][1:]], 2), (-1, [float("nan")] * width, 3), (-2, [*rows[0][1][1:], float("-inf")], 3)]
    got = vectorcodes.compress(spark.createDataFrame([(*r, "c", 1) for r in rows], VECTORS)).drop("label").collect()
    assert Counter(tuple(r) for r in got) == Counter(plain_codes(rows))


def test_vectors_of_other_lengths_and_empty_tables(spark):
    rows = [*some_vectors(20, 16, 1), (50, [1.0] * 24, 0), (51, [], None)]
    got = {r.vec_id: r for r in vectorcodes.compress(spark.createDataFrame([(*r, "c", 1) for r in rows], VECTORS)).collect()}
    assert len(got) == 22 and (got[50].code, got[50].error, got[51].code) == (None, None, None)
    assert {(r.vec_id, r.code) for r in got.values() if r.code} == {r[:2] for r in plain_codes(rows[:20])}
    for few in ([], [(1, None, 1)], [(1, [1.0, 2.0], 1)]):
        made = vectorcodes.compress(spark.createDataFrame([(*r, "c", 1) for r in few], VECTORS)).collect()
        assert [(r.vec_id, r.code) for r in made] == [(1, None)] * (len(few) and few[0][1] is not None)


def test_bounds_lose_nothing_and_spare_distances():
    for seed, top in ((0, 3), (1, 4000), (2, 2**26), (3, 2**40)):
        rng = np.random.default_rng(seed)
        centres = rng.integers(-top, top + 1, (16, 8))
        u = centres[rng.integers(0, 16, 3000)] + rng.integers(-top // 8 - 1, top // 8 + 2, (3000, 8))
        u[:16] = (centres + np.roll(centres, 1, axis=0)) // 2  # some are nearly as near to two
        if top > 2**30:
            u, centres = u.astype(object)[:200], centres.astype(object)
        entry, distance, computed = vectorcodes.nearest(u, centres)
        every = ((u[:, None] - centres[None]) ** 2).sum(2)
        assert (distance == every.min(1)).all() and (entry == np.array([row.tolist().index(min(row)) for row in every])).all()
        if top >= 4000:
            assert computed < 0.4 * every.size


def test_a_repeated_row_or_copies_do_not_push_a_language_out(spark):
    """Forty texts beside one row repeated thousands of times, and beside copies under many identifiers."""
    texts = [f"zeta {'quux ' * 5}number {chr(97 + k % 26)}{chr(97 + k // 26)} plugh" for k in range(40)]
    for copies in ([(0, "same row again")] * 30_000, [(3 * k, "same text under many ids") for k in range(30_000)]):
        rows = [(3 * k, t, "zz") for k, t in enumerate(texts)] + [(i, t, "zz") for i, t in copies]
        sample = langid.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))["zz"].split("\n")
        assert sorted(sample) == sorted({*(t for k, t in enumerate(texts) if zlib.crc32(str(3 * k).encode()) % 3 != 1), copies[0][1]})


@pytest.mark.parametrize("block", [4_000_000, 30])
def test_items_without_an_identifier_hit_and_common_windows_list_all(spark, block):
    items = [(None, "alpha beta gamma"), *((k, "delta epsilon") for k in range(500)), (None, "zeta")]
    docs = [(1, "Alpha beta, GAMMA ok"), (2, "delta epsilon"), (2, "delta epsilon"), (None, "a zeta"), (4, None), (5, "nothing")]
    got = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), block_bytes=block).collect()
    every = sorted(str(k) for k in range(500))
    assert sorted(((r.doc_id or 0, r.n_words, r.n_hit, r.items) for r in got)) == [(0, 2, 1, []), (1, 4, 3, []), (2, 2, 2, every), (2, 2, 2, every), (4, 0, 0, []), (5, 1, 0, [])]
    assert decontaminate.keep_clean(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), block_bytes=block).count() == 2


def test_long_secrets_are_found():
    for n in (31, 32, 128, 130, 100_000):
        found = [p for p in pii.proposals(f"the api key is {'a1' * n}"[: 15 + n] + " end") if p[0] == "secret"]
        assert [(a, b) for _, a, b, _, _ in found] == ([(15, 15 + n)] if n >= 32 else [])


def test_scratch_tables_belong_to_a_thread(spark):
    import threading

    made = []
    with common.scratch(spark):
        mine = common.materialise(spark.range(3))
        other = threading.Thread(target=lambda: made.append(common.materialise(spark.range(5))))
        other.start()
        other.join()
        assert mine.count() == 3
    assert made[0].count() == 5
    with pytest.raises(Exception, match="FILE_NOT_EXIST|PATH_NOT_FOUND"):
        mine.count()


def test_toxicity_sample_moves_no_text_through_one_task(spark):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(60)] + [(1, "text 1"), (1, "other")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, 0, k % 2) for k in range(60)], "doc_id bigint, quality int, toxic int")
    rows = toxicity._sample(docs, labels, "doc_id", "text", "toxic", 20).collect()
    assert len(rows) == 20 and all(r.toxic == r.doc_id % 2 and zlib.crc32(str(r.doc_id).encode()) % 5 for r in rows)
    assert {r.text for r in rows} <= {f"text {k}" for k in range(60)} | {"other"}
