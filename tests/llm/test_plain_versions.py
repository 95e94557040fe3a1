"""Queries that no SQL expresses, whole, against versions written with plain loops over a small fixture."""

import itertools
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from loomgraph.llm import langid, pii, toxicity


def written(spark, path, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


# --- language ID: cross-parsing by substring search


def symbols(text, alphabet):
    """Known letters, ? for others, one blank for each run of what isn't a letter."""
    return re.sub(" +", " ", "".join((c.lower() if c.lower() in alphabet else "?") if c.isalpha() else " " for c in text))


def plain_language(text, samples):
    if text is None or not any(map(str.isalpha, text)):
        return "und", 0.0
    alphabet = {c for t in samples.values() for c in t.lower() if c.isalpha()}
    costs = {}
    for lang, sample in sorted(samples.items()):
        known = symbols(sample, alphabet)[: langid.SYMBOLS_PER_LANGUAGE]
        phrases = lacking = 0
        whole = symbols(text, alphabet)
        for block in (whole[k : k + langid.BLOCK] for k in range(0, len(whole), langid.BLOCK)):
            at = 0
            while at < len(block):
                phrases += 1
                if block[at] not in known:
                    lacking, at = lacking + 1, at + 1
                n = 0
                while at + n < len(block) and block[at : at + n + 1] in known:
                    n += 1
                at += n
        costs[lang] = phrases * math.log2(max(2, len(known))) + lacking * math.log2(len(alphabet) + 3)
    best = min(costs, key=lambda k: (costs[k], k))
    return best, 1 / sum(math.exp(-(c - costs[best]) / langid.SOFTNESS) for c in costs.values())


def test_language_query_equals_plain_parsing(spark, tmp_path):
    rng = random.Random(2)
    syllables = {"de": ["sch", "ein", "ü", "ung", "der", "ich"], "es": ["ción", "la", "ñ", "que", "os", "ra"], "en": ["th", "ing", "of", "er", "and", "st"]}
    word = lambda lang: "".join(rng.choices(syllables[lang], k=rng.randrange(1, 4)))
    texts = [(" ".join(word(lang) for _ in range(rng.randrange(1, 40))).capitalize() + rng.choice([".", " 12!", ""]), lang) for lang in syllables for _ in range(25)]
    texts += [(None, "en"), ("", "de"), ("123 !", None), ("Ωμέγα ßß the", None), ("ing " * 2000 + "Ж", "en"), (texts[0][0], "de"), ("th", None), ("xqxq zz", "en")]
    rng.shuffle(texts)
    rows = [(k, t, lang, "s") for k, (t, lang) in enumerate(texts)]
    where = written(spark, tmp_path, documents=(rows, "doc_id bigint, text string, lang string, source string"))
    chosen = defaultdict(dict)
    for k, t, lang, _ in rows:
        if lang and t is not None and crc(k) % 3 != 1:
            chosen[lang][xxhash.xxh64_intdigest(t, 42) & ((1 << 30) - 1)] = t
    samples = {lang: "\n".join(t for _, t in sorted(own.items())) for lang, own in chosen.items()}
    got = {r.doc_id: r for r in langid.query(spark, where).collect()}
    assert len(got) == len(rows)
    for k, text, _, _ in rows:
        name, score = plain_language(text, samples)
        assert (got[k].held_out, got[k].lang_pred) == (crc(k) % 3 == 1, name) and got[k].score == pytest.approx(score, abs=1e-12), (k, text)


# --- toxicity: every term against every word


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def plain_features(text, terms, harmless):
    tokens, hits = (text or "").lower().split(), []

    def near(word):
        found = min(((d, t) for t in terms if (d := distance(word, t)) <= (0 if len(t) < 5 else 1 if len(t) < 9 else 2)), default=None)
        return None if found is None or (found[0] and word in harmless) else found

    for i, token in enumerate(tokens):
        words = re.findall(r"[^\W_]+", token)
        found = [f for w in words if (f := near(w))]
        whole = re.sub(r"^\W+|\W+$", "", token)
        if not found and words != [whole] and (f := near(whole)):
            found = [f]
        hits += [(i, *f) for f in found]
    if not hits:
        return [0.0] * 6
    quoted = [any(set(t) & set("\"“”„«»‹›") or t.strip(".,:;!?") in toxicity._REPORTING for t in tokens[max(0, i - 3) : i + 4]) for i, _, _ in hits]
    weight = [0.25 if q else 1.0 for q in quoted]
    around = max(sum(w for w, (j, _, _) in zip(weight, hits, strict=True) if abs(i - j) <= 25) for i, _, _ in hits)
    return [math.log1p(sum(weight)), math.log1p(sum(d > 0 for _, d, _ in hits)), min(8, len({t for (_, _, t), q in zip(hits, quoted, strict=True) if not q})), min(20.0, 100 * sum(weight) / len(tokens)) / 5, min(6.0, around), sum(quoted) / len(quoted)]


def test_toxicity_query_equals_plain_scores(spark, tmp_path):
    rng = random.Random(9)
    plain, bad = [f"plain{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(90)], ["scum", "idiot", "disgusting"]

    def spoilt(word):
        at = rng.randrange(1, len(word) - 1)
        return rng.choice([word, word, word[:at] + word[at + 1 :], word[:at] + "x" + word[at:], word.upper(), f"({word})!", f"x/{word}"])

    rows, labels = [], []
    for k in range(260):
        words = rng.choices(plain, k=rng.randrange(5, 60))
        if k % 3 == 0:
            for _ in range(rng.randrange(1, 5)):
                words.insert(rng.randrange(len(words)), spoilt(rng.choice(bad)))
        if k % 11 == 0:
            words += ["he", "said", "“idiot”", "once"]
        rows.append((k, " ".join(words), None, "s"))
        labels.append((k, 1, rng.choice([None, 0]) if k % 40 == 1 else int(k % 3 == 0)))
    rows += [(900, None, "en", "s"), (901, "", "en", "s"), (902, "idiot " * 500, "en", "s"), (903, "idioot iidiot disgustin disgusxtingx", "en", "s")]
    docs = (rows, "doc_id bigint, text string, lang string, source string")
    where = written(spark, tmp_path, documents=docs, labels=(labels, "doc_id bigint, quality int, toxic int"))
    terms, harmless, weights = toxicity.fit(spark.createDataFrame(*docs), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    assert set(bad) <= set(terms)
    texts, made = {r[0]: r[1] for r in rows}, {}
    got = {r.doc_id: r for r in toxicity.query(spark, where).collect()}
    for k, text in texts.items():
        made[k] = plain_features(text, terms, harmless)
        score = 1 / (1 + math.exp(-(weights[0] + sum(w * f for w, f in zip(weights[1:], made[k], strict=True)))))
        assert got[k].held_out == (crc(k) % 5 == 0) and got[k].score == pytest.approx(score, abs=1e-9) and got[k].predicted == (score >= 0.5)
    # the weights are where the penalised likelihood of the sample is greatest: no slope is left
    sample = [(made[k], y) for k, _, y in labels if y is not None and crc(k) % 5]
    for j in range(7):
        slope = sum((y - 1 / (1 + math.exp(-(weights[0] + np.dot(weights[1:], f))))) * (1.0 if j == 0 else f[j - 1]) for f, y in sample)
        assert abs(slope - (1e-6 if j == 0 else 1.0) * weights[j]) < 1e-5


# --- personal data: expectation-maximisation and the classifier over single proposals


def plain_model(rows):
    """Rows of (kind, votes, shape), one for each proposal; probabilities of those kinds of row."""
    kinds = list(pii.KINDS)
    truth = [min(0.95, max(0.05, 0.5 + 0.18 * sum(v))) for _, v, _ in rows]
    for _ in range(pii.ROUNDS):
        rates = []
        for sign in (1, 0):
            side = []
            for k in range(len(pii.LABELERS)):
                mass = {-1: 1.0 + (2.0 if not sign else 0.0), 0: 1.0, 1: 1.0 + (2.0 if sign else 0.0)}
                for t, (_, v, _) in zip(truth, rows, strict=True):
                    mass[v[k]] += t if sign else 1 - t
                side.append({x: m / sum(mass.values()) for x, m in mass.items()})
            rates.append(side)
        prior = {}
        for kind in kinds:
            own = [t for t, (k, _, _) in zip(truth, rows, strict=True) if k == kind]
            prior[kind] = (sum(own) + 2) / (len(own) + 3)
        new = []
        for kind, v, _ in rows:
            gap = math.log(prior[kind] / (1 - prior[kind])) + sum(math.log(rates[0][k][x]) - math.log(rates[1][k][x]) for k, x in enumerate(v))
            new.append(1 / (1 + math.exp(-max(-30.0, min(30.0, gap)))))
        done = max(abs(a - b) for a, b in zip(new, truth, strict=True)) < 1e-9
        truth = truth if done else new
        if done:
            break
    inputs = lambda kind, v, s: [1.0, *(float(x == -1) for x in v), *(float(x == 1) for x in v), *(float(kind == k) for k in kinds), *(float(s == k) for k in range(pii.SHAPES))]
    x = np.array([inputs(*r) for r in rows] * 2)
    y, weight = np.array([1.0] * len(rows) + [0.0] * len(rows)), np.array([*truth, *(1 - t for t in truth)]) * min(1.0, 10_000 / len(rows))
    w, ridge = np.zeros(x.shape[1]), np.array([1e-3] + [0.1] * (x.shape[1] - 1))
    for _ in range(200):
        p = 1 / (1 + np.exp(-x @ w))
        w = w + np.linalg.solve((x.T * (weight * p * (1 - p))) @ x + np.diag(ridge), x.T @ (weight * (y - p)) - ridge * w)
    return {r: float(1 / (1 + np.exp(-np.dot(w, inputs(*r))))) for r in set(rows)}


def test_personal_data_query_equals_plain_estimation(spark, tmp_path):
    rng = random.Random(5)
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    makers = [
        lambda: f"mail me: jo.{rng.choice('abc')}x@site{digits(1)}.{rng.choice(['com', 'zz', 'de'])}", lambda: f"reach ann{digits(2)} [at] host [dot] {rng.choice(['org', 'q'])} now",
        lambda: f"call ({rng.randrange(200, 999)}) {rng.randrange(200, 999)}-{digits(4)}", lambda: f"no {digits(3)}-{digits(3)}-{digits(4)} there", lambda: f"phone +49 {digits(3)} {digits(7)}",
        lambda: f"host {rng.randrange(300)}.{rng.randrange(300)}.1.{rng.randrange(256)}", lambda: "api key " + "".join(rng.choices("0123456789abcdef", k=rng.choice([32, 33, 40, 64, 200]))),
        lambda: "sum " + digits(rng.choice([32, 40])), lambda: "plain words and a dot .",
    ]
    rows = [(k, " ".join(rng.choice(makers)() for _ in range(rng.randrange(4))) if k % 17 else None, "en", "s") for k in range(150)]
    where = written(spark, tmp_path, documents=(rows, "doc_id bigint, text string, lang string, source string"))

    def votes(number):
        own = [number // 3**k % 3 - 1 for k in range(len(pii.LABELERS))]
        return tuple(own), number // 3 ** len(pii.LABELERS)

    proposed = {k: pii.proposals(text) for k, text, _, _ in rows}
    every = [(kind, *votes(n)) for own in proposed.values() for kind, _, _, _, n in own]
    model = plain_model(every)
    assert 0 < sum(p >= 0.5 for p in model.values()) < len(model) or min(model.values()) > 0.5
    got = {r.doc_id: r for r in pii.query(spark, where).collect()}
    added = 0
    for k, own in proposed.items():
        kept = [(pii.KINDS.index(kind), a, b, kind) for kind, a, b, base, n in own if base or model[kind, *votes(n)] >= 0.5]
        added += sum(not base for _, _, _, base, _ in own)
        assert got[k].spans == ",".join(f"{kind}:{a}:{b}" for _, a, b, kind in sorted(kept))
        assert all(b <= c for (_, a, b, _), (_, c, _, _) in itertools.pairwise(sorted(s for s in kept if s[3] == "secret")))
    assert added > 20
