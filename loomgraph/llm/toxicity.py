"""Toxicity by a learned lexicon, Levenshtein automata and context windows.

The lexicon is learned from labelled rows that aren't held out: words that occur in far more toxic than other documents,
counted once for each group of near copies (documents of one least hash of four words), so that a copied text can't vote often.
Its terms form a trie. The Levenshtein automata of all terms, intersected with the trie, are made deterministic lazily:
a state is the set of (trie node, edits) that a prefix can reach, and most words fall into the empty state within three
letters. Misspelled terms are found at distance 1 from five letters on and 2 from nine on; variants that the labelled
rows show to be harmless are left alone.

A hit's context window tells quotation from abuse: hits next to quotation marks or reporting words weigh less, hits with
others nearby weigh more. A logistic regression over the sums is fitted on at most ``SAMPLE`` labelled rows.

Defined results: null and empty texts have no hits and get the score of a text without hits; without labels of both
kinds every score is the share of toxic labels (0 if there are none); repeated rows get equal scores; a document with
contradicting labels counts with each of them.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BoundedCache, arrow_pass, held, materialise, table

#: Labelled rows that the lexicon and the weights are fitted on, chosen by hash; toxic groups that a term is in at least.
SAMPLE, LEAST_GROUPS = 12_000, 5
#: Likelihood ratio against chance, of which one word in 100,000 has as much.
SURPRISE = 20.0
#: Words on either side that make a hit's context; words on either side looked at for signs of quotation.
WINDOW, NEAR = 25, 3
CACHE_LIMIT = 300_000
_QUOTES = frozenset("\"“”„«»‹›")
_REPORTING = frozenset(["said", "says", "quote", "quoted", "wrote", "called", "word", "term", "dit", "sagte", "dijo", "wort", "mot", "palabra"])
_EDGE = re.compile(r"^\W+|\W+$")
#: The boundaries that the lexicon is learned with.
_WORD = re.compile(r"[^\W_]+")
FEATURES = ("hits", "misspelled", "terms", "density", "context", "quoted")


def held_out(id_col: str) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def edits_allowed(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class FuzzyLexicon:
    """All terms within their allowed distance of a word, by a lazily determinised automaton over the terms' trie."""

    def __init__(self, terms: list[str]):
        self.children, self.term = [{}], [None]
        self.reach = [0]  # most edits that any term below a node allows
        for t in sorted(set(terms)):
            node = 0
            self.reach[0] = max(self.reach[0], edits_allowed(t))
            for c in t:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                    self.reach.append(0)
                node = self.children[node][c]
                self.reach[node] = max(self.reach[node], edits_allowed(t))
            self.term[node] = t
        start = self._closed({0: 0})
        self.states, self.ids, self.moves = [start], {start: 0}, [{}]

    def _closed(self, reached: dict[int, int]) -> frozenset:
        """With what deletions from the terms add: stepping down the trie without a letter."""
        stack = list(reached.items())
        while stack:
            node, edits = stack.pop()
            if reached.get(node, 99) < edits:
                continue
            for child in self.children[node].values():
                if edits < self.reach[child] and reached.get(child, 99) > edits + 1:
                    reached[child] = edits + 1
                    stack.append((child, edits + 1))
        return frozenset(reached.items())

    def _step(self, state: int, letter: str) -> int:
        reached: dict[int, int] = {}

        def put(node, edits):
            if edits <= self.reach[node] and reached.get(node, 99) > edits:
                reached[node] = edits

        for node, edits in self.states[state]:
            put(node, edits + 1)  # a letter too many
            for c, child in self.children[node].items():
                put(child, edits + (c != letter))
        to = self._closed(reached)
        if to not in self.ids:
            self.ids[to] = len(self.states)
            self.states.append(to)
            self.moves.append({})
        self.moves[state][letter] = self.ids[to]
        return self.ids[to]

    def find(self, word: str) -> tuple[str, int] | None:
        """The nearest term within its allowed distance (the first of equals) and the distance."""
        state = 0
        for c in word:
            to = self.moves[state].get(c)
            state = self._step(state, c) if to is None else to
            if not self.states[state]:
                return None
        found = [(e, self.term[n]) for n, e in self.states[state] if self.term[n] is not None and e <= edits_allowed(self.term[n])]
        return (min(found)[1], min(found)[0]) if found else None


class Scorer:
    def __init__(self, terms: list[str], harmless: frozenset = frozenset()):
        self.lexicon, self.harmless = FuzzyLexicon(terms), harmless
        self.known = BoundedCache(self._look, CACHE_LIMIT)

    def _look(self, token: str) -> tuple:
        """Of the words in a token; if there are none, of the whole, for terms that a mark splits."""
        words = _WORD.findall(token)
        found = tuple(hit for w in words if (hit := self._hit(w)) is not None)
        if found or words == [whole := _EDGE.sub("", token)]:
            return found
        return () if (hit := self._hit(whole)) is None else (hit,)

    def _hit(self, word: str) -> tuple[str, int, str] | None:
        found = self.lexicon.find(word)
        return None if found is None or (found[1] and word in self.harmless) else (*found, word)

    def hits(self, text: str | None) -> tuple[list[str], list[tuple[int, str, int, str]]]:
        """The tokens, and (position, term, distance, word) of each hit."""
        tokens = (text or "").lower().split()
        get = self.known.__getitem__
        return tokens, [(i, *hit) for i, found in enumerate(map(get, tokens)) for hit in found]

    def features(self, text: str | None) -> list[float]:
        tokens, hits = self.hits(text)
        if not hits:
            return [0.0] * len(FEATURES)
        at = np.array([h[0] for h in hits])
        quoted = np.array([self._quoted(tokens, i) for i in at])
        weight = np.where(quoted, 0.25, 1.0)
        sums = np.concatenate(([0], np.cumsum(weight)))
        around = sums[np.searchsorted(at, at + WINDOW, "right")] - sums[np.searchsorted(at, at - WINDOW, "left")]
        wrong = sum(1 for h in hits if h[2])
        return [
            float(np.log1p(weight.sum())), float(np.log1p(wrong)), float(min(8, len({h[1] for h, q in zip(hits, quoted, strict=True) if not q}))),
            float(min(20.0, 100 * weight.sum() / len(tokens))) / 5, float(min(6.0, around.max())), float(quoted.mean()),
        ]

    @staticmethod
    def _quoted(tokens: list[str], at: int) -> bool:
        near = tokens[max(0, at - NEAR) : at + NEAR + 1]
        return any(_QUOTES.intersection(t) or t.strip(".,:;!?") in _REPORTING for t in near)


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, size: int) -> DataFrame:
    """At most ``size`` labelled rows that aren't held out, with their texts; the limit makes the broadcasts' bound. Rows that
    repeat a labelled id and text count once, and the bound holds again after them. Rows are chosen by keys, so no task gets
    the texts of all."""
    chosen = labels.where(~held_out(id_col) & F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    chosen = chosen.select(F.col(id_col).cast("bigint").alias("doc_id"), (F.col(label_col) == 1).cast("int").alias("toxic")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(size)
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    found = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "key").distinct()
    keys = found.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic", "key").limit(size)
    return texts.join(F.broadcast(keys), ["doc_id", "key"]).groupBy("doc_id", "toxic", "key").agg(F.min("text").alias("text")).select("doc_id", "text", "toxic")


def learn_lexicon(sample: DataFrame) -> list[str]:
    """Words of far more groups of toxic documents than others', by log odds and likelihood ratio."""
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 1)
    rows = sample.select("toxic", words.alias("ws")).where(F.size("ws") > 0)
    # four words in a row are rarely common to documents that aren't copies
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("ws") - 3, F.lit(1))), lambda i: F.xxhash64(F.slice("ws", i, 4)))
    rows = rows.withColumn("grp", F.array_min(runs)).withColumn("ws", F.array_distinct("ws"))
    totals = rows.groupBy("toxic").agg(F.countDistinct("grp").alias("n"))
    n = {r["toxic"]: r["n"] for r in totals.collect()}
    if not n.get(0) or not n.get(1):
        return []
    once = rows.select("toxic", "grp", F.explode("ws").alias("w")).distinct()
    counts = once.groupBy("w").agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("q"))
    odds = F.log((F.col("p") + 0.5) / (n[1] - F.col("p") + 0.5)) - F.log((F.col("q") + 0.5) / (n[0] - F.col("q") + 0.5))
    share, p, q = n[1] / (n[0] + n[1]), F.col("p"), F.col("q")
    part = lambda k, expected: F.when(k > 0, k * F.log(k / expected)).otherwise(F.lit(0.0))
    surprise = 2 * (part(p, (p + q) * share) + part(q, (p + q) * (1 - share)))
    # in five toxic groups at least; the terms are as many as the sample's words bear out
    chosen = counts.where((p >= LEAST_GROUPS) & (odds > 2) & (surprise > SURPRISE))
    return sorted(r["w"] for r in chosen.collect())


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights with the intercept first, by Newton's method; the intercept isn't penalised."""
    x = np.column_stack([np.ones(len(x)), x])
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-6] + [penalty] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _mapped(df: DataFrame, model: tuple, fn, column: str, kind: pa.DataType, sql: str) -> DataFrame:
    """``df`` (doc_id, text, one more) with the text replaced by what ``fn`` makes of it with the worker's scorer."""
    sent, name = df.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    middle, middle_sql = df.dtypes[1]

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        scorer = held(name, lambda: Scorer(*sent.value[:2]))
        return pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([fn(scorer, t) for t in part.column(2).to_pylist()], kind)], ["doc_id", middle, column])

    return arrow_pass(df, run, f"doc_id bigint, {middle} {middle_sql}, {column} {sql}", 2048)


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE) -> tuple:
    """(terms, harmless variants, weights), of at most ``sample_rows`` labelled rows."""
    sample = materialise(_sample(docs, labels, id_col, text_col, label_col, sample_rows))
    terms = learn_lexicon(sample)
    rows = sample.select("doc_id", "toxic", "text")
    if not terms:
        share = rows.agg(F.avg("toxic")).first()[0] or 0.0
        return [], frozenset(), np.array([np.log((share + 1e-4) / (1 - share + 1e-4))] + [0.0] * len(FEATURES))
    variants = _mapped(rows, (terms, frozenset()), lambda s, t: sorted({h[3] for h in s.hits(t)[1] if h[2]}), "words", pa.list_(pa.string()), "array<string>")
    counts = variants.select("toxic", F.explode("words").alias("w")).groupBy("w").agg(F.sum("toxic").alias("p"), F.count(F.lit(1)).alias("n"))
    base = rows.agg(F.avg("toxic")).first()[0]
    # seen in other documents twice, and not clearly more often among the toxic than they are themselves
    harmless = frozenset(r["w"] for r in counts.where((F.col("n") - F.col("p") >= 2) & (F.col("p") <= F.lit(max(0.5, 2 * base)) * F.col("n"))).collect())
    made = _mapped(rows, (terms, harmless), lambda s, t: s.features(t), "f", pa.list_(pa.float64()), "array<double>").select("toxic", "f").collect()
    x, y = np.array([r["f"] for r in made]), np.array([r["toxic"] for r in made], float)
    return terms, harmless, fit_logistic(x, y)


def score(docs: DataFrame, model: tuple, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted."""
    terms, harmless, weights = model
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))

    def value(scorer: Scorer, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(weights[0] + np.dot(weights[1:], scorer.features(text)), -30, 30))))

    return _mapped(rows, (terms, harmless), value, "score", pa.float64(), "double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
