"""Language identification by cross-parsing entropy.

A suffix automaton holds a bounded sample of labelled text of each language. A text is parsed greedily into phrases, each
the longest match of the remaining text that occurs in the sample. A phrase costs the logarithm of the sample's length (the
bits of a pointer into it), a letter that the sample lacks costs a phrase and the bits of a symbol; the language with the
cheapest parse wins. So a short sample pays for its short phrases, and no language wins by having seen little. Texts are
cut into blocks of ``BLOCK`` symbols that are parsed on their own and their costs added, so that all blocks of a slice
advance together, two look-ups a symbol and language.

The automata of all languages are built once, on the driver, and packed into one double array (a transition of a state is
the slot at the state's base plus the symbol, checked by its owner), so that any number of letters costs no width. Its size
follows from the bounds of the sample; it is broadcast, and workers look up in the broadcast arrays themselves.

The sample: for each language at most ``docs_per_language`` distinct labelled texts chosen by hash and the first
``symbols_per_language`` symbols of them joined. Languages whose sample has no letter aren't learned. Every document is then
parsed whole.

Defined results: null texts and texts without letters are ``und`` with score 0; if nothing is labelled all are ``und``;
ties go to the language that comes first in alphabetical order; repeated rows get equal results.
"""

from __future__ import annotations

import sys
import unicodedata
import uuid
from array import array
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_pass, held, table

DOCS_PER_LANGUAGE, SYMBOLS_PER_LANGUAGE, BLOCK = 150, 30_000, 1024
#: Symbols: letters that no sample has, and whatever isn't a letter.
UNKNOWN, GAP = 0, 1
#: Bits of difference between two languages' parses that make their odds e to 1.
SOFTNESS = 25.0
#: A text needing more phrases a symbol than this times its language's own held-out rate is like no learned language.
STRANGE = 1.75
#: Bytes of texts parsed at once: the parse holds some forty bytes for each.
PASS_BYTES = 2_000_000


@cache
def letters() -> np.ndarray:
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def automaton_moves(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton, by state."""
    moves, link, length, last = [{}], [-1], [0], 0
    for c in symbols:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return moves


def packed(rows: list[dict[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A double array of transitions: (base of each state, owner of each slot or -1, target). States of many transitions are
    placed first, at the first of some free slots that suits them or beyond the last; those of one fill what is left."""
    width = 1 + max((max(r) for r in rows if r), default=0)
    size = 2 * sum(map(len, rows)) + 4 * width
    owner, target, base = array("i", [-1]) * size, array("i", [0]) * size, array("i", [0]) * len(rows)
    used, low, top = bytearray(size), width, width

    def grown(to: int) -> None:
        if to > len(used):
            more = max(to, 2 * len(used)) - len(used)
            used.extend(bytes(more))
            owner.extend(array("i", [-1]) * more)
            target.extend(array("i", [0]) * more)

    def put(state: int, at: int, row: dict[int, int]) -> None:
        base[state] = at
        for c, to in row.items():
            used[at + c], owner[at + c], target[at + c] = 1, state, to

    for state in sorted((k for k, r in enumerate(rows) if len(r) > 1), key=lambda k: -len(rows[k])):
        row = rows[state]
        letters_ = sorted(row)
        least, at, tries = letters_[0], low, 0
        while tries < 12 and at < top:
            at = used.find(0, at)
            tries += 1
            if at < 0 or at >= top or (at - least + letters_[-1] < len(used) and not any(used[at - least + c] for c in letters_)):
                break
            at += 1
        if at < 0 or at >= top or tries >= 12:
            at = top
        grown(at + width + 1)
        put(state, at - least, row)
        top = max(top, at - least + letters_[-1] + 1)
        low = max(used.find(0, low), low) if tries < 12 else max(low, at - 4 * width, top - 20 * width)
    single = [k for k, r in enumerate(rows) if len(r) == 1]
    grown(top + len(single) + width)
    free = np.flatnonzero(np.frombuffer(bytes(used), np.uint8)[width:] == 0)[: len(single)] + width
    for state, slot in zip(single, free.tolist(), strict=True):
        ((c, to),) = rows[state].items()
        put(state, slot - c, {c: to})
    end = used.rfind(1) + width + 2
    grown(end)
    return tuple(np.array(x, np.int32) for x in (base, owner[:end], target[:end]))


class Parser:
    """The automata of all languages in one double array. Made on the driver; its arrays are what is broadcast."""

    def __init__(self, samples: dict[str, str], symbols_per_language: int = SYMBOLS_PER_LANGUAGE):
        samples = {k: t for k, t in samples.items() if any(map(str.isalpha, t))}
        self.languages = sorted(samples)
        common = Counter()
        for text in samples.values():
            common.update(c for c in text.lower() if c.isalpha())
        alphabet = {c: k for k, (c, _) in enumerate(common.most_common(), 2)}
        self.width = len(alphabet) + 2
        self.classes = np.where(letters(), UNKNOWN, GAP).astype(np.min_scalar_type(self.width))
        for c, k in alphabet.items():
            self.classes[ord(c)] = k
        for c, k in alphabet.items():  # a form of two letters is the commoner one's
            for form in {c.upper(), c.title()}:
                if len(form) == 1 and self.classes[ord(form)] == UNKNOWN:
                    self.classes[ord(form)] = k
        for c in set().union(*samples.values()):  # letters that no letter's capital is
            if self.classes[ord(c)] == UNKNOWN:
                self.classes[ord(c)] = alphabet.get(c.lower()[0], UNKNOWN)
        rows, roots, bits = [], [], []
        for language in self.languages:
            symbols = self.symbols([samples[language]])[0][:symbols_per_language]
            offset = len(rows)
            rows += [{c: to + offset for c, to in row.items()} for row in automaton_moves(symbols[symbols != UNKNOWN].tolist())]
            roots.append(offset)
            bits.append(float(np.log2(max(2, symbols.size))))
        self.roots, self.bits = np.array(roots, np.int32), np.array(bits)
        #: Bits of a letter told outright.
        self.literal = float(np.log2(self.width + 1))
        self.base, self.owner, self.target = packed(rows)
        if self.languages:
            self.first = self._next(np.repeat(self.roots[:, None], self.width, 1), np.arange(self.width))

    def _next(self, state: np.ndarray, sym: np.ndarray) -> np.ndarray:
        """Targets [language, text], -1 where there is none."""
        at = self.base[state] + sym
        return np.where(self.owner[at] == state, self.target[at], -1)

    def symbols(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Classes of all code points, runs of gaps as one, and the end of each text in them."""
        flat = self.classes[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
        ends = np.cumsum([len(t) for t in texts])
        keep = np.ones(flat.size, bool)
        keep[1:] = (flat[1:] != GAP) | (flat[:-1] != GAP)
        kept = np.concatenate(([0], np.cumsum(keep)))
        return flat[keep], kept[ends]

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Phrases and letters that the sample lacks [text, language], symbols and whether there are letters [text]."""
        flat, ends = self.symbols(texts)
        starts = np.concatenate(([0], ends[:-1]))
        sizes = ends - starts
        blocks = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(texts)), blocks)
        rank = np.arange(owner.size) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        begin = starts[owner] + rank * BLOCK
        length = np.minimum(BLOCK, ends[owner] - begin)
        order = np.argsort(-length, kind="stable")
        begin, length, owner = begin[order], length[order], owner[order]
        n_lang, n = len(self.languages), owner.size
        count, literal = np.ones((n_lang, n), np.int32), np.zeros((n_lang, n), np.int32)
        state = np.repeat(self.roots[:, None], n, 1)
        live = np.searchsorted(-length, -np.arange(BLOCK), "left")
        for at in range(int(length[0]) if n else 0):
            k = int(live[at])
            sym = flat[begin[:k] + at]
            now = self._next(state[:, :k], sym)
            lang, col = np.nonzero(now < 0)
            if lang.size:
                if at:
                    count[lang, col] += 1
                to = self.first[lang, sym[col]]
                lacking = to < 0
                literal[lang[lacking], col[lacking]] += 1
                now[lang, col] = np.where(lacking, self.roots[lang], to)
            state[:, :k] = now
        total, outright = np.zeros((2, len(texts), n_lang), np.int64)
        for k in range(n_lang):
            total[:, k] = np.bincount(owner, count[k], len(texts))
            outright[:, k] = np.bincount(owner, literal[k], len(texts))
        has = np.concatenate(([0], np.cumsum(flat != GAP)))
        return total, outright, sizes, has[ends] > has[starts]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float, float]]:
        """Language, score, the winner's phrases a symbol and a lower bound of that rate for short texts (0 for ``und``)."""
        if not self.languages or not texts:
            return [("und", 0.0, 0.0, 0.0)] * len(texts)
        total, outright, sizes, has = self.phrases([t or "" for t in texts])
        cost = total * self.bits + outright * self.literal
        best = cost.argmin(1)
        odds = np.exp(-(cost - cost.min(1, keepdims=True)) / SOFTNESS).sum(1)
        rate = total[np.arange(len(texts)), best] / np.maximum(sizes, 1)
        least = rate - 3 * np.sqrt(rate / np.maximum(sizes, 1))
        return [(self.languages[b], float(1 / o), float(r), float(x)) if h else ("und", 0.0, 0.0, 0.0) for b, o, r, x, h in zip(best.tolist(), odds, rate, least, has.tolist(), strict=True)]


def held_out(id_col: str) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def fit(docs: DataFrame, *, docs_per_language: int = DOCS_PER_LANGUAGE, symbols_per_language: int = SYMBOLS_PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, str]:
    """Sample text of each label, from rows that aren't held out: at most ``docs_per_language`` distinct texts, and twice
    ``symbols_per_language`` characters of them."""
    key = F.xxhash64(F.col(text_col))  # of the text alone: copies, under one or many identifiers, are one text
    rows = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in rows.select(F.col(lang_col).alias("l"), key.alias("k")).distinct().groupBy("l").count().collect()}  # one row for each language
    if not counts:
        return {}
    # a first choice by hash, so that few texts are sorted; the bound itself is the row number
    spread = F.pmod(key, F.lit(1 << 30))
    share = F.create_map(*(x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1 << 30, int((1 << 30) * 2 * docs_per_language / n) + 1)))))
    few = rows.where(spread < share[F.col(lang_col)]).select(F.col(lang_col).alias("l"), spread.alias("k"), F.substring(text_col, 1, 2 * symbols_per_language).alias("t"))
    chosen = few.groupBy("l", "k").agg(F.min("t").alias("t")).withColumn("n", F.row_number().over(Window.partitionBy("l").orderBy("k"))).where(F.col("n") <= docs_per_language)
    found: dict[str, list] = {lang: [] for lang in counts}
    for r in chosen.toLocalIterator():
        found[r["l"]].append((r["k"], r["t"]))
    return {lang: "\n".join(t for _, t in sorted(some))[: 2 * symbols_per_language] for lang, some in found.items()}


def usual_rates(samples: dict[str, str], piece: int = 400) -> dict[str, float]:
    """For each language, phrases a symbol of pieces of its sample's second half under the automaton of the first half: their
    median, as pieces that are near copies of something in the first half take hardly any phrases."""
    out = {}
    for language, text in samples.items():
        half = len(text) // 2
        pieces = [text[k : k + piece] for k in range(half, max(half + 1, len(text) - piece // 2), piece)]
        rates = [rate for _, _, rate, _ in Parser({language: text[:half]}).predict(pieces) if rate]
        out[language] = float(np.median(rates)) if rates else 1.0
    return out


def identify(docs: DataFrame, samples: dict[str, str], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score, phrase_rate."""
    sent, name = docs.sparkSession.sparkContext.broadcast(Parser(samples)), uuid.uuid4().hex

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        found = held(name, lambda: sent.value).predict(part.column(2).to_pylist())
        return pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score", "phrase_rate"])

    chosen = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return arrow_pass(chosen, run, "doc_id bigint, held_out boolean, lang_pred string, score double, phrase_rate double", 2048, PASS_BYTES)


def keep_known(docs: DataFrame, samples: dict[str, str], *, text_col: str = "text", strange: float = STRANGE) -> DataFrame:
    """The rows of ``docs``, whole, whose text is in one of the learned languages: not ``und``, and not certainly
    parsed by more phrases a symbol than ``strange`` times that language's own rate."""
    at, usual = docs.columns.index(text_col), usual_rates(samples)
    sent, name = docs.sparkSession.sparkContext.broadcast(Parser(samples)), uuid.uuid4().hex

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        found = held(name, lambda: sent.value).predict(part.column(at).to_pylist())
        return part.filter(pa.array([lang != "und" and least <= strange * usual[lang] for lang, _, _, least in found], pa.bool_()))

    return arrow_pass(docs, run, docs.schema, 2048, PASS_BYTES)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs))
