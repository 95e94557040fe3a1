"""Personal data by weak supervision.

Base spans are exact: leftmost non-overlapping matches of one expression a kind, dropped where their check fails. Wider
expressions propose more spans (telephone numbers without a country's code, spelt-out addresses, secret keys). Labelers
vote on every proposal (for, against or no opinion): the regex labeler on how regular its form is, the gazetteer labeler on
top-level domains, issuers' digits, the numbering plan's area and exchange codes and reserved address blocks, the context
labeler on the words before it, the bounds labeler on what touches it. The corpus is reduced to counts of (kind, votes,
shape); expectation-maximisation over all of them estimates how far each labeler can be trusted, and a logistic regression
on votes, kind and the span's shape, trained on its posteriors, is the final span classifier. Base spans always stay; other
proposals stay if the classifier gives them 0.5 or more, they overlap no base span, and no proposal that starts earlier (or
there, and is longer) covers them.

The texts are read once: proposals with their votes are written, the model is fitted on the counts, and the classifier
is a table of at most kinds x 3^labelers x shapes decisions.

Defined results: null is the empty text, without spans; long texts cost time in proportion to their length; repeated
rows get equal results; an empty table has no rows. Offsets are code points, end exclusive.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_pass, materialise, table

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
LABELERS = ("regex", "gazetteer", "context", "bounds")
ROUNDS = 60

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"([0-9]++(?:\.[0-9]++){3})|[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NATIONAL = re.compile(r"(?<![0-9+(])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9])")
_SPELT = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:[\[(](?:dot|DOT)[\])]|\.) ?[A-Za-z0-9-]{1,63})+")
_SECRET = re.compile(r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,}+(?![0-9A-Za-z])")
_TLD = frozenset("com org net edu gov int io de fr es uk eu us ch at it nl info biz".split())
_CUES = {
    "email": "e-?mail|mail|contact|kontakt|correo|courriel",
    "ip": "ip|host|server|address|adresse",
    "card": "card|karte|carte|tarjeta|visa|credit",
    "phone": "phone|telephone|tel|call|fax|mobile",
    "secret": "token|key|secret|password|api",
}
_CUES = {kind: re.compile(rf"(?<![^\W_])(?:{words})(?![^\W_])") for kind, words in _CUES.items()}
#: Shapes of a span: three lengths, with and without letters.
SHAPES = 6


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str):
    """At each @: the local part is the run before it, back to the last match's end; both sides are read once."""
    free, before, at = 0, -1, text.find("@")
    while at >= 0:
        low = max(free, before + 1)
        start = low + len(text[low:at].rstrip(_LOCAL))
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
        before, at = at, text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """By kind as listed, then start."""
    out = [("email", a, b) for a, b in _emails(text)]
    out += [("ip", *m.span()) for m in _IP.finditer(text) if m[1] and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[1].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


def _wider(text: str) -> list[tuple[str, int, int]]:
    out = [("phone", *m.span()) for m in _NATIONAL.finditer(text)]
    if "(at)" in text or "[at]" in text or "(AT)" in text or "[AT]" in text:
        out += [("email", *m.span()) for m in _SPELT.finditer(text)]
    return out + [("secret", *m.span()) for m in _SECRET.finditer(text)]


def _votes(text: str, kind: str, start: int, end: int) -> tuple[int, ...]:
    """Of each labeler: 1 for, -1 against, 0 without an opinion."""
    span, digits = text[start:end], [c for c in text[start:end] if c.isdigit()]
    if kind == "email":
        last = re.split(r"[.\s)\]]", span.lower())[-1]
        form = 1 if span[0].isalnum() and len(last) >= 2 and last.isalpha() else -1
        known = 1 if last in _TLD else 0
    elif kind == "card":
        form = 1 if len(digits) == 16 and len(set(re.sub("[0-9]", "", span))) <= 1 else 0
        known = 1 if digits[0] in "23456" else -1
    elif kind == "phone":
        form = 1 if len(set(re.sub(r"[0-9+() ]", "", span))) <= 1 and len(digits) >= 10 else 0
        area = digits[-10:]
        planned = len(area) == 10 and area[0] > "1" and area[3] > "1" and area[1:3] != ["1", "1"]
        known = (1 if digits[0] != "0" else -1) if span[0] == "+" else 1 if planned else -1
    elif kind == "ip":
        parts = span.split(".")
        form = 1 if all(p == "0" or p[0] != "0" for p in parts) else -1
        known = -1 if parts[0] in ("0", "127", "255") or span.startswith("1.0.") else 1
    else:
        form = 1 if len(span) in (32, 40, 64, 128) and any(c.isalpha() for c in span) else 0
        known = 1 if 6 <= len(set(span.lower())) else -1
    cue = 1 if _CUES[kind].search(text[max(0, start - 24) : start].lower()) else 0
    touching = text[max(0, start - 1) : start] + text[end : end + 1]
    bound = -1 if any(c.isalnum() for c in touching) else 1
    return form, known, cue, bound


def shape(span: str) -> int:
    return min(2, len(span) // 16) * 2 + any(map(str.isalpha, span))


def proposals(text: str | None) -> list[tuple[str, int, int, bool, int]]:
    """(kind, start, end, whether it is a base span, its votes and shape as one number)."""
    if not text:
        return []
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    starts, ends = [a for a, _ in taken], list(itertools.accumulate((b for _, b in taken), max))
    out = [(k, a, b, True) for k, a, b in base]
    free = 0
    for kind, a, b in sorted(_wider(text), key=lambda s: (s[1], -s[2], s[0])):
        i = int(np.searchsorted(starts, b))
        if a >= free and (not i or ends[i - 1] <= a):
            out.append((kind, a, b, False))
            free = b
    return [(k, a, b, own, pattern(_votes(text, k, a, b), shape(text[a:b]))) for k, a, b, own in out]


def pattern(votes: tuple[int, ...], shape: int) -> int:
    return sum((v + 1) * 3**k for k, v in enumerate(votes)) + 3 ** len(votes) * shape


def fit(counts: dict[tuple[str, int], int]) -> dict[tuple[str, int], float]:
    """Probability that a proposal is personal data, for every kind and pattern of votes, from the counts of all."""
    every = list(itertools.product(range(len(KINDS)), itertools.product((-1, 0, 1), repeat=len(LABELERS)), range(SHAPES)))
    votes = np.array([v for _, v, _ in every])
    kinds, shapes = np.array([k for k, _, _ in every]), np.array([x for _, _, x in every])
    n = np.array([counts.get((KINDS[k], pattern(v, x)), 0) for k, v, x in every], float)
    onehot = np.stack([votes == x for x in (-1, 0, 1)], 2).astype(float)
    truth = np.clip(0.5 + 0.18 * votes.sum(1), 0.05, 0.95)  # the majority starts
    for _ in range(ROUNDS):
        sides = []
        for side in (truth, 1 - truth):
            mass = (n * side)[:, None, None] * onehot
            # an abstention says nothing about the truth, so both sides share its rate
            rates = mass.sum(0) + 1.0 + (np.array([0, 0, 2.0]) if side is truth else np.array([2.0, 0, 0]))
            sides.append(rates / rates.sum(1, keepdims=True))
        prior = np.array([((n * truth)[kinds == k].sum() + 2) / (n[kinds == k].sum() + 3) for k in range(len(KINDS))])
        log = [np.log(s)[None] * onehot for s in sides]
        gap = sum(x.sum((1, 2)) * sign for x, sign in zip(log, (1, -1), strict=True)) + np.log(prior / (1 - prior))[kinds]
        new = 1 / (1 + np.exp(-np.clip(gap, -30, 30)))
        if np.abs(new - truth).max() < 1e-9:
            break
        truth = new
    seen = n > 0
    if not seen.any():
        return {(KINDS[k], pattern(v, x)): 0.0 for k, v, x in every}
    inputs = np.column_stack([onehot[:, :, 0], onehot[:, :, 2], np.eye(len(KINDS))[kinds], np.eye(SHAPES)[shapes]])
    # soft labels: each pattern once for and once against, by its share of the proposals
    share = n[seen] / n[seen].sum() * min(n.sum(), 10_000)
    rows = np.vstack([inputs[seen], inputs[seen]])
    weights = np.concatenate([share * truth[seen], share * (1 - truth[seen])])
    w = _weighted_logistic(rows, np.concatenate([np.ones(seen.sum()), np.zeros(seen.sum())]), weights)
    p = 1 / (1 + np.exp(-np.clip(w[0] + inputs @ w[1:], -30, 30)))
    return {(KINDS[k], pattern(v, x)): float(q) for (k, v, x), q in zip(every, p, strict=True)}


def _weighted_logistic(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> np.ndarray:
    root = np.column_stack([np.ones(len(x)), x])
    w, ridge = np.zeros(root.shape[1]), np.diag([1e-3] + [0.1] * x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(root @ w, -30, 30)))
        step = np.linalg.solve((root * (weights * p * (1 - p))[:, None]).T @ root + ridge, root.T @ (weights * (y - p)) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


_SPAN = "struct<kind:string,start:int,end:int,base:boolean,votes:int>"
_SPAN_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("votes", pa.int32())]))


def _proposed(texts: list[str | None]) -> pa.Array:
    names = ("kind", "start", "end", "base", "votes")
    return pa.array([[dict(zip(names, p, strict=True)) for p in proposals(t)] for t in texts], _SPAN_ARROW)


def _accepted(found: DataFrame, column: str = "proposed") -> Column:
    """Fit on the counts of all proposals in ``found``; the accepted ones of a row, by kind as listed, then start."""
    counts = found.select(F.explode(column).alias("p")).groupBy("p.kind", "p.votes").count().collect()  # at most kinds x 3^labelers x shapes
    model = fit({(r["kind"], r["votes"]): r["count"] for r in counts})
    seen = {(r["kind"], r["votes"]) for r in counts}
    good = F.array(*[F.lit(f"{k}{v}") for (k, v), p in model.items() if p >= 0.5 and (k, v) in seen] or [F.lit("")])
    kept = F.filter(column, lambda p: p["base"] | F.array_contains(good, F.concat(p["kind"], p["votes"].cast("string"))))
    rank = F.create_map(*(F.lit(x) for pair in zip(KINDS, range(len(KINDS)), strict=True) for x in pair))
    ordered = F.array_sort(F.transform(kept, lambda p: F.struct(rank[p["kind"]].alias("rank"), p["start"].alias("start"), p["end"].alias("end"), p["kind"].alias("kind"), p["base"].alias("base"))))
    return F.transform(ordered, lambda p: F.struct(p["kind"].alias("kind"), p["start"].alias("start"), p["end"].alias("end"), p["base"].alias("base")))


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, spans (kind, start, end, base), by kind as listed, then start."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column(0), _proposed(part.column(1).to_pylist())], ["doc_id", "proposed"])

    chosen = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = materialise(arrow_pass(chosen, run, f"doc_id bigint, proposed array<{_SPAN}>"))
    return found.select("doc_id", _accepted(found).alias("spans"))


def redact(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs``, whole, with every span of its texts replaced by its kind in angle brackets. The proposals are made twice,
    once for the counts, so that the texts needn't be written an extra time."""
    at = docs.columns.index(text_col)

    def propose(part: pa.RecordBatch) -> pa.RecordBatch:
        rows = [p for t in part.column(0).to_pylist() for p in proposals(t)]
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in rows], pa.string()), pa.array([p[4] for p in rows], pa.int32())], ["kind", "votes"])

    counts = arrow_pass(docs.select(F.col(text_col)), propose, "kind string, votes int").groupBy("kind", "votes").count().collect()
    model = fit({(r["kind"], r["votes"]): r["count"] for r in counts})

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = pa.array([_without(t, model) for t in part.column(at).to_pylist()], part.schema.field(at).type)
        return pa.RecordBatch.from_arrays([texts if k == at else part.column(k) for k in range(part.num_columns)], part.schema.names)

    return arrow_pass(docs, run, docs.schema)


def _without(text: str | None, model: dict) -> str | None:
    spans = sorted((a, -b, k) for k, a, b, base, votes in proposals(text) if base or model[k, votes] >= 0.5)
    if not spans:
        return text
    out, free = [], 0
    for a, b, kind in spans:
        if a >= free:
            out += [text[free:a], f"<{kind}>"]
        free = max(free, -b)
    return "".join(out) + text[free:]


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _equal_to(kind: str):
    return lambda x: x == kind


def query(spark, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    number = [F.size(F.filter(F.transform(base, lambda s: s["kind"]), _equal_to(k))).cast("bigint").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select("doc_id", *number, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), F.size("spans").cast("bigint").alias("n_spans"))
