"""Vector code compression: product quantisation in whole numbers, nearest entries by segment-mean lower bounds.

A vector's components become floor(``SCALE`` x) and are cut into ``PARTS`` consecutive parts. Each part has a codebook that starts as
the parts of the vectors of the least identifiers and is moved ``ROUNDS`` times to the floor of the mean of what is assigned to
each entry. A vector's code is the index of its nearest entry in each part, the lower one of equally near ones.

Lower bounds, coarse to fine: cut into blocks of w components, a part's block sums S and the norm of what is left when block
means are taken off, r, bound the distance from below, w d(u, c) >= |S_u - S_c|^2 + w (r_u - r_c)^2. The entry of the least bound
gives a first exact distance; entries whose bound is above it can't be nearest, first with one block, then with blocks of half
the width, down to two components. Sums are whole numbers and norms are rounded towards a lower bound, so nothing that is nearest
or equally near is ever dropped. Survivors get their exact distance. Numbers too large for 64 bits are held as Python's.

A round reads the table once; a task emits a row of sums for each part and entry, Spark adds them up, and the driver gets
``PARTS`` x ``ENTRIES`` rows, whatever the table's size. Codebooks go out with the next round's tasks. Errors are summed by label with
partial sums; labels of a thousandth of the rows or more (a thousand at most) come back by broadcast, others by a join.

Defined results: a vector that is null or has a null or non-finite component is dropped; one whose length isn't that of the
kept vector of the least identifier, or no multiple of ``PARTS``, stays with a null code and error; a null identifier comes after all
others, and equal ones in the order of their vectors; fewer vectors than entries make smaller codebooks; repeated rows are rows
like others; components beyond 1e27 count as that, sums beyond a bigint as the largest; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_pass, materialise, table

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Vectors handled at once, the largest component, and the share of rows that makes a label a common one.
ROWS, LARGEST, COMMON = 4096, 1e27, 1000
_LAST = (1 << 63) - 1


def whole(x: np.ndarray) -> np.ndarray:
    """floor(``SCALE`` x) as int64, or as Python integers where a squared distance might not fit 64 bits."""
    x = np.floor(np.clip(x * SCALE, -LARGEST, LARGEST))
    peak = float(np.abs(x).max(initial=0.0))
    return x.astype(np.int64) if 4.0 * (peak * x.shape[-1]) ** 2 < 2.0**61 else np.vectorize(int, otypes=[object])(x)


def _blocks(v: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Block sums of the rows of ``v``, and the norms of what block means leave, times the root of ``width``."""
    sums = v.reshape(len(v), -1, width).sum(2)
    return sums, np.sqrt((width * (v * v).sum(1) - (sums * sums).sum(1)).astype(np.float64))


def _bound(su, ru, sc, rc, exact) -> np.ndarray:
    """``width`` times a lower bound of the squared distance; the last axis of the sums is the blocks'."""
    gap = np.maximum(np.abs(ru - rc) - (ru + rc) * 1e-12, 0.0)
    least = np.floor(gap * gap * (1 - 1e-12))
    return ((su - sc) ** 2).sum(-1) + (least.astype(np.int64) if exact else np.vectorize(int, otypes=[object])(least))


def nearest(u: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each row of ``u`` the index of its nearest row of ``entries`` and the squared distance; how many were computed."""
    small = u.dtype == np.int64 and entries.dtype == np.int64
    if not small:
        u, entries = u.astype(object), entries.astype(object)
    rows, width = np.arange(len(u)), u.shape[1]
    (su, ru), (sc, rc) = _blocks(u, width), _blocks(entries, width)
    bound = _bound(su[:, None], ru[:, None], sc[None], rc[None], small)
    first = bound.argmin(1)
    best = ((u - entries[first]) ** 2).sum(1)
    at, entry = np.nonzero(bound <= (best * width)[:, None])
    while width % 2 == 0 and width > 2:
        width //= 2
        (su, ru), (sc, rc) = _blocks(u, width), _blocks(entries, width)
        left = _bound(su[at], ru[at], sc[entry], rc[entry], small) <= best[at] * width
        at, entry = at[left], entry[left]
    exact = ((u[at] - entries[entry]) ** 2).sum(1)
    if small:
        known = np.full(bound.shape, np.iinfo(np.int64).max)
        known[at, entry] = exact
        chosen = known.argmin(1)
        return chosen, known[rows, chosen], len(u) + len(at)
    order = np.array(sorted(range(len(at)), key=lambda k: (at[k], exact[k], entry[k])), np.int64)
    chosen = order[np.searchsorted(at[order], rows)]
    return entry[chosen], exact[chosen], len(u) + len(at)


def _vectors(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows that are kept, those of ``dims`` components among them, and their whole components."""
    there = column.is_valid().to_numpy(zero_copy_only=False)
    lengths = np.where(there, column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null components become NaN, null rows have none
    ends = np.cumsum(lengths)
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))
    kept = there & (bad[ends] == bad[ends - lengths])
    coded = np.flatnonzero(kept & (lengths == dims))
    at = (ends - lengths)[coded][:, None] + np.arange(dims)
    return np.flatnonzero(kept), coded, flat[at]


def _assigned(x: np.ndarray, books: list[np.ndarray]):
    """Part number, its whole components, entry numbers and distances of the rows of ``x``."""
    width = x.shape[1] // len(books)
    for part, book in enumerate(books):
        u = whole(x[:, part * width : (part + 1) * width])
        entry, distance, _ = nearest(u, book)
        yield part, u, entry, distance


def _moved(rows: DataFrame, books: list[np.ndarray], dims: int) -> list[np.ndarray]:
    """Codebooks whose entries are the floors of the means of the parts assigned to them; unused ones stay."""
    width = dims // len(books)
    names, number = [f"s{k}" for k in range(width)], pa.decimal128(38, 0)

    def run(part: pa.RecordBatch) -> pa.RecordBatch | None:
        _, _, x = _vectors(part.column(0), dims)
        found = []
        for book, u, entry, _ in _assigned(x, books) if len(x) else ():
            for e in np.unique(entry).tolist():
                own = u[entry == e]
                found.append((book, e, len(own), *map(int, own.sum(0))))
        if not found:
            return None
        from decimal import Decimal

        columns = list(zip(*found, strict=True))
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), *(pa.array([Decimal(v) for v in c], number) for c in columns[3:])], ["part", "entry", "n", *names])

    sums = arrow_pass(rows.select("vector"), run, ", ".join(["part bigint", "entry bigint", "n bigint", *(f"{c} decimal(38,0)" for c in names)]), ROWS)
    made = [book.copy() for book in books]
    for r in sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in names)).collect():  # PARTS x ENTRIES rows at most
        made[r.part][r.entry] = [int(r[c]) // r.n for c in names]
    return made


def compress(vectors: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per kept vector: vec_id, label (as a string), code, error, label_error, codebooks_sha256."""
    if not 0 < entries <= 256 or parts < 1:
        raise ValueError("codes have two hexadecimal digits: 1 to 256 entries, at least one part")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    order = [F.col("vec_id").asc_nulls_last(), "vector"]
    seeds = rows.where(F.col("vector").isNotNull() & finite).orderBy(*order)
    dims = next((len(r.vector) for r in seeds.limit(1).collect()), 0)
    if dims % parts or not dims:
        dims, books = -1, []
    else:
        first = np.array([r.vector for r in seeds.where(F.size("vector") == dims).limit(entries).collect()])
        books = [whole(part) for part in np.split(first, parts, axis=1)]
        for _ in range(rounds):
            books = _moved(rows, books, dims)
    digest = hashlib.sha256(",".join(str(int(v)) for book in books for v in book.ravel()).encode()).hexdigest()

    def run(part: pa.RecordBatch) -> pa.RecordBatch | None:
        kept, coded, x = _vectors(part.column(2), dims)
        codes, errors = [None] * part.num_rows, [None] * part.num_rows
        if len(coded):
            found = [(entry, distance) for _, _, entry, distance in _assigned(x, books)]
            hexed = np.stack([entry for entry, _ in found], axis=1).astype(np.uint8)
            for k, row in enumerate(coded.tolist()):
                codes[row] = hexed[k].tobytes().hex()
                errors[row] = min(sum(int(distance[k]) for _, distance in found), _LAST)
        made = pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(codes, pa.string()), pa.array(errors, pa.int64())], ["vec_id", "label", "code", "error"])
        return made.take(pa.array(kept)) if len(kept) else None

    coded = materialise(arrow_pass(rows, run, "vec_id bigint, label string, code string, error bigint", ROWS))
    capped = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_LAST).cast("decimal(38,0)")).cast("bigint")
    by_label = materialise(coded.groupBy("label").agg(capped.alias("label_error"), F.count(F.lit(1)).alias("n")))
    total = coded.count()
    common, rare = by_label.where(F.col("n") * COMMON >= total).drop("n"), by_label.where(F.col("n") * COMMON < total).drop("n")
    own = lambda told: [F.col(f"c.{c}").alias(c) for c in ("vec_id", "label", "code", "error")] + [F.col(told).alias("label_error")]
    same = lambda side: F.col("c.label").eqNullSafe(F.col(f"{side}.label"))
    first = coded.alias("c").join(F.broadcast(common.withColumn("found", F.lit(True)).alias("m")), same("m"), "left")
    rest = first.where("m.found is null").select("c.*").alias("c").join(rare.alias("r"), same("r"))
    told = first.where("m.found").select(*own("m.label_error")).unionByName(rest.select(*own("r.label_error")))
    return told.withColumn("codebooks_sha256", F.lit(digest))


def query(spark, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings")).drop("label")


def _oracle() -> str:
    """The whole computation, each round a step of its own."""
    floor_div = "(s - ((s % n) + n) % n) // n"
    steps = ["""kept as materialized (select vec_id, label, list_transform(embedding, lambda x: floor(x::double * 4096)::bigint) v from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)""",
        "u as materialized (select vec_id, label, i // (len(v) // 8) part, i % (len(v) // 8) pos, v[i + 1] x from (select vec_id, label, v, unnest(range(len(v))) i from kept))",
        "c0 as materialized (select part, (dense_rank() over (order by vec_id) - 1) entry, pos, x from u where vec_id in (select vec_id from kept order by vec_id limit 16))"]
    for k in range(ROUNDS + 1):
        steps.append(f"a{k} as materialized (select vec_id, label, part, entry, d from (select vec_id, any_value(label) as label, part, entry, sum((u.x - c.x) * (u.x - c.x))::bigint d from u join c{k} c using (part, pos) group by vec_id, part, entry) qualify row_number() over (partition by vec_id, part order by d, entry) = 1)")
        if k < ROUNDS:
            steps.append(f"m{k} as (select part, entry, pos, sum(x)::bigint s, count(*) n from u join a{k} using (vec_id, part) group by all)")
            steps.append(f"c{k + 1} as materialized (select part, entry, pos, coalesce({floor_div}, c.x) x from c{k} c left join m{k} using (part, entry, pos))")
    return f"""with {", ".join(steps)}, coded as (select vec_id, any_value(label) as label, string_agg(printf('%02x', entry), '' order by part) code, sum(d)::bigint error from a{ROUNDS} group by vec_id)
select vec_id, code, error, (sum(error) over (partition by label))::bigint label_error, (select sha256(string_agg(x::varchar, ',' order by part, entry, pos)) from c{ROUNDS}) codebooks_sha256 from coded"""


ORACLE_SQL = _oracle()
