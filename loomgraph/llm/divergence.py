"""Source divergence audit: how far apart the term distributions of the sources of one language are.

A language keeps the terms of at least ``least_docs`` of its documents, V of them. A group (a source in a language, or the whole
language) gives each kept term p = 1 + floor(``SCALE`` (count + ``PRIOR``) / (N + ``PRIOR`` V)); a term it doesn't have is given
the group's zero level z. A pair of sources differs by the sum of |p - q| over all kept terms.

Baseline correction: each pair starts at V |z_a - z_b|, as if no term occurred in either. Terms correct that, and only where
they occur. A term in a alone changes the sum by |p - z_b| - |z_a - z_b|: where z_a >= z_b that is p - z_a, one number for
a as a whole; where z_a < z_b it is z_a - p + 2 max(0, p - z_b), so only the levels p above z_b are emitted, from a's
histogram of levels. A term in both changes the sum by both of these and by -2 max(0, min(p_a, p_b) - max(z_a, z_b)); the
inverted index, a term's postings by source, emits that for pairs of postings where it isn't zero. Partial sums are formed
before each shuffle. Every source of a language meets every other in the result itself, a term's postings no more than that.

Counting: whole texts, by tasks that hold bounded dictionaries and emit a row for each (language, source, term) whenever they are
full, so a source of a third of all rows is no row's and no task's burden.
Terms are ranked by a window that keeps a group's first ``top`` rows in each task before anything moves.

All arithmetic is exact: whole numbers, the quotient by decimals of 38 digits.

Defined results: null text, language and source count as ''; a group without terms has N = 0 and is compared like others; a
language without kept terms has pairs of value 0 and no terms; a language of one source has no pairs; equal values
are ranked by the item's bytes; repeated rows count each; identifiers and further columns aren't read; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, forget, in_arrow, materialise, slices, table

SCALE, PRIOR, LEAST_DOCS, TOP = 1_000_000_000, 5, 30, 50
#: Terms in a task's dictionaries, and bytes of texts, before they are emitted and emptied.
ENTRIES, ENTRY_CHARS = 400_000, 64_000_000
#: Bytes that are no part of a term, by the separator; A-Z by a-z.
_LETTERS = bytes(b if b > 0x7F else b | 32 if chr(b).isalpha() else 32 for b in range(256))


def pieces(data: bytes, most: int = 1_000_000) -> Iterator[list[bytes]]:
    """The terms of UTF-8 bytes, runs of ASCII letters, lower-cased, and of code points beyond ASCII; a list for each ``most``
    bytes, as a long text's terms take many times its size."""
    letters, at = data.translate(_LETTERS), 0
    while at < len(letters):
        to = letters.find(b" ", at + most)
        to = len(letters) if to < 0 else to
        yield letters[at:to].split()
        at = to


def counted(docs: DataFrame, entries: int = ENTRIES, chars: int = ENTRY_CHARS) -> DataFrame:
    """lang, source, term, n (occurrences), docs; several rows for one term, to be summed up. A null term counts the documents of a
    group."""

    def run(batches):
        found: dict[tuple, tuple[Counter, Counter]] = {}
        sizes: Counter = Counter()

        def rows() -> pa.RecordBatch:
            groups, per_group = list(found), [[None, *tf] for tf, _ in found.values()]
            of = pa.array(np.repeat(np.arange(len(groups)), [len(g) for g in per_group]))
            names = [pa.array([g[k] for g in groups], pa.string()).take(of) for k in (0, 1)]
            words = pa.array([t for g in per_group for t in g], pa.binary()).cast(pa.string())
            n = pa.array([v for tf, _ in found.values() for v in (0, *tf.values())], pa.int64())
            docs = pa.array([v for g, (tf, df) in found.items() for v in (sizes[g], *map(df.__getitem__, tf))], pa.int64())
            found.clear()
            sizes.clear()
            return pa.RecordBatch.from_arrays([*names, words, n, docs], ["lang", "source", "term", "n", "docs"])

        held = size = 0
        for part in slices(batches):
            for data, lang, source in zip(as_bytes(part.column(0)), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                group = (lang or "", source or "")
                tf, df = found[group] if group in found else found.setdefault(group, (Counter(), Counter()))
                before, own = len(tf), set()
                for piece in pieces(data or b""):
                    tf.update(piece)
                    own.update(piece)
                df.update(own)
                sizes[group] += 1
                held += len(tf) - before
                size += len(data or b"")
                if held >= entries or size >= chars:
                    yield rows()
                    held = size = 0
        if found:
            yield rows()
        forget()

    return in_arrow(docs.select(*(F.col(c).cast("string") for c in ("text", "lang", "source"))), run, "lang string, source string, term string, n bigint, docs bigint")


def audit(docs: DataFrame, *, least_docs: int = LEAST_DOCS, top: int = TOP, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank."""
    named = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    # dealt by term alone: a term's rows are as many as tasks and sources at most, and no term has many more than other common ones
    counts = counted(named).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    told = counts.withColumn("lang_n", F.sum("n").over(of_term)).withColumn("lang_docs", F.sum("docs").over(of_term)).withColumn("first", F.row_number().over(of_term.orderBy("source")) == 1)
    index = materialise(told.where(F.col("term").isNull() | (F.col("lang_docs") >= least_docs)).drop("docs", "lang_docs"))
    kept, groups = index.where("term is not null"), index.where("term is null").select("lang", "source")

    level = lambda n, total: F.expr(f"1 + (cast({SCALE} as decimal(38,0)) * ({n} + {PRIOR})) div ({total} + {PRIOR} * v)")
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.where("first").groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
    sized = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "v", "lang_total"])
    sized = materialise(sized.withColumn("z", F.when(F.col("v") > 0, level("0", "total")).otherwise(F.lit(0)).cast("bigint")))

    postings = kept.join(sized, ["lang", "source"]).select("lang", "source", "term", "z", level("n", "total").cast("bigint").alias("p"), level("lang_n", "lang_total").cast("bigint").alias("q"))
    postings = materialise(postings)
    above = postings.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    place = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked_terms = above.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top)

    pairs = _pair_values(sized, postings)
    ends = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    both_ways = pairs.select("lang", "value", ends.alias("e")).select("lang", "e.source", F.lit("pair").alias("part"), "e.item", "value")
    return both_ways.withColumn("rank", F.row_number().over(place)).unionByName(ranked_terms)


def _pair_values(sized: DataFrame, postings: DataFrame) -> DataFrame:
    """lang, a, b, value of all pairs of sources, a the one of the lower zero level (of equal ones, the lesser name)."""
    end = lambda df, name, *cols: df.select("lang", F.col("source").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in cols))
    ordered = "z_a < z_b or (z_a = z_b and a < b)"
    # a term of one source alone moves the sum by p - z on the whole, or against it below the other's zero level
    lifted = postings.groupBy("lang", "source").agg(F.sum(F.col("p") - F.col("z")).alias("lift"))
    known = sized.join(lifted, ["lang", "source"], "left").fillna(0, ["lift"])
    base = end(known, "a", "z", "v", "lift").join(end(known, "b", "z", "lift"), "lang").where(ordered)
    base = base.select("lang", "a", "b", (F.col("v_a") * (F.col("z_b") - F.col("z_a")) + F.col("lift_b") - F.col("lift_a")).alias("value"))
    levels = postings.groupBy("lang", "source", "z", "p").agg(F.count(F.lit(1)).alias("n"))
    over = end(levels, "a", "z", "p", "n").join(end(sized, "b", "z"), "lang").where(f"({ordered}) and p_a > z_b").select("lang", "a", "b", (2 * F.col("n_a") * (F.col("p_a") - F.col("z_b"))).alias("value"))
    held = end(postings.select("lang", "term", "source", "z", "p"), "a", "term", "z", "p").withColumnRenamed("term_a", "term").join(end(postings.select("lang", "term", "source", "z", "p"), "b", "term", "z", "p").withColumnRenamed("term_b", "term"), ["lang", "term"])
    shared = held.where(f"({ordered}) and least(p_a, p_b) > z_b").select("lang", "a", "b", (-2 * (F.least("p_a", "p_b") - F.col("z_b"))).alias("value"))
    corrections = over.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")).unionByName(shared.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")))
    return base.unionByName(corrections).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def query(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


_P = "1 + (1000000000::hugeint * ({n} + 5)) // ({total} + 5 * v)"
ORACLE_SQL = rf"""with d as (select doc_id, coalesce(text, '') t, coalesce(lang, '') lang, coalesce(source, '') source from documents),
w as (select doc_id, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) term from d),
kept as (select lang, term, count(*) lang_n from w group by lang, term having count(distinct doc_id) >= 30),
c as (select lang, source, term, count(*) n from w semi join kept using (lang, term) group by all),
groups as (select distinct lang, source from d),
langs as (select lang, count(term) v, coalesce(sum(lang_n), 0)::bigint lang_total from (select distinct lang from d) left join kept using (lang) group by lang),
sized as (select lang, source, v, lang_total, coalesce(sum(n), 0)::bigint total from groups join langs using (lang) left join c using (lang, source) group by all),
p as (select lang, source, term, coalesce(n, 0) n, ({_P.format(n='coalesce(n, 0)', total='total')})::bigint p, ({_P.format(n='lang_n', total='lang_total')})::bigint q from sized join kept using (lang) left join c using (lang, source, term)),
pairs as (select lang, a.source, b.source item, coalesce(sum(abs(a.p - b.p)), 0)::bigint as value from p a join p b using (lang, term) where a.source <> b.source group by all),
empty_pairs as (select lang, a.source, b.source item, 0::bigint as value from sized a join sized b using (lang) where a.source <> b.source and a.v = 0),
r as (select lang, source, 'pair' part, item, value from pairs union all select lang, source, 'pair', item, value from empty_pairs union all select lang, source, 'term', term, p - q from p where n > 0 and p > q)
select lang, source, part, item, value, (row_number() over (partition by lang, source, part order by value desc, encode(item)))::int "rank" from r qualify part = 'pair' or "rank" <= 50"""
