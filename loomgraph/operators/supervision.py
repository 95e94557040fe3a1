"""Distant supervision: dictionary tagging, pairs of mentions, directed matching against two tiers of triples."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.sinks.workspace import new_path
from loomgraph.sources.tables import is_broadcast, small


#: The tag of capitalised words, and their form.
PERSON, PERSON_FORM = "nr", "^[A-Z][a-z]{5,}$"


def is_person(word: str) -> bool:
    """As ``rlike`` tells it: Java's ``$`` also stands before one of these at the end."""
    return re.search(PERSON_FORM[:-1] + "[\x85\u2028\u2029]?\\Z", word) is not None


def sentences(docs: DataFrame, least: int = 5) -> DataFrame:
    return docs.select("doc_id", F.posexplode(T.segments(F.col("text"), least)).alias("sid", "text"))


def vocabulary(benchmark: DataFrame, least: int = 5) -> DataFrame:
    """name, tag: three quarters of the items make true entities, the others candidates."""
    names = benchmark.select("item_id", F.explode(T.words(F.lower("text"))).alias("name")).where(F.length("name") >= least)
    return names.groupBy("name").agg(F.when(F.min("item_id") % 4 != 0, "true_entity").otherwise("candidate_entity").alias("tag"))


def tagged(segmented: DataFrame, vocab: DataFrame) -> DataFrame:
    """doc_id, sid, position, token, name, tag; the dictionary goes first, then capitalised words as ``nr``."""
    tokens = segmented.select("doc_id", "sid", F.posexplode(T.words(F.col("text"))).alias("position", "token"))
    joined = tokens.withColumn("name", F.lower("token")).join(small(vocab), "name", "left")
    return joined.withColumn("tag", F.coalesce("tag", F.when(F.col("token").rlike(PERSON_FORM), F.lit(PERSON))))


def mentions(tokens: DataFrame) -> DataFrame:
    entity = F.col("tag").isin("true_entity", "candidate_entity") | (F.startswith("tag", F.lit("nr")) & (F.length("token") > 1))
    return tokens.where((F.col("token") != "无") & entity)


def pairs(found: DataFrame) -> DataFrame:
    """Two different names of one sentence, the first first: a sentence's mentions are brought together once, as an array, and
    paired within it."""
    held = found.groupBy("doc_id", "sid").agg(F.sort_array(F.collect_list(F.struct("position", "name", "tag"))).alias("ms"))
    return paired(held)


def paired(held: DataFrame) -> DataFrame:
    """Pairs of sentences (doc_id, sid, ms: the mentions by position); a mention's pairs are formed at a time, not a sentence's."""
    each = held.where(F.size("ms") > 1).select("doc_id", "sid", "ms", F.posexplode("ms").alias("k", "a"))
    after = F.filter(F.slice("ms", F.col("k") + 2, F.size("ms")), lambda b: b["name"] != F.col("a.name"))
    return each.select("doc_id", "sid", "a", F.explode(after).alias("b")).select("doc_id", "sid", F.col("a.name").alias("e1"), F.col("a.tag").alias("tag1"), F.col("a.position").alias("p1"), F.col("b.name").alias("e2"), F.col("b.tag").alias("tag2"), F.col("b.position").alias("p2"))


def places_of(names: Column, known: list[str]) -> Column:
    """For each of the names in an array its place in ``known``, null if it isn't there."""

    @F.arrow_udf("array<int>")
    def found(lists: pa.Array) -> pa.Array:
        codes = pc.index_in(lists.flatten(), value_set=pa.array(known, lists.type.value_type))
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), codes)

    return found(names)


def sentence_mentions(segmented: DataFrame, vocab: DataFrame, words_too: bool = False) -> DataFrame:
    """doc_id, sid, ms (and ``words``, all tokens, if ``words_too``): the mentions of each sentence that has any, as ``mentions(tagged(...))`` has them in rows, by position. With a
    dictionary that fits into every task a sentence stays one row; nothing is shuffled."""
    vocab = small(vocab)
    if not is_broadcast(vocab):
        held = mentions(tagged(segmented, vocab)).groupBy("doc_id", "sid").agg(F.sort_array(F.collect_list(F.struct("position", "name", "tag"))).alias("ms"))
        return held.join(segmented.select("doc_id", "sid", T.words(F.col("text")).alias("words")), ["doc_id", "sid"]) if words_too else held
    known = sorted(vocab.where("name is not null and tag is not null").collect(), key=lambda r: r.tag)  # BROADCAST_ROWS at most
    kinds = sorted({r.tag for r in known})
    tags = F.array(*(F.lit(t) for t in kinds)).cast("array<string>")
    firsts = F.array(*(F.lit(sum(r.tag < t for r in known)) for t in kinds)).cast("array<int>")
    words = T.words(F.col("text"))
    told = segmented.select("doc_id", "sid", words.alias("words")).withColumn("codes", places_of(F.transform("words", lambda w: F.lower(w)), [r.name for r in known]))
    # a name's place tells its tag, as the names are in the order of their tags
    tag_at = lambda c: F.get(tags, F.size(F.filter(firsts, lambda f: f <= c)) - 1)
    person = lambda w: F.when(w.rlike(PERSON_FORM), F.lit(PERSON))
    every = F.transform(F.arrays_zip("words", "codes"), lambda x, i: F.struct(i.alias("position"), x["words"].alias("token"), F.when(x["codes"].isNotNull(), tag_at(x["codes"])).otherwise(person(x["words"])).alias("tag")))
    kept = F.filter(every, lambda x: (x["token"] != "无") & (x["tag"].isin("true_entity", "candidate_entity") | (F.startswith(x["tag"], F.lit("nr")) & (F.length(x["token"]) > 1))))
    ms = F.transform(kept, lambda x: F.struct(x["position"].alias("position"), F.lower(x["token"]).alias("name"), x["tag"].alias("tag")))
    return told.select("doc_id", "sid", *(["words"] if words_too else []), ms.alias("ms")).where(F.size("ms") > 0)


def known_pairs(benchmark: DataFrame, vocab: DataFrame, which: Column) -> DataFrame:
    """e1, r, e2 of the items that ``which`` selects: ordered pairs of dictionary words by their first position."""
    words = benchmark.where(which).select("item_id", F.posexplode(T.words(F.lower("text"))).alias("position", "name")).join(small(vocab), "name", "left_semi")
    first = words.groupBy("item_id", "name").agg(F.min("position").alias("position")).withColumns({"doc_id": F.col("item_id"), "sid": F.lit(0), "tag": F.lit("")})
    return pairs(first).select("e1", F.concat(F.lit("r"), (F.col("doc_id") % 5).cast("string")).alias("r"), "e2").distinct()


def matched(found: DataFrame, known: DataFrame) -> DataFrame:
    """Both directions: every relation of (e1, e2) and of (e2, e1)."""
    known = small(known)
    forward = found.join(known, ["e1", "e2"]).withColumn("label", T.directed(F.col("r"), True))
    back = found.join(known.select(F.col("e2").alias("e1"), F.col("e1").alias("e2"), "r"), ["e1", "e2"]).withColumn("label", T.directed(F.col("r"), False))
    return forward.unionByName(back).drop("r")


KEY = ["doc_id", "sid", "e1", "e2", "p1", "p2"]


def supervised(found: DataFrame, true: DataFrame, potential: DataFrame) -> DataFrame:
    """Each pair with its labels: from true triples, else from potential ones, else none. The labels of both tiers and
    directions are one dictionary, so the pairs are read once and joined once."""
    both = _labels(true, "true").unionByName(_labels(potential, "potential"))
    # of one pair the true labels alone count ("true" sorts after "potential")
    ranked = both.withColumn("best", F.max("tier").over(Window.partitionBy("e1", "e2")))
    known = small(ranked.where("tier = best").drop("best"))
    return found.join(known, ["e1", "e2"], "left").withColumn("tier", F.coalesce("tier", F.lit("none")))


def _labels(known: DataFrame, tier: str) -> DataFrame:
    """e1, e2, label, tier: each relation in both directions."""
    forward = known.select("e1", "e2", T.directed(F.col("r"), True).alias("label"))
    back = known.select(F.col("e2").alias("e1"), F.col("e1").alias("e2"), T.directed(F.col("r"), False).alias("label"))
    return forward.unionByName(back).withColumn("tier", F.lit(tier))


def both_ways(known: DataFrame) -> DataFrame:
    return known.select("e1", "e2").unionByName(known.select(F.col("e2").alias("e1"), F.col("e1").alias("e2"))).distinct()


def first_encounter_ids(rows: DataFrame, value: str, at: list[str]) -> DataFrame:
    """Zero-based ids by first appearance; null is a value of its own."""
    first = rows.groupBy(value).agg(F.min(F.struct(*at)).alias("at"))
    return numbered(first, ["at", F.col(value).asc_nulls_first()], "id").select(value, F.col("id").cast("bigint").alias("id"))


def longest_terms(tokens: DataFrame, terms: DataFrame) -> DataFrame:
    """sid columns, pos, n, name, tag of terms of one or more words in tokenised sentences (doc_id, sid, pos, tok): from the
    left, the longest that starts at a free position. ``terms``: name (words joined by one space), tag."""
    sized = terms.select("name", "tag", F.size(F.split("name", " ")).alias("n"))
    longest = sized.agg(F.max("n")).first()[0] or 0
    here = Window.partitionBy("doc_id", "sid").orderBy("pos")
    grams = F.array(*(F.struct(F.lit(n).alias("n"), F.concat_ws(" ", *([F.col("tok")] + [F.lead("tok", k).over(here) for k in range(1, n)])).alias("name"), (F.lead("pos", n - 1).over(here) if n > 1 else F.col("pos")).alias("last")) for n in range(1, longest + 1)))
    found = tokens.withColumn("grams", grams).select("doc_id", "sid", "pos", F.explode("grams").alias("g")).where("g.last is not null").select("doc_id", "sid", "pos", "g.n", "g.name").join(small(sized), ["name", "n"])
    ordered = F.sort_array(F.collect_list(F.struct("pos", (-F.col("n")).alias("k"), "name", "tag")))
    start = F.struct(F.lit(-1).cast("bigint").alias("free"), F.array().cast("array<struct<pos:bigint,n:int,name:string,tag:string>>").alias("kept"))

    def step(state, m):
        taken = F.struct((m["pos"] - m["k"]).cast("bigint").alias("free"), F.concat(state["kept"], F.array(F.struct(m["pos"].cast("bigint").alias("pos"), (-m["k"]).cast("int").alias("n"), m["name"].alias("name"), m["tag"].alias("tag")))).alias("kept"))
        return F.when(m["pos"] >= state["free"], taken).otherwise(state)

    kept = found.groupBy("doc_id", "sid").agg(F.aggregate(ordered, start, step)["kept"].alias("kept"))
    return kept.select("doc_id", "sid", F.inline("kept"))


def numbered(rows: DataFrame, order: list, name: str = "n") -> DataFrame:
    """``rows`` with their number, from 0, in a total order, without a task that holds them all: ranges are dealt and sorted,
    and each adds the count of those before it (one row a range). Written once, so that ranges are the same when read."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    path = new_path(rows.sparkSession, "numbered")
    rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id()).write.parquet(path)
    held = rows.sparkSession.read.parquet(path).withColumn("_part", F.shiftright("_row", 33))
    sizes = held.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_before"))
    within = F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    return held.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + within).drop("_part", "_before", "_row")
