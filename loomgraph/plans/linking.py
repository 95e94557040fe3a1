"""Queries that link literals to entities: complete similarity, skylines of candidates and the choice of one."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import candidates as C
from loomgraph.operators import markup as M
from loomgraph.operators import supervision as S
from loomgraph.plans.catalogue import _SIM, KNOWN, NEAR, SENT, TOKENS, VOCAB, _literals, query
from loomgraph.sources.tables import small, table


@query(f"""with n as (select distinct p_name a from part), q as (select x.a, y.a b, 1.0::double - levenshtein(x.a, y.a)::double / greatest(length(x.a), length(y.a), 1) lev from n x join n y on x.a < y.a),
near as (select * from q where lev > 0.4::double), s as (select name, t from (select name, unnest(generate_series(1, length(name))) i, name from n n0(name)) p, lateral (select unnest(list_transform(generate_series(i, length(name)), lambda j: name[i:j])) t)),
l as (select a, b, max(length(x.t)) lcs from near join s x on x.name = a join s y on y.name = b and y.t = x.t group by a, b)
select a, b, {_SIM.format("lev")} lev, coalesce(lcs, 0)::bigint lcs from near left join l using (a, b)""")
def similarity_join_complete(spark, d):
    names = table(spark, d, "part").select(F.col("p_name").alias("name"))
    near = C.similar_pairs(names, names, 0.4, substring=False).where("l < r")
    return near.select(F.col("l").alias("a"), F.col("r").alias("b"), T.fixed(F.col("like")).alias("lev"), "lcs")


CANDIDATES = f"""{SENT}, {VOCAB}, {TOKENS}, {KNOWN}, {NEAR}, said as (select distinct doc_id, sid, name from ment),
co as (select x.name s, y.name e, count(*) n from said x join said y using (doc_id, sid) where x.name in (select s from kept) and y.name in (select e from kept) group by all),
cand as (select s, r, o, e, {_SIM.format("vo")} sim_o, {_SIM.format("vs")} sim_s, coalesce(n, 0)::bigint n from kept join tri using (s, o) left join co using (s, e)),
sky as (select * from cand x where not exists (select 1 from cand y where y.s = x.s and y.r = x.r and y.o = x.o and y.sim_o >= x.sim_o and y.sim_s >= x.sim_s and y.n >= x.n and (y.sim_o > x.sim_o or y.sim_s > x.sim_s or y.n > x.n)))"""


def _skyline(spark, d):
    """Candidates of each literal with their co-occurrence with its head, only those that no other dominates."""
    triples, entities = _literals(spark, d)
    found = C.literal_candidates(triples, entities)
    mentioned = S.mentions(S.tagged(S.sentences(table(spark, d, "documents")), S.vocabulary(table(spark, d, "benchmark")))).select("doc_id", "sid", "name").distinct()
    heads, known = (small(df.distinct()) for df in (triples.select("s"), entities.select(F.col("name").alias("e"))))
    together = mentioned.withColumnRenamed("name", "s").join(heads, "s", "left_semi").join(mentioned.withColumnRenamed("name", "e").join(known, "e", "left_semi"), ["doc_id", "sid"]).groupBy("s", "e").agg(F.count(F.lit(1)).alias("n"))
    return C.skyline(found.join(together, ["s", "e"], "left").fillna(0, ["n"]).select("s", "r", "o", "e", "sim_o", "sim_s", "n"), ["s", "r", "o"], ["sim_o", "sim_s", "n"])


@query(f"with {CANDIDATES} select s, r, o, e, sim_o, sim_s, n from sky")
def candidate_skyline(spark, d):
    return _skyline(spark, d)


@query(f"""with {CANDIDATES}, k as (select *, greatest(rank() over (partition by s, r, o order by sim_o desc), rank() over (partition by s, r, o order by sim_s desc), rank() over (partition by s, r, o order by n desc)) k3,
 greatest(rank() over (partition by s, r, o order by sim_o desc), rank() over (partition by s, r, o order by n desc)) k2 from sky),
best as (select s, r, o, min(k3) m3, min(k2) m2 from k group by s, r, o),
hit as (select k.*, k3 = m3 and count(*) filter (k3 = m3) over w = 1 three, k2 = m2 and count(*) filter (k2 = m2) over w = 1 two from k join best using (s, r, o) window w as (partition by s, r, o))
select s, r, o, e, sim_o, sim_s, n, case when three then 'three' when two then 'two' else 'one' end step from hit
qualify row_number() over (partition by s, r, o order by case when three then 1 when two then 2 else 3 end, sim_o desc, encode(e)) = 1""")
def replacement_choice(spark, d):
    return C.lower_bound(_skyline(spark, d), ["s", "r", "o"], ["sim_o", "sim_s", "n"], ["sim_o", "n"], "sim_o", "e")


def _candidate_lines(spark, d):
    """Parts in the order of their keys: an object with its id, and the words of its name as candidates."""
    return table(spark, d, "part").select(F.col("p_partkey").alias("line"), F.col("p_brand").alias("object"), F.explode(F.split("p_name", " ")).alias("candidate"))


@query("""with p as (select p_partkey line, p_brand as object, unnest(string_split(p_name, ' ')) candidate from part),
o as (select object, row_number() over (order by first) id from (select object, min(line) as first from p group by object))
select candidate, min(line)::bigint line, arg_min(id, line)::bigint id from p join o using (object) where candidate <> object group by candidate""")
def candidate_ids(spark, d):
    """A candidate's id is that of the object of the first line that names it; objects are numbered by their first line."""
    lines = _candidate_lines(spark, d)
    objects = small(S.numbered(lines.groupBy("object").agg(F.min("line").alias("first")), ["first"], "n").select("object", (F.col("n") + 1).alias("id")))
    found = lines.where(F.col("candidate") != F.col("object")).join(objects, "object")
    return found.groupBy("candidate").agg(F.min("line").cast("bigint").alias("line"), F.min_by("id", "line").cast("bigint").alias("id"))


@query("""with w as (select item_id, lower(u.t) as name from (select item_id, regexp_split_to_array(text, '[\\s.,]+') a from benchmark) b, unnest(b.a) u(t) where length(u.t) >= 5)
select name from w where item_id % 4 <> 0 intersect select name from w where item_id % 4 = 0""")
def names_of_both_tags(spark, d):
    """Names that some items make true entities and others candidates."""
    words = table(spark, d, "benchmark").select("item_id", F.explode(T.words(F.lower("text"))).alias("name")).where(F.length("name") >= 5)
    return words.where("item_id % 4 <> 0").select("name").intersect(words.where("item_id % 4 = 0").select("name"))


@query("with r as (select conv_id, count(distinct role) n from conversations group by conv_id) select count(*)::bigint n_rows, (count(*) filter (n > 1))::bigint n_multi, sum(n)::bigint n_labels from r")
def multilabel_counts(spark, d):
    roles = table(spark, d, "conversations").groupBy("conv_id").agg(F.countDistinct("role").alias("n"))
    return roles.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("n") > 1).alias("n_multi"), F.sum("n").alias("n_labels"))


@query()
def page_elements(spark, d):
    """Each text of a page with the path of its open elements."""
    return M.elements(table(spark, d, "pages")).drop("parents")


@query()
def box_statements(spark, d):
    return M.boxes(M.elements(table(spark, d, "pages")))
