"""Every registered query by name, with the DuckDB SQL that must return the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.clustering import PowerIterationClustering
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import candidates as C
from loomgraph.operators import graph as G
from loomgraph.operators import ordered as O
from loomgraph.operators import supervision as S
from loomgraph.sources.tables import small, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLES[fn.__name__] = oracle
        return fn

    return register


def both(name: str, tables: str, text: str, oracle: str | None = None) -> None:
    """A query in SQL; ``oracle`` where DuckDB's dialect differs."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for t in tables.split():
            table(spark, sf_dir, t).createOrReplaceTempView(t)
        return spark.sql(text)

    QUERIES[name], ORACLES[name] = run, oracle or text


SENT = """sent as (select doc_id, row_number() over (partition by doc_id order by i) - 1 sid, t from
 (select doc_id, t, min(i) i from (select doc_id, trim(u.t) t, u.i from (select doc_id, regexp_split_to_array(text, '[\\n；]') a from documents) d, unnest(d.a) with ordinality u(t, i)) where length(t) >= 5 group by doc_id, t))"""
WORDS = "list_filter(regexp_split_to_array({}, '[\\s.,]+'), lambda x: x <> '')"
VOCAB = f"""vocab as (select name, case when min(item_id) % 4 <> 0 then 'true_entity' else 'candidate_entity' end tag
 from (select item_id, unnest({WORDS.format("lower(text)")}) as name from benchmark) where length(name) >= 5 group by name)"""
TOKENS = f"""tok as (select s.doc_id, s.sid, u.i - 1 as position, u.t token from (select doc_id, sid, {WORDS.format("t")} a from sent) s, unnest(s.a) with ordinality u(t, i)),
tagged as (select doc_id, sid, position, token, lower(token) as name, coalesce(v.tag, case when regexp_matches(token, '^[A-Z][a-z]{{5,}}$') then 'nr' end) tag from tok left join vocab v on v.name = lower(token)),
ment as materialized (select * from tagged where token <> '无' and (tag in ('true_entity', 'candidate_entity') or (tag like 'nr%' and length(token) > 1)))"""
PAIRS = """pairs as (select a.doc_id, a.sid, a.name e1, b.name e2, a.position p1, b.position p2, a.tag tag1, b.tag tag2 from ment a join ment b on a.doc_id = b.doc_id and a.sid = b.sid and a.position < b.position and a.name <> b.name)"""
KNOWN = f"""bw as (select item_id, name, min(i) p from (select b.item_id, u.t as name, u.i from (select item_id, {WORDS.format("lower(text)")} a from benchmark) b, unnest(b.a) with ordinality u(t, i)) join vocab using (name) group by 1, 2),
allk as (select distinct a.item_id % 3 k, a.name e1, 'r' || (a.item_id % 5) r, b.name e2 from bw a join bw b on a.item_id = b.item_id and a.p < b.p),
tru as (select distinct e1, r, e2 from allk where k <> 0), pot as (select distinct e1, r, e2 from allk where k = 0)"""
MATCH = """m1 as (select p.*, r || '(e1,e2)' as label from pairs p join tru t on p.e1 = t.e1 and p.e2 = t.e2 union all select p.*, r || '(e2,e1)' from pairs p join tru t on p.e1 = t.e2 and p.e2 = t.e1),
open as (select * from pairs p where not exists (select 1 from tru t where (t.e1 = p.e1 and t.e2 = p.e2) or (t.e1 = p.e2 and t.e2 = p.e1))),
m2 as (select p.*, r || '(e1,e2)' as label from open p join pot t on p.e1 = t.e1 and p.e2 = t.e2 union all select p.*, r || '(e2,e1)' from open p join pot t on p.e1 = t.e2 and p.e2 = t.e1),
m3 as (select * from open p where not exists (select 1 from pot t where (t.e1 = p.e1 and t.e2 = p.e2) or (t.e1 = p.e2 and t.e2 = p.e1)))"""
FULL = "with " + ", ".join((SENT, VOCAB, TOKENS, PAIRS, KNOWN, MATCH)) + " "


def _pairs(spark, d):
    docs, bench = table(spark, d, "documents"), table(spark, d, "benchmark")
    vocab = small(S.vocabulary(bench))
    found = S.paired(S.sentence_mentions(S.sentences(docs), vocab))
    return found, S.known_pairs(bench, vocab, F.col("item_id") % 3 != 0), S.known_pairs(bench, vocab, F.col("item_id") % 3 == 0)


def _key(df: DataFrame, *more: str) -> DataFrame:
    whole = [F.col(c).cast("bigint").alias(c) for c in ("sid", "p1", "p2")]
    return df.select("doc_id", "e1", "e2", *whole, *more)


_COLS = "doc_id, e1, e2, sid::bigint sid, p1::bigint p1, p2::bigint p2"


@query(FULL + f"select {_COLS}, label, 'true' tier from m1 union all select {_COLS}, label, 'potential' from m2 union all select {_COLS}, null, 'none' from m3")
def distant_supervision_pairs(spark, d):
    return _key(S.supervised(*_pairs(spark, d)), "label", "tier")


@query("with " + ", ".join((SENT, VOCAB, TOKENS, PAIRS)) + f" select {_COLS} from pairs")
def mention_pairs(spark, d):
    return _key(_pairs(spark, d)[0])


@query(FULL + f"select {_COLS}, label from m1")
def true_match_directed(spark, d):
    found, true, _ = _pairs(spark, d)
    return _key(S.matched(found, true), "label")


@query(FULL + f"select {_COLS}, label from m2")
def potential_fallback(spark, d):
    found, true, potential = _pairs(spark, d)
    return _key(S.matched(found.join(small(S.both_ways(true)), ["e1", "e2"], "left_anti"), potential), "label")


@query(FULL + f"select {_COLS} from m3")
def negative_pairs(spark, d):
    found, true, potential = _pairs(spark, d)
    return _key(found.join(small(S.both_ways(true).unionByName(S.both_ways(potential)).distinct()), ["e1", "e2"], "left_anti"))


@query(FULL + "select label, (row_number() over (order by f[1], f[2], f[3], f[4], label) - 1)::bigint id from (select label, min([doc_id, sid, p1, p2]) f from (select doc_id, sid, p1, p2, label from m1 union all select doc_id, sid, p1, p2, label from m2) group by label)")
def relation_ids(spark, d):
    found, true, potential = _pairs(spark, d)
    labelled = S.supervised(found, true, potential).where("label is not null").withColumn("at_label", F.col("label"))
    return S.first_encounter_ids(labelled, "label", ["doc_id", "sid", "p1", "p2", "at_label"])


@query(FULL + "select tier, label, count(*)::bigint n, count(distinct e1)::bigint n_e1 from (select 'true' tier, label, e1 from m1 union all select 'potential', label, e1 from m2 union all select 'none', null, e1 from m3) group by all")
def corpus_union_counts(spark, d):
    return S.supervised(*_pairs(spark, d)).groupBy("tier", "label").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("e1").alias("n_e1"))


@query(f"with {SENT} select doc_id, sid::bigint sid, t as text from sent")
def segment_split_filter(spark, d):
    return S.sentences(table(spark, d, "documents")).withColumn("sid", F.col("sid").cast("bigint"))


@query(f"with {SENT}, {VOCAB}, {TOKENS} select doc_id, sid::bigint sid, position::bigint as position, token, tag from tagged where tag is not null")
def dictionary_tagging(spark, d):
    tokens = S.tagged(S.sentences(table(spark, d, "documents")), S.vocabulary(table(spark, d, "benchmark")))
    return tokens.where("tag is not null").select("doc_id", F.col("sid").cast("bigint").alias("sid"), F.col("position").cast("bigint").alias("position"), "token", "tag")


@query(f"with {SENT}, {VOCAB}, {TOKENS} select doc_id, sid::bigint sid, position::bigint as position, token, coalesce(tag, 'x') pos from tagged")
def segment_pos(spark, d):
    tokens = S.tagged(S.sentences(table(spark, d, "documents")), S.vocabulary(table(spark, d, "benchmark")))
    return tokens.select("doc_id", F.col("sid").cast("bigint").alias("sid"), F.col("position").cast("bigint").alias("position"), "token", F.coalesce("tag", F.lit("x")).alias("pos"))


_CLEAN = "regexp_replace(regexp_replace(regexp_replace(html, '<!--([^-]|-[^-])*-->', '', 'g'), '<style[^>]*>[^<]*</style>', '<style>s</style>', 'g'), '<script[^>]*>([^<]|<[^/]|</[^s])*</script>', '<script>s</script>', 'g')"
_HTML = f"""parts as (select page_id, u.i, u.v, u.v[1] = '<' tag from (select page_id, regexp_extract_all({_CLEAN}, '<[^>]*>|[^<]+') a from pages) p, unnest(p.a) with ordinality u(v, i)),
armed as (select *, sum(case when tag and v[2] <> '/' and (regexp_matches(v, '^<[a-zA-Z0-9]*p') or regexp_matches(v, '^<h1')) then 1 else 0 end) over (partition by page_id order by i) c from parts),
runs as (select page_id, i, trim(v) t, c, lag(c, 1, 0) over (partition by page_id order by i) pc from armed where not tag and trim(v, E' \\n\\t\\r') <> ''),
captured as (select page_id, i, t from runs where c > pc)"""


def _captured(spark, d):
    """Text after a tag whose name holds ``p``, or the heading tag, up to the next one; a gap that no text fills stays armed."""
    html = F.regexp_replace("html", "<!--([^-]|-[^-])*-->", "")
    html = F.regexp_replace(F.regexp_replace(html, "<style[^>]*>[^<]*</style>", "<style>s</style>"), "<script[^>]*>([^<]|<[^/]|</[^s])*</script>", "<script>s</script>")
    parts = table(spark, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all(html, F.lit("<[^>]*>|[^<]+"), 0)).alias("i", "v"))
    order = Window.partitionBy("page_id").orderBy("i")
    tag = F.startswith("v", F.lit("<"))
    arms = tag & (F.substring("v", 2, 1) != "/") & (F.col("v").rlike("^<[a-zA-Z0-9]*p") | F.col("v").rlike("^<h1"))
    armed = parts.withColumn("tag", tag).withColumn("c", F.sum(arms.cast("int")).over(order))
    runs = armed.where(~F.col("tag") & (F.trim(F.translate("v", "\n\t\r", "   ")) != "")).withColumn("pc", F.lag("c", 1, 0).over(order))
    return runs.where("c > pc").select("page_id", "i", F.trim("v").alias("t")), armed


@query(f"with {_HTML} select page_id, (row_number() over (partition by page_id order by i) - 1)::bigint seq, t as text from captured")
def html_text_capture(spark, d):
    rows = _captured(spark, d)[0]
    return rows.select("page_id", (F.row_number().over(Window.partitionBy("page_id").orderBy("i")) - 1).cast("bigint").alias("seq"), F.col("t").alias("text"))


@query(f"""with {_HTML}, ev as (select page_id, i, t, null v from captured union all select page_id, i, null, v from armed where tag and regexp_matches(v, '^</h1')),
marked as (select *, case when v is not null then last_value(t ignore nulls) over (partition by page_id order by i rows between unbounded preceding and 1 preceding) end head from ev)
select page_id, t as text, last_value(head ignore nulls) over (partition by page_id order by i rows between unbounded preceding and 1 preceding) chapter from marked qualify t is not null""")
def chapter_carry_forward(spark, d):
    rows, armed = _captured(spark, d)
    ends = armed.where(F.col("tag") & F.col("v").rlike("^</h1")).select("page_id", "i", F.lit(None).cast("string").alias("t"), "v")
    past = Window.partitionBy("page_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    events = rows.withColumn("v", F.lit(None).cast("string")).unionByName(ends)
    marked = events.withColumn("head", F.when(F.col("v").isNotNull(), F.last("t", True).over(past)))
    return marked.withColumn("chapter", F.last("head", True).over(past)).where("t is not null").select("page_id", F.col("t").alias("text"), "chapter")


@query("select page_id, u.h as target, (u.i - 1)::bigint seq from (select page_id, regexp_extract_all(html, 'href=\"([^\"]*)\"', 1) a from pages) p, unnest(p.a) with ordinality u(h, i)")
def page_link_triples(spark, d):
    links = table(spark, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("seq", "target"))
    return links.select("page_id", "target", F.col("seq").cast("bigint").alias("seq"))


@query("select p_partkey, regexp_replace('e:' || p_name || ' .', '^e:', '') as keep, trim(p_name) s, p_brand r from part")
def triple_parse_normalise(spark, d):
    line = table(spark, d, "part").select("p_partkey", "p_name", F.concat_ws("\t", F.concat(F.lit('e:"'), "p_name", F.lit('"')), F.concat(F.lit("r:"), "p_brand"), F.lit('"x".')).alias("line"))
    parts = F.split("line", "\t")
    return line.select("p_partkey", F.concat("p_name", F.lit(" .")).alias("keep"), T.strip_entity(parts[0]).alias("s"), T.strip_relation(parts[1]).alias("r"))


@query("select l_orderkey, l_linenumber, string_agg(k, ',' order by k) parts from (select l_orderkey, l_linenumber % 2 l_linenumber, l_partkey::varchar k from lineitem) group by all")
def triple_index_multimap(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") % 2).alias("l_linenumber"), F.col("l_partkey").cast("string").alias("k"))
    return rows.groupBy("l_orderkey", "l_linenumber").agg(F.array_join(F.array_sort(F.collect_list("k")), ",").alias("parts"))


@query("select tag, name, cast(row_number() over (order by first, tag, name) as bigint) id from (select 'true_entity' tag, p_name name, min(p_partkey) first from part group by p_name)")
def entity_ids(spark, d):
    names = table(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("first")).withColumn("tag", F.lit("true_entity"))
    return S.numbered(names, ["first", "tag", "name"], "k").select("tag", "name", (F.col("k") + 1).cast("bigint").alias("id"))




@query("select doc_id, toxic, case when k <= floor(n * 0.7::double) then 'train' when k <= floor(n * 0.8::double) then 'dev' else 'eval' end split from (select doc_id, toxic, row_number() over (partition by toxic order by md5(doc_id::varchar), doc_id) k, count(*) over (partition by toxic) n from labels)")
def stratified_split(spark, d):
    return O.stratified_split(table(spark, d, "labels").select("doc_id", "toxic"), "toxic", "doc_id")


@query("select event_id, case when k <= floor(n / 2.0) then 'test' else 'dev' end split from (select event_id, row_number() over (order by md5(cast(event_id as string)), event_id) k, count(*) over () n from events)")
def half_split(spark, d):
    rows = table(spark, d, "events").select("event_id", F.md5(F.col("event_id").cast("string")).alias("digest"))
    half = F.lit(rows.count() // 2)
    return S.numbered(rows, ["digest", "event_id"], "k").select("event_id", F.when(F.col("k") < half, "test").otherwise("dev").alias("split"))




@query("select conv_id, unnest(string_split(r, ' ')) as label, (len(string_split(r, ' ')) > 1) multi from (select conv_id, string_agg(distinct role, ' ' order by role) r from conversations group by conv_id)")
def multilabel_explode(spark, d):
    roles = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_set("role")).alias("r"))
    return roles.select("conv_id", F.explode_outer("r").alias("label"), (F.size("r") > 1).alias("multi"))


both("label_left_join", "documents labels", "select d.doc_id, d.lang, l.quality, l.toxic from documents d left join labels l on d.doc_id = l.doc_id")


@query(f"select doc_id, (position('the' in lower(text)) - 1)::bigint head_offset, (coalesce(list_position({WORDS.format('lower(text)')}, 'the'), 0) - 1)::bigint head_idx from documents")
def span_offsets(spark, d):
    text = F.lower("text")
    return table(spark, d, "documents").select("doc_id", T.char_offset(text, F.lit("the")).alias("head_offset"), T.item_offset(T.words(text), F.lit("the")).alias("head_idx"))


@query(f"select doc_id, md5(array_to_string(list_transform({WORDS.format('lower(text)')}, lambda x: case when x = 'the' then ' head ' else x end), '|')) masked from documents")
def token_mask(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(F.array_join(F.transform(T.words(F.lower("text")), lambda x: F.when(x == "the", " head ").otherwise(x)), "|")).alias("masked"))


@query("select head_type, tail_type, relation, cast(row_number() over (order by head_type, relation, tail_type) as bigint) id from (select distinct p_brand head_type, p_type relation, p_size tail_type from part) union all select 'None', null, 'None', 0")
def schema_table(spark, d):
    kinds = table(spark, d, "part").select(F.col("p_brand").alias("head_type"), F.col("p_size").alias("tail_type"), F.col("p_type").alias("relation")).distinct()
    ids = S.numbered(kinds, ["head_type", "relation", "tail_type"], "k").select("head_type", "tail_type", "relation", (F.col("k") + 1).cast("bigint").alias("id"))
    return ids.unionByName(spark.createDataFrame([("None", None, "None", 0)], "head_type string, tail_type int, relation string, id bigint"))



GOLD = "gold as (select l.doc_id, l.quality * 2 + l.toxic y, cast(d.n_chars % 4 as int) p from labels l join documents d on l.doc_id = d.doc_id)"
CLASSES = "classes as (select 0 c union all select 1 union all select 2 union all select 3)"
COUNTS = f"{GOLD}, {CLASSES}, counts as (select c, cast(sum(case when y = c then 1 else 0 end) as bigint) target, cast(sum(case when p = c then 1 else 0 end) as bigint) predicted, cast(sum(case when y = c and p = c then 1 else 0 end) as bigint) hit from gold cross join classes group by c)"
both("class_counts", "documents labels", f"with {COUNTS} select c, target, predicted, hit from counts")
_F6 = "floor(({}) * cast(1000000.0 as double) + cast(0.5 as double)) / cast(1000000.0 as double)"
both("micro_metrics", "documents labels", f"""with {COUNTS}, s as (select cast(sum(hit) as double) h, cast(sum(target) as double) t, cast(sum(case when c <> 0 then hit else 0 end) as double) h0, cast(sum(case when c <> 0 then target else 0 end) as double) t0, cast(sum(case when c <> 0 then predicted else 0 end) as double) p0 from counts)
select {_F6.format("h / t")} accuracy, {_F6.format("case when p0 = 0 then 0 else h0 / p0 end")} micro_p, {_F6.format("h0 / t0")} micro_r, {_F6.format("case when h0 = 0 then 0 else 2 * h0 / (p0 + t0) end")} micro_f1 from s""")
both("macro_metrics", "documents labels", f"""with {COUNTS}, m as (select c, case when predicted = 0 then cast(0 as double) else cast(hit as double) / predicted end p, case when target = 0 then cast(0 as double) else cast(hit as double) / target end r, case when predicted + target = 0 then cast(0 as double) else 2 * cast(hit as double) / (predicted + target) end f from counts)
select {_F6.format("sum(p) / count(*)")} macro_p, {_F6.format("sum(r) / count(*)")} macro_r, {_F6.format("sum(f) / count(*)")} macro_f1 from m""")
both("codebook_join", "labels", "select l.doc_id, b.name from (select doc_id, quality * 2 + toxic c from labels) l left join (select 1 c, 'toxic' name union all select 2, 'good' union all select 3, 'good/toxic') b on l.c = b.c where l.c <> 0")
both("loss_two_level", "events", f"select d, {_F6.format('sum(m) / count(*)')} loss from (select cast(ts as date) d, event_id % 64 b, cast(sum(cast(round(value * 100) as bigint)) as double) / count(*) m from events group by 1, 2) group by d")
both("early_stopping", "events", """with s as (select d, cast(sum(cast(round(value * 100) as bigint)) as bigint) v from (select cast(ts as date) d, value from events) group by d),
b as (select d, v, max(v) over (order by d rows between unbounded preceding and 1 preceding) best from s),
g as (select d, v, case when best is null or v >= best then 1 else 0 end up, sum(case when best is null or v >= best then 1 else 0 end) over (order by d) grp from b)
select d, v, cast(row_number() over (partition by grp order by d) - 1 as bigint) patience from g""")
both("predicted_triples", "documents", "select d.source e1, case d.n_chars % 4 when 1 then 'toxic' when 2 then 'good' else 'good/toxic' end r, d.lang e2, cast(count(*) as bigint) n from documents d where d.n_chars % 4 <> 0 group by 1, 2, 3")
@query(FULL + "select e1, case d.n_chars % 4 when 1 then 'toxic' when 2 then 'good' else 'good/toxic' end r, e2, count(*)::bigint n from pairs join documents d using (doc_id) where d.n_chars % 4 <> 0 and tag1 not like 'nr%' and tag2 not like 'nr%' group by all")
def predicted_triples_not_nr(spark, d):
    classes = table(spark, d, "documents").select("doc_id", (F.col("n_chars") % 4).alias("c")).where("c <> 0")
    found = _pairs(spark, d)[0].where(~F.startswith("tag1", F.lit("nr")) & ~F.startswith("tag2", F.lit("nr"))).join(classes, "doc_id")
    r = F.when(F.col("c") == 1, "toxic").when(F.col("c") == 2, "good").otherwise("good/toxic").alias("r")
    return found.groupBy("e1", r, "e2").agg(F.count(F.lit(1)).alias("n"))


both("new_triples", "lineitem", "select distinct a.l_suppkey s, a.l_partkey o from lineitem a where a.l_linenumber = 2 and not exists (select 1 from lineitem b where b.l_linenumber = 1 and b.l_suppkey = a.l_suppkey and b.l_partkey = a.l_partkey)")


@query("""with n as (select distinct p_name a from part), q as (select a, b, 1.0::double - levenshtein(a, b)::double / greatest(length(a), length(b), 1) lev,
 (select coalesce(max(l), 0) from (select unnest(generate_series(1, length(a))) i), (select unnest(generate_series(1, length(a))) l) where l <= length(a) - i + 1 and contains(b, a[i:i + l - 1])) lcs from n, (select a b from n) m where a < b and a[1:3] = b[1:3])
select a, b, floor(lev * 1000000.0::double + 0.5::double) / 1000000.0::double lev, lcs::bigint lcs from q where lev > 0.4""")
def similarity_join(spark, d):
    names = table(spark, d, "part").select(F.col("p_name").alias("a")).distinct()
    block = lambda c: F.substring(c, 1, 3)
    joined = names.withColumn("k", block("a")).join(names.select(F.col("a").alias("b"), block("a").alias("k")), "k").where("a < b")
    scored = joined.withColumn("lev", T.levenshtein_ratio(F.col("a"), F.col("b"))).where("lev > 0.4")
    return scored.select("a", "b", T.fixed(F.col("lev")).alias("lev"), T.common_substring_length(F.col("a"), F.col("b")).alias("lcs"))


#: DuckDB's levenshtein counts bytes; the names are lower case, so capitals can stand for the letters of two bytes.
_BYTES = "translate({}, 'ßäçèéêíñóöü', 'ABCDEFGHIJK')"
_SIM = "floor({0} * 1000000.0::double + 0.5::double) / 1000000.0::double"


NEAR = f"""tri as (select distinct e1 s, r, e2 o from allk where e1 in (select name from vocab) and e2 in (select name from vocab where tag = 'candidate_entity')),
ent as (select name e from vocab where tag = 'true_entity'), names as (select s as name from tri union select o from tri),
sub as (select distinct name, name[i:j] t from (select name, i, unnest(generate_series(i, length(name))) j from (select name, unnest(generate_series(1, length(name))) i from (select name from names union select e from ent)))),
lcs as (select a.name, e, max(length(a.t)) l from sub a join sub b on a.t = b.t join ent on ent.e = b.name where a.name in (select name from names) group by all),
sim as (select name, e, ((m - levenshtein({_BYTES.format('name')}, {_BYTES.format('e')})) * n + l * m)::double / (m * n)::double v from (select *, greatest(length(name), length(e)) m, length(name) + length(e) n from lcs)),
near as (select s, o, x.e, x.v vo, y.v vs, x.v > 0.4::double and y.v > 0.4::double sure from (select distinct s, o from tri) join sim x on x.name = o and x.v > 0.1::double join sim y on y.name = s and y.e = x.e and y.v > 0.1::double),
kept as (select * from near where sure union all select * from (select * from near where (s, o) not in (select (s, o) from near where sure) qualify row_number() over (partition by s, o order by floor(vo * 1000000.0::double + 0.5::double) + floor(vs * 1000000.0::double + 0.5::double) desc, encode(e)) = 1))"""


@query(f"""with {VOCAB}, {KNOWN}, {NEAR}
select s, r, o, e, {_SIM.format("vo")} sim_o, {_SIM.format("vs")} sim_s, case when sure then 'candidate' else 'fallback' end tier from kept join tri using (s, o)""")
def literal_candidates(spark, d):
    return C.literal_candidates(*_literals(spark, d))


def _literals(spark, d):
    """Triples whose tail is a literal, and the entities that may stand for it."""
    bench = table(spark, d, "benchmark")
    vocab = small(S.vocabulary(bench))
    literal = vocab.where("tag = 'candidate_entity'").select(F.col("name").alias("o"))
    triples = S.known_pairs(bench, vocab, F.lit(True)).toDF("s", "r", "o").join(literal, "o", "left_semi")
    return triples.select("s", "r", "o"), vocab.where("tag = 'true_entity'")


@query(f"with {SENT}, {VOCAB}, {TOKENS} select a.name s, b.name e, count(distinct (a.doc_id, a.sid))::bigint n from ment a join ment b on a.doc_id = b.doc_id and a.sid = b.sid and a.tag = 'candidate_entity' and b.tag = 'true_entity' group by 1, 2")
def cooccurrence_counts(spark, d):
    found = S.mentions(S.tagged(S.sentences(table(spark, d, "documents")), S.vocabulary(table(spark, d, "benchmark")))).select("doc_id", "sid", "name", "tag").distinct()
    a, b = (found.where(F.col("tag") == t).select("doc_id", "sid", F.col("name").alias(c)) for t, c in (("candidate_entity", "s"), ("true_entity", "e")))
    return a.join(b, ["doc_id", "sid"]).groupBy("s", "e").agg(F.count(F.lit(1)).alias("n"))


SKY = "pts as (select p_partkey, p_brand, p_size, p_retailprice, (select count(*) from lineitem where l_partkey = p_partkey) n from part)"


@query(f"with {SKY} select p_partkey, p_brand from pts a where not exists (select 1 from pts b where b.p_brand = a.p_brand and b.p_size >= a.p_size and b.p_retailprice >= a.p_retailprice and b.n >= a.n and (b.p_size > a.p_size or b.p_retailprice > a.p_retailprice or b.n > a.n))")
def skyline_candidates(spark, d):
    return C.skyline(_points(spark, d), ["p_brand"], ["p_size", "p_retailprice", "n"]).select("p_partkey", "p_brand")


@query(f"with {SKY} select n_candidates, count(*)::bigint n from (select p_brand, count(*)::bigint n_candidates from pts a where not exists (select 1 from pts b where b.p_brand = a.p_brand and b.p_size >= a.p_size and b.p_retailprice >= a.p_retailprice and b.n >= a.n and (b.p_size > a.p_size or b.p_retailprice > a.p_retailprice or b.n > a.n)) group by p_brand) group by n_candidates")
def skyline_histogram(spark, d):
    each = skyline_candidates(spark, d).groupBy("p_brand").agg(F.count(F.lit(1)).alias("n_candidates"))
    return each.groupBy("n_candidates").agg(F.count(F.lit(1)).alias("n"))


def _points(spark, d):
    lines = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("n"))
    return table(spark, d, "part").join(lines, "p_partkey", "left").select("p_partkey", "p_brand", "p_size", "p_retailprice", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"with {SKY}, r as (select *, greatest(rank() over (partition by p_brand order by p_size desc), rank() over (partition by p_brand order by p_retailprice desc), rank() over (partition by p_brand order by n desc)) k from pts) select p_brand, p_partkey, k::bigint k from r qualify row_number() over (partition by p_brand order by k, p_partkey) = 1")
def lower_bound_choice(spark, d):
    rank = lambda c: F.rank().over(Window.partitionBy("p_brand").orderBy(F.desc(c)))
    ranked = _points(spark, d).withColumn("k", F.greatest(rank("p_size"), rank("p_retailprice"), rank("n")).cast("bigint"))
    best = ranked.groupBy("p_brand").agg(F.min(F.struct("k", "p_partkey")).alias("m"))
    return best.select("p_brand", "m.p_partkey", "m.k")


@query("select event_id, case event_type when 'click' then 'view' else event_type end relation from events where event_type <> 'error' and regexp_matches(event_type, '^[\\x00-\\x7f]*$')")
def relation_canonicalise(spark, d):
    rows = table(spark, d, "events").where((F.col("event_type") != "error") & F.col("event_type").rlike(r"^[\x00-\x7f]*$"))
    return rows.select("event_id", T.canonical_relation(F.col("event_type"), {"click": "view"}).alias("relation"))


both("kg_statistics", "customer supplier orders", "select 'customer' kind, cast(count(*) as bigint) n from customer union all select 'supplier', cast(count(*) as bigint) from supplier union all select 'placed', cast(count(*) as bigint) from orders union all select 'idle', cast(count(*) as bigint) from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
both("kg_edge_weights", "orders lineitem", "select o_custkey a, l_suppkey b, cast(count(*) as bigint) weight from orders join lineitem on l_orderkey = o_orderkey group by o_custkey, l_suppkey")
EDGES = "e as (select * from (select p_partkey a, lead(p_partkey) over (partition by p_name, p_brand order by p_partkey) b from part) q where b is not null)"


def _siblings(spark, d):
    order = Window.partitionBy("p_name", "p_brand").orderBy("p_partkey")
    return table(spark, d, "part").select(F.col("p_partkey").alias("a"), F.lead("p_partkey").over(order).alias("b")).where("b is not null")


@query(f"with recursive {EDGES}, r(a, b) as (select a, b from e union select r.a, e.b from r join e on r.b = e.a) select a, b from r where a <> b")
def sibling_closure(spark, d):
    return G.closure(_siblings(spark, d))


@query(f"with {EDGES} select distinct x.a, y.b from e x join e y on x.b = y.a where x.a <> y.b and not exists (select 1 from e z where z.a = x.a and z.b = y.b)")
def sibling_one_hop(spark, d):
    return G.one_hop(_siblings(spark, d))


@query("select distinct m.l_suppkey b, f.l_suppkey c from lineitem m join lineitem f on m.l_orderkey = f.l_orderkey and m.l_linenumber = 1 and f.l_linenumber = 2 where m.l_suppkey <> f.l_suppkey and not exists (select 1 from lineitem x join lineitem y on x.l_orderkey = y.l_orderkey and x.l_linenumber = 3 and y.l_linenumber = 4 where x.l_suppkey = m.l_suppkey and y.l_suppkey = f.l_suppkey)")
def spouse_rule(spark, d):
    line = lambda k, c: table(spark, d, "lineitem").where(F.col("l_linenumber") == k).select(F.col("l_orderkey").alias("child"), F.col("l_suppkey").alias(c))
    return G.spouses(line(1, "b"), line(2, "c"), line(3, "b").join(line(4, "c"), "child").select("b", "c").distinct())


def _links(spark, d, once=True):
    pages = table(spark, d, "pages").select(F.concat(F.lit("h:"), F.regexp_extract("url", "^https?://([^/]*)", 1)).alias("a"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("b"))
    made = pages.select("a", F.concat(F.lit("t:"), "b").alias("b"))
    return made.distinct() if once else made


LINKS = "l as (select distinct 'h:' || regexp_extract(url, '^https?://([^/]*)', 1) a, 't:' || unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) b from pages), e as (select a, b from l union select b, a from l), dg as (select a, count(*) n from e group by a)"
_PR = "r{k} as (select e.b as node, 0.15::double / (select count(*) from dg) + 0.85::double * sum(r.rank / dg.n) as rank from e join dg on dg.a = e.a join r{j} r on r.node = e.a group by e.b)"


@query(f"with {LINKS}, r0 as (select a as node, 1.0::double / (select count(*) from dg) as rank from dg), {', '.join(_PR.format(k=k, j=k - 1) for k in range(1, 6))} select node, floor(rank * 1000000.0::double + 0.5::double) / 1000000.0::double as rank from r5")
def pagerank_fixed_iter(spark, d):
    return G.pagerank(_links(spark, d)).select("node", T.fixed(F.col("rank")).alias("rank"))


both("type_subgraph", "customer supplier", "select c_custkey a, s_suppkey b from customer join supplier on c_nationkey = s_nationkey where c_acctbal > 5000 and s_acctbal > 5000")


both("type_graph_nodes", "nation customer orders lineitem supplier", """with e as (select distinct c_nationkey a, s_nationkey b from customer join orders on o_custkey = c_custkey join lineitem on l_orderkey = o_orderkey join supplier on s_suppkey = l_suppkey),
g as (select concat('region ', cast(n_regionkey as string)) kind, n_nationkey node from nation union all select 'all', n_nationkey from nation),
t as (select x.kind, e.a, e.b from e join g x on x.node = e.a join g y on y.node = e.b and y.kind = x.kind),
ends as (select kind, a node, case when a = b then 1 else 0 end self from t union all select kind, b, 0 from t),
k as (select g.kind, g.node, cast(count(ends.node) as bigint) degree, cast(coalesce(sum(ends.self), 0) as bigint) self_loops from g left join ends on ends.kind = g.kind and ends.node = g.node group by g.kind, g.node)
select kind, node, degree, self_loops, degree = 2 * self_loops isolated from k""")


@query()
def spectral_clusters(spark, d):
    """node, cluster: nodes are numbered, so that each has an identifier of its own, and named again afterwards."""
    links = _links(spark, d)
    nodes = S.numbered(links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct(), ["node"], "id")
    ids = links.join(nodes.select(F.col("node").alias("a"), F.col("id").alias("src")), "a").join(nodes.select(F.col("node").alias("b"), F.col("id").alias("dst")), "b").select("src", "dst", F.lit(1.0).alias("w"))
    found = PowerIterationClustering(k=8, maxIter=10, srcCol="src", dstCol="dst", weightCol="w").assignClusters(ids)
    return nodes.join(found, "id").select("node", "cluster")


@query()
def node_link_export(spark, d):
    links = _links(spark, d)
    rank = G.pagerank(links)
    nodes = rank.select(F.to_json(F.struct(F.col("node").alias("id"), (F.col("rank") * 30 + 10).alias("radius"))).alias("row"), F.lit("node").alias("kind"))
    return nodes.unionByName(_links(spark, d, once=False).groupBy("a", "b").agg(F.count(F.lit(1)).alias("weight")).select(F.to_json(F.struct(F.col("a").alias("source"), F.col("b").alias("target"), "weight")).alias("row"), F.lit("link").alias("kind")))


@query(f"select doc_id, array_to_string((list_transform({WORDS.format('lower(text)')}, lambda x: length(x)::int) || [0 for i in range(90)])[1:90], ',') ids, least(len({WORDS.format('lower(text)')}), 90)::bigint n from documents")
def wordpiece_pad_mask(spark, d):
    ids = F.transform(T.words(F.lower("text")), lambda x: F.length(x))
    return table(spark, d, "documents").select("doc_id", F.array_join(T.padded_ids(ids).cast("array<string>"), ",").alias("ids"), F.least(F.size(ids), F.lit(90)).cast("bigint").alias("n"))


@query("select vec_id, (list_position(embedding, list_max(embedding)) - 1)::bigint y from embeddings")
def argmax_class(spark, d):
    return table(spark, d, "embeddings").select("vec_id", T.item_offset(F.col("embedding"), F.array_max("embedding")).alias("y"))


@query(f"with {VOCAB}, dw as (select distinct unnest({WORDS.format('lower(text)')}) as name from documents) select name, tag, name in (select name from dw) seen from vocab")
def vocabulary_intersect_except(spark, d):
    words = table(spark, d, "documents").select(F.explode(T.words(F.lower("text"))).alias("name")).distinct().withColumn("seen", F.lit(True))
    return S.vocabulary(table(spark, d, "benchmark")).join(words, "name", "left").select("name", "tag", F.coalesce("seen", F.lit(False)).alias("seen"))


both("sequence_dedup", "documents", "select text, min(doc_id) doc_id, cast(count(*) as bigint) n from documents group by text having count(*) > 1")
both("attribute_pivot", "customer", "select c_custkey, max(case when r = 'name' then o end) name, max(case when r = 'type' then o end) type from (select c_custkey, 'name' r, c_name o from customer union all select c_custkey, 'type', c_mktsegment from customer) t group by c_custkey")
both("candidate_normalise", "part", "select distinct p_brand s, regexp_replace(concat('e:', p_type), '^e:', '') o from part where p_type <> '' and p_brand <> p_type")


@query(f"select doc_id, list_sum([contains(lower(text), k)::int for k in ['idiot', 'license', 'token']])::bigint hits from documents where contains(lower(text), 'idiot') or contains(lower(text), 'license') or contains(lower(text), 'token')")
def keyword_filter(spark, d):
    text = F.lower("text")
    hits = sum((F.contains(text, F.lit(k)).cast("bigint") for k in ("license", "token")), F.contains(text, F.lit("idiot")).cast("bigint"))
    return table(spark, d, "documents").select("doc_id", hits.alias("hits")).where("hits > 0")


@query(f"select doc_id, len(list_filter({WORDS.format('lower(text)')}, lambda x: x not in ('the', 'of', 'and', 'die', 'la')))::bigint n from documents")
def stopword_filter(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(F.filter(T.words(F.lower("text")), lambda x: ~x.isin("the", "of", "and", "die", "la"))).cast("bigint").alias("n"))


@query("select p_partkey, unnest(string_split(p_name, ' ')) part from part")
def name_parts(spark, d):
    return table(spark, d, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("part"))


@query("select doc_id, md5(translate(text, 'éèáíóúñüöä' || E'\\r\\n\\t', 'eeaiounuoa')) h from documents")
def char_normalise(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(F.translate("text", "éèáíóúñüöä\r\n\t", "eeaiounuoa")).alias("h"))


@query(f"with {VOCAB} select tag, name || ':x' as name, tag || ':' || name || ':x' as key from vocab")
def vocabulary_key_split(spark, d):
    keys = S.vocabulary(table(spark, d, "benchmark")).select(F.concat_ws(":", "tag", "name", F.lit("x")).alias("key"))
    parts = F.split("key", ":", 2)
    return keys.select(parts[0].alias("tag"), parts[1].alias("name"), "key")


@query("with h as (select conv_id, turn, role, text, case when role = 'user' then text end f from conversations) select conv_id, turn, last_value(f ignore nulls) over (partition by conv_id order by turn) family, lag(text) over (partition by conv_id order by turn) before from h")
def family_members_state(spark, d):
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, d, "conversations")
    return rows.select("conv_id", "turn", F.last(F.when(F.col("role") == "user", F.col("text")), True).over(order).alias("family"), F.lag("text").over(order).alias("before"))
