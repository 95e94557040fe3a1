"""Queries over files that are written and read again, over models and over metrics; their SQL is written apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import graph as G
from loomgraph.operators import metrics as M
from loomgraph.operators import ordered as O
from loomgraph.operators import relation_model as R
from loomgraph.operators import supervision as S
from loomgraph.plans.catalogue import query
from loomgraph.sinks import files
from loomgraph.sinks.workspace import new_path
from loomgraph.sources import tables as X
from loomgraph.sources.tables import table

SAMPLE = "event_id bigint, user_id bigint, event_type string, value double, split string"


@query("select event_id, user_id, event_type, value, case when event_id % 10 < 7 then 'train' when event_id % 10 = 7 then 'dev' else 'eval' end split from events")
def format_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    part = F.when(F.col("event_id") % 10 < 7, "train").when(F.col("event_id") % 10 == 7, "dev").otherwise("eval")
    rows = table(spark, d, "events").select("event_id", "user_id", "event_type", "value", part.alias("split"))
    return X.samples(spark, files.json_lines(rows, new_path(spark, "samples"), by="split"), SAMPLE)


@query("select p_partkey, p_name sentence, p_brand head, len(string_split(p_name, ' '))::bigint n_tokens, string_split(p_name, ' ')[1] first_token from part")
def csv_roundtrip(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("sentence"), F.col("p_brand").alias("head"), F.split("p_name", " ").alias("tokens"))
    path = files.csv_table(rows, new_path(spark, "csv"))
    back = spark.read.option("header", True).option("escape", '"').schema("p_partkey bigint, sentence string, head string, tokens string").csv(path)
    tokens = F.from_json("tokens", "array<string>")
    return back.select("p_partkey", "sentence", "head", F.size(tokens).cast("bigint").alias("n_tokens"), tokens[0].alias("first_token"))


@query("select distinct case when n_regionkey % 2 = 0 then 'true_entity' else 'candidate_entity' end tag, n_name || ':' || n_regionkey name from nation")
def vocabulary_roundtrip(spark, d):
    tag = F.when(F.col("n_regionkey") % 2 == 0, "true_entity").otherwise("candidate_entity")
    rows = table(spark, d, "nation").select(tag.alias("tag"), F.concat_ws(":", "n_name", "n_regionkey").alias("name"))
    return X.vocabulary(spark, files.vocabulary_lines(rows, new_path(spark, "vocabulary")))


@query("select n_name as key, n_nationkey::bigint as value from nation union all select null, 99")
def relation_map_roundtrip(spark, d):
    rows = table(spark, d, "nation").select(F.col("n_name").alias("k"), F.col("n_nationkey").cast("bigint").alias("v"))
    rows = rows.unionByName(spark.createDataFrame([(None, 99)], "k string, v bigint"))
    return X.dictionary(spark, files.map_object(rows, "k", "v", new_path(spark, "map")))


@query("select word from (select c_name word, row_number() over (order by c_name) n from customer) where n <= 263 union all select '…'")
def stopword_prefix(spark, d):
    names = table(spark, d, "customer").select("c_name").orderBy("c_name").limit(263)
    return X.stopwords(spark, files.lines(names, "c_name", new_path(spark, "stopwords")), first=263)


_SOURCES = """with n as (select n_nationkey id, n_name s, r_name o from nation join region on n_regionkey = r_regionkey)
select 'statements' format, s, 'region' r, o from n
union all select 'sentences', s, (len(string_split(s || ' lies in ' || o, ' ')))::varchar, o from n
union all select 'labels', id::varchar, u.l::varchar, null from n, unnest([id, id + 1]) u(l)
union all select 'markup', o, 'p', s from n
union all select 'spo', s, 'region', o from n
union all select 'schema', s, row_number() over (order by s, o)::varchar, o from n
union all select 'schema', 'None', '0', 'None'
union all select 'codebook', 'place/' || o || '/' || s, id::varchar, s from n
union all select 'free json', s, 'none', id::varchar from n
union all select 'free text', s, 'none', 'none' from n
union all select 'log', s, null, null from n
union all select 'samples', s, id::varchar, o from n
union all select 'graph nodes', id::varchar, null, s from n
union all select 'graph links', a.id::varchar, (count(*))::varchar, min(b.id)::varchar from n a join n b on a.o = b.o group by a.id"""


@query(_SOURCES)
def text_format_sources(spark, d):
    n = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("s"), F.col("r_name").alias("o"))
    at = lambda name: new_path(spark, name)
    text = lambda name, *value: files.lines(n.select(F.concat(*value).alias("v")), "v", at(name))
    tab, none = F.lit("\t"), F.lit(None).cast("string")
    out = []

    def add(name: str, df: DataFrame, s, r, o):
        out.append(df.select(F.lit(name).alias("format"), s.cast("string").alias("s"), r.cast("string").alias("r"), o.cast("string").alias("o")))

    c = F.col
    found = X.triples(spark, text("statements", F.lit("@prefix e: <e> .\n@prefix r: <r> .\ne:"), c("s"), F.lit("\tr:region\te:"), c("o"), F.lit(".")))
    add("statements", found, c("s"), c("r"), c("o"))
    found = X.sentences(spark, text("sentences", c("id"), tab, c("s"), tab, c("o"), tab, c("s"), F.lit(" lies in "), c("o")))
    add("sentences", found, c("head"), F.size("token"), c("tail"))
    add("labels", X.labels(spark, text("labels", c("id"), tab, c("id"), F.lit(" "), c("id") + 1)), c("id"), c("label"), none)
    pages = n.groupBy("o").agg(F.concat(F.lit("<html><h2>"), c("o"), F.lit("</h2>"), F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda x: F.concat(F.lit("<p>"), x, F.lit("</p>"))), ""), F.lit("</html>")).alias("v"))
    found = X.markup_files(spark, files.lines(pages.repartition(5, "o"), "v", at("markup")), "*.txt").withColumn("page", F.explode(F.split("html", "\n"))).where("page <> ''")
    each = found.select(F.regexp_extract("page", "<h2>(.*?)</h2>", 1).alias("h"), F.explode(F.regexp_extract_all("page", F.lit("<p>(.*?)</p>"), 1)).alias("p"))
    add("markup", each, c("h"), F.lit("p"), c("p"))
    spo = n.select(c("s").alias("text"), F.array(F.struct(c("s").alias("word"), F.lit("n").alias("pos"))).alias("postag"), F.array(F.struct(F.lit("region").alias("predicate"), c("s").alias("subject"), c("o").alias("object"), F.lit("a").alias("subject_type"), F.lit("b").alias("object_type"))).alias("spo_list"))
    add("spo", X.statements(spark, files.json_lines(spo, at("spo"))), c("spo.subject"), c("spo.predicate"), c("spo.object"))
    schema = n.select(c("s").alias("subject_type"), F.lit("region").alias("predicate"), c("o").alias("object_type"))
    add("schema", X.relation_table(spark, files.json_lines(schema, at("schema"))), c("head_type"), c("id"), c("tail_type"))
    add("codebook", X.codebook(spark, text("codebook", F.lit("place/"), c("o"), F.lit("/"), c("s"), tab, c("id"))), c("relation"), c("id"), c("leaf"))
    found = X.free_rows(spark, files.lines(n.select(F.concat(F.lit('{"content": "'), c("s"), F.lit('", "title": NaN, "id": "'), c("id"), F.lit('"}')).alias("v")), "v", at("free") + ".jsonl"))
    add("free json", found, c("content"), c("title"), c("id"))
    found = X.free_rows(spark, files.lines(n, "s", at("free") + ".txt"))
    add("free text", found, c("content"), c("title"), c("id"))
    found = X.optional_list(spark, text("log", F.lit("1 >> 2 >> "), c("s")), log=True).unionByName(X.optional_list(spark, at("absent")))
    add("log", found, c("word"), none, none)
    add("samples", X.samples(spark, files.json_lines(n, at("jsonl")), "id int, s string, o string"), c("s"), c("id"), c("o"))
    nodes, links = X.node_link(spark, files.node_link(*_region_graph(n), at("graph")))
    add("graph nodes", nodes, c("id"), none, c("name"))
    add("graph links", links, c("source"), c("weight"), c("target"))
    made = out[0]
    for df in out[1:]:
        made = made.unionByName(df)
    return made


def _region_graph(n: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nations, each linked with the least of its region by as many edges as the region has nations."""
    nodes = n.select(F.col("id").cast("bigint").alias("id"), F.col("s").alias("name"), F.lit("#888").alias("color"), F.lit(1.0).alias("radius"))
    each = n.alias("a").join(n.alias("b"), "o").groupBy(F.col("a.id").alias("source")).agg(F.count(F.lit(1)).alias("weight"), F.min("b.id").alias("target"))
    return nodes, each.select("weight", F.col("source").cast("bigint"), F.col("target").cast("bigint"))


_PRED = "g as (select l.quality * 2 + l.toxic y, (d.n_chars % 4)::int p from labels l join documents d using (doc_id)), k(c) as (values (0), (1), (2), (3), (4))"
_PER = f"with {_PRED}, m as (select c, count(*) filter (y = c and p = c) / nullif(count(*) filter (p = c), 0)::double pr, count(*) filter (y = c and p = c) / nullif(count(*) filter (y = c), 0)::double re from k, g group by c), f as (select c, coalesce(pr, 0) pr, coalesce(re, 0) re, coalesce(2 * pr * re / nullif(pr + re, 0), 0) f from m)"
_R = "floor({} * 1000000.0::double + 0.5) / 1000000.0::double"
_MACRO = ", ".join(f"{_R.format(f'sum({a}) / count(*)')} macro_{b}" for a, b in (("pr", "p"), ("re", "r"), ("f", "f1")))


def _counts(spark, d):
    y = (F.col("quality") * 2 + F.col("toxic")).cast("int").alias("y_true")
    rows = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select(y, (F.col("n_chars") % 4).cast("int").alias("y_pred"))
    return M.class_counts(rows, spark.range(5).withColumnRenamed("id", "c"))


@query(f"{_PER} select 'all' classes, {_MACRO} from f union all select 'real', {_MACRO} from f where c <> 0")
def macro_metrics_variants(spark, d):
    counts = _counts(spark, d)
    return M.macro(counts).select(F.lit("all").alias("classes"), "*").unionByName(M.macro(counts, without=0).select(F.lit("real").alias("classes"), "*"))


@query(f"with {_PRED}, s as (select avg((y = p)::int) a, count(*) filter (y = p and y <> 0) / nullif(count(*) filter (p <> 0), 0)::double pr, count(*) filter (y = p and y <> 0) / nullif(count(*) filter (y <> 0), 0)::double re from g) select {_R.format('a')} accuracy, {_R.format('coalesce(pr, 0)')} micro_p, {_R.format('coalesce(re, 0)')} micro_r, {_R.format('coalesce(2 * pr * re / nullif(pr + re, 0), 0)')} micro_f1 from s")
def micro_metrics_by_operator(spark, d):
    return M.micro(_counts(spark, d))


_RUNS = "r as (select event_type run, date_diff('day', date '2024-01-01', ts::date)::bigint as epoch, sum(round(value * 100)::bigint)::bigint score from events group by all)"


def _runs(spark, d):
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("bigint")
    return table(spark, d, "events").groupBy(F.col("event_type").alias("run"), day.alias("epoch")).agg(F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("score"))


@query(f"""with recursive {_RUNS}, o as (select *, row_number() over (partition by run order by epoch) n from r),
f(run, n, epoch, score, best, waited, stopped) as (select run, n, epoch, score, score, 0::bigint, false from o where n = 1
 union all select o.run, o.n, o.epoch, o.score, case when o.score >= f.best + 500 then o.score else f.best end, case when o.score >= f.best + 500 then 0 else f.waited + 1 end, f.stopped or (o.score < f.best + 500 and f.waited + 1 >= 4) from f join o on o.run = f.run and o.n = f.n + 1)
select run, epoch, score, best, waited, stopped from f""")
def early_stopping_by_run(spark, d):
    return M.early_stopping(_runs(spark, d), "run", "epoch", "score", patience=4, delta=500)


@query(f"with {_RUNS} select run, epoch, score from r where epoch > 0 qualify row_number() over (partition by run order by score desc, epoch) = 1")
def best_epoch(spark, d):
    return M.best_epoch(_runs(spark, d), "run", "epoch", "score")


@query("select count(*)::bigint before, (count(*) filter (p_size > 10 and p_name like '%widget'))::bigint \"after\" from part")
def filter_row_counts(spark, d):
    return M.row_counts(table(spark, d, "part"), (F.col("p_size") > 10) & F.endswith("p_name", F.lit("widget")))


@query("select p_partkey, p_name from part where (suffix(p_name, 'widget') or (prefix(p_name, 'old') and length(p_name) > 8)) and p_name not in (select p_name from part where p_size = 1)")
def name_filters(spark, d):
    parts = table(spark, d, "part")
    kept = parts.where(T.is_family(F.col("p_name"), "widget") | T.is_speech(F.col("p_name"), "old", 8))
    return kept.join(parts.where("p_size = 1").select("p_name"), "p_name", "left_anti").select("p_partkey", "p_name")


@query("""with t as (select item_id, text, string_split(text, ' ') w from benchmark), f as (select *, w[2] head, 'the' tail from t),
o as (select item_id, instr(text, head) - 1 a, instr(text, tail) - 1 b, coalesce(list_position(w, head), 0) - 1 i, coalesce(list_position(w, tail), 0) - 1 j from f)
select item_id, a::bigint head_offset, b::bigint tail_offset, i::bigint head_start, (i + 1)::bigint head_end, j::bigint tail_start, (j + 1)::bigint tail_end from o where a <> -1 and b <> -1 and i <> -1 and j <> -1""")
def offset_filter(spark, d):
    rows = table(spark, d, "benchmark").select("item_id", "text", F.split("text", " ").alias("w")).withColumn("head", F.get("w", F.lit(1))).withColumn("tail", F.lit("the"))
    at = {"head_offset": T.char_offset(F.col("text"), F.col("head")), "tail_offset": T.char_offset(F.col("text"), F.col("tail")), "i": T.item_offset(F.col("w"), F.col("head")), "j": T.item_offset(F.col("w"), F.col("tail"))}
    found = rows.select("item_id", *(v.alias(k) for k, v in at.items())).where("head_offset <> -1 and tail_offset <> -1 and i <> -1 and j <> -1")
    head, tail = T.unit_span(F.col("i")), T.unit_span(F.col("j"))
    return found.select("item_id", "head_offset", "tail_offset", head[0].alias("head_start"), head[1].alias("head_end"), tail[0].alias("tail_start"), tail[1].alias("tail_end"))


@query("with e as (select distinct o_custkey a, l_suppkey b from orders join lineitem on l_orderkey = o_orderkey) select a, b from e where a in (select c_custkey from customer where c_nationkey in (select n_nationkey from nation where n_regionkey = 1)) and b in (select s_suppkey from supplier where s_nationkey in (select n_nationkey from nation where n_regionkey = 1))")
def induced_subgraph(spark, d):
    edges = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("a"), F.col("l_suppkey").alias("b")).distinct()
    here = F.broadcast(table(spark, d, "nation").where("n_regionkey = 1").select("n_nationkey"))
    of = lambda name, key, nation: table(spark, d, name).join(here, F.col(nation) == F.col("n_nationkey"), "left_semi").select(F.col(key).alias("v"))
    custs, sups = of("customer", "c_custkey", "c_nationkey"), of("supplier", "s_suppkey", "s_nationkey")
    # two kinds of vertices: each end has its own set
    return edges.join(custs.withColumnRenamed("v", "a"), "a", "left_semi").join(sups.withColumnRenamed("v", "b"), "b", "left_semi")


@query("with recursive e as (select distinct l_suppkey a, l_partkey % 50 b from lineitem where l_partkey % 50 <> l_suppkey) select a, b from e where a <= 20 and b <= 20")
def induced_subgraph_one_kind(spark, d):
    edges = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 50).alias("b")).where("a <> b").distinct()
    return G.induced(edges, spark.range(21).withColumnRenamed("id", "v"))


@query("select distinct p_type path, string_split(p_type, ' ')[-1] leaf, list_aggregate(list_transform(range(1, len(string_split(p_type, ' ')) + 1), lambda n: array_to_string(string_split(p_type, ' ')[1:n], '/')), 'string_agg', '|') prefixes from part")
def path_rollup(spark, d):
    path = F.replace("p_type", F.lit(" "), F.lit("/"))
    return table(spark, d, "part").select(F.col("p_type").alias("path"), T.path_leaf(path).alias("leaf"), F.array_join(T.path_prefixes(path), "|").alias("prefixes")).distinct()


@query("select distinct cast(floor((l_orderkey % 1500) / 100.0) as int) epoch, 0.001::double * power(0.5::double, floor(floor((l_orderkey % 1500) / 100.0) / 2)) rate from lineitem")
def learning_rate(spark, d):
    """The rate of each epoch that the table's rows fall into."""
    epochs = table(spark, d, "lineitem").select(F.floor((F.col("l_orderkey") % 1500) / 100).cast("int").alias("epoch")).distinct()
    return epochs.select("epoch", T.learning_rate(F.lit(0.001), F.col("epoch")).alias("rate"))


@query("select event_id, 'click' relation from events where event_type = 'click' and not regexp_matches(props, '^[\\x00-\\x7f]*$') union all select event_id, event_type from events where event_type not in ('click', 'error')")
def relation_drop(spark, d):
    """Listed relations go, and of one relation the rows all of whose characters are ASCII."""
    ascii_only = F.col("props").rlike(r"^[\x00-\x7f]*$")
    kept = table(spark, d, "events").where(~F.col("event_type").isin("error") & ~((F.col("event_type") == "click") & ascii_only))
    return kept.select("event_id", F.col("event_type").alias("relation"))


def _multiword(spark, d):
    words = F.transform(F.split(F.lower("text"), r"[\s.,]+"), lambda w: w)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.slice("w", i, 2)))
    pairs = table(spark, d, "benchmark").select(words.alias("w")).select(F.explode(grams).alias("name"))
    return pairs.where(F.size(F.split("name", " ")) == 2).distinct().withColumn("tag", F.lit("true_entity")).unionByName(S.vocabulary(table(spark, d, "benchmark")).select("name", "tag"))


@query()
def multiword_tagging(spark, d):
    tokens = S.sentences(table(spark, d, "documents")).select("doc_id", "sid", F.posexplode(T.words(F.lower("text"))).alias("pos", "tok"))
    return S.longest_terms(tokens.withColumn("pos", F.col("pos").cast("bigint")), _multiword(spark, d))


def relation_samples(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    made = rows.select("doc_id", R.marked_words(F.col("text"), F.col("source"), F.col("lang")).alias("words"), F.col("source").alias("e1"), F.col("lang").alias("e2"), F.lit("source").alias("tag1"), F.when(F.col("lang") == "fr", "nr").otherwise("lang").alias("tag2"), (F.col("quality") * 2 + F.col("toxic")).cast("int").alias("label"))
    return O.stratified_split(made.where("label is not null"), "label", "doc_id")


def _predicted(spark, d):
    samples = relation_samples(spark, d)
    path = R.save(R.fit(samples.where("split = 'train'")), new_path(spark, "model"))
    return R.predict(R.load(path), samples.drop("label").join(samples.select("doc_id", "label"), "doc_id"))


@query()
def linear_relation_classifier(spark, d):
    return _predicted(spark, d).select("doc_id", "split", "label", "y_pred")


@query()
def scored_triples(spark, d):
    codebook = spark.createDataFrame([(1, "toxic"), (2, "good"), (3, "good/toxic")], "y_pred int, r string")
    return R.without_persons(R.scored_triples(_predicted(spark, d), F.broadcast(codebook)))
