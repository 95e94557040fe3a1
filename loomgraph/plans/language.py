"""Queries of the text models."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import language as L
from loomgraph.operators import supervision as S
from loomgraph.plans.catalogue import PAIRS, SENT, TOKENS, VOCAB, query
from loomgraph.sources.tables import dealt, is_broadcast, small, table


@query()
def lattice_segmentation(spark, d):
    """Sentences whose spaces are taken out, cut again by a lattice over the words and tags of the table's own tokens."""
    sentences = S.sentences(dealt(table(spark, d, "documents")))
    model = L.learn_from_sentences(sentences, S.vocabulary(table(spark, d, "benchmark")))
    return L.segment(L.tokens_without_spaces(sentences), model)


_MARK = "case when p{k} = position then [{id}] else []::int[] end"


@query(f"""with recursive {SENT}, {VOCAB}, {TOKENS}, {PAIRS}, names as (select distinct name from vocab),
parts as (select name, n, case when i > 1 then '##' else '' end || name[i:i + n - 1] piece from (select name, i, unnest(generate_series(1, least({L.PIECE}, length(name) - i + 1))) n from (select name, unnest(generate_series(1, length(name))) i from names))),
found as (select piece from parts group by piece having count(distinct name) >= 3 or min(n) = 1 union select name from names),
pv as (select piece, ({len(L.SPECIAL)} - 1 + row_number() over (order by encode(piece)))::int id from found),
one as (select doc_id, sid, min([p1, p2]) f from pairs group by all), mine as (select t.doc_id, t.sid, t.position, lower(t.token) w, f[1] p1, f[2] p2 from tok t join one using (doc_id, sid)),
ws as (select distinct w from mine),
hits as (select w, o, max(n) n, arg_max(id, n) id from (select w, o, unnest(generate_series(1, length(w) - o)) n from (select w, unnest(generate_series(0, length(w) - 1)) o from ws where length(w) <= {L.LONGEST_WORD})) join pv on piece = case when o > 0 then '##' else '' end || w[o + 1:o + n] group by w, o),
cut(w, o, ids) as (select w, 0::bigint, []::int[] from ws union all select c.w, c.o + h.n, c.ids || [h.id] from cut c join hits h on h.w = c.w and h.o = c.o),
wp as (select w, coalesce(max(ids) filter (o = length(w)), [1]) ids from cut group by w),
whole as (select doc_id, sid, [2] || flatten(list({_MARK.format(k=1, id=4)} || {_MARK.format(k=2, id=5)} || ids || {_MARK.format(k=1, id=6)} || {_MARK.format(k=2, id=7)} order by position)) || [3] a from mine join wp using (w) group by doc_id, sid)
select doc_id, sid::bigint sid, array_to_string((a || [0 for i in range(90)])[1:90], ',') ids, least(len(a), 90)::bigint n_mask, len(a)::bigint n, (coalesce(list_position(a[1:90], 4), 0) - 1)::bigint head_at, (coalesce(list_position(a[1:90], 5), 0) - 1)::bigint tail_at from whole""")
def wordpiece_assembly(spark, d):
    """The first pair of mentions of each sentence, marked among its sentence's word pieces."""
    vocab = small(S.vocabulary(table(spark, d, "benchmark")))
    sentences = S.sentences(dealt(table(spark, d, "documents"), least=1000))
    if is_broadcast(vocab):
        made = L.first_pairs(sentences, vocab, L.piece_vocabulary(vocab))
        return made.select("doc_id", F.col("sid").cast("bigint").alias("sid"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"), "n_mask", "n", "head_at", "tail_at")
    told = S.sentence_mentions(sentences, vocab, words_too=True)
    # the first pair: the first mention, and the first one after it of another name
    other = F.get(F.filter("ms", lambda m: m["name"] != F.get("ms", F.lit(0))["name"]), F.lit(0))
    first = told.select("doc_id", "sid", "words", F.get("ms", F.lit(0))["position"].alias("head_from"), other["position"].alias("tail_from")).where("tail_from is not null")
    names = F.transform("words", lambda w: F.lower(w))
    made = L.marked_sentences(first.select("doc_id", "sid", names.alias("names"), F.sequence(F.lit(0), F.size("words") - 1).alias("positions"), "head_from", (F.col("head_from") + 1).alias("head_to"), "tail_from", (F.col("tail_from") + 1).alias("tail_to")), L.piece_vocabulary(vocab))
    ones = F.aggregate("mask", F.lit(0), lambda n, x: n + x).cast("bigint")
    return made.select("doc_id", F.col("sid").cast("bigint").alias("sid"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"), ones.alias("n_mask"), "n", "head_at", "tail_at")


_FROM, _TO = "éèáíóúñüöäßçêà", "eeaiounuoascea"


@query(f"""with {VOCAB}, phrases as (select name source, '<' || name || '>' target from vocab where regexp_matches(name, '[^\\x00-\\x7f]')), chars as (select unnest(string_split('{_FROM}', '')) source, unnest(string_split('{_TO}', '')) target),
entries as (select * from phrases union all select * from chars), pattern as (select '(?s)' || coalesce(string_agg(source, '|' order by length(source) desc, source) || '|', '') || '.' p from entries), m as (select map_from_entries(list((source, target))) e from entries),
t as (select doc_id, regexp_extract_all(text, p) a from documents, pattern)
select doc_id, md5(array_to_string(list_transform(a, lambda x: coalesce(e[x], x)), '')) h, len(list_filter(a, lambda x: e[x] is not null))::bigint n_converted from t, m""")
def script_conversion(spark, d):
    """Accented words of the vocabulary as phrases in brackets, accented letters elsewhere as plain ones."""
    vocab = S.vocabulary(table(spark, d, "benchmark"))
    phrases = vocab.where(F.col("name").rlike(r"[^\x00-\x7f]")).select(F.col("name").alias("source"), F.concat(F.lit("<"), "name", F.lit(">")).alias("target"))
    chars = spark.createDataFrame(list(zip(_FROM, _TO, strict=True)), "source string, target string")
    made = L.convert_script(table(spark, d, "documents").select("doc_id", "text"), "text", phrases.unionByName(chars))
    return made.select("doc_id", F.md5("text").alias("h"), "n_converted")
