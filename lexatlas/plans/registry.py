"""Registered queries: one per operator, each over whole tables, with its twin in DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexatlas.functions import stats, text
from lexatlas.operators import classes, enrichment, evaluation, factorize, incidence, linking, mentions, nullmodel, senses, substitutes, vectors
from lexatlas.plans import derived as d
from lexatlas.runtime import table
from lexatlas.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# ------------------------------------------------------------ sources and mentions


@query("s1_tokens", f"with {d.SQL_TOKENS} select doc_id, tok_idx::bigint as tok_idx, form, array_to_string(tag, '-') as tag from tok")
def s1_tokens(spark, sf):
    arrays = d.token_arrays(spark, sf)
    each = arrays.select("doc_id", F.posexplode(F.arrays_zip("forms", "tags")).alias("i", "t"))
    return each.select("doc_id", F.col("i").cast("long").alias("tok_idx"), F.col("t.forms").alias("form"), F.array_join("t.tags", "-").alias("tag"))


@query("n1_mentions", f'with {d.SQL_MENTIONS} select doc_id, ne, tag, context, start, "end", first_idx::int as first_idx, close_idx::int as close_idx from mentions')
def n1_mentions(spark, sf):
    return d.mentions(spark, sf)


@query(
    "n3_find_target",
    """select doc_id, case when strpos(lower(text), 'the') > 0 then (strpos(lower(text), 'the') - 1)::int end as start,
      case when strpos(lower(text), 'the') > 0 then (strpos(lower(text), 'the') + 2)::int end as "end" from documents""",
)
def n3_find_target(spark, sf):
    return mentions.find_target(table(spark, sf, "documents"), "the", "text").select("doc_id", "start", "end")


@query("a1_mention_groups", f"with {d.SQL_MENTIONS} select ne || '::' || tag as key, count(*) as n, min(doc_id) as first_doc, max(doc_id) as last_doc from mentions group by 1")
def a1_mention_groups(spark, sf):
    m = d.mentions(spark, sf).withColumn("key", F.concat_ws("::", "ne", "tag"))
    g = mentions.group_mentions(m, "key", "doc_id")
    return g.select("key", "n", F.col("lowest").alias("first_doc"), F.col("highest").alias("last_doc"))


@query("a2_distinct_counts", f"with {d.SQL_MENTIONS} select count(*) as occurrences, count(distinct ne) as surfaces, count(distinct ne || '::' || tag) as pairs, count(distinct context) as contexts from mentions")
def a2_distinct_counts(spark, sf):
    m = d.mentions(spark, sf)
    return m.agg(F.count("*").alias("occurrences"), F.countDistinct("ne").alias("surfaces"), F.countDistinct("ne", "tag").alias("pairs"), F.countDistinct("context").alias("contexts"))


@query(
    "f5_crop",
    """with w as (select doc_id, string_split_regex(text, '[ \\t\\n\\r]+') as f from documents),
    t as (select doc_id, f, len(f) as n, (len(f) // 3)::int as t from w)
    select doc_id, array_to_string(case when n > 300 then f[greatest(0, t - 150) + 1 : least(n, t + 150)] else f end, ' ') as tokens,
      (case when n > 300 then t - greatest(0, t - 150) else t end)::int as target from t""",
)
def f5_crop(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.split("text", r"[ \t\n\r]+").alias("f")).withColumn("t", F.floor(F.size("f") / 3).cast("int"))
    tokens, target = mentions.crop(F.col("f"), F.col("t"))
    return rows.select("doc_id", F.array_join(tokens, " ").alias("tokens"), target.alias("target"))


# ------------------------------------------------------------ text functions and linkers


_URIS = "(select '<http://kb.example.org/' || c_mktsegment || '/' || c_custkey || '##' || (c_custkey % 3) || '>' as u, c_custkey from customer)"


@query(
    "f14_f16_uri_parts",
    f"""select c_custkey, split_part(u, '##', 1) as plain, regexp_replace(regexp_replace(u, '^<', ''), '>$', '') as inner_uri, u like '<http%>' as is_uri,
      not (u[2:] like 'http%' and u[2:] like '<%') as bare_ok from {_URIS}""",
)
def f14_f16_uri_parts(spark, sf):
    u = F.concat(F.lit("<http://kb.example.org/"), "c_mktsegment", F.lit("/"), "c_custkey", F.lit("##"), F.col("c_custkey") % 3, F.lit(">"))
    rows = table(spark, sf, "customer").select("c_custkey", u.alias("u"))
    return rows.select("c_custkey", text.without_sense("u").alias("plain"), text.unwrap("u").alias("inner_uri"), text.is_uri("u").alias("is_uri"), (~text.is_uri(F.substring("u", F.lit(2), F.length("u")))).alias("bare_ok"))


@query("e3_dummy_uri", "select c_custkey, '<' || regexp_replace(lower(trim(c_name || ' of ' || c_mktsegment)), '[ \\t\\n\\r]+', '_', 'g') || '>' as uri from customer")
def e3_dummy_uri(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.concat_ws(" of ", "c_name", "c_mktsegment").alias("ne"))
    return linking.DummyLinker().link(c).select("c_custkey", "uri")


@query(
    "e4_dummy_broaders",
    """select p_partkey, '<https://broaders.url/' || upper(p_name[i + 1]) || i || '>' as broader
    from (select p_partkey, regexp_replace(p_name, '[ \\t\\n\\r]+', '_', 'g') as p_name from part), unnest(range(0, least(5, length(p_name)))) as t(i)""",
)
def e4_dummy_broaders(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("entity"))
    return p.select("p_partkey", F.explode(linking.dummy_broaders(F.col("entity"))).alias("broader"))


@query("e5_type_broaders", f"with {d.SQL_MENTIONS} select distinct m.ne as entity, t.tag as broader from mentions m join mentions t on t.ne = split_part(m.ne, '##', 1) where t.tag is not null")
def e5_type_broaders(spark, sf):
    m = d.mentions(spark, sf).withColumn("uri", F.col("ne"))
    return linking.TypeLinker(m).broaders(m.select(F.col("ne").alias("entity")).distinct())


@query(
    "e8_categories",
    f"""with {d.SQL_EDGES} select distinct child as entity, parent as category, coalesce('label of ' || n_name, parent) as label
    from edges left join nation on 'N' || n_nationkey = parent and n_nationkey % 2 = 0 where property = 'P31'""",
)
def e8_categories(spark, sf):
    edges = d.edges(spark, sf)
    labels = table(spark, sf, "nation").where("n_nationkey % 2 = 0").select(F.concat(F.lit("N"), "n_nationkey").alias("wid"), F.lit("en").alias("lang"), F.concat(F.lit("label of "), "n_name").alias("label"))
    linker = linking.GraphLinker(None, edges, labels, "de")
    return linker.categories(edges.select(F.col("child").alias("entity")).distinct())


@query(
    "s15_labels",
    """select 'N' || n_nationkey as wid, case when n_nationkey % 3 = 0 then 'de ' || n_name when n_nationkey % 3 = 1 then 'en ' || n_name else 'N' || n_nationkey end as label from nation""",
)
def s15_labels(spark, sf):
    n = table(spark, sf, "nation").withColumn("wid", F.concat(F.lit("N"), "n_nationkey"))
    de = n.where("n_nationkey % 3 = 0").select("wid", F.lit("de-at").alias("lang"), F.concat(F.lit("de "), "n_name").alias("label"))
    en = n.where("n_nationkey % 3 < 2").select("wid", F.lit("en").alias("lang"), F.concat(F.lit("en "), "n_name").alias("label"))
    return tables.labels_for(n.select("wid"), de.unionByName(en), "de")


_SPANS = f"""with {d.SQL_MENTIONS},
c as (
  select doc_id || ':' || first_idx as context_id, pos, 'Q' || (length(ne) * 10 + pos) as wid, start + pos - 1 as s, "end" + (pos * 3) % 4 - 2 as e,
    case when pos % 2 = 0 then null when pos = 1 then 0.1 else 0.9 end as score
  from mentions, unnest(range(0, 4)) as t(pos)),
m as (select doc_id || ':' || first_idx as context_id, ne, start, "end" from mentions),
j as (
  select m.context_id, c.wid, c.pos, (least(m."end", c.e) - greatest(m.start, c.s)) / (greatest(m."end", c.e) - least(m.start, c.s)) as jac
  from m join c on m.context_id = c.context_id and c.s <= m."end" and c.e >= m.start where coalesce(c.score, 0.21) > 0.8 * 0.2)
select m.context_id, coalesce('<http://www.wikidata.org/entity/' || b.wid || '>', '<' || m.ne || '>') as uri
from m left join (select context_id, min_by(wid, -jac * 1000000 + pos * 0.001) as wid from j where jac > 0.5 group by 1) b on m.context_id = b.context_id"""


@query("j4_best_spans", _SPANS)
def j4_best_spans(spark, sf):
    m = d.mentions(spark, sf).withColumn("context_id", F.concat_ws(":", "doc_id", "first_idx"))
    each = m.select("context_id", "ne", "start", "end", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("pos"))
    score = F.when(F.col("pos") % 2 == 0, F.lit(None).cast("double")).when(F.col("pos") == 1, 0.1).otherwise(0.9)
    c = each.select(
        "context_id", "pos", F.concat(F.lit("Q"), F.length("ne") * 10 + F.col("pos")).alias("wikidataId"), (F.col("start") + F.col("pos") - 1).alias("offsetStart"),
        (F.col("end") + F.col("pos") * 3 % 4 - 2).alias("offsetEnd"), score.alias("nerd_score"), F.lit(None).cast("double").alias("nerd_selection_score"),
    )
    return linking.best_spans(m.select("context_id", "ne", "start", "end"), c).select("context_id", "uri")


@query("j8_lookup", f"with {d.SQL_MENTIONS} select m.doc_id, m.ne, m.first_idx::int as first_idx, k.uri from mentions m left join (select ne, context, min(tag) as uri from mentions where doc_id % 2 = 0 group by 1, 2) k on m.ne = k.ne and m.context = k.context")
def j8_lookup(spark, sf):
    m = d.mentions(spark, sf)
    known = m.where("doc_id % 2 = 0").withColumn("uri", F.col("tag"))
    return linking.TypeLinker(known).link(m).select("doc_id", "ne", "first_idx", "uri")


@query(
    "j9_transitive_broaders",
    f"""with recursive {d.SQL_EDGES},
    step as (select distinct child, parent from edges where property in ('P279', 'P31') and parent not in ('Q16889133', 'Q35120', 'Q36161')),
    walk(entity, node, hop) as (
      select child, parent, 1 from step
      union select w.entity, s.parent, hop + 1 from walk w join step s on w.node = s.child where hop < 4)
    select distinct entity, node as broader from walk""",
)
def j9_transitive_broaders(spark, sf):
    edges = d.edges(spark, sf)
    return linking.transitive_broaders(edges.select(F.col("child").alias("entity")).distinct(), edges)


@query("j2_surfaces", "select p_partkey || '##' || (p_partkey % 2) as entity, coalesce(case when p_partkey % 3 > 0 then lower(p_name || '::' || p_type) end, p_partkey || '##' || (p_partkey % 2)) as surface from part")
def j2_surfaces(spark, sf):
    p = table(spark, sf, "part")
    uri = F.when(F.col("p_partkey") % 3 > 0, F.col("p_partkey").cast("string")).otherwise(F.lit("<https://no.entity.found>"))
    seen = p.select(F.col("p_name").alias("ne"), F.col("p_type").alias("tag"), uri.alias("uri"), F.col("p_partkey").alias("mention_id"))
    return linking.surfaces(p.select(F.concat_ws("##", "p_partkey", F.col("p_partkey") % 2).alias("entity")), tables.surface_forms(seen))


@query("s6_surface_forms", "select p_type as uri, min_by(lower(p_name || '::' || p_brand), p_partkey) as surface from part group by 1")
def s6_surface_forms(spark, sf):
    p = table(spark, sf, "part")
    return tables.surface_forms(p.select(F.col("p_name").alias("ne"), F.col("p_brand").alias("tag"), F.col("p_type").alias("uri"), F.col("p_partkey").alias("mention_id")))


# ------------------------------------------------------------ substitutes


def _contexts(spark, sf) -> DataFrame:
    m = d.mentions(spark, sf)
    before, after = F.substring("context", F.lit(1), F.col("start") - 1), F.substring("context", F.col("end") + 2, F.length("context"))
    return m.select("doc_id", F.concat_ws(":", "doc_id", "first_idx").alias("context_id"), F.element_at(F.split(before, " "), -1).alias("left"), F.col("ne").alias("target"), F.split(after, " ")[0].alias("right"), "context", "start", "end", "first_idx", "tag")


#: Exact sums of neighbour counts; as the ``limit``-th best sum is at least any list's ``limit``-th count, a term that belongs to the
#: best has its share of it in one list at least, and only those terms are added up.
_SCORES = """
bi as (select a.form as a, b.form as b, count(*) as n from tok a join tok b on a.doc_id = b.doc_id and b.tok_idx = a.tok_idx + 1 group by 1, 2),
side as (select 0 as s, a as word, b as term, n from bi union all select 1, b, a, n from bi),
ends as (select s, word, coalesce(min(case when r = {limit} then n end), 0) as last from (select s, word, n, row_number() over (partition by s, word order by n desc) as r from side) group by 1, 2),
ctx as (
  select doc_id || ':' || first_idx as context_id, masked, string_split(before, ' ')[-1] as l, case when masked then '' else ne end as t, string_split(after, ' ')[1] as r
  from mentions, unnest([true, false]) as x(masked)),
q as (select row_number() over () as q, * from (select distinct masked, l, t, r from ctx)),
lists as (select q, 0 as s, l as word from q union all select q, 1, r from q union all select q, 0, t from q where not masked union all select q, 1, t from q where not masked),
known as (select q, s, word, last from lists join ends using (s, word)),
share as (select q, greatest(ceil(max(last) / count(*)), 1) as share from known group by 1),
cand as (select distinct q, term from known join share using (q) join side using (s, word) where n >= share),
pred as (select q, term, sum(n)::double as score from cand join known using (q) join side using (s, word, term) group by 1, 2),
seen as (select * from (select *, row_number() over (partition by q order by score desc, term) as v from pred) where v <= {limit}),
fit as (select * from seen where length(term) >= 3 and not starts_with(term, '##') and not starts_with(term, '[') and lower(term) not in ('the', 'and', 'that', 'die', 'der', 'les', 'los')),
best as (select q, row_number() over (partition by q order by v) - 1 as rank, term from fit),
ranked as (select context_id, masked, rank, term from ctx join q using (masked, l, t, r) join best using (q))
"""


def _stopwords(spark) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*map(F.lit, ("the", "and", "that", "die", "der", "les", "los")))).alias("word"))


@query("f1_candidate_filter", f"with {d.SQL_TOKENS} select distinct form as term from tok where length(form) >= 3 and not starts_with(form, '##') and not starts_with(form, '[') and lower(form) not in ('the', 'and', 'that', 'die', 'der', 'les', 'los')")
def f1_candidate_filter(spark, sf):
    terms = d.token_arrays(spark, sf).select(F.explode("forms").alias("term")).distinct()
    return substitutes.fit_terms(terms, _stopwords(spark))


@query("f2_f4_tags_and_lemmas", f"with {d.SQL_TOKENS}, t as (select distinct form from tok) select form as raw, case when length(form) % 2 = 0 then 'lemma of ' || form else form end as term from t where length(form) % 3 > 0")
def f2_f4_tags_and_lemmas(spark, sf):
    terms = d.token_arrays(spark, sf).select(F.explode("forms").alias("term")).distinct()
    lexicon = terms.select("term", F.when(F.length("term") % 3 > 0, "NN").otherwise("VB").alias("tag"))
    lemmas = terms.where(F.length("term") % 2 == 0).select("term", F.concat(F.lit("lemma of "), "term").alias("lemma"))
    return substitutes.lemmatised(substitutes.fit_tags(terms, lexicon, "N").withColumn("raw", F.col("term")), lemmas).select("raw", "term")


@query("l5_top_terms", f"with {d.SQL_MENTIONS}, {_SCORES.format(limit=41)} select context_id, masked, rank::int as rank, term from ranked where rank < 10")
def l5_top_terms(spark, sf):
    provider = substitutes.DistributionalProvider(d.token_arrays(spark, sf))
    listed = substitutes.substitute_lists(provider, _contexts(spark, sf), 10, ["context_id"], _stopwords(spark))
    each = F.explode(F.array(*(F.struct(F.lit(c == "masked").alias("masked"), F.col(c).alias("terms")) for c in ("unmasked", "masked"))))
    return listed.select("context_id", each.alias("l")).select("context_id", "l.masked", F.posexplode("l.terms").alias("rank", "term"))


@query(
    "l6_l7_substitutes",
    f"with {d.SQL_MENTIONS}, {_SCORES.format(limit=101)} select context_id, string_agg(term, '|' order by masked, rank) as terms from ranked where rank < 25 group by 1",
)
def l6_l7_substitutes(spark, sf):
    provider = substitutes.DistributionalProvider(d.token_arrays(spark, sf))
    return substitutes.substitutes(provider, _contexts(spark, sf), 50, stopwords=_stopwords(spark)).select("context_id", F.array_join("terms", "|").alias("terms"))


@query(
    "a4_most_common",
    f"""with {d.SQL_TOKENS}, c as (select form as term, count(*) as n, min(doc_id * 100000000 + tok_idx) as first from tok group by 1)
    select rank::int as rank, term, n from (select *, row_number() over (order by n desc, first) as rank from c) where rank <= 25""",
)
def a4_most_common(spark, sf):
    lists = d.token_arrays(spark, sf).select("doc_id", F.col("forms").alias("terms"))
    return substitutes.most_common(lists, 25, order="doc_id")


# ------------------------------------------------------------ vectors


@query(
    "l8_disambiguate",
    """with e as (select vec_id, label, i, embedding[i]::double as x from embeddings, unnest(range(1, len(embedding) + 1)) as t(i)),
    m as (select label, i, avg(x) as x from e group by 1, 2),
    c as (select label, list(x order by i) as v from m group by 1)
    select vec_id, c.label as sense, round(list_cosine_similarity(embedding::double[], c.v), 8) as score from embeddings, c""",
)
def l8_disambiguate(spark, sf):
    e = table(spark, sf, "embeddings")
    inventory = vectors.mean_vectors(e, "label").withColumnRenamed("label", "sense")
    return vectors.disambiguate(e.select("vec_id", "embedding"), inventory).select("vec_id", "sense", F.round("score", 8).alias("score"))


@query(
    "l9_choose_sense",
    """with e as (select vec_id, label, i, embedding[i]::double as x from embeddings, unnest(range(1, len(embedding) + 1)) as t(i)),
    m as (select label, i, avg(x) as x from e group by 1, 2),
    c as (select label, list(x order by i) as v from m group by 1),
    s as (select vec_id, c.label as sense, round(list_cosine_similarity(embedding::double[], c.v), 8) as score from embeddings, c)
    select vec_id, sense, score from (select *, row_number() over (partition by vec_id order by score desc, sense) as r from s) where r = 1""",
)
def l9_choose_sense(spark, sf):
    return vectors.choose_sense(l8_disambiguate(spark, sf), "vec_id")


# ------------------------------------------------------------ formal contexts


@query("c1_incidence", f"with {d.SQL_INCIDENCE} select obj, att from inc")
def c1_incidence(spark, sf):
    return d.incidence(spark, sf)


@query("c3_extents", f"with {d.SQL_INCIDENCE} select att, string_agg(obj, ',' order by obj) as extent from inc group by 1")
def c3_extents(spark, sf):
    return incidence.extents(d.incidence(spark, sf)).select("att", F.array_join("extent", ",").alias("extent"))


@query("c4_intents", f"with {d.SQL_INCIDENCE} select obj, string_agg(att, ',' order by att) as intent from inc group by 1")
def c4_intents(spark, sf):
    return incidence.intents(d.incidence(spark, sf)).select("obj", F.array_join("intent", ",").alias("intent"))


_WANTED = ("ECONOMY", "ring")


@query("c5_common_objects", f"with {d.SQL_INCIDENCE} select obj from inc where att in {_WANTED} group by 1 having count(*) = 2")
def c5_common_objects(spark, sf):
    wanted = spark.range(1).select(F.explode(F.array(*map(F.lit, _WANTED))).alias("att"))
    return incidence.common_objects(d.incidence(spark, sf), wanted)


@query(
    "c5_closure",
    f"""with {d.SQL_INCIDENCE}, e as (select obj from inc where att in {_WANTED} group by 1 having count(*) = 2)
    select att from inc join e using (obj) group by 1 having count(*) = (select count(*) from e)""",
)
def c5_closure(spark, sf):
    wanted = spark.range(1).select(F.explode(F.array(*map(F.lit, _WANTED))).alias("att"))
    return incidence.closure(d.incidence(spark, sf), wanted)


@query("c6_clarify", f"with {d.SQL_INCIDENCE}, i as (select obj, string_agg(att, ',' order by att) as intent from inc group by 1), one as (select min(obj) as obj from i group by intent) select obj, att from inc join one using (obj)")
def c6_clarify(spark, sf):
    return incidence.clarify(d.incidence(spark, sf))


@query("f6_drop_rare", f"with {d.SQL_INCIDENCE} select obj, att from inc where att in (select att from inc group by 1 having count(*) >= log10((select count(distinct obj) from inc)) + 1)")
def f6_drop_rare(spark, sf):
    return incidence.drop_rare(d.incidence(spark, sf))


@query("f7_drop_full", f"with {d.SQL_INCIDENCE}, z as (select obj, att from inc where att in ('ECONOMY', 'SMALL', 'size1')), n as (select obj from z group by 1 having count(*) < (select count(distinct att) from z)) select obj, att from z join n using (obj)")
def f7_drop_full(spark, sf):
    return incidence.drop_full(d.incidence(spark, sf).where("att in ('ECONOMY', 'SMALL', 'size1')"))


@query("f8_clean", f"with {d.SQL_INCIDENCE} select obj, att from inc where length(att) >= 4 and att in (select att from inc group by 1 having count(*) >= 40)")
def f8_clean(spark, sf):
    return incidence.clean(d.incidence(spark, sf), 40, 4)


@query("f9_truncate", "select distinct doc_id, unnest(string_split_regex(text, '[ \\t\\n\\r]+')[1:7]) as att from documents")
def f9_truncate(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.split("text", r"[ \t\n\r]+").alias("atts"))
    return incidence.incidence(docs, "doc_id", "atts", 7).select(F.col("obj").alias("doc_id"), "att")


def _greedy_sql(pairs: str, fidelity: float, min_size: int, objs_ge_atts: bool = False) -> str:
    """Tables s and factors (g, i, extent, intent, v, gone) of the greedy factorisation of each group of ``pairs`` (g, obj, att),
    after ``with recursive``. Each step of s holds every pair: whether it is open, whether its object and attribute belong to the
    concept that grows, that concept's open pairs v, the pairs covered so far, and the dead ends as attribute lists."""
    wide = "and e >= len(d)" if objs_ge_atts else ""
    return f"""
s(g, n, phase, obj, att, open, inside, held, v, gone, dead) as (
  select g, 0, 0, obj, att, 1, 1, 0, 0, 0, []::varchar[][] from {pairs}
  union all
  select s.g, s.n + (b.kind = 1)::int, s.phase + 1, s.obj, s.att,
    case when b.kind = 1 and s.inside = 1 and s.held = 1 then 0 else s.open end,
    case when b.kind = 0 then (s.inside = 1 and list_contains(b.objs, s.obj))::int else 1 end,
    case when b.kind = 0 then list_contains(b.d, s.att)::int else 0 end,
    case when b.kind = 0 then b.v else 0 end,
    s.gone + case when b.kind = 1 then s.v else 0 end,
    case when b.kind = 2 then list_append(s.dead, b.held) else s.dead end
  from s join (
    with own as (select g, obj, att as j from s where inside = 1 and held = 0),
    pair as (select own.g, j, x.att, count(*) as c, sum(open) as u from own join s x on x.g = own.g and x.obj = own.obj where x.inside = 1 group by 1, 2, 3),
    size as (select g, j, c as e from pair where j = att and c >= {min_size}),
    step as (select g, j, max(e) as e, sum(u)::int as v, list_sort(list(pair.att)) as d from pair join size using (g, j) where c = e group by 1, 2),
    now as (select g, max(v) as v, list_sort(coalesce(list(distinct att) filter (where held = 1), [])) as held, max(gone) as gone, count(*) as total, any_value(dead) as dead from s group by 1),
    fine as (
      select step.*, row_number() over (partition by step.g order by step.v desc, j) as r from step join now on now.g = step.g
      where step.v > case when len(now.held) >= greatest({min_size}, 1) then now.v else 0 end and not list_contains(now.dead, d) {wide}),
    best as (select fine.*, (select list(obj) from s where s.g = fine.g and inside = 1 and att = fine.j) as objs from fine where r = 1)
    select now.g, case when best.j is not null then 0 when len(now.held) >= greatest({min_size}, 1) then 1 else 2 end as kind, best.v, best.d, now.held, best.objs
    from now left join best on best.g = now.g
    where now.gone < {fidelity} * now.total - 1e-9 and (best.j is not null or len(now.held) > 0)
  ) b on b.g = s.g),
factors as (
  select s.g, s.n as i, list_sort(list(distinct obj)) as extent, list_sort(list(distinct att)) as intent, max(v) as v, max(gone) + max(v) as gone
  from s join (select g, n, max(phase) as phase from s group by 1, 2) e on s.g = e.g and s.n = e.n and s.phase = e.phase where inside = 1 and held = 1 group by 1, 2)"""


@query(
    "c7_factorize",
    f"""with recursive {d.SQL_INCIDENCE}, kept as (select 0 as g, obj, att from inc where att in (select att from inc group by 1 having count(*) >= 3)), {_greedy_sql("kept", 0.8, 2)}
    select i::int as i, array_to_string(extent, ',') as extent, array_to_string(intent, ',') as intent, round(v / (select count(*) from kept), 8) as score, round(gone / (select count(*) from kept), 8) as covered from factors""",
)
def c7_factorize(spark, sf):
    found = factorize.factorize(incidence.clean(d.incidence(spark, sf), 3), fidelity=0.8, min_size=2)
    return found.select("i", F.array_join("extent", ",").alias("extent"), F.array_join("intent", ",").alias("intent"), F.round("score", 8).alias("score"), F.round("covered", 8).alias("covered"))


@query(
    "c8_cutoff",
    """with f as (select l_suppkey as key, (row_number() over (partition by l_suppkey order by l_discount desc, l_orderkey, l_linenumber) - 1)::int as i, l_discount as score from lineitem),
    t as (select *, coalesce(sum(score) over w / (count(*) over w + 3), 0) as lim from f window w as (partition by key order by i rows between unbounded preceding and 1 preceding)),
    s as (select *, max((score < lim)::int) over (partition by key order by i) as stop from t)
    select key, i, score from s where stop = 0""",
)
def c8_cutoff(spark, sf):
    li = table(spark, sf, "lineitem")
    order = Window.partitionBy("l_suppkey").orderBy(F.desc("l_discount"), "l_orderkey", "l_linenumber")
    f = li.select(F.col("l_suppkey").alias("key"), (F.row_number().over(order) - 1).alias("i"), F.col("l_discount").alias("score"))
    return incidence.accepted(f, ["key"])


def _line_lists(spark, sf) -> DataFrame:
    """key = supplier, context_id = line item, terms = seven of its properties in a turning order."""
    li = table(spark, sf, "lineitem")
    same = Window.partitionBy("l_suppkey", "l_orderkey", "l_linenumber").orderBy("l_partkey", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    li = li.withColumn("copy", F.row_number().over(same)).where("copy = 1")
    whole = lambda c: c.cast("int").cast("string")
    base = F.array(
        F.concat(F.lit("flag"), "l_returnflag"), F.concat(F.lit("status"), "l_linestatus"), F.concat(F.lit("qty"), whole(F.floor(F.col("l_quantity") / 10))), F.concat(F.lit("disc"), whole(F.round(F.col("l_discount") * 100))),
        F.concat(F.lit("tax"), whole(F.round(F.col("l_tax") * 100))), F.concat(F.lit("line"), "l_linenumber"), F.concat(F.lit("year"), F.year("l_shipdate")),
    )
    turn = (F.col("l_orderkey") % 7).cast("int")
    return li.select(F.col("l_suppkey").alias("key"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("context_id"), F.concat(F.slice(base, turn + 1, 7 - turn), F.slice(base, F.lit(1), turn)).alias("terms"))


_LINE_LISTS = """
base as (
  select l_suppkey as key, l_orderkey * 10 + l_linenumber as context_id, (l_orderkey % 7)::int as turn, ['flag' || l_returnflag, 'status' || l_linestatus, 'qty' || floor(l_quantity / 10)::int, 'disc' || round(l_discount * 100)::int,
    'tax' || round(l_tax * 100)::int, 'line' || l_linenumber, 'year' || year(l_shipdate)] as t
  from (select *, row_number() over (partition by l_suppkey, l_orderkey, l_linenumber order by l_partkey, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) as copy from lineitem) where copy = 1),
lists as (
  select key, context_id, list_concat(t[turn + 1 :], t[1 : turn]) as terms
  from (select *, row_number() over (partition by key order by context_id) as r from base) where r <= 30)
"""
#: Senses of lists (key, context_id, terms): table senses (key, sense_ix, contexts, descriptors).
_SENSES_OF = f"""
places as (select key, context_id, unnest(terms) as term, unnest(range(0, len(terms))) as place from lists),
many as (select key, count(*) as n from lists group by 1 having count(*) >= 5),
held as (select distinct key, context_id, term from places join many using (key)),
common as (select key, term from held join many using (key) group by key, term, n having count(*) >= log10(n) + 1),
shared as (select held.* from held join common using (key, term)),
rows as (select key, context_id, list_sort(list(term)) as t from shared group by 1, 2),
single as (select key, t, min(context_id) as context_id from rows group by 1, 2),
every as (select key, count(distinct term) as n from shared group by 1),
fit as (select single.* from single join every using (key) where len(t) < every.n),
pairs as (select key::varchar as g, lpad(context_id::varchar, 20, '0') as obj, unnest(t) as att from fit),
{_greedy_sql("pairs", 1.0, 3)},
cut as (select *, v * (count(*) over w + 3) < coalesce(sum(v) over w, 0) as low from factors window w as (partition by g order by i rows between unbounded preceding and 1 preceding)),
good as (select * from (select *, max(low::int) over (partition by g order by i) as stop from cut) where stop = 0),
ranks as (
  select g.g, g.i, p.term, sum(p.place) as rank from good g, unnest(g.extent) as x(obj), unnest(g.intent) as y(term), (select key, context_id, term, min(place) as place from places group by 1, 2, 3) p
  where p.key::varchar = g.g and p.context_id = x.obj::bigint and p.term = y.term group by 1, 2, 3),
clustered as (
  select g.g::bigint as key, g.i::int as sense_ix, list_transform(g.extent, lambda x: x::bigint) as contexts, (select list(term order by rank, term) from ranks where ranks.g = g.g and ranks.i = g.i)[1:5] as descriptors from good g),
counts as (select key, term, count(*) as n, min(context_id * 100 + place) as first from places group by 1, 2),
fallback as (
  select key, 0 as sense_ix, (select list_sort(list(context_id)) from lists l where l.key = c.key) as contexts, list(term order by n desc, first)[1:5] as descriptors
  from counts c where key not in (select key from clustered) group by key),
senses as (select * from clustered union all select * from fallback)
"""


@query("c9_c11_line_senses", f"with recursive {_LINE_LISTS}, {_SENSES_OF} select key, sense_ix, array_to_string(list_sort(contexts), ',') as contexts, array_to_string(descriptors, ',') as descriptors from senses")
def c9_c11_line_senses(spark, sf):
    found = senses.induce_senses(_line_lists(spark, sf), "key", 5, 100, min_contexts=5, contexts_limit=30)
    return found.select("key", "sense_ix", F.array_join(F.transform("contexts", lambda c: c.cast("string")), ",").alias("contexts"), F.array_join("descriptors", ",").alias("descriptors"))


def _part_senses(spark, sf) -> DataFrame:
    """A sense of every part: its size class, type and the words of its name."""
    p = table(spark, sf, "part")
    words = F.concat(F.array(F.concat(F.lit("size"), (F.col("p_size") % 10).cast("string")), F.col("p_type")), F.split("p_name", " "))
    return p.select(F.concat_ws("::", F.col("p_partkey").cast("string"), "p_brand").alias("entity"), words.alias("descriptors"))


_PART_CLASSES = f"""
inc as (select distinct p_partkey::varchar || '::' || p_brand as obj, unnest(list_concat(['size' || (p_size % 10)::varchar, p_type], string_split(p_name, ' '))[1:3]) as att from part),
kept as (select 0 as g, obj, att from inc where att in (select att from inc group by 1 having count(*) >= 3)), {_greedy_sql("kept", 0.5, 2, True)}"""


def _part_classes(spark, sf) -> DataFrame:
    return classes.induce_classes(_part_senses(spark, sf), k=3, min_descriptors=2)


@query(
    "c13_part_classes",
    f"with recursive {_PART_CLASSES} select i::int as type_ix, round(v / (select count(*) from kept), 8) as score, round(gone / (select count(*) from kept), 8) as covered, array_to_string(intent, ',') as descriptors, array_to_string(extent, ',') as entities from factors",
)
def c13_part_classes(spark, sf):
    found = _part_classes(spark, sf)
    return found.select("type_ix", F.round("score", 8).alias("score"), F.round("covered", 8).alias("covered"), F.array_join("descriptors", ",").alias("descriptors"), F.array_join("entities", ",").alias("entities"))


@query(
    "a3_part_tags",
    f"with recursive {_PART_CLASSES} select i::int as type_ix, split_part(x.e, '::', 2) as tag, count(*) as n from factors, unnest(extent) as x(e) group by 1, 2",
)
def a3_part_tags(spark, sf):
    return classes.tag_histogram(_part_classes(spark, sf))


def _entity_lists(spark, sf) -> DataFrame:
    provider = substitutes.DistributionalProvider(d.token_arrays(spark, sf))
    contexts = _contexts(spark, sf).withColumn("key", F.concat_ws("::", "target", "tag"))
    contexts = senses.first_contexts(contexts, "key", senses.CONTEXTS, ["doc_id", "first_idx"])  # before the expensive predictions
    lists = substitutes.substitutes(provider, contexts, 50, ["key", "doc_id", "first_idx"], stopwords=_stopwords(spark), min_length=4)
    return lists.select("key", (F.col("doc_id") * 1_000_000 + F.col("first_idx")).alias("context_id"), "terms")


@query("c12_entity_senses")
def c12_entity_senses(spark, sf):
    return senses.entity_senses(_entity_lists(spark, sf), "key")


def _senses(spark, sf) -> DataFrame:
    found = c12_entity_senses(spark, sf)
    many = F.count("*").over(Window.partitionBy("key")) > 1
    return found.select(F.when(many, F.concat_ws("##", "key", "sense_ix")).otherwise(F.col("key")).alias("entity"), "descriptors")


@query("c13_classes")
def c13_classes(spark, sf):
    return classes.induce_classes(_senses(spark, sf), k=10, min_descriptors=2, fidelity=0.5)


@query("a3_tag_histogram")
def a3_tag_histogram(spark, sf):
    return classes.tag_histogram(c13_classes(spark, sf))


# ------------------------------------------------------------ enrichment


@query("u1_entities", "select distinct p_partkey::varchar as entity from part")
def u1_entities(spark, sf):
    return enrichment.entity_set(d.candidates(spark, sf))


@query("a5_broader_counts", f"with {d.SQL_ENRICHMENT} select cand, size::int as size, broader, n from counts")
def a5_broader_counts(spark, sf):
    return enrichment.broader_counts(d.candidates(spark, sf), d.broaders(spark, sf))


@query("a7_corpus_shares", f"with {d.SQL_ENRICHMENT} select broader, pairs, round(share, 10) as share, round(mean_share, 10) as mean_share from shares")
def a7_corpus_shares(spark, sf):
    return enrichment.corpus_shares(d.broaders(spark, sf)).select("broader", "pairs", F.round("share", 10).alias("share"), F.round("mean_share", 10).alias("mean_share"))


@query("a8_binomial_tail", f"with {d.SQL_ENRICHMENT} select cand, c.broader, round({d.SQL_TAIL}, 8) as p from counts c join shares s on c.broader = s.broader")
def a8_binomial_tail(spark, sf):
    b = d.broaders(spark, sf)
    counts = enrichment.broader_counts(d.candidates(spark, sf), b).join(enrichment.corpus_shares(b), "broader")
    return counts.select("cand", "broader", F.round(stats.binomial_tail(F.col("size"), F.col("share"), F.col("n")), 8).alias("p"))


_A9 = f"""{d.SQL_ENRICHMENT},
good as (select c.*, share, mean_share from counts c join shares s on c.broader = s.broader where n > 0.1 * size and n / size > share),
test as (select *, {d.SQL_TAIL} as p, count(*) over (partition by cand) as good_n from good),
best as (
  select cand, rank::int as rank, broader, n, size::int as size, p, sig as significant, share / mean_share as surprise
  from (select *, p < 0.1 / good_n as sig, row_number() over (partition by cand order by (p < 0.1 / good_n) desc, share, broader) as rank from test) where rank <= 5)"""


@query("a9_enrichment", f"with {_A9} select cand, rank, broader, n, size, round(p, 8) as p, significant, round(surprise, 8) as surprise from best")
def a9_enrichment(spark, sf):
    b = d.broaders(spark, sf)
    best = enrichment.enrichment(enrichment.broader_counts(d.candidates(spark, sf), b), enrichment.corpus_shares(b))
    return best.withColumns({"p": F.round("p", 8), "surprise": F.round("surprise", 8)})


@query(
    "a10_log_odds",
    f"""with {d.SQL_ENRICHMENT}, k as (select *, n > 0.1 * size as fit, max((n > 0.1 * size)::int) over (partition by cand) as any_fit from counts),
    o as (select cand, k.broader, round(ln((n / size) / (pairs / (select count(distinct entity) from br))), 10) as lo from k join pairs p on k.broader = p.broader where fit or any_fit = 0)
    select cand, rank::int as rank, broader, round(lo, 8) as log_odds from (select *, row_number() over (partition by cand order by lo desc, broader) as rank from o) where rank <= 5""",
)
def a10_log_odds(spark, sf):
    b = d.broaders(spark, sf)
    return enrichment.log_odds(enrichment.broader_counts(d.candidates(spark, sf), b), b).withColumn("log_odds", F.round("log_odds", 8))


_A15 = f"""with {_A9},
c as (select p_brand as cand, count(*) as size from part group by 1),
e as (
  select c.cand, c.size, (select count(*) from counts x where x.cand = c.cand) as nb, b.p, b.surprise
  from c left join best b on b.cand = c.cand and b.rank = 1)
select length(cand)::int as k, count(*) as number_of_candidates, round(avg(size), 6) as average_candidate_size, max(size)::int as maximum_candidate_size, min(size)::int as minumum_candidate_size,
  round(count_if(p < 0.05 / nb) / count(*), 8) as proportion_significantly_enriched_HIB,
  round(count_if(p < 0.05 / nb and surprise < 1) / count(*), 8) as proportion_matching_smaller_than_average_broaders_HIB, round(max(coalesce(p, 0.1)), 8) as max_pvalue
from e group by 1"""


@query("a15_experiment_metrics", _A15)
def a15_experiment_metrics(spark, sf):
    b, c = d.broaders(spark, sf), d.candidates(spark, sf)
    counts = enrichment.broader_counts(c, b)
    best = enrichment.enrichment(counts, enrichment.corpus_shares(b))
    e = enrichment.enriched_candidates(c, counts, best).select(
        F.length("cand").alias("k"), "entities", F.size("broader_counts").alias("n_broaders"), "best_p", F.get(F.col("log_odds"), F.lit(0))["loggods"].alias("top_p"), F.get(F.col("log_odds"), F.lit(0))["suprise"].alias("top_surprise"),
    )
    m = evaluation.experiment_metrics(e, ["k"])
    rounded = {c: F.round(c, 8) for c in ("proportion_significantly_enriched_HIB", "proportion_matching_smaller_than_average_broaders_HIB", "max_pvalue")}
    return m.withColumns(rounded | {"average_candidate_size": F.round("average_candidate_size", 6)})


@query("j3_best_labels", f"with {_A9} select c.cand, coalesce(case when b.broader is not null then coalesce(case when length(b.broader) > 5 then upper(b.broader) end, b.broader) end, '') as label from (select distinct p_brand as cand from part) c left join best b on c.cand = b.cand and b.rank = 1")
def j3_best_labels(spark, sf):
    b, c = d.broaders(spark, sf), d.candidates(spark, sf)
    counts = enrichment.broader_counts(c, b)
    labels = b.select("broader").distinct().where(F.length("broader") > 5).withColumn("label", F.upper("broader"))
    return enrichment.enriched_candidates(c, counts, enrichment.enrichment(counts, enrichment.corpus_shares(b)), labels).select("cand", F.col("best_match_broader_label").alias("label"))


@query("f10_large_enough", "with c as (select p_brand as cand, length(p_brand)::int as k, count(*)::int as size from part group by 1, 2), f as (select * from c where size >= 80) select cand, k, size from f where k in (select k from f group by 1 having count(*) >= 2)")
def f10_large_enough(spark, sf):
    c = d.candidates(spark, sf).withColumn("k", F.length("cand"))
    return evaluation.large_enough(c, 80, ["k"]).select("cand", "k", F.size("entities").alias("size"))


# ------------------------------------------------------------ null model


#: Random deals of classes (cand, entities): table ``deals`` (replicate, cand, entities).
_DEALS = """
reps as (select unnest(range(0, {n}))::int as replicate),
bag as (select cand, (unnest(range(1, len(entities) + 1)) - 1)::int as place, unnest(entities) as entity from {table}),
dealt as (select replicate, entity, row_number() over (partition by replicate order by md5(entity || '|' || cand || '|' || place || '|' || replicate || '|{seed}'), entity, cand, place) as pos from bag, reps),
bounds as (select cand, len(entities) as n, sum(len(entities)) over (order by md5(cand), cand) as hi from {table}),
slots as (select cand, unnest(range(hi::bigint - n + 1, hi::bigint + 1)) as pos from bounds),
deals as (select replicate, cand, list_sort(list(entity)) as entities from dealt join slots using (pos) group by 1, 2)
"""
_CANDIDATES = "cands as (select p_brand as cand, list(p_partkey::varchar order by p_partkey::varchar) as entities from part group by 1)"


@query("p1_random_candidates", f"with {_CANDIDATES}, {_DEALS.format(n=5, seed=0, table='cands')} select replicate, cand, array_to_string(entities, ',') as entities from deals")
def p1_random_candidates(spark, sf):
    return nullmodel.random_candidates(d.candidates(spark, sf), 5).select("replicate", "cand", F.array_join("entities", ",").alias("entities"))


def _values(spark, sf) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select("l_linenumber", F.when(F.col("l_quantity") != 7, F.col("l_discount")).alias("value"), (F.col("l_returnflag") != "A").alias("is_random"))


_VALUES = "v as (select l_linenumber, case when l_quantity <> 7 then l_discount end as value, l_returnflag <> 'A' as is_random from lineitem)"


@query(
    "p3_above_random",
    f"""with {_VALUES}, s as (select l_linenumber, avg(value) as m, stddev_pop(value) as sd from v where is_random and value is not null group by 1)
    select v.l_linenumber, count_if(not is_random and value is not null and value - m > 1.2 * sd)::bigint as above from v left join s on v.l_linenumber = s.l_linenumber group by 1""",
)
def p3_above_random(spark, sf):
    return nullmodel.above_random(_values(spark, sf), ["l_linenumber"], 1.2)


@query(
    "p5_histogram",
    f"""with {_VALUES}, f as (select * from v where value is not null), s as (select l_linenumber, min(value) as lo, max(value) as hi from f group by 1),
    b as (select f.l_linenumber, least(floor((value - lo) / ((hi - lo) / 10)), 9)::int as bin, lo, hi from f join s on f.l_linenumber = s.l_linenumber where not is_random)
    select l_linenumber, bin, round(lo + bin * (hi - lo) / 10, 8) as lo, round(lo + (bin + 1) * (hi - lo) / 10, 8) as hi, count(*) as n from b group by l_linenumber, bin, b.lo, b.hi""",
)
def p5_histogram(spark, sf):
    return nullmodel.histogram(_values(spark, sf), ["l_linenumber"]).withColumns({"lo": F.round("lo", 8), "hi": F.round("hi", 8)})


#: Bins of a table (g, value, is_random): tables ``o`` (of a group) and ``c`` (cells).
_CELLS = """
o as (
  select g, min(value) as lo, max(value) as hi, count_if(value is not null and not is_random) as induced, count_if(value is not null and is_random) as random,
    stddev_samp(case when is_random then value end) as dev, coalesce(bool_or(value is null and not is_random), false) as hole
  from {table} group by 1),
c as (
  select t.g, is_random, count(*)::double as n, avg(value) as x
  from {table} t join o on t.g = o.g where value is not null
  group by t.g, is_random, case when hi > lo then least(floor((value - lo) / ((hi - lo) / 2048)), 2047) else 0 end)
"""
#: The error function by its series with positive terms only; beyond 6 it is 1 in doubles.
_ERF = "case when abs({z}) > 6 then sign({z}) when {z} = 0 then 0 else sign({z}) * list_sum(list_transform(range(0, 130), lambda i: exp((2 * i + 1) * ln(abs({z})) - lgamma(i + 1.5) - {z} * {z}))) end"
_TAIL_OF = f"""
inside as (
  select i.g, i.x, i.n, sum(r.n * ({_ERF.format(z="((i.x - r.x) / (o.dev * pow(o.random, -0.2) * sqrt(2)))")} - {_ERF.format(z="((2 * o.lo - o.hi - r.x) / (o.dev * pow(o.random, -0.2) * sqrt(2)))")})) / (2 * max(o.random)) as mass
  from c i join c r on i.g = r.g and not i.is_random and r.is_random join o on o.g = i.g where o.random > 1 and o.dev > 0 group by 1, 2, 3),
tails as (select o.g, t.tail from o left join (select g, sum(n * (1 - mass)) / sum(n) as tail from inside group by 1) t on t.g = o.g)
"""
_KL_OF = """
dev as (select c.g, sqrt(sum(n * (x - m) * (x - m)) / (sum(n) - 1)) as dev, sum(n) as total, count(*) as cells from c join (select g, sum(n * x) / sum(n) as m from c where not is_random group by 1) a on a.g = c.g where not is_random group by 1),
points as (select g, unnest(range(0, 301)) as i, lo, hi from o),
dens as (
  select p.g, p.i, c.is_random, sum(c.n * exp(-pow((p.lo - (p.hi - p.lo) / 2 + p.i * (2 * (p.hi - p.lo)) / 300 - c.x) / (case when c.is_random then o.dev * pow(o.random, -0.2) else dev.dev * pow(dev.total, -0.2) end), 2) / 2)) as v
  from points p join c on c.g = p.g join o on o.g = p.g left join dev on dev.g = p.g where o.random > 1 and o.dev > 0 and (c.is_random or dev.cells > 1) group by 1, 2, 3),
share as (select g, i, is_random, v / sum(v) over (partition by g, is_random) as v from dens),
kls as (
  select o.g, case when o.random > 1 and o.dev > 0 then case when o.hole or o.induced < 2 or dev.cells < 2 or dev.cells is null then 0.0 else k.kl end end as kl
  from o left join dev on dev.g = o.g
  left join (select a.g, sum(case when a.v > 0 then a.v * ln(a.v / b.v) else 0 end) as kl from share a join share b on a.g = b.g and a.i = b.i and a.is_random and not b.is_random group by 1) k on k.g = o.g)
"""


def _densities(spark, sf) -> DataFrame:
    """A sum of discount and tax of every line item."""
    li = table(spark, sf, "lineitem")
    return li.select("l_linenumber", F.round(F.col("l_discount") + 2 * F.col("l_tax"), 2).alias("value"), (F.col("l_returnflag") != "A").alias("is_random"))


_DENSITIES = "d as (select l_linenumber as g, round(l_discount + 2 * l_tax, 2) as value, l_returnflag <> 'A' as is_random from lineitem)"


@query("p2_mean_tail", f"with {_DENSITIES}, {_CELLS.format(table='d')}, {_TAIL_OF} select g as l_linenumber, round(tail, 8) as tail from tails")
def p2_mean_tail(spark, sf):
    return nullmodel.mean_tail(_densities(spark, sf), ["l_linenumber"]).withColumn("tail", F.round("tail", 8))


@query("p4_divergence", f"with {_DENSITIES}, {_CELLS.format(table='d')}, {_KL_OF} select g as l_linenumber, round(kl, 8) as kl from kls")
def p4_divergence(spark, sf):
    return nullmodel.divergence(_densities(spark, sf), ["l_linenumber"]).withColumn("kl", F.round("kl", 8))


# ------------------------------------------------------------ evaluation grid


@query(
    "a11_grid",
    f"""with {d.SQL_EXPERIMENTS} select a.linker, b.th, c.k, m.m, coalesce(v.value, -1) as value
    from (select distinct linker from ex) a, (select distinct th from ex) b, (select distinct k from ex) c, (select distinct m from ex) m
    left join (select linker, th, k, m, min_by(quant4, number_of_candidates) as value from ex group by 1, 2, 3, 4) v on v.linker = a.linker and v.th = b.th and v.k = c.k and v.m = m.m""",
)
def a11_grid(spark, sf):
    return evaluation.grid(d.experiments(spark, sf), "quant4", "number_of_candidates")


@query(
    "a11_matrix",
    f"""with {d.SQL_EXPERIMENTS}, cells as (
      select a.linker, b.th, c.k, m.m, coalesce(v.quant4, -1) as value
      from (select distinct linker from ex) a, (select distinct th from ex) b, (select distinct k from ex) c, (select distinct m from ex) m
      left join ex v on v.linker = a.linker and v.th = b.th and v.k = c.k and v.m = m.m)
    select linker, th, k, {", ".join(f'max(case when m = {m} then value end) as "{m}"' for m in (0, 10, 20, 30, 40, 50))} from cells group by 1, 2, 3""",
)
def a11_matrix(spark, sf):
    return evaluation.matrix(a11_grid(spark, sf), [0, 10, 20, 30, 40, 50])


@query("a12_best_rows", f"with {d.SQL_EXPERIMENTS} select k, m, th, linker, quant4 from (select *, rank() over (partition by linker order by quant4 desc) as r from ex) where r = 1")
def a12_best_rows(spark, sf):
    return evaluation.best_rows(d.experiments(spark, sf), "quant4").select("k", "m", "th", "linker", "quant4")


@query(
    "a13_bounds",
    f"""with {d.SQL_EXPERIMENTS}, f as (select * from ex where not (th in (5, 6) and k = 10))
    select 'quant4' as criterion, min(quant4) as least, least(max(quant4), 0.09) as most from f union all select 'max_pvalue', min(max_pvalue), max(max_pvalue) from f""",
)
def a13_bounds(spark, sf):
    return evaluation.bounds(d.experiments(spark, sf), ["quant4", "max_pvalue"], {"quant4": 0.09})


@query("f11_excluded", f"with {d.SQL_EXPERIMENTS} select k, m, th, linker from ex where not (th in (5, 6) and k = 10)")
def f11_excluded(spark, sf):
    return d.experiments(spark, sf).where(~evaluation.excluded()).select("k", "m", "th", "linker")


@query(
    "a14_normalised",
    f"""with {d.SQL_EXPERIMENTS} select k, m, th, linker, round(1 - oddsratios_probs_vs_random_LIB, 8) as one_minus_avg_pval_oddsratios_HIB,
      round(above2std_of_oddsrations_vs_random_HIB / number_of_candidates, 8) as above2std_of_oddsrations_vs_random_normalized_HIB from ex""",
)
def a14_normalised(spark, sf):
    n = evaluation.normalised(d.experiments(spark, sf))
    return n.select("k", "m", "th", "linker", *(F.round(c, 8).alias(c) for c in ("one_minus_avg_pval_oddsratios_HIB", "above2std_of_oddsrations_vs_random_normalized_HIB")))


@query("a16_axis_values", f"with {d.SQL_EXPERIMENTS} select distinct 'k' as param, k::varchar as value from ex union select distinct 'm', m::varchar from ex union select distinct 'th', th::varchar from ex union select distinct 'linker', linker from ex")
def a16_axis_values(spark, sf):
    return evaluation.axis_values(d.experiments(spark, sf), ["k", "m", "th", "linker"])
