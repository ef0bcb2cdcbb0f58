"""Registered queries that go through files, services, caches and reports, with their twins."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexatlas import config
from lexatlas.functions import languages, text
from lexatlas.operators import enrichment, evaluation, linking, multimap, nullmodel, reports, substitutes
from lexatlas.plans import corpus, registry
from lexatlas.plans import derived as d
from lexatlas.plans.registry import query
from lexatlas.runtime import open_uri, scratch, table
from lexatlas.sources import conll, files, services, tables

# ------------------------------------------------------------ token files


def _token_lines(spark, sf, sep: str, middle: str) -> DataFrame:
    """doc_id, line_no, value: a line for each token, a blank line after a form that ends with a full stop."""
    line = lambda t: F.concat(t["forms"], F.lit(sep + middle), F.array_join(t["tags"], "-"))
    rows = d.token_arrays(spark, sf).withColumn("t", F.arrays_zip("forms", "tags"))
    lines = F.flatten(F.transform("t", lambda t: F.when(t["forms"].endswith("."), F.array(line(t), F.lit(""))).otherwise(F.array(line(t)))))
    return rows.select("doc_id", F.posexplode(lines).alias("line_no", "value"))


def _tokens_sql(corpus_id: str, limit: int) -> str:
    """Token lines as they are read again: remarks are gone, sentences end at blank lines."""
    return f"""with {d.SQL_TOKENS},
    seen as (select *, {corpus_id} as corpus, coalesce(sum((form like '%.')::int) over (partition by {corpus_id} order by doc_id, tok_idx rows between unbounded preceding and 1 preceding), 0) as breaks from tok),
    kept as (select *, row_number() over (partition by corpus order by doc_id, tok_idx) - 1 as i, dense_rank() over (partition by corpus order by breaks) - 1 as sent from seen where form not like '#%')
    select corpus as corpus_id, sent as sent_idx, i as tok_idx, form, array_to_string(tag, '-') as tag from kept where i < {limit}"""


def _read_back(found: DataFrame) -> DataFrame:
    part = F.regexp_extract("corpus_id", r"/part=(\d+)/", 1).cast("long")
    return found.select(part.alias("corpus_id"), "sent_idx", "tok_idx", "form", F.array_join("tag", "-").alias("tag"))


def _written(spark, sf, sep: str, middle: str) -> str:
    path = scratch(spark, "conll")
    lines = _token_lines(spark, sf, sep, middle).withColumn("part", F.col("doc_id") % 4)
    order = ("part", "doc_id", "line_no")
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("part", "value").write.partitionBy("part").text(path)  # files in order
    return path


@query("s1_parse_conll", _tokens_sql("doc_id", 500))
def s1_parse_conll(spark, sf):
    lines = _token_lines(spark, sf, "\t", "x\ty\t").withColumnRenamed("doc_id", "corpus_id")
    found = conll.parse_tokens(lines, n_tokens=500)
    return found.select("corpus_id", "sent_idx", "tok_idx", "form", F.array_join("tag", "-").alias("tag"))


@query("s2_conll_files", _tokens_sql("doc_id % 4", 30_000))
def s2_conll_files(spark, sf):
    return _read_back(conll.read_conll(spark, _written(spark, sf, "\t", "x\ty\t"), n_tokens=30_000, folders=True))


@query("s3_blank_separated_files", _tokens_sql("doc_id % 4", 1 << 60))
def s3_blank_separated_files(spark, sf):
    return _read_back(conll.read_conll(spark, _written(spark, sf, " ", ""), ("form", "tag"), blanks_separate=True, folders=True))


# ------------------------------------------------------------ mention, sense, type and evaluation files

_LINKED = f"{d.SQL_MENTIONS}, linked as (select *, case when first_idx % 3 = 0 then '<https://no.entity.found>' else '<http://kb.example.org/' || length(ne) || '>' end as uri from mentions)"
_LINKED_READ = f"{_LINKED}, file as (select split_part(ne || '::' || tag, '::', 1) as ne, split_part(ne || '::' || tag, '::', -1) as tag, start, \"end\", context, uri from linked)"


def _mention_file(spark, sf) -> str:
    m = d.mentions(spark, sf)
    uri = F.when(F.col("first_idx") % 3 == 0, "<https://no.entity.found>").otherwise(F.concat(F.lit("<http://kb.example.org/"), F.length("ne"), F.lit(">")))
    path = scratch(spark, "mentions")
    tables.write_mentions(m.withColumn("uri", uri), path)
    return path


@query("s4_k1_mention_file", f"with {_LINKED_READ} select ne, tag, start, \"end\", context, case when uri like '%no.entity.found%' then ne else uri end as uri from file")
def s4_k1_mention_file(spark, sf):
    return tables.read_mentions(spark, _mention_file(spark, sf))


@query(
    "s5_types_of_file",
    f"with {_LINKED_READ}, t as (select distinct case when uri like '%no.entity.found%' then ne else uri end as uri, tag from file) select distinct uri || '##1' as entity, t.tag as broader from t where not contains(uri, '##')",
)
def s5_types_of_file(spark, sf):
    linker = linking.TypeLinker(tables.read_mentions(spark, _mention_file(spark, sf)))
    entities = linker.mentions.select("uri").where(~F.col("uri").contains("##")).distinct()
    return linker.broaders(entities.select(F.concat("uri", F.lit("##1")).alias("entity")))


_SENSES = "senses as (select case when p_partkey % 5 = 0 then 'part ' || p_partkey else p_brand end as entity, (row_number() over (partition by case when p_partkey % 5 = 0 then 'part ' || p_partkey else p_brand end order by p_partkey) - 1)::int as sense_ix, string_split(p_name, ' ') as descriptors from part)"


def _some_senses(spark, sf) -> DataFrame:
    entity = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("part "), "p_partkey")).otherwise(F.col("p_brand"))
    p = table(spark, sf, "part").withColumn("entity", entity)
    number = F.row_number().over(Window.partitionBy("entity").orderBy("p_partkey")) - 1
    return p.select("entity", number.alias("sense_ix"), F.split("p_name", " ").alias("descriptors"))


def _flat_senses(read: DataFrame) -> DataFrame:
    return read.select("entity", "sense_ix", F.array_join("descriptors", "|").alias("descriptors"))


_SENSE_ROWS = "select entity, case when count(*) over (partition by entity) > 1 then sense_ix end as sense_ix, array_to_string(descriptors, '|') as descriptors from senses"


@query("s7_k2_senses_file", f"with {_SENSES} {_SENSE_ROWS}")
def s7_k2_senses_file(spark, sf):
    path = files.write_senses_file(_some_senses(spark, sf), scratch(spark, "senses"), 30, 50)
    return _flat_senses(tables.read_senses(spark, path, lines=False))


@query("s7_k2_senses_lines", f"with {_SENSES} {_SENSE_ROWS}")
def s7_k2_senses_lines(spark, sf):
    path = scratch(spark, "senses")
    tables.write_senses(_some_senses(spark, sf), path)
    return _flat_senses(tables.read_senses(spark, path))


@query("k3_snapshot", f"with {_SENSES} {_SENSE_ROWS} where entity in (select distinct entity from senses order by 1 limit 11)")
def k3_snapshot(spark, sf):
    path = files.write_senses_file(_some_senses(spark, sf), scratch(spark, "senses"), 30, 50, corpus.SNAPSHOT)
    return _flat_senses(tables.read_senses(spark, path, lines=False))


def _types(spark, sf) -> DataFrame:
    p = table(spark, sf, "part")
    group = {"m": (F.col("p_size") % 3 + 1) * 10, "k": F.when(F.col("p_partkey") % 2 == 0, 10).otherwise(50), "th": (F.col("p_size") % 2 + 3)}
    g = p.withColumns(group).groupBy("m", "k", "th", "p_brand").agg(F.array_sort(F.collect_list(F.col("p_partkey").cast("string"))).alias("entities"))
    ix = F.row_number().over(Window.partitionBy("m", "k", "th").orderBy("p_brand")) - 1
    rows = g.withColumn("type_ix", ix).where("not (m = 20 and type_ix = 5)")
    return rows.select("m", "k", "th", "type_ix", (F.size("entities") / 8).alias("score"), F.array(F.col("p_brand"), F.lit("a\"b\\c")).alias("descriptors"), "entities")


_TYPE_ROWS = """
with g as (
  select ((p_size % 3 + 1) * 10)::int as m, case when p_partkey % 2 = 0 then 10 else 50 end as k, (p_size % 2 + 3)::int as th, p_brand, list(p_partkey::varchar order by p_partkey::varchar) as entities from part group by 1, 2, 3, 4),
t as (select *, (row_number() over (partition by m, k, th order by p_brand) - 1)::int as type_ix from g)
select m, k, th, type_ix, len(entities) / 8 as score, p_brand || '|a"b\\c' as descriptors, array_to_string(entities, ',') as entities from t where not (m = 20 and type_ix >= 5)"""


def _flat_types(read: DataFrame) -> DataFrame:
    return read.select("m", "k", "th", "type_ix", "score", F.array_join("descriptors", "|").alias("descriptors"), F.array_join("entities", ",").alias("entities"))


@query("s8_s10_k4_type_files", _TYPE_ROWS)
def s8_s10_k4_type_files(spark, sf):
    folder = scratch(spark, "types")
    files.write_type_files(_types(spark, sf), folder)
    return _flat_types(files.read_type_files(spark, folder))


@query("s8_k4_type_partitions", _TYPE_ROWS)
def s8_k4_type_partitions(spark, sf):
    folder = scratch(spark, "types")
    tables.write_types(_types(spark, sf), folder)
    return _flat_types(tables.read_types(spark, folder))


@query("s9_path_parameters", "select p_partkey, (p_partkey % 100)::double as m, p_size::double as k, (p_partkey % 10 + 0.5)::double as th from part")
def s9_path_parameters(spark, sf):
    p = table(spark, sf, "part")
    path = F.concat(F.lit("/data/m"), F.col("p_partkey") % 100, F.lit("/k"), "p_size", F.lit("_th"), F.col("p_partkey") % 10, F.lit(".5"))
    found = tables.params_of_path(F.col("path"))
    return p.select("p_partkey", path.alias("path")).select("p_partkey", *(found[c].alias(c) for c in ("m", "k", "th")))


_EVALUATION_ROWS = f"""{d.SQL_EXPERIMENTS},
rows as (
  select k, m, th, linker, oddsratios_probs_vs_random_LIB, above2std_of_oddsrations_vs_random_HIB::double as above2std_of_oddsrations_vs_random_HIB, quant4 * 2 as KL_vs_random_HIB, number_of_candidates::int as number_of_candidates,
    quant4 * 100 as average_candidate_size, (number_of_candidates + k)::int as maximum_candidate_size, k as minumum_candidate_size, quant4 as proportion_significantly_enriched_HIB, quant4 / 2 as proportion_matching_smaller_than_average_broaders_HIB, max_pvalue
  from ex)"""


def _evaluation_rows(spark, sf) -> DataFrame:
    ex = d.experiments(spark, sf)
    return ex.select(
        "k", "m", "th", "linker", "oddsratios_probs_vs_random_LIB", F.col("above2std_of_oddsrations_vs_random_HIB").cast("double").alias("above2std_of_oddsrations_vs_random_HIB"), (F.col("quant4") * 2).alias("KL_vs_random_HIB"),
        F.col("number_of_candidates").cast("int").alias("number_of_candidates"), (F.col("quant4") * 100).alias("average_candidate_size"), (F.col("number_of_candidates") + F.col("k")).cast("int").alias("maximum_candidate_size"),
        F.col("k").alias("minumum_candidate_size"), F.col("quant4").alias("proportion_significantly_enriched_HIB"), (F.col("quant4") / 2).alias("proportion_matching_smaller_than_average_broaders_HIB"), "max_pvalue",
    )


@query("s11_k5_evaluation_file", f"with {_EVALUATION_ROWS} select * from rows")
def s11_k5_evaluation_file(spark, sf):
    path = scratch(spark, "evaluation")
    tables.write_evaluation(_evaluation_rows(spark, sf), path)
    return tables.read_evaluation(spark, path)


@query("k6_experiment_json", f"with {_EVALUATION_ROWS} select linker, k, m, th, quant4 as enriched, 0.05 as pvalthrs, k || ' ' || m as candidate from (select *, proportion_significantly_enriched_HIB as quant4 from rows)")
def k6_experiment_json(spark, sf):
    rows = _evaluation_rows(spark, sf).withColumn("candidate_types", F.array(F.struct(F.concat_ws(" ", "k", "m").alias("name"))))
    path = scratch(spark, "experiments")
    tables.evaluation_json(rows, ["k", "m", "th", "linker", "proportion_significantly_enriched_HIB"], {"pvalthrs": 0.05, "num_random": 0}).write.text(path)
    kind = "candidate_types array<struct<name: string>>, evaluation_results struct<k: int, m: int, th: int, linker: string, proportion_significantly_enriched_HIB: double>, evaluation_parameters struct<pvalthrs: double, num_random: int>"
    read = spark.read.schema(kind).json(path)
    r = F.col("evaluation_results")
    return read.select(r["linker"].alias("linker"), r["k"].alias("k"), r["m"].alias("m"), r["th"].alias("th"), r["proportion_significantly_enriched_HIB"].alias("enriched"), F.col("evaluation_parameters.pvalthrs").alias("pvalthrs"), F.col("candidate_types")[0]["name"].alias("candidate"))


_INI = """[wikiner]
; folder of the run
base_dir=/data/de
conll_data_path=${base_dir}/tokens.conll
ner_contexts_output=${base_dir}/mentions.tsv
nes_senses_output_stem=${base_dir}/senses
tokens_to_be_processed=120000
language=de
ms=3,10
max_k=50
[entity_linking]
linker=dummy
cache=${wikiner:base_dir}/cache
"""


@query(
    "s12_configuration",
    """select * from (values ('wikiner', 'base_dir', '/data/de'), ('wikiner', 'conll_data_path', '/data/de/tokens.conll'), ('wikiner', 'ner_contexts_output', '/data/de/mentions.tsv'), ('wikiner', 'nes_senses_output_stem', '/data/de/senses'),
    ('wikiner', 'tokens_to_be_processed', '120000'), ('wikiner', 'language', 'de'), ('wikiner', 'ms', '3,10'), ('wikiner', 'max_k', '50'), ('entity_linking', 'linker', 'dummy'), ('entity_linking', 'cache', '/data/de/cache')) as t(section, name, value)""",
)
def s12_configuration(spark, sf):
    path = scratch(spark, "config") + "/run.conf"
    with open_uri(path, "w") as out:
        out.write(_INI.encode())
    sections = config.load(spark, path)
    config.SensesRun.of(sections)
    return spark.createDataFrame([(s, n, v) for s, own in sections.items() for n, v in own.items()], "section string, name string, value string")


# ------------------------------------------------------------ services and caches


def _concept(key: str) -> str:
    number = int(key[1:])
    if number % 5 == 0:
        raise TimeoutError(key)
    statements = [{"propertyId": "P31", "value": f"N{number % 25}", "valueName": f"nation {number % 25}"}, {"propertyId": "P279", "value": f"R{number % 5}"}]
    return json.dumps({"wikidataId": key, "preferredTerm": f"customer {number}"} | ({"statements": statements} if number % 7 else {}))


def _customers(spark, sf) -> DataFrame:
    return table(spark, sf, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("key"))


@query("s13_fetched_concepts", "select 'C' || c_custkey as key, c_custkey % 5 <> 0 as answered, case when c_custkey % 5 = 0 then 2 else 1 end as tries from customer")
def s13_fetched_concepts(spark, sf):
    found = services.fetched(_customers(spark, sf), _concept)
    return found.select("key", F.col("response").isNotNull().alias("answered"), "tries")


@query(
    "s13_concept_edges",
    """select 'C' || c_custkey as child, unnest(['P31', 'P279']) as property, unnest(['N' || c_custkey % 25, 'R' || c_custkey % 5]) as parent, unnest(['nation ' || c_custkey % 25, null]) as label
    from customer where c_custkey % 5 <> 0 and c_custkey % 7 <> 0""",
)
def s13_concept_edges(spark, sf):
    return services.concept_edges(services.fetched(_customers(spark, sf), _concept))


@query("s15_preferred_labels", "select 'C' || c_custkey as wid, 'customer ' || c_custkey as label from customer where c_custkey % 5 <> 0")
def s15_preferred_labels(spark, sf):
    return services.preferred_labels(services.fetched(_customers(spark, sf), _concept))


def _entities(body: str) -> str:
    asked = json.loads(body)
    said = asked.get("text") or asked["shortText"]
    first = len(said.split(" ")[0])
    found = [{"rawName": said[:first], "wikidataId": f"Q{first}", "offsetStart": 0, "offsetEnd": first, "nerd_score": 0.5}, {"rawName": said, "offsetStart": 0, "offsetEnd": len(said)}]
    return json.dumps({"entities": found, "short": "shortText" in asked})


@query(
    "s14_disambiguation",
    """with t as (select distinct p_name as t from part union select distinct split_part(p_name, ' ', 1) from part), f as (select t, split_part(t, ' ', 1) as w from t)
    select t as text, unnest([0, 1])::int as pos, unnest(['Q' || length(w), null]) as "wikidataId", 0 as "offsetStart", unnest([length(w), length(t)])::int as "offsetEnd", unnest([w, t]) as "rawName", unnest([0.5, null])::double as nerd_score from f""",
)
def s14_disambiguation(spark, sf):
    p = table(spark, sf, "part")
    said = p.select(F.col("p_name").alias("text")).union(p.select(F.split("p_name", " ")[0])).distinct().withColumn("key", services.disambiguation_request(F.col("text"), "de"))
    found = services.entity_candidates(services.fetched(said, _entities))
    return said.join(found, "key").select("text", "pos", "wikidataId", "offsetStart", "offsetEnd", "rawName", "nerd_score")


@query("s16_k9_cache", "select 'C' || c_custkey as key, case when c_custkey = 3 then 'stored first' when c_custkey % 5 <> 0 then 'kept' end as response from customer")
def s16_k9_cache(spark, sf):
    path, keys = scratch(spark, "cache"), _customers(spark, sf)
    first = services.Cache(spark, path, flush_after=10)
    first.store(spark.createDataFrame([("C3", "stored first"), ("C3", "stored first")], "key string, response string"))
    first.lookup(keys.where("key like '%1'"), _concept)
    first.flush()
    again = services.Cache(spark, path)
    found = again.lookup(keys, _concept)
    again.store(spark.createDataFrame([("C3", "too late")], "key string, response string"))
    again.flush()
    whole = services.Cache(spark, path).table()
    return found.select("key").join(whole, "key").select("key", F.when(F.col("response") == "stored first", "stored first").when(F.col("response").isNotNull(), "kept").alias("response"))


@query("e10_probe", "select true as known, false as unknown")
def e10_probe(spark, sf):
    answers = [services.responds(spark, lambda name, ok=ok: f"found {name}" if ok else 1 / 0) for ok in (True, False)]
    return spark.createDataFrame([tuple(answers)], "known boolean, unknown boolean")


# ------------------------------------------------------------ linkers


@query("e2_link_keys", "select c_custkey, md5(c_name) || '_@_' || md5(c_mktsegment) as key from customer")
def e2_link_keys(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", linking.link_key(F.col("c_name"), F.col("c_mktsegment")).alias("key"))


@query("e6_type_labels", f"with {d.SQL_MENTIONS} select distinct ne as uri, ne as label from mentions")
def e6_type_labels(spark, sf):
    m = d.mentions(spark, sf).withColumn("uri", F.col("ne"))
    return linking.TypeLinker(m).labels(m.select("uri").distinct())


@query(
    "e7_standalone",
    """with t as (select distinct p_name as ne from part)
    select ne, ne || ' ist ein Begriff, den wir finden wollen' as context, case when length(ne) % 3 < 2 then '<http://www.wikidata.org/entity/Q' || length(ne) || '>' else '<' || ne || '>' end as uri from t""",
)
def e7_standalone(spark, sf):
    m = linking.standalone(table(spark, sf, "part").select(F.col("p_name").alias("ne")), "de")
    size = F.length("ne")
    c = m.select(
        "context_id", F.lit(0).alias("pos"), F.concat(F.lit("Q"), size).alias("wikidataId"), F.lit(0).alias("offsetStart"), F.when(size % 3 < 2, size - size % 3).otherwise(1).alias("offsetEnd"),
        F.lit(0.9).alias("nerd_score"), F.lit(None).cast("double").alias("nerd_selection_score"),
    )
    return linking.GraphLinker(c, None, None).link(m).select("ne", "context", "uri")


@query(
    "e9_labels",
    "select c_custkey, case when c_nationkey % 3 = 0 then 'de ' || n_name when c_nationkey % 3 = 1 then 'en ' || n_name else 'N' || c_nationkey end as label from customer join nation on n_nationkey = c_nationkey",
)
def e9_labels(spark, sf):
    n = table(spark, sf, "nation").withColumn("wid", F.concat(F.lit("N"), "n_nationkey"))
    de = n.where("n_nationkey % 3 = 0").select("wid", F.lit("de-at").alias("lang"), F.concat(F.lit("de "), "n_name").alias("label"))
    en = n.where("n_nationkey % 3 < 2").select("wid", F.lit("en").alias("lang"), F.concat(F.lit("en "), "n_name").alias("label"))
    c = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("<http://www.wikidata.org/entity/N"), "c_nationkey", F.lit(">##"), F.col("c_custkey") % 3).alias("uri"))
    labels = linking.GraphLinker(None, None, de.unionByName(en), "de").labels(c.select("uri").distinct())
    return c.join(labels, "uri").select("c_custkey", "label")


@query(
    "e11_made_uris",
    """with t as (select c_custkey, c_name || ' of ' || c_mktsegment as s from customer), h as (select *, md5(s) as h from t)
    select c_custkey, '<https://some.uri/' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] || '/' || replace(lower(s), ' ', '_') || '>' as uri from h""",
)
def e11_made_uris(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.concat_ws(" of ", "c_name", "c_mktsegment").alias("s"))
    return c.select("c_custkey", linking.made_uri(F.col("s")).alias("uri"))


@query("e12_gathered", "select p_brand, array_to_string(list(p_size order by p_partkey), ',') as sizes, array_to_string(flatten(list(string_split(p_name, ' ') order by p_partkey)), ',') as words from part group by 1")
def e12_gathered(spark, sf):
    p = table(spark, sf, "part").select("p_brand", "p_partkey", F.struct(F.col("p_size").cast("string").alias("sizes"), F.split("p_name", " ").alias("words")).alias("value"))
    found = multimap.gather(p, "p_brand", "value", "p_partkey")
    return found.select("p_brand", F.array_join("sizes", ",").alias("sizes"), F.array_join("words", ",").alias("words"))


@query("e12_gathered_lists", "select p_brand, array_to_string(list(p_partkey::varchar order by p_partkey), ',') as ids, array_to_string(flatten(list(string_split(p_name, ' ') order by p_partkey)), ',') as words from part group by 1")
def e12_gathered_lists(spark, sf):
    p = table(spark, sf, "part").select("p_brand", "p_partkey", F.col("p_partkey").cast("string").alias("id"), F.split("p_name", " ").alias("words"))
    ids, words = multimap.gather(p, "p_brand", "id", "p_partkey"), multimap.gather(p, "p_brand", "words", "p_partkey")
    return ids.select("p_brand", F.array_join("values", ",").alias("ids")).join(words.select("p_brand", F.array_join("values", ",").alias("words")), "p_brand")


# ------------------------------------------------------------ small functions


@query("f16_local_names", "select c_custkey, c_mktsegment || '##' || c_custkey % 3 as local, c_mktsegment as plain from customer")
def f16_local_names(spark, sf):
    u = F.concat(F.lit("<http://kb.example.org/e/"), "c_mktsegment", F.lit("##"), F.col("c_custkey") % 3, F.lit(">"))
    rows = table(spark, sf, "customer").select("c_custkey", u.alias("u"))
    return rows.select("c_custkey", text.local_name("u").alias("local"), text.local_name(text.without_sense("u")).alias("plain"))


@query(
    "f3_target_tags",
    f"with {d.SQL_TOKENS}, t as (select doc_id, forms[len(forms) // 2 + 1] as target from w) select t.doc_id as context_id, min_by(array_to_string(tag, '-'), tok_idx) as tag from t left join tok on tok.doc_id = t.doc_id and tok.form = t.target group by 1",
)
def f3_target_tags(spark, sf):
    arrays = d.token_arrays(spark, sf)
    tokens = arrays.select(F.col("doc_id").alias("context_id"), F.posexplode(F.arrays_zip("forms", "tags")).alias("tok_idx", "t")).select("context_id", "tok_idx", F.col("t.forms").alias("form"), F.array_join("t.tags", "-").alias("tag"))
    targets = arrays.select(F.col("doc_id").alias("context_id"), F.get("forms", F.floor(F.size("forms") / 2).cast("int")).alias("target"))
    return substitutes.target_tag(tokens, targets)


@query(
    "l2_languages",
    """select doc_id, case lang when 'de' then 'de' when 'en' then 'en' when 'es' then 'es' end as code, case lang when 'de' then 'de_core_news_sm' when 'en' then 'en_core_web_sm' when 'es' then 'es_core_news_sm' end as model,
    case lang when 'de' then 'german' when 'en' then 'english' when 'es' then 'spanish' end as stopwords from documents""",
)
def l2_languages(spark, sf):
    names = F.when(F.col("lang") == "de", "German").when(F.col("lang") == "es", "spa").otherwise(F.col("lang"))
    docs = table(spark, sf, "documents").select("doc_id", names.alias("lang"))
    return docs.select("doc_id", languages.code(F.col("lang")).alias("code"), languages.model_name(F.col("lang")).alias("model"), languages.stopwords_name(F.col("lang")).alias("stopwords"))


@query(
    "l3_target_tokens",
    f"""with {d.SQL_MENTIONS},
    c as (select doc_id || ':' || first_idx as context_id, ne, list_filter(string_split_regex(before, '[ ]+'), lambda x: x <> '') as a, list_filter(string_split_regex(substring(context, "end" + 1), '[ ]+'), lambda x: x <> '') as b from mentions),
    t as (select context_id, ne, len(a) as pos, list_concat(a, ['[MASK]'], b) as f from c),
    k as (select *, len(f) > 30 as long, greatest(0, pos - 15) as lo from t),
    short as (select context_id, ne, case when long then f[lo + 1 : least(len(f), pos + 15)] else f end as f, case when long then pos - lo else pos end as pos from k),
    own as (select *, list_filter(string_split_regex(ne, '[ ]+'), lambda x: x <> '') as o from short)
    select context_id, true as masked, array_to_string(f, ' ') as tokens, pos::int as first, (pos + 1)::int as "end" from own
    union all select context_id, false, array_to_string(list_concat(f[1 : pos], o, f[pos + 2 :]), ' '), pos::int, (pos + len(o))::int from own""",
)
def l3_target_tokens(spark, sf):
    m = d.mentions(spark, sf).withColumn("context_id", F.concat_ws(":", "doc_id", "first_idx"))
    words = lambda s: [x for x in s.split(" ") if x]
    found = substitutes.tokenized_targets(m, words, lambda s: [s], 30)
    return found.select("context_id", "masked", F.array_join("tokens", " ").alias("tokens"), "first", "end")


# ------------------------------------------------------------ reports and whole runs


@query(
    "k10_class_reports",
    f"""with recursive {registry._PART_CLASSES},
    tags as (select i, split_part(x.e, '::', 2) as tag, count(*) as n from factors, unnest(extent) as x(e) group by 1, 2),
    listed as (select i, string_agg(tag || ': ' || n, ', ' order by n desc, tag) as tags from tags group by 1),
    total as (select count(*) as t from kept)
    select i::int as type_ix, 'Class ' || i || chr(10) as head, printf('Class %d.%s%s.%sContained NE types: %s%sClass score: %.4f, accumulated score: %.4f%sTotal NEs: %d, total descriptors: %d', i, chr(10), array_to_string(intent, ', '), chr(10), tags, chr(10), v / t, gone / t, chr(10), len(extent), len(intent)) as report
    from factors join listed using (i), total""",
)
def k10_class_reports(spark, sf):
    found = reports.class_reports(registry._part_classes(spark, sf))
    return found.select("type_ix", F.concat(F.lit("Class "), "type_ix", F.lit("\n")).alias("head"), "report")


def _chi(spark, sf) -> DataFrame:
    arrays = d.token_arrays(spark, sf)
    provider = substitutes.DistributionalProvider(arrays)
    return corpus.corpus_classes(arrays, provider, "doc_id", stopwords=registry._stopwords(spark), min_length=4)


@query("c14_corpus_classes")
def c14_corpus_classes(spark, sf):
    return reports.class_reports(_chi(spark, sf))


_COMPARED = f"""with {registry._A9}, {registry._CANDIDATES}, {registry._DEALS.format(n=5, seed=0, table="cands")},
rsizes as (select replicate || ':' || cand as cand, cand as own, len(entities) as size, entities from deals),
rcounts as (select r.cand, r.own, r.size, broader, count(*) as n from (select cand, own, size, unnest(entities) as entity from rsizes) r join br using (entity) group by 1, 2, 3, 4),
rgood as (select c.*, share, mean_share from rcounts c join shares s on c.broader = s.broader where n > 0.1 * size and n / size > share),
rtest as (select *, {d.SQL_TAIL} as p, count(*) over (partition by cand) as good_n from rgood),
rbest as (select cand, own, p from (select *, row_number() over (partition by cand order by (p < 0.1 / good_n) desc, share, broader) as rank from rtest) where rank = 1),
e as (select c.cand, c.size, (select count(*) from counts x where x.cand = c.cand) as nb, b.p, b.surprise from (select p_brand as cand, count(*) as size from part group by 1) c left join best b on b.cand = c.cand and b.rank = 1),
d as (select length(cand) as g, p as value, false as is_random from e union all select length(own), p, true from rsizes left join (select cand, p from rbest) b using (cand)),
{registry._CELLS.format(table="d")}, {registry._TAIL_OF}, {registry._KL_OF},
spread as (select g, avg(value) as m, stddev_pop(value) as sd from d where is_random and value is not null group by 1),
above as (select d.g, count_if(not is_random and value is not null and value - m > 2 * sd) as above from d join spread on spread.g = d.g group by 1)
select length(cand)::int as k, count(*) as number_of_candidates, round(avg(size), 6) as average_candidate_size, round(count_if(p < 0.05 / nb) / count(*), 6) as proportion_significantly_enriched_HIB,
  round(max(tail), 6) as oddsratios_probs_vs_random_LIB, max(above)::double as above2std_of_oddsrations_vs_random_HIB, round(max(kl), 6) as KL_vs_random_HIB, round(max(above) / count(*), 6) as above2std_of_oddsrations_vs_random_normalized_HIB
from e join tails on tails.g = length(cand) join above on above.g = length(cand) join kls on kls.g = length(cand) group by 1"""


@query("a15_evaluation_rows", _COMPARED)
def a15_evaluation_rows(spark, sf):
    b, c = d.broaders(spark, sf), d.candidates(spark, sf)
    shares = enrichment.corpus_shares(b)
    counts = enrichment.broader_counts(c, b)
    k = F.length("cand").alias("k")
    enriched = enrichment.enriched_candidates(c, counts, enrichment.enrichment(counts, shares)).select(
        k, "entities", F.size("broader_counts").alias("n_broaders"), "best_p", F.get(F.col("log_odds"), F.lit(0))["loggods"].alias("top_p"), F.get(F.col("log_odds"), F.lit(0))["suprise"].alias("top_surprise"),
    )
    dealt = nullmodel.random_candidates(c, 5).withColumn("own", F.col("cand")).withColumn("cand", F.concat_ws(":", "replicate", "cand"))
    rcounts = enrichment.broader_counts(dealt, b)
    best = enrichment.enrichment(rcounts, shares).where("rank = 1").select("cand", F.col("p").alias("best_p"))
    random_values = dealt.join(best, "cand", "left").select(F.length("own").alias("k"), "best_p")
    rows = evaluation.normalised(evaluation.experiment_rows(enriched, random_values, ["k"]))
    digits = ("average_candidate_size", "proportion_significantly_enriched_HIB", "oddsratios_probs_vs_random_LIB", "KL_vs_random_HIB", "above2std_of_oddsrations_vs_random_normalized_HIB")
    return rows.select("k", "number_of_candidates", "above2std_of_oddsrations_vs_random_HIB", *(F.round(x, 6).alias(x) for x in digits))
