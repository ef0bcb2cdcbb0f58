"""Annotated inputs derived from the plain tables (no corpus or knowledge base is at hand).

Each has a twin in SQL (``SQL_...``) that gives the same rows in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexatlas.operators.mentions import extract_mentions
from lexatlas.runtime import spread, table

WIDTH = 25


def token_arrays(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, forms, tags: capitalised words of four letters and more are entities, their kind by length and place."""
    forms = F.split("text", r"[ \t\n\r]+")
    kind = lambda x, i: F.element_at(F.array(F.lit("PER"), F.lit("LOC"), F.lit("ORG")), ((F.length(x) + i) % 3 + 1).cast("int"))
    tag = lambda x, i: F.when(x.rlike(r"^\p{Lu}") & (F.length(x) >= 4), F.array(F.lit("I"), kind(x, i))).otherwise(F.array(F.lit("O")))
    return spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", forms.alias("forms")).withColumn("tags", F.transform("forms", tag))


SQL_TOKENS = r"""
w as (select doc_id, string_split_regex(text, '[ \t\n\r]+') as forms from documents),
tok as (
  select doc_id, i - 1 as tok_idx, forms[i] as form,
    case when regexp_matches(forms[i], '^\p{Lu}') and length(forms[i]) >= 4
      then ['I', ['PER', 'LOC', 'ORG'][(length(forms[i]) + i - 1) % 3 + 1]] else ['O'] end as tag
  from w, unnest(range(1, len(forms) + 1)) as t(i))
"""


def mentions(spark: SparkSession, sf: str) -> DataFrame:
    return extract_mentions(token_arrays(spark, sf), "doc_id", WIDTH)


SQL_MENTIONS = (
    SQL_TOKENS
    + r""",
o as (select *, tag[1] in ('"', 'NE', 'O') as outside from tok),
r as (select *, sum(outside::int) over (partition by doc_id order by tok_idx) as run from o),
filled as (select * from r where not outside and trim(form) <> ''),
g as (
  select doc_id, run, string_agg(form, ' ' order by tok_idx) as ne, max_by(tag[2], tok_idx) as tag, count(*) as n, min(tok_idx) as first_idx
  from filled group by doc_id, run),
closed as (select g.*, r.tok_idx as i from g join r on g.doc_id = r.doc_id and r.outside and r.run = g.run + 1),
cut as (
  select c.*, array_to_string(w.forms[greatest(0, i - 25 - n) + 1 : i - n], ' ') as before, array_to_string(w.forms[i + 1 : i + 25], ' ') as after
  from closed c join w on c.doc_id = w.doc_id),
mentions as (
  select doc_id, ne, tag, before || ' ' || ne || ' ' || after as context, (length(before) + 1)::int as start, (length(before) + 1 + length(ne))::int as "end",
    first_idx, i as close_idx, before, after
  from cut)
"""
)


def incidence(spark: SparkSession, sf: str) -> DataFrame:
    """obj = part, att = its brand, type, size class and words of its name."""
    p = spread(table(spark, sf, "part"))
    atts = F.concat(F.array("p_brand", "p_type", F.concat(F.lit("size"), (F.col("p_size") % 10).cast("string"))), F.split("p_name", " "))
    return p.select(F.col("p_partkey").cast("string").alias("obj"), F.explode(atts).alias("att")).distinct()


SQL_INCIDENCE = """
inc as (
  select distinct p_partkey::varchar as obj, unnest(list_concat([p_brand, p_type, 'size' || (p_size % 10)::varchar], string_split(p_name, ' '))) as att
  from part)
"""


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    """cand = brand, entities = its parts."""
    p = table(spark, sf, "part")
    return p.groupBy(F.col("p_brand").alias("cand")).agg(F.array_sort(F.collect_list(F.col("p_partkey").cast("string"))).alias("entities"))


def broaders(spark: SparkSession, sf: str) -> DataFrame:
    """(entity, broader): a part's type, size class and the words of its name."""
    p = table(spark, sf, "part")
    names = F.concat(F.array("p_type", F.concat(F.lit("size"), (F.col("p_size") % 10).cast("string"))), F.split("p_name", " "))
    return p.select(F.col("p_partkey").cast("string").alias("entity"), F.explode(F.array_distinct(names)).alias("broader"))


SQL_ENRICHMENT = """
br as (
  select distinct p_partkey::varchar as entity, unnest(list_concat([p_type, 'size' || (p_size % 10)::varchar], string_split(p_name, ' '))) as broader
  from part),
sizes as (select p_brand as cand, count(*) as size from part group by 1),
counts as (
  select p_brand as cand, s.size, broader, count(*) as n
  from part join br on br.entity = p_partkey::varchar join sizes s on s.cand = p_brand group by 1, 2, 3),
pairs as (select broader, count(*) as pairs from br group by 1),
shares as (select broader, pairs, pairs / sum(pairs) over () as share, 1 / count(*) over () as mean_share from pairs)
"""

#: Binomial tail of (size, share, n) in SQL.
SQL_TAIL = """
case when n / size > share
  then list_sum(list_transform(range(n, size + 1), lambda k: exp(lgamma(size + 1) - lgamma(k + 1) - lgamma(size - k + 1) + k * ln(share) + (size - k) * ln(1 - share))))
  else -list_sum(list_transform(range(0, n + 1), lambda k: exp(lgamma(size + 1) - lgamma(k + 1) - lgamma(size - k + 1) + k * ln(share) + (size - k) * ln(1 - share)))) end
"""


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """child, property, parent: customers in nations in regions, and a chain of six concepts with an ignored one."""
    c = table(spark, sf, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("child"), F.lit("P31").alias("property"), F.concat(F.lit("N"), "c_nationkey").alias("parent"))
    n = table(spark, sf, "nation").select(F.concat(F.lit("N"), "n_nationkey"), F.lit("P279"), F.concat(F.lit("R"), "n_regionkey"))
    r = table(spark, sf, "region").select(F.concat(F.lit("R"), "r_regionkey"), F.lit("P279"), F.lit("T1"))
    chain = spark.range(1, 6).select(F.concat(F.lit("T"), "id"), F.lit("P279"), F.concat(F.lit("T"), F.col("id") + 1))
    bad = spark.range(1).select(F.lit("T1"), F.lit("P279"), F.lit("Q35120"))
    beyond = spark.range(1).select(F.lit("Q35120"), F.lit("P279"), F.lit("T9"))
    return c.union(n).union(r).union(chain).union(bad).union(beyond)


SQL_EDGES = """
edges as (
  select 'C' || c_custkey as child, 'P31' as property, 'N' || c_nationkey as parent from customer
  union all select 'N' || n_nationkey, 'P279', 'R' || n_regionkey from nation
  union all select 'R' || r_regionkey, 'P279', 'T1' from region
  union all select 'T' || i, 'P279', 'T' || (i + 1) from range(1, 6) as t(i)
  union all select 'T1', 'P279', 'Q35120' union all select 'Q35120', 'P279', 'T9')
"""


def experiments(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of an evaluation table from line items: k, m, th, linker and criteria."""
    li = table(spark, sf, "lineitem")
    g = li.groupBy((F.col("l_linenumber") * 5).alias("k"), (F.floor(F.col("l_quantity") / 10) * 10).cast("int").alias("m"), F.month("l_shipdate").alias("th"), F.col("l_returnflag").alias("linker"))
    return g.agg(
        F.round(F.avg("l_discount"), 6).alias("quant4"),
        F.round(F.max("l_tax"), 6).alias("max_pvalue"),
        F.count("*").alias("number_of_candidates"),
        F.count_if(F.col("l_discount") > 0.05).alias("above2std_of_oddsrations_vs_random_HIB"),
        F.round(F.avg("l_tax"), 6).alias("oddsratios_probs_vs_random_LIB"),
    ).where("not (k = 35 and linker = 'N')")


SQL_EXPERIMENTS = """
ex as (
  select (l_linenumber * 5)::int as k, (floor(l_quantity / 10) * 10)::int as m, month(l_shipdate)::int as th, l_returnflag as linker,
    round(avg(l_discount), 6) as quant4, round(max(l_tax), 6) as max_pvalue, count(*) as number_of_candidates,
    count_if(l_discount > 0.05)::bigint as above2std_of_oddsrations_vs_random_HIB, round(avg(l_tax), 6) as oddsratios_probs_vs_random_LIB
  from lineitem group by 1, 2, 3, 4 having not (k = 35 and linker = 'N'))
"""
