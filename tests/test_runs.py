"""Whole runs on small corpora, services with failures, and the parts that need a model, with a stand-in for it."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexatlas import config
from lexatlas.functions import languages
from lexatlas.operators import linking, nullmodel, reports, senses, substitutes, vectors
from lexatlas.plans import corpus
from lexatlas.runtime import discard, exists, materialize, scratch
from lexatlas.sources import conll, services, tables


def tokens_file(path, n=60):
    """Sentences in which animals and brands stand between words of their own."""
    lines = []
    for i in range(n):
        kind, names = [("animal", ("Wulf", "Lyra", "Tigra")), ("brand", ("Autox", "Motra", "Karro"))][i % 2]
        for form, tag in (("the", "O"), (f"{kind}{i % 3}", "O"), (names[i // 2 % 3], "I-MISC"), (f"{kind}er", "O"), ("runs", "O"), (".", "O")):
            lines.append(f"{form}\tX\t_\t{tag}")
        lines.append("")
    path.write_text("# remark\n" + "\n".join(lines) + "\n")


class Words:
    """A provider: terms of the kind of the words beside the target."""

    def predictions(self, contexts, limit):
        kind = F.regexp_replace("left", "[0-9]", "")
        masks = F.explode(F.array(F.lit(True), F.lit(False)))
        terms = F.explode(F.transform(F.sequence(F.lit(0), F.lit(min(limit, 6) - 1)), lambda i: F.named_struct(F.lit("term"), F.concat(kind, F.lit("term"), i.cast("string")), F.lit("score"), (-i).cast("double"))))
        return contexts.select("context_id", masks.alias("masked"), terms.alias("t")).select("context_id", "masked", "t.*")


def test_configured_run(spark, tmp_path):
    tokens_file(tmp_path / "c.conll")
    ini = f"""[wikiner]
base_dir=file://{tmp_path}
conll_data_path=${{base_dir}}/c.conll
ner_contexts_output=${{base_dir}}/mentions.tsv
nes_senses_output_stem=${{base_dir}}/senses
tokens_to_be_processed=0
language=en
ms=3,4
max_k=5
[entity_linking]
linker=dummy
"""
    (tmp_path / "run.conf").write_text(ini)
    run = config.SensesRun.of(config.load(spark, f"file://{tmp_path}/run.conf"))
    paths = corpus.run_senses(spark, run, provider=lambda arrays, lang: Words() if lang == "eng" else None)
    assert [p.rsplit("/", 1)[1] for p in paths] == ["senses_m3_k5.json", "senses_m4_k5.json"]
    assert (tmp_path / "senses_m3_k5_10.json").exists()
    found = json.loads((tmp_path / "senses_m4_k5.json").read_text())
    assert {k.split("##")[0] for k in found} == {"<wulf>", "<lyra>", "<tigra>", "<autox>", "<motra>", "<karro>"}
    assert found["<wulf>"] == [f"animalterm{i}" for i in range(4)]
    again = corpus.run_senses(spark, run, provider=lambda *_: Words())  # reads the mentions file this time
    assert again == paths and json.loads((tmp_path / "senses_m4_k5.json").read_text()) == found
    types = config.TypesRun.of(config.parse(f"[wikiner]\nners_predictions_path={paths[1]}\nnew_types_output_folder=file://{tmp_path}/new/m4\nlanguage=en\nks=3,5\nths_type_descriptors=2,3\n"))
    # k = 3: both kinds have three entities and three descriptors; k = 5: four descriptors are more than their three entities
    assert corpus.run_types(spark, types, fidelity=1.0) == 4
    one = json.loads((tmp_path / "new/m4/k3_th2/k3_th2_type0.json").read_text())
    assert one == {"score": 0.5, "descriptors": [f"animalterm{i}" for i in range(3)], "entities": ["<lyra>", "<tigra>", "<wulf>"]}
    with pytest.raises(ValueError, match="language"):
        corpus.run_senses(spark, config.SensesRun(**{**run.__dict__, "language": "fr"}))
    with pytest.raises(ValueError, match="linker"):
        config.SensesRun.of(config.parse(ini.replace("linker=dummy", "linker=other")))


def test_lines_are_numbered_over_stretches(spark, monkeypatch, tmp_path):
    tokens_file(tmp_path / "c.conll", 20)
    lines = [(0, i, v) for i, v in enumerate((tmp_path / "c.conll").read_text().split("\n"))]
    df = spark.createDataFrame(lines, "corpus_id int, line_no long, value string").repartition(3)
    whole = conll.parse_tokens(df).orderBy("tok_idx").collect()
    assert [r.tok_idx for r in whole] == list(range(120)) and [r.sent_idx for r in whole] == [i // 6 for i in range(120)]
    for size in (1, 3, 10):
        monkeypatch.setattr(conll, "STRETCH", size)
        assert conll.parse_tokens(df).orderBy("tok_idx").collect() == whole
        assert conll.parse_tokens(df, n_tokens=25).orderBy("tok_idx").collect() == whole[:25]
    empty = df.limit(0)
    assert conll.parse_tokens(empty).count() == 0


def test_cache_and_retries(spark):
    asked = spark.createDataFrame([(f"k{i}",) for i in range(6)] + [("k1",), (None,)], "key string")

    def answer(key):
        if key == "k5":
            raise OSError(key)
        return key.upper()

    got = {r.key: (r.response, r.tries) for r in services.fetched(asked, answer, 3).collect()}
    assert got == {f"k{i}": (f"K{i}", 1) for i in range(5)} | {"k5": (None, 3)}
    path = scratch(spark, "cache")
    cache = services.Cache(spark, path, flush_after=2)
    assert cache.lookup(asked.where("key < 'k2'"), answer).count() == 2
    assert not exists(spark, path) and cache.misses == 2  # held back
    cache.lookup(asked, answer)
    assert exists(spark, path) and cache.misses == 0
    assert {r.key: r.response for r in services.Cache(spark, path).table().collect()} == {f"k{i}": f"K{i}" for i in range(5)} | {"k5": None}
    assert cache.store(spark.createDataFrame([("k1", "other")], "key string, response string")) == 0
    cache.clear()
    assert not exists(spark, path) and cache.table().count() == 0


def test_scratch_is_discarded(spark):
    df = materialize(spark.range(3))
    path = df._scratch
    assert exists(spark, path) and df.count() == 3
    discard(df)
    assert not exists(spark, path)


def test_target_tokens():
    words = str.split
    text = "One two. Three Jaguar Cars four. Five"
    assert substitutes.target_tokens(text, 15, 26, True, words) == (["One", "two.", "Three", "[MASK]", "four.", "Five"], 3, 4)
    assert substitutes.target_tokens(text, 15, 26, False, words) == (["One", "two.", "Three", "Jaguar", "Cars", "four.", "Five"], 3, 5)
    long_ = " ".join(f"w{i}" for i in range(500))
    at = long_.index("w400")
    tokens, first, end = substitutes.target_tokens(long_, at, at + 4, False, words)
    assert (tokens[first:end], first, len(tokens)) == (["w400"], 150, 250)


def test_model_provider_with_a_stand_in(spark):
    def load(name):
        vocabulary = ["[MASK]", "red", "green", "blue", "car"]

        def scores(lists):  # a term's score at a place: how often it stands in the text, less its number
            return [[[t.count(v) * 10 - i for i, v in enumerate(vocabulary)] for _ in t] for t in lists]

        return str.split, vocabulary, scores

    rows = [(1, "red red blue car", 8, 12), (2, "green car", 6, 9)]
    contexts = spark.createDataFrame(rows, "context_id int, context string, start int, end int")
    got = substitutes.MaskedModelProvider("bert-x", batch=1, load=load).predictions(contexts, 2).collect()
    best = {(r.context_id, r.masked): [] for r in got}
    for r in got:
        best[r.context_id, r.masked].append(r.term)
    assert best == {(1, True): ["red", "[MASK]"], (1, False): ["red", "blue"], (2, True): ["[MASK]", "green"], (2, False): ["green", "car"]}


def test_lazy_resources():
    loaded = []
    resources = languages.LazyResources(lambda name: loaded.append(name) or name.upper())
    assert resources["German"] == ("DE_CORE_NEWS_SM", "german") and resources["deu"] is resources["de"] and resources["eng"][1] == "english"
    assert loaded == ["de_core_news_sm", "en_core_web_sm"]
    with pytest.raises(KeyError, match="only de"):
        resources["fr"]


def test_disambiguation_in_blocks_and_by_key(spark, monkeypatch):
    r = np.random.default_rng(1)
    targets = spark.createDataFrame([(i, f"l{i % 3}", r.normal(size=4).tolist()) for i in range(12)], "id int, lemma string, embedding array<double>")
    inventory = spark.createDataFrame([(i, f"l{i % 3}", r.normal(size=4).tolist()) for i in range(30)] + [(30, "l1", []), (31, "l2", None)], "sense int, lemma string, centroid array<double>")
    pick = lambda df: sorted((x.id, x.sense, round(x.score, 9)) for x in df.collect())
    whole = pick(vectors.disambiguate(targets, inventory.drop("lemma")))
    assert len(whole) == 12 * 32 and all(s == 0 for _, n, s in whole if n > 29)
    monkeypatch.setattr(vectors, "MAX_SENSES", 7)
    assert pick(vectors.disambiguate(targets, inventory.drop("lemma"))) == whole
    own = pick(vectors.disambiguate(targets, inventory, by=["lemma"]))
    assert own == [x for x in whole if x[1] < 30 and x[0] % 3 == x[1] % 3 or (x[0] % 3, x[1]) in ((1, 30), (2, 31))]


def test_binned_densities_are_close_to_exact_ones(spark):
    r = np.random.default_rng(3)
    random, induced = r.normal(size=400), r.normal(0.7, 0.8, size=150)
    v = spark.createDataFrame([(1, float(x), True) for x in random] + [(1, float(x), False) for x in induced], "g int, value double, is_random boolean")
    h = np.std(random, ddof=1) * 400**-0.2
    lo = min(random.min(), induced.min())
    lo -= max(random.max(), induced.max()) - lo
    phi = lambda z: 0.5 * (1 + math.erf(z / math.sqrt(2)))
    exact = np.mean([1 - np.mean([phi((x - m) / h) - phi((lo - m) / h) for m in random]) for x in induced])
    assert nullmodel.mean_tail(v, ["g"]).first().tail == pytest.approx(exact, abs=1e-5)
    both = np.concatenate((random, induced))
    width = both.max() - both.min()
    at = np.linspace(both.min() - width / 2, both.max() + width / 2, 301)
    dens = lambda x: np.exp(-(((at[:, None] - x) / (np.std(x, ddof=1) * len(x) ** -0.2)) ** 2) / 2).mean(1)
    p, q = dens(random), dens(induced)
    p, q = p / p.sum(), q / q.sum()
    assert nullmodel.divergence(v, ["g"]).first().kl == pytest.approx(float(np.sum(p[p > 0] * np.log(p[p > 0] / q[p > 0]))), rel=2e-3)


def test_linkers_without_context(spark):
    m = linking.standalone(spark.createDataFrame([("Rom",), ("Rom",)], "ne string"), "fr").collect()
    assert [(x.ne, x.context, x.start, x.end) for x in m] == [("Rom", "Rom is a concept we want to find", 0, 3)]


def test_reports(spark):
    s = senses.induce_senses(spark.createDataFrame([("x", i, ["a", "b"]) for i in range(2)], "key string, context_id long, terms array<string>"), "key", 2)
    assert [r.report for r in reports.sense_reports(s).collect()] == ["Sense #1\nSense descriptors: a, b\nFound in contexts: 0, 1"]
    c = spark.createDataFrame([(7, "A jaguar ran", ["cat", "lion"])], "title int, context string, descriptors array<string>")
    assert reports.choice_reports(c).first().report == 'For context: "7. A jaguar ran" the sense: cat, lion is chosen.'


def test_numbered_mentions(spark, tmp_path):
    m = spark.createDataFrame([(f"n{i}", "PER", 0, 2, f"c{i}", "<u>") for i in range(50)], "ne string, tag string, start int, end int, context string, uri string")
    tables.write_mentions(m.coalesce(1), str(tmp_path / "m"))
    back = tables.read_mentions(spark, str(tmp_path / "m"), numbered=True).orderBy(*tables.FILE_ORDER)
    assert [r.ne for r in back.collect()] == [f"n{i}" for i in range(50)]
