"""Hand-computed cases and properties of the operators."""

import math
import random
import re
from collections import Counter
from decimal import Decimal, localcontext
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexatlas.functions import stats, text
from lexatlas.operators import classes, evaluation, factorize, incidence, linking, mentions, nullmodel, senses, substitutes
from lexatlas.plans import exchange, registry
from lexatlas.sources import conll, tables


def test_mentions(spark):
    forms = ["In", "New", "York", "Bob", "ran", "to", " ", "Acme", ".", "Zed"]
    tags = [["O"], ["I", "LOC"], ["I", "LOC"], ["I", "PER"], ["O"], ["O"], ["I", "ORG"], ["I", "ORG"], ["O"], ["I", "PER"]]
    rows = spark.createDataFrame([(1, forms, tags), (2, [], []), (3, ["Acme"], [["I", "ORG"]])], "doc_id long, forms array<string>, tags array<array<string>>")
    got = mentions.extract_mentions(rows, "doc_id", 2).orderBy("start").collect()
    assert [(r.ne, r.tag, r.context, r.start, r.end) for r in got] == [("New York Bob", "PER", "In New York Bob ran to", 3, 15), ("Acme", "ORG", "to   Acme . Zed", 5, 9)]
    assert all(r.context[r.start : r.end] == r.ne for r in got)


@pytest.mark.parametrize("n,target,lo,hi,at", [(400, 10, 0, 160, 10), (400, 200, 50, 350, 150), (300, 7, 0, 300, 7)])
def test_crop(spark, n, target, lo, hi, at):
    row = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i.cast("string")).alias("t"), F.lit(target).alias("p"))
    tokens, index = mentions.crop(F.col("t"), F.col("p"))
    r = row.select(tokens.alias("t"), index.alias("i")).first()
    assert (r.t, r.i) == ([str(i) for i in range(lo, hi)], at)


def test_targets(spark):
    rows = spark.createDataFrame([("A Jaguar ran",), ("no cat",)], "context string")
    found = mentions.find_target(rows, "jaguar")
    assert [(r.start, r.end) for r in found.collect()] == [(2, 8), (None, None)]
    with pytest.raises(Exception, match="target not found"):
        mentions.require_targets(found).collect()


def test_conll_and_files(spark, tmp_path):
    (tmp_path / "c.txt").write_text("#x\nIn\tP\tz\tO\nRom\tN\tz\tI-LOC\n\n\nBob\tN\tz\tI-PER\n.\tP\tz\tO\n")
    t = conll.read_conll(spark, str(tmp_path / "c.txt"))
    assert [(r.sent_idx, r.tok_idx, r.form, r.tag) for r in t.orderBy("tok_idx").collect()] == [(0, 0, "In", ["O"]), (0, 1, "Rom", ["I", "LOC"]), (1, 2, "Bob", ["I", "PER"]), (1, 3, ".", ["O"])]
    assert conll.read_conll(spark, str(tmp_path / "c.txt"), n_tokens=2).count() == 2
    assert conll.token_arrays(t).first().forms == ["In", "Rom", "Bob", "."]
    m = spark.createDataFrame([("Rom", "LOC", 0, 3, "Rom \"a\"", "<u1>"), ("Bob", "PER", 1, 4, "x", "<https://no.entity.found>")], "ne string, tag string, start int, end int, context string, uri string")
    tables.write_mentions(m, str(tmp_path / "m"))
    back = tables.read_mentions(spark, str(tmp_path / "m")).orderBy("ne").collect()
    assert [(r.ne, r.tag, r.start, r.end, r.context, r.uri) for r in back] == [("Bob", "PER", 1, 4, "x", "Bob"), ("Rom", "LOC", 0, 3, 'Rom "a"', "<u1>")]
    s = spark.createDataFrame([("e", 0, ["a"]), ("e", 1, ["b"]), ("f", None, ["c"])], "entity string, sense_ix int, descriptors array<string>")
    tables.write_senses(s, str(tmp_path / "s"))
    back = tables.read_senses(spark, str(tmp_path / "s")).collect()
    assert {(r.entity, r.sense_ix, tuple(r.descriptors)) for r in back} == {("e", 0, ("a",)), ("e", 1, ("b",)), ("f", None, ("c",))}
    ty = spark.createDataFrame([(3, 10, 5, i, 0.5, ["d"], ["e"]) for i in (0, 1, 3)], "m int, k int, th int, type_ix int, score double, descriptors array<string>, entities array<string>")
    tables.write_types(ty, str(tmp_path / "t"))
    assert sorted(r.type_ix for r in tables.read_types(spark, str(tmp_path / "t")).collect()) == [0, 1]
    p = tables.params_of_path(F.lit("/a/m30/k50_th6"))
    assert tuple(spark.range(1).select(p["m"], p["k"], p["th"]).first()) == (30.0, 50.0, 6.0)


def test_uri_functions(spark):
    rows = spark.createDataFrame([("<http://a.org/b/C>",), ("http://a.org",), ("",), ("<x>",), ("<ftps://localhost:80/a>",)], "u string")
    assert [r[0] for r in rows.select(text.is_uri("u")).collect()] == [True, False, False, False, True]
    assert rows.select(text.local_name("u")).first()[0] == "C"
    assert spark.range(1).select(text.strip(F.lit("  a b\t\n"))).first()[0] == "a b"


@pytest.mark.parametrize("t,p,n", [(10, 0.1, 3), (200, 0.05, 30), (5, 0.4, 5), (10, 0.5, 2), (7, 0.0, 0), (7, 1.0, 7), (4000, 0.5, 2100)])
def test_binomial(spark, t, p, n):
    got = spark.range(1).select(stats.binomial_tail(F.lit(t), F.lit(p), F.lit(n))).first()[0]
    ks = range(n, t + 1) if n / t > p else range(n + 1)
    want = sum(math.comb(t, k) * (p**k) * ((1 - p) ** (t - k)) if t < 1000 else math.exp(math.lgamma(t + 1) - math.lgamma(k + 1) - math.lgamma(t - k + 1) + t * math.log(0.5)) for k in ks)
    assert got == pytest.approx(want if n / t > p else -want, rel=1e-8)


def test_spans(spark):
    m = spark.createDataFrame([(1, "x", 10, 20)], "context_id long, ne string, start int, end int")
    kind = "context_id long, pos int, wikidataId string, offsetStart int, offsetEnd int, nerd_score double, nerd_selection_score double"
    rows = [(1, 0, "Q2", 8, 20, 0.9, None), (1, 1, "Q1", 10, 20, 0.1, None), (1, 2, "Q3", 10, 16, 0.9, None), (1, 3, None, 10, 20, 0.9, None)]
    assert linking.best_spans(m, spark.createDataFrame(rows, kind)).first().uri.endswith("/Q2>")
    rows[1] = (1, 1, "Q1", 10, 20, None, None)
    assert linking.best_spans(m, spark.createDataFrame(rows, kind)).first().uri.endswith("/Q1>")
    assert linking.best_spans(m, spark.createDataFrame(rows[3:], kind)).first().uri == "<x>"


def test_closure(spark):
    e = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("f", "a"), ("a", "Q35120"), ("Q35120", "z")]
    edges = spark.createDataFrame([(c, "P279", p) for c, p in e], "child string, property string, parent string")
    got = linking.transitive_broaders(spark.createDataFrame([("a",)], "entity string"), edges)
    assert {r.broader for r in got.collect()} == {"b", "c", "d", "e"}


def test_factors_by_hand():
    got = list(factorize.factors_of({"1": {"x", "y"}, "2": {"x", "y"}, "3": {"x", "z"}}, min_size=1))
    assert [(e, i) for e, i, _, _ in got] == [(["1", "2"], ["x", "y"]), (["3"], ["x", "z"])]
    assert [round(s, 6) for _, _, s, _ in got] == [round(4 / 6, 6), round(2 / 6, 6)]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdefgh"), st.sets(st.sampled_from("uvwxyz"), min_size=1), min_size=1), st.integers(0, 2))
def test_factors_are_concepts(rows, least):
    pairs = {(o, a) for o, s in rows.items() for a in s}
    covered, last = set(), 0.0
    for extent, intent, score, total in factorize.factors_of(rows, min_size=least):
        assert set(extent) == {o for o in rows if set(intent) <= rows[o]}
        assert set(intent) == set.intersection(*(rows[o] for o in extent))
        cells = {(o, a) for o in extent for a in intent}
        assert cells <= pairs and len(extent) >= least and len(intent) >= least
        assert score * len(pairs) == pytest.approx(len(cells - covered)) and total > last
        covered, last = covered | cells, total
    if least == 0:
        assert covered == pairs


def test_distributed_factors_agree(spark):
    rows = [(f"o{i}", f"a{j}") for i in range(14) for j in range(7) if (i * (j + 3) + j) % 3 == 0 or i % 5 == j % 5]
    pairs = spark.createDataFrame(rows, "obj string, att string")
    pick = lambda df: [(r.i, r.extent, r.intent, round(r.score, 9)) for r in df.orderBy("i").collect()]
    assert pick(factorize.factorize(pairs, min_size=2, limit=4)) == pick(factorize.factorize(pairs, min_size=2, limit=4, max_local=5))
    # single attributes only lead on, some to dead ends
    rows = [(f"o{i}", a) for i in range(9) for a in (f"a{i % 2}", f"b{i % 3}", f"z{i}")] + [(f"p{i}", "y") for i in range(3)]
    pairs = spark.createDataFrame(rows, "obj string, att string")
    one = pick(factorize.factorize(pairs, min_size=2, objs_ge_atts=True))
    assert one and one == pick(factorize.factorize(pairs, min_size=2, objs_ge_atts=True, max_local=5))


def test_equal_objects_are_factorised_as_one(spark, monkeypatch):
    """Copies of objects do not make a table too large for one task, nor change anything but sizes."""
    monkeypatch.setattr(factorize, "_distributed", None)
    r = random.Random(5)
    rows = {f"o{i}": {f"a{r.randrange(6)}" for _ in range(3)} for i in range(400)}
    pairs = spark.createDataFrame([(o, a) for o, own in rows.items() for a in own], "obj string, att string")
    for least, wide in ((0, False), (2, True), (40, False)):
        got = factorize.factorize(pairs, 0.9, least, wide, max_local=300).orderBy("i").collect()
        want = list(factorize.factors_of(rows, 0.9, least, wide))
        assert [(x.extent, x.intent, round(x.score, 9), round(x.covered, 9)) for x in got] == [(e, i, round(s, 9), round(c, 9)) for e, i, s, c in want]


def test_factors_pass_through_small_concepts():
    """Every single attribute has a large extent, and only pairs of attributes may leave."""
    rows = {f"o{i:02}": {f"a{i % 4}", f"b{i % 5}", f"c{i % 3}"} for i in range(60)}
    found = list(factorize.factors_of(rows, 0.8, min_size=2))
    assert found and all(len(i) >= 2 for _, i, _, _ in found) and found[-1][3] >= 0.8
    assert [(len(e), i) for e, i, _, _ in found[:2]] == [(5, ["a0", "c0"]), (5, ["a0", "c1"])]


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdefgh"), st.sets(st.sampled_from("uvwxyz"), min_size=1), min_size=1), st.integers(0, 3), st.booleans())
def test_no_allowed_concept_is_left(rows, least, wide):
    left = {(o, a) for o, s in rows.items() for a in s}
    for extent, intent, _, _ in factorize.factors_of(rows, min_size=least, objs_ge_atts=wide):
        cells = {(o, a) for o in extent for a in intent}
        assert cells & left and min(len(extent), len(intent)) >= least and (not wide or len(extent) >= len(intent))
        left -= cells
    for n in range(1, 7):
        for atts in combinations("uvwxyz", n):
            extent = {o for o in rows if set(atts) <= rows[o]}
            intent = set.intersection(*(rows[o] for o in extent)) if extent else set()
            if len(extent) >= max(least, 1) and len(intent) >= least and (not wide or len(extent) >= len(intent)):
                assert not {(o, a) for o in extent for a in intent} & left


def test_senses(spark):
    assert senses.fallback_sense({0: ["b", "a"], 1: ["a", "c"], 2: ["c", "b"]}, 2)[1] == ["b", "a"]
    animal, brand = ["cat", "lion", "tiger", "beast"], ["car", "brand", "motor", "wheel"]
    lists = [(1, i, [*animal[i % 3 :], *animal[: i % 3], f"x{i}"]) for i in range(6)] + [(1, 6 + i, [*brand, f"y{i}"] if i else brand[:3]) for i in range(6)] + [(2, 0, ["q", "r"]), (2, 1, ["r"])]
    df = spark.createDataFrame(lists, "key long, context_id long, terms array<string>")
    got = {(r.key, r.sense_ix): set(r.descriptors) for r in senses.induce_senses(df, "key", 4).collect()}
    assert got[2, 0] == {"q", "r"}
    assert {frozenset(v) for (k, _), v in got.items() if k == 1} >= {frozenset(brand[:3])} or frozenset(animal) in {frozenset(v) for v in got.values()}


def test_classes_and_histogram(spark):
    rows = [(f"e{i}::{'PER' if i < 4 else 'LOC'}", ["a", "b", "c"] if i < 4 else ["d", "e", "f"]) for i in range(8)]
    found = classes.induce_classes(spark.createDataFrame(rows, "entity string, descriptors array<string>"), 3, 2, 1.0)
    hist = {(r.type_ix, r.tag): r.n for r in classes.tag_histogram(found).collect()}
    assert hist == {(0, "PER"): 4, (1, "LOC"): 4}


def test_registered_classes_reach_half_of_the_table(spark, monkeypatch):
    rows = [(f"e{g}_{i}::PER", [f"name{g}_{a}" for a in range(3)]) for g in range(40) for i in range(4)]
    senses_ = spark.createDataFrame(rows, "entity string, descriptors array<string>")
    monkeypatch.setattr(registry, "_senses", lambda *_: senses_)
    found = registry.QUERIES["c13_classes"](spark, "").collect()
    assert len(found) == 20 and max(r.covered for r in found) == pytest.approx(0.5)
    assert registry.QUERIES["a3_tag_histogram"](spark, "").count() == 20


def test_random_classes_keep_sizes(spark):
    c = spark.createDataFrame([("a", ["1", "2", "3"]), ("b", ["3", "4"]), ("c", [])], "cand string, entities array<string>")
    got = nullmodel.random_candidates(c, 3, spare=4).collect()
    assert {r.replicate for r in got} == {0, 1, 2}
    for r in got:
        assert len(set(r.entities)) == len(r.entities) == {"a": 3, "b": 2}[r.cand]
    assert sorted(e for r in got if r.replicate == 0 for e in r.entities) == ["1", "2", "3", "3", "4"]


def test_random_classes_that_share_entities(spark):
    rows = [(g, f"c{i}", [f"e{j}" for j in range(40) if (i * 7 + j * (g + 3)) % 5 < 3 or j == 0]) for g in range(2) for i in range(12)]
    c = spark.createDataFrame(rows, "g int, cand string, entities array<string>")
    got = nullmodel.random_candidates(c, 6, by=["g"]).collect()
    size = {(g, cand): len(e) for g, cand, e in rows}
    assert Counter((r.g, r.replicate) for r in got) == {(g, i): 12 for g in range(2) for i in range(6)}
    for r in got:
        assert len(set(r.entities)) == len(r.entities) == size[r.g, r.cand]
    for g in range(2):
        bag = sorted(e for h, _, entities in rows if h == g for e in entities)
        deals = [sorted((r.cand, *r.entities) for r in got if (r.g, r.replicate) == (g, i)) for i in range(6)]
        assert all(sorted(e for d in deal for e in d[1:]) == bag for deal in deals) and len(set(map(str, deals))) == 6
    assert sorted(map(str, got)) == sorted(map(str, nullmodel.random_candidates(c.repartition(3), 6, by=["g"]).collect()))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sets(st.sampled_from("abcdefg"), min_size=1), min_size=1, max_size=7), st.randoms(use_true_random=False))
def test_doubles_can_always_be_moved(sets, rand):
    bag = [e for s in sets for e in sorted(s)]
    rand.shuffle(bag)
    classes_, left = [], iter(bag)
    for s in sets:
        classes_.append([next(left) for _ in s])
    nullmodel.repaired(classes_, lambda e: ord(e) * 31)
    assert [len(set(c)) for c in classes_] == [len(c) for c in classes_] == [len(s) for s in sets]
    assert sorted(e for c in classes_ for e in c) == sorted(bag)


def test_density_values(spark):
    rows = [(1, float(x), True) for x in (0, 1, 2, 3, 4)] + [(1, 2.0, False)]
    v = spark.createDataFrame(rows, "g int, value double, is_random boolean")
    assert nullmodel.mean_tail(v, ["g"]).first().tail == pytest.approx(0.5, abs=0.02)
    same = v.unionByName(v.where("is_random").withColumn("is_random", F.lit(False))).where("is_random or value <> 2 or value = 2")
    assert nullmodel.divergence(same, ["g"]).first().kl < 0.05


def test_half_is_rounded_to_even():
    assert [substitutes.half(n) for n in (5, 7, 50)] == [2, 4, 25]
    with pytest.raises(ValueError):
        substitutes.MaskedModelProvider("gpt")


def test_neighbour_counts_are_summed_before_the_cut(spark):
    r = random.Random(7)
    word = lambda: f"w{min(int(r.expovariate(0.12)), 60)}"
    docs = [(i, [word() for _ in range(40)]) for i in range(60)]
    # "mid" stands third on both sides of l _ r and is the best sum
    docs += [(100, f"l {t} x".split()) for t in ("a", "a", "a", "b", "b", "b", "mid", "mid")] + [(101, f"y {t} r".split()) for t in ("c", "c", "c", "d", "d", "d", "mid", "mid")]
    tokens = spark.createDataFrame(docs, "doc_id long, forms array<string>")
    asked = [("0", "l", "t", "r")] + [(str(i), word(), word(), word()) for i in range(1, 25)] + [("25", None, "w1", "w2"), ("26", "", "none", "w0")]
    contexts = spark.createDataFrame(asked, "context_id string, left string, target string, right string")
    n = Counter(p for _, forms in docs for p in zip(forms, forms[1:], strict=False))
    vocabulary = {w for _, forms in docs for w in forms}
    for limit in (1, 2, 7, 500):
        got = {}
        for row in substitutes.DistributionalProvider(tokens).predictions(contexts, limit).collect():
            got.setdefault((row.context_id, row.masked), []).append((-row.score, row.term))
        for i, left, target, right in asked:
            for masked in (True, False):
                score = {t: n[left, t] + n[t, right] + (0 if masked else n[target, t] + n[t, target]) for t in vocabulary}
                want = sorted((-s, t) for t, s in score.items() if s)[:limit]
                assert sorted(got.get((i, masked), []))[:limit] == want
    assert substitutes.DistributionalProvider(tokens).predictions(contexts.where("context_id = '0'"), 1).where("masked").first().term == "mid"


def test_questions_are_answered_where_they_are(spark, monkeypatch):
    """Nothing is exchanged for the lists but the index, whose words and files are many here."""
    monkeypatch.setattr(substitutes.neighbours, "BUCKET", 150)
    monkeypatch.setattr(substitutes.neighbours, "PART", 9)
    r = random.Random(3)
    word = lambda: f"w{min(int(r.expovariate(0.12)), 60)}"
    docs = [(i, [word() for _ in range(30)]) for i in range(40)] + [(40, []), (41, ["w1"])]
    asked = [(str(i), word(), word(), word()) for i in range(60)] + [("60", None, "w1", "none")]
    contexts = spark.createDataFrame(asked, "context_id string, left string, target string, right string")
    listed = substitutes.substitutes(substitutes.DistributionalProvider(spark.createDataFrame(docs, "doc_id long, forms array<string>")), contexts, 6, min_length=3)
    assert "Exchange" not in listed._jdf.queryExecution().executedPlan().toString()
    n = Counter(p for _, forms in docs for p in zip(forms, forms[1:], strict=False))
    vocabulary, got = {w for _, forms in docs for w in forms}, dict(listed.collect())
    for i, left, target, right in asked:
        want = []
        for beside in (1, 0):
            score = {t: n[left, t] + n[t, right] + beside * (n[target, t] + n[t, target]) for t in vocabulary}
            want += [t for _, t in sorted((-s, t) for t, s in score.items() if s)[:13] if len(t) >= 3][:3]
        assert got.get(i, []) == want


def test_entity_senses_read_fifty_substitutes(spark, monkeypatch):
    outside, name = ["O"], ["I", "PER"]
    rows = [(i, ["pre", f"word{i}", "post"], [outside] * 3) for i in range(60)] + [(60, ["pre", "Smith", "post"], [outside, name, outside])]
    tokens = spark.createDataFrame(rows, "doc_id long, forms array<string>, tags array<array<string>>")
    monkeypatch.setattr(registry.d, "token_arrays", lambda *_: tokens)
    (row,) = registry._entity_lists(spark, "").collect()
    assert row.key == "Smith::PER" and len(row.terms) == 50 and len(set(row.terms[25:])) == 25


def test_tails_of_large_classes(spark):
    """Against exact sums; adding up from no hits on is off by more than 1e-9 of them for large classes."""
    cases = [(48_000, 0.125, 6_020), (48_000, 0.125, 5_990), (48_000, 0.04, 1_925), (300_000, 0.11, 33_050), (300_000, 0.0001, 31), (50, 0.3, 50), (50, 0.3, 0), (1, 0.5, 1)]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, size int, share double, n int")
    got = {r.i: r.p for r in rows.select("i", stats.binomial_tail(F.col("size"), F.col("share"), F.col("n")).alias("p")).collect()}
    with localcontext() as context:
        context.prec = 60
        for i, (size, share, n) in enumerate(cases):
            p = Decimal(share)
            at = Decimal(math.comb(size, n)) * p**n * (1 - p) ** (size - n)
            over, total, term, k = n / size > share, at, at, n
            while term and (k < size if over else k > 0) and term > total / 10**25:
                term *= Decimal(size - k) / (k + 1) * p / (1 - p) if over else Decimal(k) / (size - k + 1) * (1 - p) / p
                total, k = total + term, k + (1 if over else -1)
            assert got[i] == pytest.approx(float(total if over else -total), rel=1e-9)


def test_equal_random_values_have_no_density(spark):
    enriched = spark.createDataFrame([(k, [str(k)], 2, p, p, 1.0) for k in (1, 2, 3) for p in (0.0, 0.1)], "k int, entities array<string>, n_broaders int, best_p double, top_p double, top_surprise double")
    randoms = spark.createDataFrame([(1, 0.0), (1, 0.0), (2, 0.1), (2, 0.3), (2, 0.2)], "k int, best_p double")
    got = {r.k: (r.oddsratios_probs_vs_random_LIB, r.above2std_of_oddsrations_vs_random_HIB, r.KL_vs_random_HIB) for r in evaluation.experiment_rows(enriched, randoms, ["k"]).collect()}
    assert got[1] == (None, 1.0, None) and got[3] == (0.0, 0.0, 0.0) and None not in got[2]


def test_a_corpus_of_several_files(spark, monkeypatch):
    """No corpus is written or numbered by one task."""
    docs = [(i, [f"w{i}.{j}" if j % 3 else f"w{i}." for j in range(5)]) for i in range(40)]
    tokens = spark.createDataFrame(docs, "doc_id long, forms array<string>").withColumn("tags", F.transform("forms", lambda x: F.array(F.lit("O"))))
    monkeypatch.setattr(exchange.d, "token_arrays", lambda *_: tokens)
    many = {"spark.sql.shuffle.partitions": "7", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in many}
    for name, value in many.items():
        spark.conf.set(name, value)
    path = exchange._written(spark, "", " ", "")
    for name, value in before.items():
        spark.conf.set(name, value)
    read = conll.read_lines(spark, path, folders=True)
    assert read.select("corpus_id").distinct().count() == 4 < read.select("stretch").distinct().count()
    got = exchange._read_back(conll.read_conll(spark, path, ("form", "tag"), blanks_separate=True, folders=True)).orderBy("corpus_id", "tok_idx").collect()
    for part in range(4):
        forms = [f for i, own in docs if i % 4 == part for f in own]
        own = [r for r in got if r.corpus_id == part]
        assert [(r.tok_idx, r.form) for r in own] == list(enumerate(forms))
        assert [r.sent_idx for r in own] == [sum(f.endswith(".") for f in forms[:i]) for i in range(len(forms))]


def test_slots_are_not_broadcast(spark, monkeypatch):
    plans = []

    def seen(df, name):
        rows = df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return spark.createDataFrame(rows, df.schema)

    monkeypatch.setattr(nullmodel, "materialize", seen)
    found = nullmodel.random_candidates(spark.createDataFrame([(f"c{i}", [f"e{j}" for j in range(i, i + 9)]) for i in range(5)], "cand string, entities array<string>"), 2)
    assert sorted(map(len, (r.entities for r in found.collect()))) == [9] * 10
    final = plans[0].split("Initial Plan")[0]
    assert re.search(r"SortMergeJoin[^\n]*\[at#", final) and not re.search(r"BroadcastHashJoin[^\n]*\[at#", final)


def test_few_files_are_dealt_to_all_cores(spark, tmp_path):
    spark.range(8).selectExpr("id as doc_id", "'A word' as text").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(8).selectExpr("id as p_partkey", "'b' as p_brand", "'t' as p_type", "1 as p_size", "'a ring' as p_name").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    for rows in (registry.d.token_arrays(spark, str(tmp_path)), registry.d.incidence(spark, str(tmp_path))):
        assert "REPARTITION_BY_NUM" in rows._jdf.queryExecution().executedPlan().toString()


def test_drop_rare(spark):
    pairs = spark.createDataFrame([(f"o{i}", "x") for i in range(5)] + [("o0", "y"), ("o1", "z"), ("o2", "z")], "obj string, att string")
    assert {r.att for r in incidence.drop_rare(pairs).collect()} == {"x", "z"}
