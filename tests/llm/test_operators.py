"""Operators of the subpackage against brute force, and their edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexatlas.llm import decontaminate, ngram_join, packing, pii, quality_rules, quotes, secrets, suffix_dedup, tokens, topk, uneven, warc
from lexatlas.llm import textkernel as tk

DOCS = "doc_id long, text string, lang string, source string, n_chars long, cls string, k long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "src", len(t or ""), "x", 7) for i, t in rows], DOCS)


def words_of(r, n):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))


def shingles(s):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), s or ""))
    return frozenset(zip(*[w[i:] for i in range(5)], strict=False)) if len(w) >= 5 else frozenset({tuple(w)} if w else ())


def components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    up = {i: i for i, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, x in sets:
        for b, y in sets:
            if a < b and x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    return {i: (len(s), find(i)) for i, s in sets}


def corpus(seed=1, families=12):
    r = random.Random(seed)
    rows, passage = [], words_of(r, 30)
    for _ in range(families):
        base = words_of(r, r.randint(1, 90)).split()
        for _ in range(r.randint(1, 6)):
            w = list(base)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = words_of(r, 1)
            rows.append(" ".join(w) if r.random() < 0.7 else " ".join(w) + " " + passage)
    rows += ["", None, "One", "one", "a b c d", "A  b\tc\nd", rows[0], rows[0].upper(), "é " * 9, passage]
    order = list(range(len(rows)))
    r.shuffle(order)
    return list(zip(order, rows, strict=True))


@pytest.mark.parametrize("block", [2048, 3])
def test_jaccard_join(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = corpus()
    docs = documents(spark, rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs).collect()}
    want = components(rows)
    assert got == want
    if block > 3:
        kept = ngram_join.one_of_each(docs)
        assert kept.columns == docs.columns
        assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in want.items() if c == i)


def test_jaccard_join_empty_and_repeated(spark):
    assert ngram_join.near_duplicates(documents(spark, [])).count() == 0
    got = ngram_join.near_duplicates(documents(spark, [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (9, None)])).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in got) == [(0, 5), (5, 5), (5, 5), (9, 9)]


def test_one_of_each_tells_texts_apart(spark):
    """Rows that share an id stay or go by their own text; the smallest id of a component stays, without an id only where there is none."""
    text, other = "one two three four five six", "another text that nobody else has at all"
    rows = [(1, text), (1, text), (5, text + "!"), (5, other), (7, text.upper()), (None, text), (None, "words of a row without id"), (None, "Words of a row without id"), (9, ""), (9, None), (1, text.upper())]
    kept = [(r.doc_id, r.text) for r in ngram_join.one_of_each(documents(spark, rows)).collect()]
    assert len(kept) == 6 and {(5, other), (9, ""), (9, None), (5, text + "!")} <= set(kept)  # "six!" is another shingle of two
    assert sum(t.lower() == text for i, t in kept if t and i == 1) == 1 and sum(i is None for i, _ in kept) == 1


@pytest.mark.parametrize("bucket,hold,broadcast", [(2, 1 << 17, 1_000_000), (3, 4, 10), (200, 6, 0)])
def test_size_bounds_change_no_result(spark, monkeypatch, bucket, hold, broadcast):
    monkeypatch.setattr(ngram_join, "BUCKET", bucket)
    monkeypatch.setattr(ngram_join, "MAX_BROADCAST", broadcast)
    monkeypatch.setattr(ngram_join, "MAX_FREQUENT", 40)
    monkeypatch.setattr(uneven, "LEAST_ROWS", bucket)  # from here on a class's rows are not shuffled
    links = ngram_join.bucket_links
    monkeypatch.setattr(ngram_join, "bucket_links", lambda keys: links(keys, hold))
    rows = corpus(7, 16)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(documents(spark, rows)).collect()}
    assert got == components(rows)


def test_tree_is_exact():
    r = np.random.default_rng(0)
    base = [np.unique(r.integers(0, 1 << 62, 60, dtype=np.uint64)) for _ in range(4)]
    sets = [np.unique(np.concatenate((base[i % 4][r.permutation(60)[r.integers(0, 14) :]], r.integers(0, 1 << 62, r.integers(0, 9), dtype=np.uint64)))) for i in range(70)]
    up = list(range(70))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(70):
        for j in range(i):
            o = len(np.intersect1d(sets[i], sets[j]))
            if 100 * o >= 80 * (len(sets[i]) + len(sets[j]) - o):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    assert ngram_join.tree_links(sets).tolist() == [find(i) for i in range(70)]


def test_quotes(spark):
    rows = [
        (1, 0, "user", "Hello there everyone, how are you today?\n\nSecond paragraph is here."),
        (1, 1, "assistant", "On Mon, Bob wrote:\n> Hello there everyone,  how are you today?\nI am fine, thank you very much"),
        (1, 2, "user", "> > Hello there everyone, how are you today?\n> I am fine, thank you very much\nGreat. a > b"),
        (2, 0, "user", "> Second paragraph is here.\n\nfrom elsewhere"),
        (1, 3, None, None), (None, 1, "x", "> Hello there everyone, how are you today?"), (1, 3, None, None),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    links = {(r.conv_id, r.turn, r.level): (r.source_conv, r.source_turn) for r in quotes.link_quotes(df).collect()}
    assert links == {(1, 1, 1): (1, 0), (1, 2, 2): (1, 0), (1, 2, 1): (1, 1), (2, 0, 1): (1, 0), (None, 1, 1): (None, None)}
    got = quotes.reply_ordered(df).collect()
    assert len(got) == len(rows)
    by = {(r.conv_id, r.turn): r for r in got}
    assert by[1, 1].body == "I am fine, thank you very much" and by[1, 2].body == "Great. a > b"
    assert (by[1, 2].reply_to, by[1, 2].max_level, by[1, 2].n_linked) == (1, 2, 2)
    assert sorted(r.place for r in got if r.conv_id == 1) == [1, 2, 3, 4, 5]
    assert quotes.reply_ordered(df.limit(0)).count() == 0


def test_quotes_of_several_lines(spark):
    long_ = "Dear all,\nthe first line of a paragraph\nand its second line, too.\n\nAnother paragraph stands here,\r\nwrapped as well.\nOk\nRegards"
    rows = [
        (1, 0, "user", long_), (1, 1, "user", "Yes"),
        (1, 2, "user", "> the first line of a paragraph\n> and its second line, too.\nTwo lines"),
        (1, 3, "user", "> and its second line, too.\n>\n> Another paragraph stands here,\n> wrapped as well.\nTwo paragraphs"),
        (1, 4, "user", "> the first line of\n> a paragraph and its\n> second line, too.\nRewrapped"),
        (1, 5, "user", "> line of a paragraph\n> and its second line, too.\nNo whole line"),
        (1, 6, "user", "> ok\nShort"), (1, 7, "user", "> Dear all,\n> wrapped as well.\nNo run"),
        (2, 0, "user", "> only once in here\n> and there\nFirst"), (2, 1, "user", "only once in here\nand there"), (3, 5, "user", "x\nonly once in here\nand there\ny"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    links = {(r.conv_id, r.turn): (r.source_conv, r.source_turn) for r in quotes.link_quotes(df).collect()}
    none = (None, None)
    assert links == {(1, 2): (1, 0), (1, 3): (1, 0), (1, 4): (1, 0), (1, 5): none, (1, 6): (1, 0), (1, 7): none, (2, 0): (3, 5)}
    got = {(r.conv_id, r.turn): (r.n_linked, r.reply_to) for r in quotes.reply_ordered(df).collect()}
    assert got[1, 2] == (1, 0) and got[1, 5] == (0, 4) and got[2, 0] == (1, None)


def test_decontamination(spark):
    r = random.Random(3)
    items = [(i, words_of(r, 25).capitalize() + ". " + words_of(r, 8) + ".") for i in range(40)] + [(40, None), (41, "")]
    rows = [(i, words_of(r, 400)) for i in range(20)]
    rows += [(100 + i, words_of(r, 10 + 40 * i) + "*** " + items[i][1] + "### " + words_of(r, 60)) for i in range(8)] + [(200, items[9][1]), (201, None), (202, "")]
    rows += [(300, " ".join(items[10][1].split()[:12])), (200, items[9][1])]
    docs, bench = documents(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    want = {(100 + i, i) for i in range(8)} | {(200, 9)}
    for size in (1000, 15):
        assert {(x.doc_id, x.item_id) for x in decontaminate.find(docs, bench, shard_items=size).collect()} == want
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(x.doc_id for x in kept.collect()) == sorted(i for i, _ in rows if i not in {d for d, _ in want})
    assert decontaminate.find(docs.limit(0), bench).count() == 0 == decontaminate.find(docs, bench.limit(0)).count()


def test_decontamination_does_not_depend_on_shards(spark):
    r = random.Random(8)
    vocab = [words_of(r, 1) for _ in range(150)]
    items = [(i, " ".join(r.choice(vocab[: 20 + i]) for _ in range(10 + i)) + ". " + " ".join(r.choice(vocab) for _ in range(8)) + ".") for i in range(60)] + [(60, None), (61, "")]
    rows = [(i, words_of(r, 30) + " " + " ".join(w for w in t.split() if r.random() < 0.93) + " " + words_of(r, 30)) for i, t in items[:60]]
    docs, bench = documents(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    whole, parts = (sorted(map(tuple, decontaminate.find(docs, bench, 0.6, 0.3, shard_items=n).collect())) for n in (1000, 9))
    assert whole == parts and len(whole) > 10 and any(x[2] < 0.99 for x in whole)


def test_decontamination_of_items_that_end_without_words(spark):
    body = "Which of the seven rivers crosses the old border twice? The third one does, as the map of the north shows."
    items = [(0, body + " ..."), (1, "?! ... " + "Only one sentence with some words in it stands here"), (2, "... - !")]
    docs = documents(spark, [(i, "some text before it and " + t + " and some after it") for i, t in items])
    found = {(x.doc_id, x.item_id) for x in decontaminate.find(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found == {(0, 0), (1, 1)}


def test_wand_equals_exhaustive_scoring():
    r = random.Random(5)
    vocab = [words_of(r, 1) for _ in range(60)]
    index = decontaminate.build_index(list(range(50)), [" ".join(r.choice(vocab) for _ in range(r.randint(3, 20))) for _ in range(50)])
    pairs = sorted({(w, r.randrange(len(index.vocabulary))) for w in range(80) for _ in range(r.randint(1, 25))})
    w, t = np.array(pairs).T
    score = {}
    for a, b in pairs:
        for p in range(index.first[b], index.first[b + 1]):
            score[a, int(index.items[p])] = score.get((a, int(index.items[p])), 0.0) + index.impact[p]
    for minimum in (0.15, 0.3, 0.5):
        got = {(int(a), int(b)): s for a, b, s in zip(*decontaminate.candidates(index, w, t, minimum), strict=True)}
        assert got.keys() == {k for k, s in score.items() if s >= minimum - 1e-9}
        assert all(s == pytest.approx(score[k]) for k, s in got.items())


def brute_top_k(vecs, k, every=20):
    """Every row of an id that ``every`` divides against every other row; rows may share an id."""
    rows = [(i, [int(np.floor(float(np.float32(x)) * 64)) for x in v]) for i, v in vecs if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, (i, q) in enumerate(rows):
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, c, strict=False)), j) for m, (j, c) in enumerate(rows) if m != n)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("shard,block", [(3, 16), (1000, 4096)])
def test_top_k(spark, monkeypatch, shard, block):
    r = np.random.default_rng(2)
    vecs = [(i, (r.normal(size=8) * r.choice((0.2, 1, 3))).tolist()) for i in range(150)] + [(500, [0.5] * 8), (501, [0.5] * 8), (40, [1.0] * 8), (40, [1.0] * 8), (502, None), (503, [None] * 8), (504, [float("nan")] * 8), (None, [1.0] * 8), (505, [0.25] * 3), (506, []), (520, [0.0] * 8), (507, [float("inf")] * 8)]
    monkeypatch.setattr(topk, "SEED", 30)
    monkeypatch.setattr(topk, "SCANS", 2)
    monkeypatch.setattr(topk, "STEP", 5)
    df = spark.createDataFrame([(*v, "x", 1.5) for v in vecs], "vec_id long, embedding array<float>, rank string, score double")
    assert sorted(tuple(x) for x in topk.top_k(df, 5, 20, shard=shard, block=block).collect()) == brute_top_k(vecs, 5)
    assert topk.top_k(df.limit(0)).count() == 0


def brute_dedup(rows, length=100):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        late = np.zeros(len(b) + 1, int)
        for s in range(len(b) - length + 1):
            if b[s : s + length] in seen:
                late[s] += 1
                late[s + length] -= 1
            else:
                seen.add(b[s : s + length])
        gone = np.cumsum(late)[: len(b)] > 0
        edge = np.diff(np.concatenate(([0], gone.astype(int), [0])))
        out[i] = (len(b), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())
    return out


@pytest.mark.parametrize("hot", [4096, 3])
def test_suffix_dedup(spark, monkeypatch, hot):
    r = random.Random(8)
    passages = [words_of(r, k) for k in (18, 25, 60, 200)]
    rows = [(i, words_of(r, r.randint(0, 60)) + r.choice(passages) + words_of(r, r.randint(0, 30)) + r.choice(passages)) for i in range(40)]
    rows += [(100, None), (101, ""), (102, "x" * 99), (103, "ab" * 200), (104, "é" * 150), (105, rows[3][1]), (106, rows[3][1]), (107, passages[3] * 3), (108, "y" * 100), (109, "y" * 101)]
    r.shuffle(rows)
    monkeypatch.setattr(suffix_dedup, "MAX_BROADCAST", 10 if hot == 3 else 1000)
    monkeypatch.setattr(uneven, "LEAST_ROWS", 2 if hot == 3 else 1000)
    if hot == 3:  # every document is looked at for hot hashes, and most are
        monkeypatch.setattr(suffix_dedup, "SAMPLE", 1)
        monkeypatch.setattr(suffix_dedup, "OFTEN", 4)
        monkeypatch.setattr(suffix_dedup, "HOLD", 50)
    got = suffix_dedup.deduplicate(documents(spark, rows)).select("doc_id", "n_bytes", F.expr("aggregate(removed, 0L, (a, x) -> a + x.end - x.start)").alias("gone"), F.size("removed").alias("spans"), "kept_sha256").collect()
    assert {x.doc_id: (x.n_bytes, x.gone, x.spans, x.kept_sha256) for x in got} == brute_dedup(rows)
    assert suffix_dedup.deduplicate(documents(spark, [])).count() == 0


def test_suffix_dedup_of_null_ids_and_repeated_rows(spark):
    r = random.Random(12)
    a, b = words_of(r, 40), words_of(r, 40)
    rows = [(None, a + b), (3, a), (3, a), (3, b + a), (None, b), (7, a)]
    got = suffix_dedup.deduplicate(documents(spark, rows)).select("doc_id", "n_bytes", F.expr("aggregate(removed, 0L, (a, x) -> a + x.end - x.start)").alias("gone")).collect()
    assert len(got) == len(rows)
    out = sorted((x.doc_id or 99, x.n_bytes, x.gone) for x in got)
    by = {n: [g for i, m, g in out if (i, m) == n] for n in {(i, m) for i, m, _ in out}}
    na, nb = len(a), len(b)
    assert by[7, na] == [na] and by[99, na + nb][0] > 100 and by[99, nb] == [nb]  # later than all others
    assert len(by[3, na]) == 2 and len(set(by[3, na])) == 1  # rows equal in id and text are one document
    assert sorted((by[3, na][0], by[3, na + nb][0])) == [0, na]  # and of two texts under an id one comes first


def test_deep_shallow_sort():
    r = random.Random(4)
    strings = [bytes(r.choice(b"ab\x00") for _ in range(r.choice((3, 30, 60)))) for _ in range(300)] + [b"a" * 40, b"a" * 50, b"a" * 50, b""]
    group = np.array([r.randrange(3) for _ in strings])
    order, lcp = suffix_dedup.suffix_order(group, strings)
    keys = [(int(group[i]), strings[i]) for i in order]
    assert keys == sorted(keys)
    for n in range(1, len(keys)):
        (g, a), (h, b) = keys[n - 1], keys[n]
        assert lcp[n] == (-1 if g != h else suffix_dedup.common_prefix(a, b))


def test_packing(spark):
    r = random.Random(6)
    rows = [(i, words_of(r, r.choice((0, 3, 40, 900)))) for i in range(60)] + [(70, None), (71, "a  b"), (71, "a  b"), (None, "x"), (72, "日本 語 <|endoftext|> it's")]
    path = tokens.default_path()
    docs = documents(spark, rows)
    got = packing.pack_documents(docs, path, window_tokens=3000).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    want = {}
    for i, x in rows:
        want.setdefault(i, []).append([*t.encode(x or "", add_special_tokens=False).ids, 0])
    sequences, own = {}, {}
    for x in got:
        sequences.setdefault(x.sequence_id, []).append((x.offset, x.length))
        ids = np.frombuffer(x.ids, "<u4").tolist()
        assert any(ids == w[x.start : x.start + x.length] and x.doc_tokens == len(w) for w in want[x.doc_id])
        own[x.doc_id] = own.get(x.doc_id, 0) + x.length
    assert own == {i: sum(map(len, w)) for i, w in want.items()}
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024 and at & (at - 1) == 0
    assert packing.pack_documents(documents(spark, []), path).count() == 0


def test_secrets(spark):
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    rows = [(1, f'the ann token = "{key}" an the'), (2, "paid by 9807915762804490 on the"), (3, "how-to-bake-bread-in-10-minutes is fun"), (4, None), (5, ""), (6, f"{'word ' * 3000}secret={key} and {'w ' * 9}api_key: AKIA{'Q7' * 8}")]
    got = secrets.scan(documents(spark, rows)).collect()
    text = dict(rows)
    assert all(text[r.doc_id][r.start : r.end] == r.candidate for r in got)
    assert {(r.doc_id, r.candidate) for r in got if r.secret} == {(1, key), (6, key), (6, "AKIA" + "Q7" * 8)}
    assert secrets.scan(documents(spark, [])).count() == 0


BASE = {
    0: r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", 1: r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", 2: r"[0-9](?:[\x20-]?[0-9])+", 3: r"\+[0-9][\x20().0-9-]+[0-9]",
}


def test_pii_base_by_brute_force():
    r = random.Random(9)
    for _ in range(3000):
        s = "".join(r.choice(["a", ".", "@", "1", "23", "-", " ", "+", "(", ")", "255", "4111111111111111", "x.y"]) for _ in range(r.randint(0, 30)))
        want = []
        for k, p in BASE.items():
            for m in re.finditer(p, s):
                d = re.sub("[^0-9]", "", m.group())
                if k == 0 or k == 1 and all(int(x) < 256 for x in m.group().split(".")) or k == 2 and 13 <= len(d) <= 19 and pii.luhn(d) or k == 3 and 9 <= len(d) <= 15:
                    want.append((k, m.start(), m.end()))
        assert sorted(pii.base_spans(s)) == sorted(want), s


def test_pii_model(spark):
    w = dict(pii.train())
    hit = good = total = 0
    for text, gold in pii.training_sentences(150, seed=99):
        base, added = pii.all_spans(text, w)
        found = set(base) | set(added)
        hit += len(found & set(gold))
        good += len(found)
        total += len(gold)
    assert hit / total > 0.9 and hit / good > 0.85
    docs = documents(spark, [(1, "call (017) 555-7713 or mail a.b@c.org"), (2, None), (3, ""), (4, "nothing 2019 here")])
    out = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert out == {1: "call [PHONE] or mail [EMAIL]", 2: None, 3: "", 4: "nothing 2019 here"}
    assert pii.redact(docs).columns == docs.columns and pii.find_spans(documents(spark, [])).count() == 0


def test_warc(spark):
    long, short = "ä" * 60, "tiny"
    rows = [(3, "u3", long), (1, "http://a b\n", long), (2, "u", short), (4, "u", short), (5, None, None), (None, "u", long), (6, "u", "line\r\n\r\nWARC/1.1\r\n" * 20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.round_trip(pages).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert (by[1].record_type, by[3].record_type, by[3].refers_to, by[2].record_type, by[4].record_type, by[5].payload_bytes) == ("response", "revisit", 1, "response", "response", 0)
    assert by[None].refers_to == 1 and by[6].payload.decode() == rows[6][2] and by[3].payload is None
    assert all(r.payload_digest == hashlib.sha256((dict((i, h) for i, _, h in rows)[r.page_id] or "").encode()).hexdigest() for r in got)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_quality(spark):
    r = random.Random(1)
    rows, labels = [], []
    for i in range(600):
        good = r.random() < 0.7
        t = words_of(r, 60).capitalize() + "."
        rows.append((i, t if good else " ".join(w + r.choice(["###", "$$$", "%%%"]) for w in t.split())))
        labels.append((i, int(good), 0))
    rows += [(900, None), (901, ""), (901, "")]
    docs = documents(spark, rows)
    lab = spark.createDataFrame([*labels, (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in quality_rules.score(docs, lab).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(600))
    wrong = [i for i, q, _ in labels if got[i].held_out and got[i].predicted != q]
    assert len(wrong) <= 2 and all(0 <= x.score <= 1 for x in got.values())
    kept = quality_rules.keep_good(docs, lab)
    assert kept.columns == docs.columns
    assert sorted(x.doc_id for x in kept.collect()) == sorted(i for i, _ in rows if got[i].predicted == 1)
    assert {x.score for x in quality_rules.score(docs, lab.limit(0)).collect()} == {0.5}


def test_kernel_words():
    texts = ["A bc\tD", "", "x y z", " lead trail "]
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    data = np.frombuffer(b"".join(raw), np.uint8)
    h, row = tk.word_hashes(data, offsets)
    assert np.bincount(row, minlength=4).tolist() == [3, 0, 2, 2]
    alone = tk.word_hashes(np.frombuffer(b"d", np.uint8), np.array([0, 1]))[0]
    assert h[2] == alone[0]
