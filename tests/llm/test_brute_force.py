"""Operators that SQL cannot say, against plain versions of their definitions; long texts; SQL twins on made-up tables."""

import itertools
import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexatlas.llm import decontaminate, ngram_join, packing, pii, quality_rules, quotes, secrets, suffix_dedup, tokens, topk, warc
from lexatlas.llm import textkernel as tk
from tests.llm.test_operators import BASE, brute_dedup, brute_top_k, components, corpus, documents, words_of

# ------------------------------------------------------------ quotation linking


def normal(text):
    return " ".join(re.sub(r"[\W_]+", " ", text.lower()).split())


def split_message(text):
    """(body, [(level, passage)]) of a message."""
    lines = []
    for line in re.split("\r\n|\r|\n", text or ""):
        m = re.match(r"[ \t]*((?:>[ \t]?)+)", line)
        level = m[1].count(">") if m else 0
        lines.append((level, line[m.end() :] if m else line, bool(re.match(r"(?i)[ \t]*(on|am|el|le)\b.{0,200}\b(wrote|schrieb|escribió|a écrit)[ \t]*:[ \t]*$", line))))
    body = [t for n, (v, t, head) in enumerate(lines) if v == 0 and not (head and n + 1 < len(lines) and lines[n + 1][0] > 0)]
    passages = [(v, "\n".join(t for _, t, _ in run)) for v, run in ((v, list(run)) for v, run in itertools.groupby(lines, key=lambda x: x[0])) if v > 0]
    return "\n".join(body).strip(" ") if ">" in (text or "") else text or "", passages


def brute_links(rows):
    """{(conv, turn, position): (level, source conversation, source turn)}"""
    said = {}
    for c, t, _, text in rows:
        own = [x for x in map(normal, re.split("\r\n|\r|\n", split_message(text)[0])) if x]
        for i in range(len(own)):
            for j in range(i, len(own)):
                said.setdefault(" ".join(own[i : j + 1]), set()).add((c, t))
    out = {}
    for c, t, _, text in rows:
        for n, (level, passage) in enumerate(split_message(text)[1]):
            if key := normal(passage):
                places = said.get(key, set())
                inside = [p for p in places if p[0] == c]
                others = [p for p in places if p[0] != c]
                first = min(inside, default=None)
                out[c, t, n] = (level, *(first if first and first[1] < t else min(others, default=(None, None))))
    return out


def mail_threads(seed, threads=12):
    """Threads in which messages quote lines, runs of lines and quotes of each other, rewrapped or altered."""
    r = random.Random(seed)
    rows = []
    for c in range(threads):
        texts = []
        for t in range(r.randint(1, 7)):
            lines = [" ".join(words_of(r, 1) for _ in range(r.randint(0, 4))) + r.choice(["", ".", "!", " é"]) for _ in range(r.randint(0, 5))]
            if r.random() < 0.3 and rows:
                lines.insert(r.randint(0, len(lines)), r.choice(rows)[3].split("\n")[0].lstrip("> "))  # said before somewhere
            if texts and r.random() < 0.8:
                source = r.choice(texts if r.random() < 0.8 or not rows else [r.choice(rows)[3]]).split("\n")
                i = r.randrange(len(source))
                part = source[i : i + r.randint(1, 3)]
                if r.random() < 0.3:
                    part = re.sub(r" (?=[a-h])", "\n", "\n".join(part), count=1).split("\n")  # broken elsewhere
                if r.random() < 0.15:
                    part[0] += " more"
                head = ["On Monday, Ann wrote:"] if r.random() < 0.4 else []
                lines = [*head, *(r.choice([">", "> "]) + x for x in part), *lines]
            texts.append(r.choice(["\n", "\r\n"]).join(lines))
            rows.append((c, t, r.choice("ab"), texts[-1].replace("\r\n", "\n")))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_quotes_by_brute_force(spark, seed):
    rows = mail_threads(seed)
    df = spark.createDataFrame([(*x, 5, "e") for x in rows], "conv_id long, turn long, role string, text string, level int, hash string")
    got = {(x.conv_id, x.turn, x.position): (x.level, x.source_conv, x.source_turn) for x in quotes.link_quotes(df).collect()}
    want = brute_links(rows)
    assert got == want and sum(v[1] is not None for v in want.values()) > 10 and any(v[1] is None for v in want.values())
    messages = {(x.conv_id, x.turn): x for x in quotes.reply_ordered(df).collect()}
    for c, t, _, text in rows:
        body, passages = split_message(text)
        x = messages[c, t]
        assert (x.body, x.n_quotes, x.max_level) == (body, len(passages), max([0, *(v for v, _ in passages)]))
        here = sorted((v, n, s) for (a, b, n), (v, o, s) in want.items() if (a, b) == (c, t) and o == c)
        assert x.reply_to == (here[0][2] if here else t - 1 if t else None)
    for c in {r[0] for r in rows}:
        order = sorted((x.reply_to if x.reply_to is not None else x.turn, x.turn) for x in messages.values() if x.conv_id == c)
        assert [t for _, t in order] == [x.turn for x in sorted((x for x in messages.values() if x.conv_id == c), key=lambda x: x.place)]


def test_quotes_of_empty_and_equal_messages(spark):
    rows = [(1, 0, "a", ""), (1, 0, "a", ""), (1, 1, "b", ">"), (1, 2, "c", "> \n>> x\n"), (1, 3, "d", "x"), (2, 0, "a", "x")]
    got = quotes.reply_ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == 6 and sorted(x.place for x in got if x.conv_id == 1) == [1, 2, 3, 4, 5]
    by = {(x.conv_id, x.turn): x for x in got}
    assert (by[1, 1].n_quotes, by[1, 1].n_linked, by[1, 2].n_linked, by[1, 2].max_level) == (1, 0, 1, 2)  # what (2, 0) says


# ------------------------------------------------------------ decontamination


def brute_hits(docs, items, minimum=0.6, overlap=0.8, k1=1.2, b=0.75):
    """{(doc, item): best (score, question overlap, answer overlap) of windows of 2 L words every L words}"""
    words = lambda s: re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), s or ""))
    own = [(i, words(t), t) for i, t in items]
    n, span = len(own), max(1, *(len(w) for _, w, _ in own))
    mean = max(1.0, sum(len(w) for _, w, _ in own) / n)
    df = {}
    for _, w, _ in own:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    runs = lambda w, m: {tuple(w[i : i + m]) for i in range(len(w) - m + 1)} if m else set()
    out = {}
    for d, text in docs:
        w = words(text)
        for lo in range(0, len(w), span):
            window = w[lo : lo + 2 * span]
            for i, iw, raw in own:
                if not iw:
                    continue
                weight = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * iw.count(t) * (k1 + 1) / (iw.count(t) + k1 * (1 - b + b * len(iw) / mean)) for t in set(iw)}
                score = sum(weight[t] for t in set(window) & set(iw)) / sum(weight.values())
                if score < minimum - 1e-9:
                    continue
                shares = []
                for part in decontaminate.question_answer(raw):
                    p = words(part)
                    m = min(5, len(p))
                    shares.append(len(runs(p, m) & runs(window, m)) / len(runs(p, m)) if m and len(window) >= m else 0.0)
                if min(shares) >= overlap:
                    out[d, i] = tuple(max(x, round(y, 6)) for x, y in zip(out.get((d, i), (0, 0, 0)), (score, *shares), strict=True))
    return out


@pytest.mark.parametrize("shards", [5, 50, 1000])
def test_decontamination_by_brute_force(spark, shards):
    r = random.Random(21)
    vocab = [words_of(r, 1) for _ in range(90)]
    some = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(i, some(r.randint(3, 20)).capitalize() + r.choice([". ", "? ", " "]) + some(r.randint(1, 9)) + ".") for i in range(50)]
    items += [(50, some(400) + ". " + some(30)), (51, ""), (52, None), (53, "... -- !"), (54, "Ünï " + some(8) + "."), (3, some(12) + ". " + some(5))]
    docs = []
    for i in range(70):
        parts = [some(r.randint(0, 60)) for _ in range(3)]
        if r.random() < 0.7:
            hidden = r.choice(items)[1] or ""
            parts.insert(1, " ".join(w if r.random() < 0.97 else r.choice(vocab) for w in hidden.split()))
        docs.append((i, r.choice([" ", " * ", "\n"]).join(parts)))
    docs += [(100, items[50][1]), (101, None), (102, ""), (103, "x " + items[50][1][:900])]
    found = decontaminate.find(documents(spark, docs), spark.createDataFrame([(*x, "en", 1.0) for x in items], "item_id long, text string, lang string, score double"), shard_items=shards)
    got = {(x.doc_id, x.item_id): (x.score, x.question_overlap, x.answer_overlap) for x in found.collect()}
    want = brute_hits(docs, items)
    assert got.keys() == want.keys() and len(want) > 25
    assert all(got[k] == pytest.approx(want[k], abs=2e-6) for k in want)


# ------------------------------------------------------------ secrets


def brute_features(path, before, c, after):
    n = len(c)
    classes = re.sub("[0-9]", "0", re.sub("[a-z]", "l", re.sub("[A-Z]", "U", re.sub("[^A-Za-z0-9]", ".", c))))
    share = lambda chars: sum(x in chars for x in c) / n
    digits, upper = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    rest, low = "", c.lower()
    while low:  # the leftmost word of the list, the first listed of those that begin there, goes
        at = next((w for w in secrets.DICTIONARY if low.startswith(w)), None)
        rest, low = (rest, low[len(at) :]) if at else (rest + low[0], low[1:])
    flag = lambda p, s: float(s is not None and re.search(p, s) is not None)
    return {
        "length": float(n), "changes": (len([k for k, _ in itertools.groupby(classes)]) - 1) / n, "digit_share": share(digits), "upper_share": share(upper), "distinct_share": len(set(c.lower())) / min(n, 36),
        "hex": float(all(x in "0123456789abcdef" for x in c) or all(x in "0123456789ABCDEF" for x in c)), "only_digits": float(all(x in "0123456789_/+=-" for x in c)), "separators": sum(not (x.isalnum() or x in "+/=") for x in c) / n,
        "coverage": 1 - len(rest) / n, "vowels": share("aeiouAEIOU"), "assigned": flag(secrets._ASSIGNED, before), "quoted": float(before[-1:] in tuple("\"'`") and after[:1] in tuple("\"'`")),
        "equals_before": flag(r"[=:]\s*[\"'`]?$", before), "harmless_word": flag(secrets._HARMLESS, before), "harmless_path": flag(secrets._HARMLESS_PATH, path), "known_prefix": flag("^(AKIA|ASIA|ghp_|gho_|glpat-|xox[abp]-|sk-|sk_live_|eyJ|AIza)", c),
    }


def brute_forest(forest, x):
    def leaf(t):
        while len(t) > 1:
            t = t[2] if x[secrets.FEATURES[t[0]]] <= t[1] else t[3]
        return t[0]

    return sum(map(leaf, forest)) / len(forest)


def test_secrets_by_brute_force(spark, monkeypatch):
    r = random.Random(6)
    labelled = secrets.labelled_findings(300, seed=77)
    texts = []
    for i in range(40):
        parts = []
        for path, before, c, after, _ in r.sample(labelled, r.randint(0, 9)):
            parts.append(before + c + after)
        texts.append((i, r.choice([" ", "\n", " é "]).join(parts)))
    texts += [(90, None), (91, ""), (92, " ".join(f"k{n}=a1b2c3d4e5f6{n}" for n in range(60))), (92, "token a1b2c3d4e5f6g7"), (None, "secret=0123456789abcdef0123")]
    monkeypatch.setattr(secrets, "RUN", 7)
    forest = secrets.train(spark)
    got = sorted((x.doc_id if x.doc_id is not None else -1, x.start, x.end, x.candidate, x.probability, x.secret) for x in secrets.scan(documents(spark, texts)).collect())
    want = []
    for i, text in texts:
        for m in re.finditer(secrets.CANDIDATE, text or ""):
            before, after = (text[: m.start()])[-40:], text[m.end() : m.end() + 40]
            prior = [x.end() for x in re.finditer(secrets.CANDIDATE, text) if x.end() <= m.start()]
            nxt = [x.start() for x in re.finditer(secrets.CANDIDATE, text) if x.start() >= m.end()]
            before = text[max([0, m.start() - 40, *prior]) : m.start()]  # neighbours end at the next candidate
            after = text[m.end() : min([len(text), m.end() + 40, *nxt])]
            p = round(brute_forest(forest, {k: round(v, 6) for k, v in brute_features("src", before, m[0], after).items()}), 6)
            want.append((i if i is not None else -1, m.start(), m.end(), m[0], p, p >= 0.5))
    want.sort()
    assert [x[:4] for x in got] == [x[:4] for x in want] and len(want) > 120
    assert [x[4] for x in got] == pytest.approx([x[4] for x in want], abs=2e-6)
    assert any(x[5] for x in got) and not all(x[5] for x in got)


# ------------------------------------------------------------ personal data


def segmentations(segs, n, at=0):
    """All ways to place disjoint (segment, kind)."""
    if at >= n:
        yield ()
        return
    yield from segmentations(segs, n, at + 1)
    for s, (i, j, *_rest) in enumerate(segs):
        if i == at:
            for k in range(len(pii.KINDS)):
                for rest in segmentations(segs, n, j):
                    yield ((s, k), *rest)


def short_texts():
    r = random.Random(31)
    out = []
    while len(out) < 25:
        s = "".join(r.choice(["12", "3", "a@b.c", "555-0199", " ", "-", "(017) ", "+49", "x", "1234567", ".", "4111"]) for _ in range(r.randint(2, 6)))
        n, segs = pii.segments(s, 0, len(s))
        if 0 < len(segs) < 12 and n < 18:
            out.append((s, n, segs))
    return out


def test_crf_by_enumeration():
    w = dict(pii.train())
    for s, n, segs in short_texts():
        ways = list(segmentations(segs, n))
        value = [sum(pii._score(w, segs[i][4], k) for i, k in way) for way in ways]
        spans = pii.decode(w, s, 0, len(s))
        own = sum(pii._score(w, next(f for _, _, a, b, f in segs if (a, b) == x[1:]), x[0]) for x in spans)
        assert own == pytest.approx(max(value))
        total = sum(map(math.exp, value))
        for (i, k), p in pii._marginals(w, n, segs).items():
            assert p == pytest.approx(sum(math.exp(v) for way, v in zip(ways, value, strict=True) if (i, k) in way) / total, abs=1e-9)


def test_crf_gradient_is_the_slope_of_the_likelihood():
    """Expected minus observed counts against differences of the enumerated likelihood."""
    w = {k: v / 3 for k, v in dict(pii.train()).items()}
    s, n, segs = next(x for x in short_texts() if len(x[2]) > 2)
    gold = {(0, 3)}

    def likelihood(w):
        values = [sum(pii._score(w, segs[i][4], k) for i, k in way) for way in segmentations(segs, n)]
        return sum(pii._score(w, segs[i][4], k) for i, k in gold) - math.log(sum(map(math.exp, values)))

    marginals = pii._marginals(w, n, segs)
    for f, k in {(f, k) for i in range(len(segs)) for f in segs[i][4] for k in (0, 3)}:
        slope = sum((((i, k) in gold) - marginals[i, k]) * segs[i][4].count(f) for i in range(len(segs)))
        up, down = ({**w, (f, k): w.get((f, k), 0.0) + e} for e in (1e-5, -1e-5))
        assert slope == pytest.approx((likelihood(up) - likelihood(down)) / 2e-5, abs=1e-5)


def test_added_spans_touch_nothing():
    w = dict(pii.train())
    r = random.Random(5)
    for _ in range(200):
        s = "".join(r.choice(["call (017) 555-7713 ", "1.2.3.4 ", "+4930123456789 ", "a@b.org", " or 4111111111111111 ", "\n", "555-123-4567", " "]) for _ in range(r.randint(0, 12)))
        base, added = pii.all_spans(s, w)
        taken = [x[1:] for x in base]
        for _, a, b in added:
            assert not any(x < b and a < y for x, y in taken)
            taken.append((a, b))
        slow = [(a, b) for _, a, b in base]
        want = []
        for lo, hi in pii.windows(s):
            for k, a, b in pii.decode(w, s, lo, hi):
                if not any(x < b and a < y for x, y in slow):
                    want.append((k, a, b))
                    slow.append((a, b))
        assert added == want


def test_personal_data_of_null_ids_and_repeated_rows(spark):
    rows = [(None, "mail a.b@c.org"), (2, "mail a.b@c.org"), (2, "mail a.b@c.org"), (3, None)]
    got = pii.find_spans(documents(spark, rows)).collect()
    assert sorted((x.doc_id or 0, len(x.base)) for x in got) == [(0, 1), (2, 1), (2, 1), (3, 0)]


# ------------------------------------------------------------ quality


def brute_statistics(text):
    data = (text or "").encode()
    per = max(len(data), 1)
    words = re.findall(rb"[^\x20\x09-\x0D]+", data)
    n = max(len(words), 1)
    count = lambda chars: sum(x in chars for x in data) / per
    upper, symbols, marks = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|<>{}[]@^~=_+\\/", b"!?"
    alpha = lambda w: sum(bytes([x]).isalpha() or x > 127 for x in w)
    lines = data.split(b"\n")
    lines = lines[:-1] if data.endswith(b"\n") else lines
    lines = lines if data else []
    repeats = lambda xs: (len(xs) - len(set(xs))) / max(len(xs), 1)
    low = [bytes(x + 32 if 65 <= x <= 90 else x for x in w) for w in words]
    shingles = [tuple(low[i : i + 5]) for i in range(len(low) - 4)] if len(low) > 4 else [tuple(low)] if low else []
    return {
        "chars": len(data), "n_words": len(words), "word_len": sum(map(len, words)) / n, "long_words": sum(len(w) > 14 for w in words) / n, "short_words": sum(len(w) < 4 for w in words) / n,
        "upper": count(upper), "digits": count(b"0123456789"), "symbols": count(symbols), "marks": count(marks), "non_ascii": sum(x > 127 for x in data) / per, "sentence_ends": count(b"."),
        "capitalised": sum(w[0] in upper for w in words) / n, "symbol_ended": sum(w[-1] in symbols + marks for w in words) / n, "upper_words": sum(2 * sum(x in upper for x in w) > max(alpha(w), 1) for w in words) / n,
        "lines": len(lines), "line_words": len(words) / max(len(lines), 1), "repeated_lines": repeats(lines), "repeated_words": repeats(low), "repeated_shingles": repeats(shingles), "bars": count(b"|"),
    }


def test_statistics_and_rules_by_brute_force(spark):
    r = random.Random(17)
    atoms = ["word", "Word", "WORD", "a", "averyveryverylongword", "12", "|", "#tag", "end.", "what?", "é", "ÜBER", "x|y", "...", "it's", "B2B"]
    texts = ["".join(r.choice(atoms) + r.choice([" ", "  ", "\n", "\t", " \n\n"]) for _ in range(r.randint(0, 40))) for _ in range(80)] + [None, "", " ", "\n", "a", "a\n", "\na", "same line\nsame line\nother"]
    docs = documents(spark, list(enumerate(texts)))
    got = {x.doc_id: x for x in quality_rules.with_statistics(docs).collect()}
    for i, t in enumerate(texts):
        for k, v in brute_statistics(t).items():
            assert got[i][k] == pytest.approx(v, abs=1e-8), (k, t)
    x = np.array([[got[i][s] for s in quality_rules.STATS] for i in range(len(texts))])
    y = (x[:, 1] + 3 * x[:, 5] > np.median(x[:, 1])).astype(float)
    b, rules = quality_rules.fit(x, y)
    fired = quality_rules.rule_matrix(x, [p for _, p in rules])
    slow = np.array([[float(all((row[k] > t) == above for k, above, t in path)) for _, path in rules] for row in x])
    assert rules and (fired == slow).all()
    want = 1 / (1 + np.exp(-(b + slow @ np.array([v for v, _ in rules]))))
    scored = quality_rules.with_statistics(docs).select("doc_id", quality_rules.compile_rules((b, rules)).alias("s")).collect()
    assert {r.doc_id: r.s for r in scored} == pytest.approx(dict(enumerate(want.tolist())))


def test_lasso_is_optimal():
    """At the optimum each weight's slope is the penalty, or under it where the weight is zero."""
    r = np.random.default_rng(4)
    m = (r.random((300, 12)) < 0.4).astype(float)
    y = (m[:, 0] + m[:, 3] - m[:, 5] + r.normal(0, 0.5, 300) > 0.4).astype(float)
    b, w = quality_rules.lasso_logistic(m, y, 0.02, 4000)
    g = m.T @ (1 / (1 + np.exp(-(b + m @ w))) - y) / len(y)
    assert (np.abs(g) <= 0.02 + 1e-4).all() and (w == 0).any() and np.allclose(g[w != 0], -0.02 * np.sign(w[w != 0]), atol=1e-4)


def test_quality_of_null_ids(spark):
    docs = documents(spark, [(None, "some text"), (None, None), (4, "some text")])
    labels = spark.createDataFrame([(4, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality_rules.score(docs, labels).collect()
    assert len(got) == 3 and all(x.held_out for x in got if x.doc_id is None)


# ------------------------------------------------------------ long texts


def test_texts_of_megabytes(spark):
    """A text far over a chunk gives what its definition says, in every operator that reads whole texts."""
    r = random.Random(2)
    vocab = [words_of(r, 1) for _ in range(3000)]
    long_ = " ".join(r.choice(vocab) for _ in range(900_000))
    assert len(long_) > 4_500_000
    item = " ".join(r.choice(vocab) for _ in range(30)) + ". " + " ".join(r.choice(vocab) for _ in range(9)) + "."
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    tail = f" mail a.b@c.org {item} token = \"{key}\" "
    docs = documents(spark, [(1, long_ + tail), (2, long_ + " other end"), (3, "short text"), (4, "y" * 3_000_000)])
    got = {x.doc_id: x for x in ngram_join.near_duplicates(docs).collect()}
    w = (long_ + tail).split()
    assert got[1].n_shingles == len({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    assert got[2].component_id == 1 and got[4].n_shingles == 1 and got[3].component_id == 3
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert [(x.doc_id, x.item_id) for x in decontaminate.find(docs, bench).collect()] == [(1, 7)]
    gone = {x.doc_id: sum(s.end - s.start for s in x.removed) for x in suffix_dedup.deduplicate(docs).select("doc_id", "removed").collect()}
    assert gone[1] == 0 and len(long_) <= gone[2] < len(long_) + 10 and gone[4] == 3_000_000 - 1
    packed = packing.pack_documents(docs, tokens.default_path()).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()
    assert all(x.n == x.t for x in packed) and len(packed) == 4
    assert {x.doc_id: [s.kind for s in x.base] for x in pii.find_spans(docs).collect()} == {1: ["email"], 2: [], 3: [], 4: []}
    assert [(x.doc_id, x.candidate) for x in secrets.scan(docs).where("secret").collect()] == [(1, key)]
    sizes = {x.doc_id: (x.chars, x.n_words) for x in quality_rules.with_statistics(docs).collect()}
    assert sizes[1] == (len(long_ + tail), len(w)) and sizes[4] == (3_000_000, 1)
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"), "lang", "k")
    assert {x.page_id: x.payload_bytes for x in warc.round_trip(pages).select("page_id", "payload_bytes").collect()}[2] == len(long_) + 10


def test_words_of_stretches():
    r = random.Random(3)
    text = (" ".join(words_of(r, 1) for _ in range(400_000)) + " " + "Z" * 2_500_000 + " end").encode()
    data = np.frombuffer(text, np.uint8)
    h, _ = tk.word_hashes(data, np.array([0, len(data)]))
    alone = [tk.word_hashes(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[0][0] for w in (text.split()[0], text.split()[77_777], b"end")]
    assert len(h) == len(text.split()) and [h[0], h[77_777], h[-1]] == alone


# ------------------------------------------------------------ twins on made-up tables


def rows_of(df):
    return sorted(str(tuple(None if v != v else v for v in r)) for r in df.astype(object).where(df.notna(), None).itertuples(index=False))


def duck(sql, **frames):
    c = duckdb.connect()
    for name, f in frames.items():
        c.register(name, f)
    return c.sql(sql).df()


def test_twins_of_documents(spark):
    r = random.Random(9)
    rows = corpus(3, 10)
    passage = words_of(r, 60)
    rows += [(1000 + i, words_of(r, r.randint(0, 50)) + passage[r.randint(0, 40) :] + words_of(r, 20) + passage * (i % 2) + "é") for i in range(20)]
    docs = documents(spark, rows)
    frame = docs.toPandas()
    want = components(rows)
    got = duck(ngram_join.OP1_SQL, documents=frame)
    assert {int(x.doc_id): (x.n_shingles, x.component_id) for x in got.itertuples()} == want
    got = duck(suffix_dedup.OP5_SQL, documents=frame)
    assert {int(x.doc_id): (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got.itertuples()} == brute_dedup(rows)


def test_twin_of_vectors(spark):
    r = np.random.default_rng(8)
    vecs = [(i % 70, (r.normal(size=6)).tolist()) for i in range(90)] + [(80, [1.0]), (81, None), (82, [])]
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<float>")
    got = duck(topk.OP4_SQL, embeddings=df.toArrow())
    assert sorted((x.query_id, x.rank, x.vec_id, x.score) for x in got.itertuples()) == brute_top_k(vecs, 20)


def test_base_patterns_are_the_contract():
    assert len(BASE) == len(pii.KINDS)
