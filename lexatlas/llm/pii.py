"""Personal data: pattern spans plus a semi-Markov conditional random field.

Base spans of four kinds come from patterns with checks (octet range, Luhn,
digit counts). A semi-Markov CRF then segments the text around digits and at
signs: every candidate span of bounded length is scored as a whole (shape,
digit groups, checksum, neighbouring words), and a dynamic program over token
positions chooses boundaries and kinds together. Its spans are added where
they touch no base span; base spans always stay. The model is trained by
conditional likelihood on generated sentences, on the driver, in a second or two.

Defined results: null and empty texts have no spans; repeated rows and null
ids are treated row by row; an empty table gives an empty result; further
columns pass through ``redact`` untouched and are ignored elsewhere. Offsets
are code points, ends exclusive. Of equally good segmentations the one with
fewer spans wins.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexatlas.runtime import lean, ship_package

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # (kind, start, end)

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) << (i & 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that pass its check, by kind and start."""
    out: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:
        lo = at
        while lo > free and text[lo - 1] in _LOCAL:
            lo -= 1
        m = _DOMAIN.match(text, at + 1) if lo < at else None
        if m:
            out.append((0, lo, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    if _DIGIT.search(text):
        out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                d = _only_digits(m.group())
                if 13 <= len(d) <= 19 and luhn(d):
                    out.append((2, m.start(), m.end()))
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_only_digits(m.group())) <= 15]
    return out


# ---------------------------------------------------------------- the CRF

MAX_TOKENS, MAX_CHARS = 24, 56
_TRIGGER = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|[\s\S]")
#: Fixed cue words by kind; the last group speaks against personal data.
_CUES = {
    "email": "mail email e-mail contact kontakt correo courriel write".split(),
    "ip": "ip host server address adresse client from".split(),
    "card": "card visa mastercard credit karte tarjeta carte".split(),
    "phone": "phone tel call fax mobile telefon phoned ring telefono".split(),
    "not": "version page order year isbn no id number seite license ticket invoice total chapter".split(),
}
_CUE = {w: k for k, ws in _CUES.items() for w in ws}


def windows(text: str) -> Iterator[tuple[int, int]]:
    """Stretches around digits and at signs, inside one line each."""
    lo = hi = -1
    for m in _TRIGGER.finditer(text):
        p = m.start()
        if lo >= 0 and p - hi <= 40 and "\n" not in text[hi:p]:
            hi = p + 1
            continue
        if lo >= 0:
            yield _widen(text, lo, hi)
        lo, hi = p, p + 1
    if lo >= 0:
        yield _widen(text, lo, hi)


def _widen(text: str, lo: int, hi: int) -> tuple[int, int]:
    a = max(text.rfind("\n", max(0, lo - 40), lo) + 1, lo - 40, 0)
    b = text.find("\n", hi, hi + 40)
    return a, (b if b >= 0 else min(len(text), hi + 40))


def segments(text: str, lo: int, hi: int) -> tuple[int, list[tuple[int, int, int, int, list[str]]]]:
    """(number of tokens, [(first token, end token, start, end, shared features)])."""
    toks = [(m.start(), m.end()) for m in _TOKEN.finditer(text, lo, hi)]
    n = len(toks)
    word = lambda k: 0 <= k < len(text) and (text[k].isalnum() or text[k] == "_")
    out = []
    for i in range(n):
        a = toks[i][0]
        c = text[a]
        if not (c.isalnum() or c in "+(") or (word(a - 1) and c.isalnum()):
            continue
        signs = digits = letters = 0
        for j in range(i + 1, min(n, i + MAX_TOKENS) + 1):
            x, y = toks[j - 1]
            if y - a > MAX_CHARS:
                break
            t = text[x]
            if "0" <= t <= "9":
                digits += y - x
            elif t == "@":
                signs += 1
            elif t.isalpha():
                letters += 1
            elif t not in " ().-+_%":
                break
            if signs > 1 or (t == " " and (letters or signs)) or (letters and c in "+("):
                break
            if not (text[y - 1].isalnum()) or word(y) or digits > 19:
                continue
            if signs or (digits >= 7 and not letters):
                out.append((i, j, a, y, _features(text, a, y, lo)))
    return n, out


def _features(text: str, a: int, b: int, lo: int) -> list[str]:
    s = text[a:b]
    d = _only_digits(s)
    groups = [len(g) for g in re.findall(r"[0-9]+", s)]
    f = ["bias"]
    if "@" in s:
        local, _, host = s.partition("@")
        f += ["at", "host:" + ("dots" if re.fullmatch(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", host) else "plain")]
        f.append("local:" + ("ok" if re.fullmatch(r"[A-Za-z0-9._%+-]+", local) else "odd"))
        if a > 0 and text[a - 1] in _LOCAL:
            f.append("local:cut")
    else:
        f.append("digits:" + ("7-8" if len(d) < 9 else "9" if len(d) == 9 else "10" if len(d) == 10 else "11-12" if len(d) < 13 else "13-15" if len(d) < 16 else "16" if len(d) == 16 else "17+"))
        seps = "".join(sorted(set(re.sub(r"[0-9]", "", s))))
        f.append("seps:" + seps)
        f.append("groups:" + ("-".join(map(str, groups)) if len(groups) <= 5 else "many"))
        if len(d) >= 13:
            f.append(f"luhn:{luhn(d)}")
        if seps == "." and len(groups) == 4:
            f.append(f"octets:{all(int(g) < 256 for g in re.findall(r'[0-9]+', s))}")
        if a > 0 and text[a - 1] in "+-./,:$(" or text[b : b + 1] in tuple("-/:,.") and text[b + 1 : b + 2].isdigit():
            f.append("glued")
        if text[b : b + 1] in tuple(" -") and text[b + 1 : b + 2].isdigit() or a > 1 and text[a - 1] in " -" and text[a - 2].isdigit():
            f.append("number beside")
    before = re.findall(r"[^\W\d_]+", text[max(lo, a - 24) : a])
    if before and before[-1].lower() in _CUE:
        f.append("cue:" + _CUE[before[-1].lower()])
    return f


Weights = dict[tuple[str, int], float]


def _score(w: Weights, feats: list[str], kind: int) -> float:
    return sum(w.get((f, kind), 0.0) for f in feats)


def decode(w: Weights, text: str, lo: int, hi: int) -> list[Span]:
    """Best segmentation of text[lo:hi] (Viterbi over token positions)."""
    n, segs = segments(text, lo, hi)
    if not segs:
        return []
    ending: dict[int, list] = {}
    for i, j, a, b, feats in segs:
        for k in range(len(KINDS)):
            v = _score(w, feats, k)
            if v > 0:
                ending.setdefault(j, []).append((v, i, (k, a, b)))
    best: list[tuple[float, int, Span | None]] = [(0.0, 0, None)]
    for j in range(1, n + 1):
        top = (best[j - 1][0], j - 1, None)
        for v, i, span in ending.get(j, ()):
            if best[i][0] + v > top[0]:
                top = (best[i][0] + v, i, span)
        best.append(top)
    out, j = [], n
    while j:
        _, i, span = best[j]
        if span:
            out.append(span)
        j = i
    return out[::-1]


def _lse(xs: list[float]) -> float:
    m = max(xs)
    return m + math.log(sum(math.exp(x - m) for x in xs))


def _marginals(w: Weights, n: int, segs: list) -> dict[tuple[int, int], float]:
    """P(segment index, kind) by the forward-backward recursions."""
    scored = [(i, j, s, k, _score(w, feats, k)) for s, (i, j, _, _, feats) in enumerate(segs) for k in range(len(KINDS))]
    into: dict[int, list] = {}
    outof: dict[int, list] = {}
    for x in scored:
        into.setdefault(x[1], []).append(x)
        outof.setdefault(x[0], []).append(x)
    fwd, bwd = [0.0] * (n + 1), [0.0] * (n + 1)
    for j in range(1, n + 1):
        fwd[j] = _lse([fwd[j - 1], *(fwd[i] + v for i, _, _, _, v in into.get(j, ()))])
    for i in range(n - 1, -1, -1):
        bwd[i] = _lse([bwd[i + 1], *(v + bwd[j] for _, j, _, _, v in outof.get(i, ()))])
    return {(s, k): math.exp(fwd[i] + v + bwd[j] - fwd[n]) for i, j, s, k, v in scored}


def _luhn_number(r: random.Random, n: int) -> str:
    body = "".join(r.choice("0123456789") for _ in range(n - 1))
    return next(body + c for c in "0123456789" if luhn(body + c))


def training_sentences(count: int = 260, seed: int = 11) -> list[tuple[str, list[Span]]]:
    """Generated sentences with gold spans; about half of the number-like strings are harmless."""
    r = random.Random(seed)
    syllables = "the an er on in re ti es or at is ou le la de en un ei ch au".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    num = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    octet = lambda: str(r.randint(0, 255))
    grouped = lambda s, sep: sep.join(s[i : i + 4] for i in range(0, len(s), 4))

    def personal() -> tuple[int, str]:
        k = r.randint(0, 3)
        if k == 0:
            return 0, word() + r.choice([".", "_", "", "+"]) + r.choice([num(2), word()]) + "@" + word() + r.choice(["", num(1)]) + "." + r.choice(["example.com", "org", "net", "co.uk"])
        if k == 1:
            return 1, ".".join(octet() for _ in range(4))
        if k == 2:
            s = _luhn_number(r, r.choice([16, 16, 16, 15, 13]))
            return 2, r.choice([s, grouped(s, " "), grouped(s, "-")])
        a, b, c = num(3), num(3), num(4)
        return 3, r.choice([f"+{r.randint(1, 99)} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{r.randint(1, 99)} {a} {b} {c}", f"+{r.randint(1, 99)}{a}{b}{c}", f"{a}.{b}.{c}"])

    def harmless() -> str:
        bad16 = num(16)
        while luhn(bad16):
            bad16 = num(16)
        return r.choice([
            str(r.randint(1900, 2035)), f"{num(1)}.{num(1)}", f"{num(2)},{num(3)}.{num(2)}", f"20{num(2)}-0{r.randint(1, 9)}-{r.randint(10, 28)}", f"{num(2)}:{num(2)}", f"{num(2)}-{num(2)}",
            "".join(r.choice("0123456789abcdef") for _ in range(40)), f"{r.randint(256, 999)}.{octet()}.{octet()}.{octet()}", num(r.randint(7, 12)), bad16, num(24), f"{num(1)}.{num(1)}.{num(1)}", f"{word()}@{word()}", "@" + word(),
            f"20{num(2)}-0{r.randint(1, 9)}-{r.randint(10, 28)} {num(2)}:{num(2)}", f"{num(3)}-{num(1)}-{num(2)}-{num(6)}-{num(1)}", f"20{num(2)}0{num(1)}{r.randint(10, 28)}", num(14), num(13), grouped(bad16, " "), grouped(bad16, "-"), bad16 + " " + num(16),
        ])

    out = []
    for _ in range(count):
        s, gold = "", []
        for _ in range(r.randint(1, 3)):
            s += " ".join(word() for _ in range(r.randint(1, 4))) + " "
            if r.random() < 0.5:
                k, t = personal()
                if r.random() < 0.3:
                    s += r.choice(_CUES[KINDS[k]]) + r.choice([" ", ": "])
                gold.append((k, len(s), len(s) + len(t)))
            else:
                t = harmless()
                if r.random() < 0.3:
                    s += r.choice(_CUES["not"]) + " "
            s += t + r.choice([" ", ". ", ", "])
        out.append((s + word(), gold))
    return out


@lru_cache(maxsize=2)
def train(count: int = 260, epochs: int = 12, seed: int = 11, l2: float = 2e-3) -> tuple[tuple[tuple[str, int], float], ...]:
    """AdaGrad on the conditional log-likelihood; returns the weights as sorted pairs."""
    w: Weights = {}
    seen: dict[tuple[str, int], float] = {}
    data = []
    for text, gold in training_sentences(count, seed):
        n, segs = segments(text, 0, len(text))
        want = {(s, k) for s, (_, _, a, b, _) in enumerate(segs) for k, ga, gb in gold if (a, b) == (ga, gb)}
        data.append((n, segs, want))
    order = random.Random(seed)
    for _ in range(epochs):
        order.shuffle(data)
        for n, segs, want in data:
            grad: Weights = {}
            for (s, k), p in _marginals(w, n, segs).items():
                g = ((s, k) in want) - p
                if abs(g) > 1e-4:
                    for f in segs[s][4]:
                        grad[f, k] = grad.get((f, k), 0.0) + g
            for key, g in sorted(grad.items()):
                g -= l2 * w.get(key, 0.0)
                seen[key] = seen.get(key, 1e-6) + g * g
                w[key] = w.get(key, 0.0) + 0.5 * g / math.sqrt(seen[key])
    return tuple(sorted((k, round(v, 6)) for k, v in w.items()))


def all_spans(text: str, w: Weights) -> tuple[list[Span], list[Span]]:
    """(base spans, spans the CRF adds)."""
    base = base_spans(text)
    taken: list[tuple[int, int]] = []  # disjoint, in order
    for _, a, b in sorted(base, key=lambda s: s[1:]):
        if taken and a < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
        else:
            taken.append((a, b))
    added = []
    for lo, hi in windows(text):
        for k, a, b in decode(w, text, lo, hi):
            at = bisect_left(taken, (b, 0))  # stretches that begin before b
            if not at or taken[at - 1][1] <= a:
                added.append((k, a, b))
                taken.insert(at, (a, b))
    return base, added


def redacted(text: str, spans: list[Span]) -> str:
    """Each maximal stretch of overlapping spans becomes [KIND] of its first span."""
    merged: list[list[int]] = []
    for a, b, k in sorted((a, b, k) for k, a, b in spans):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b, k])
    out, at = [], 0
    for a, b, k in merged:
        out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = b
    return "".join([*out, text[at:]])


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_SPAN_SQL = "array<struct<kind: string, start: bigint, end: bigint>>"


def find_spans(docs: DataFrame) -> DataFrame:
    """doc_id, base, added (arrays of kind, start, end; by kind, then start) for every row."""
    ship_package(docs.sparkSession)
    weights = train()
    kind = docs.schema["doc_id"].dataType.simpleString()
    row = lambda spans: [{"kind": KINDS[k], "start": a, "end": b} for k, a, b in sorted(spans)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = dict(weights)
        for batch in batches:
            base, added = [], []
            for text in batch.column(1):
                b, x = all_spans(text.as_py() or "", w)
                base.append(row(b))
                added.append(row(x))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, _SPAN), pa.array(added, _SPAN)], names=["doc_id", "base", "added"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {kind}, base {_SPAN_SQL}, added {_SPAN_SQL}")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind and n_chars, if there, set anew."""
    ship_package(docs.sparkSession)
    weights = train()
    names, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = dict(weights)
        for batch in batches:
            texts = []
            for t in batch.column(at):
                t = t.as_py()
                if t:
                    base, added = all_spans(t, w)
                    t = redacted(t, base + added) if base or added else t
                texts.append(t)
            cols = list(batch.columns)
            cols[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(cols, names=[f"c{i}" for i in range(len(cols))])

    out = docs.mapInArrow(lean(run), ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))).toDF(*names)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def _joined(spans) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8(spark, sf_dir: str) -> DataFrame:
    from lexatlas.runtime import table

    found = find_spans(table(spark, sf_dir, "documents"))
    order = F.array(*(F.lit(k) for k in KINDS))
    every = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(F.array_position(order, s["kind"]).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *(count(k) for k in KINDS), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(every).alias("spans"))
