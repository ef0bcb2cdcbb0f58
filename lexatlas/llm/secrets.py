"""Secret scan: candidates by pattern, false positives removed by a random forest.

Native DataFrame operations only. Runs of key-like characters with a digit are
candidates. Their features (length, character transitions, dictionary
coverage, path and neighbouring words) are SQL expressions; a random forest
trained on labelled findings with the same expressions is compiled into nested
CASE columns. Each document is read once and stays in its partition.

Defined results: null and empty texts have no findings; repeated rows and null
ids are scanned row by row; ``path`` may be null (no evidence either way); an
empty table gives an empty result; further columns are ignored. Offsets are
code points, ends exclusive.
"""

from __future__ import annotations

import json
import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_KEY = "A-Za-z0-9+/_-"
CANDIDATE = rf"(?<![{_KEY}])(?=[A-Za-z+/_-]*+[0-9])[{_KEY}]{{12,}}+={{0,2}}"
NEIGHBOURHOOD = 40
#: Hits of a text whose positions are added up together.
RUN = 512

#: Fixed word lists of the features.
DICTIONARY = (
    "password secret token access private public account admin address backup bearer build center change client cloud commit config "
    "content country customer data default delete deploy device document domain download email error event example export file filter "
    "format group guest handler header history home host http image import index info install item key label letter level library license "
    "link list local login mail main manager master member message method minute model module month name network number object option order "
    "output package page parameter parent path person phone photo place plugin point policy print process product profile project query random "
    "record release report request response result return root sample screen script search section select server service session setting sign "
    "simple source status store string style support system table target team template test text theme thread time title total update upload "
    "url user utility value version video view week window word work your here xxxx 1234 2345 3456 4567 5678 6789 abcd"
).split()
_ASSIGNED = r"(?i)(token|secret|api[ _-]?key|access[ _-]?key|key|password|passwd|pwd|auth|bearer|credential)s?[\"'\]]?\s*(:|=|=>)?\s*[\"'(\[]*$"
_HARMLESS = r"(?i)(sha-?\d*|commit|hash|checksum|md5|uuid|guid|revision|digest|etag|example|sample|placeholder|card|phone|isbn|order|invoice|serial|version|file|image|page|slug|build)[\"'\]]?\W*$"
_HARMLESS_PATH = r"(?i)(^|[/_.-])(test|tests|example|examples|sample|docs|doc|fixture|mock|vendor|node_modules|lock)([/_.-]|$)"

FEATURES = ("length", "changes", "digit_share", "upper_share", "distinct_share", "hex", "only_digits", "separators", "coverage", "vowels", "assigned", "quoted", "equals_before", "harmless_word", "harmless_path", "known_prefix")


def candidates(docs: DataFrame, path_col: str | None = "source") -> DataFrame:
    """doc_id, path, start, end, candidate, before, after of every candidate of every text."""
    path = F.col(path_col).cast("string") if path_col and path_col in docs.columns else F.lit(None).cast("string")
    rows = docs.select("doc_id", path.alias("path"), "text").where(F.col("text").rlike(CANDIDATE))
    found = rows.select("doc_id", "path", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("hit"), F.split("text", CANDIDATE, -1).alias("gap"))
    # what stands before hit i: gaps 0..i and hits 0..i-1
    size = F.transform("hit", lambda h, i: F.length(h) + F.length(F.col("gap")[i]))
    total = lambda x: F.aggregate(x, F.lit(0), lambda a, v: a + v)
    # sums of whole runs of RUN hits, sums before each run, and the hits of the own run: no array grows hit by hit
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size("size") - 1) / RUN).cast("int")), lambda r: total(F.slice("size", r * RUN + 1, RUN)))
    before = F.transform("runs", lambda _, r: total(F.slice("runs", F.lit(1), r)))
    ends = F.transform("size", lambda _, i: F.col("sums")[F.floor(i / RUN).cast("int")] + total(F.slice("size", i - i % RUN + 1, i % RUN + 1)))
    found = found.withColumn("size", size).withColumn("runs", runs).withColumn("sums", before)
    zipped = F.zip_with("hit", F.sequence(F.lit(0), F.size("hit") - 1), lambda h, i: F.struct(h.alias("candidate"), i.alias("i"), F.substring(F.reverse(F.col("gap")[i]), F.lit(1), F.lit(NEIGHBOURHOOD)).alias("back"), F.substring(F.col("gap")[i + 1], F.lit(1), F.lit(NEIGHBOURHOOD)).alias("after")))
    each = found.withColumn("ends", ends).select("doc_id", "path", "ends", F.explode(zipped).alias("c"))
    end = F.col("ends")[F.col("c.i")]
    return each.select("doc_id", "path", (end - F.length("c.candidate")).cast("long").alias("start"), end.cast("long").alias("end"), "c.candidate", F.reverse("c.back").alias("before"), "c.after")


def with_features(found: DataFrame) -> DataFrame:
    """``found`` with one double column per feature."""
    c, n = F.col("candidate"), F.length("candidate")
    share = lambda pattern: F.length(F.regexp_replace(c, pattern, "")) / n
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9]", "."), "[A-Z]", "U"), "[a-z]", "l"), "[0-9]", "0")
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    columns = {
        "length": n.cast("double"),
        "changes": (F.length(F.regexp_replace(classes, r"(.)\1+", "$1")) - 1) / n,
        "digit_share": share("[^0-9]"),
        "upper_share": share("[^A-Z]"),
        "distinct_share": F.size(F.array_distinct(F.split(F.lower(c), ""))) / F.least(n, F.lit(36)),
        "hex": flag(c.rlike("^([0-9a-f]+|[0-9A-F]+)$")),
        "only_digits": flag(c.rlike("^[0-9_/+=-]+$")),
        "separators": share("[A-Za-z0-9+/=]"),
        "coverage": 1 - F.length(F.regexp_replace(F.lower(c), "|".join(DICTIONARY), "")) / n,
        "vowels": share("[^aeiouAEIOU]"),
        "assigned": flag(F.col("before").rlike(_ASSIGNED)),
        "quoted": flag(F.col("before").rlike("[\"'`]$") & F.col("after").rlike("^[\"'`]")),
        "equals_before": flag(F.col("before").rlike(r"[=:]\s*[\"'`]?$")),
        "harmless_word": flag(F.col("before").rlike(_HARMLESS)),
        "harmless_path": flag(F.col("path").rlike(_HARMLESS_PATH)),
        "known_prefix": flag(c.rlike("^(AKIA|ASIA|ghp_|gho_|glpat-|xox[abp]-|sk-|sk_live_|eyJ|AIza)")),
    }
    return found.withColumns({k: F.round(v, 6) for k, v in columns.items()})


def labelled_findings(count: int = 1200, seed: int = 5) -> list[tuple[str, str, str, str, int]]:
    """(path, before, candidate, after, is a secret), generated; the default training set."""
    r = random.Random(seed)
    hexes, lower, both = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    some = lambda alphabet, n: "".join(r.choice(alphabet) for _ in range(n))
    word = lambda: r.choice(DICTIONARY[:-8])
    prose = lambda: " ".join(some("aeiourstnl", r.randint(2, 8)) for _ in range(4)) + " "

    def secret() -> str:
        s = r.choice([
            lambda: some(hexes, r.choice([32, 40, 40, 48, 64])), lambda: some(hexes.upper(), r.choice([32, 40])), lambda: "AKIA" + some("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16),
            lambda: "ghp_" + some(both, 36), lambda: "sk-" + some(both, 32), lambda: some(both + "+/", 39) + "=", lambda: some(both, r.randint(20, 44)), lambda: "glpat-" + some(both, 20),
        ])()
        return s if any(x.isdigit() for x in s) else s[:-1] + "7"

    def harmless() -> tuple[str, str]:
        return r.choice([
            lambda: ("commit ", some(hexes, 40)), lambda: (r.choice(["sha256: ", "checksum=", "md5 ", "etag: \""]), some(hexes, r.choice([32, 64]))),
            lambda: (r.choice(["uuid ", "id = ", ""]), "-".join(some(hexes, k) for k in (8, 4, 4, 4, 12))), lambda: ("", "-".join(word() for _ in range(r.randint(2, 5))) + "-" + str(r.randint(1, 99))),
            lambda: (r.choice(["key = \"", "token: ", "api_key="]), r.choice(["your-api-key-here-1234", "xxxxxxxxxxxx1234", "example-token-1234", "test_secret_key_1234567", "changeme-password-123"])),
            lambda: ("", word() + word().title() + word().title() + str(r.randint(1, 9))), lambda: (r.choice(["card ", "order ", ""]), some("0123456789", r.randint(12, 19))),
            lambda: ("", f"20{some('012', 2)}-0{r.randint(1, 9)}-{r.randint(10, 28)}-{word()}"), lambda: ("", f"IMG_20{some('012', 2)}0{r.randint(1, 9)}{r.randint(10, 28)}_{some('0123456789', 6)}"),
            lambda: ("", some("aeiourstnlthdm", r.randint(11, 18)) + str(r.randint(1, 9))), lambda: ("/", f"{word()}/{word()}/{word()}{r.randint(1, 50)}/{word()}"),
            lambda: ("", "=" * r.randint(11, 30) + str(r.randint(1, 9))), lambda: ("version ", f"{word()}-{r.randint(1, 9)}-{r.randint(1, 9)}-{word()}"),
        ])()

    out = []
    for _ in range(count):
        path = r.choice(["src/app.py", "web/page.html", "src3", "notes", "tests/fixture.py", "docs/readme"])
        if r.random() < 0.5:
            lead, quote = r.choice([("token = ", '"'), ("api_key: ", "'"), ("Authorization: Bearer ", ""), ("secret=", ""), ("AWS_ACCESS_KEY=", ""), ("password = ", '"'), ("TOKEN = ", '"'), ("", "")])
            out.append((path, (prose() + lead + quote)[-NEIGHBOURHOOD:], secret(), quote + " " + prose(), int("test" not in path or r.random() < 0.8)))
        else:
            lead, c = harmless()
            out.append((path, (prose() + lead)[-NEIGHBOURHOOD:], c, " " + prose(), 0))
    return out


Tree = tuple  # (p,) or (feature, threshold, low, high)


def grow_forest(x: np.ndarray, y: np.ndarray, trees: int = 12, depth: int = 5, seed: int = 3) -> list[Tree]:
    """Bootstrap trees on random feature subsets, split by Gini impurity."""
    rng = np.random.default_rng(seed)
    tries = max(2, int(np.sqrt(x.shape[1])) + 1)

    def grow(rows: np.ndarray, left: int) -> Tree:
        p = float(y[rows].mean())
        if left == 0 or len(rows) < 8 or p in (0.0, 1.0):
            return (round(p, 6),)
        best = (p * (1 - p) * len(rows) - 1e-9, None)
        for k in rng.permutation(x.shape[1])[:tries]:
            order = np.argsort(x[rows, k], kind="stable")
            v, t = x[rows[order], k], np.cumsum(y[rows[order]])
            cut = np.flatnonzero(v[1:] > v[:-1])
            if not len(cut):
                continue
            n = cut + 1
            a, b = t[cut] / n, (t[-1] - t[cut]) / (len(rows) - n)
            cost = n * a * (1 - a) + (len(rows) - n) * b * (1 - b)
            j = int(np.argmin(cost))
            if cost[j] < best[0]:
                best = (cost[j], (int(k), float((v[cut[j]] + v[cut[j] + 1]) / 2)))
        if best[1] is None:
            return (round(p, 6),)
        k, t = best[1]
        low = x[rows, k] <= t
        return (k, t, grow(rows[low], left - 1), grow(rows[~low], left - 1))

    return [grow(rng.integers(0, len(y), len(y)), depth) for _ in range(trees)]


def compile_forest(forest: list[Tree]) -> Column:
    """Mean of the trees' probabilities as a column over FEATURES."""

    def sql(t: Tree) -> str:
        return f"{t[0]}D" if len(t) == 1 else f"CASE WHEN {FEATURES[t[0]]} <= {t[1]!r}D THEN {sql(t[2])} ELSE {sql(t[3])} END"

    return F.expr("(" + " + ".join(sql(t) for t in forest) + f") / {float(len(forest))}D")


def train(spark: SparkSession, findings: list[tuple[str, str, str, str, int]] | None = None) -> list[Tree]:
    """A forest for labelled findings; their features come from the same expressions as at scan time."""
    rows = [dict(zip(("path", "before", "candidate", "after", "secret"), x, strict=True)) for x in (findings or labelled_findings())]
    table = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), "array<struct<path: string, before: string, candidate: string, after: string, secret: int>>")).alias("r")).select("r.*")
    got = with_features(table).select(*FEATURES, "secret").collect()  # the labelled findings
    m = np.array([[float(v) for v in r] for r in got])
    return grow_forest(m[:, :-1], m[:, -1])


def scan(docs: DataFrame, path_col: str | None = "source", findings: list[tuple[str, str, str, str, int]] | None = None, threshold: float = 0.5) -> DataFrame:
    """doc_id, start, end, candidate, probability, secret for every candidate."""
    forest = train(docs.sparkSession, findings)
    scored = with_features(candidates(docs, path_col)).withColumn("probability", F.round(compile_forest(forest), 6))
    return scored.select("doc_id", "start", "end", "candidate", "probability", (F.col("probability") >= threshold).alias("secret"))


def op7(spark, sf_dir: str) -> DataFrame:
    from lexatlas.runtime import table

    return scan(table(spark, sf_dir, "documents"))
