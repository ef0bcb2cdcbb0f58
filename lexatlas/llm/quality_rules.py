"""Quality classifier: a sparse rule ensemble compiled into Spark column expressions.

Text statistics come from a vectorised Arrow stage over whole texts. Shallow
boosted trees on a bounded labelled sample give paths; each path is one
conjunctive rule over the statistics; a lasso-penalised logistic regression
keeps few of them; the kept rules are ``CASE WHEN`` columns summed under a
sigmoid, so scoring is one JVM projection without a shuffle.

Defined results: a null or empty text has all statistics 0 and gets the score
of those; rows with repeated or null doc_id are scored one by one; an empty
table gives an empty result; other columns of the input are kept apart and
never read (labels, lang, source and doc_id are no inputs of a score).
Without any usable label every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexatlas.llm import textkernel as tk
from lexatlas.runtime import lean, ship_package

#: Bound of the labelled sample that the model is fitted on.
MAX_LABELLED = 12_000

STATS = (
    "chars", "n_words", "word_len", "long_words", "short_words", "upper", "digits", "symbols", "marks",
    "non_ascii", "sentence_ends", "capitalised", "symbol_ended", "upper_words", "lines", "line_words",
    "repeated_lines", "repeated_words", "repeated_shingles", "bars",
)

_C = np.arange(256)
_UPPER = ((_C >= 65) & (_C <= 90)).astype(np.int64)
_ALPHA = (((_C | 32) >= 97) & ((_C | 32) <= 122) & (_C < 128)) | (_C >= 128)
_CLASSES = {
    "upper": _UPPER,
    "digits": ((_C >= 48) & (_C <= 57)).astype(np.int64),
    "symbols": np.isin(_C, [ord(x) for x in "#$%&*|<>{}[]@^~=_+\\/"]).astype(np.int64),
    "marks": np.isin(_C, [ord(x) for x in "!?"]).astype(np.int64),
    "non_ascii": (_C >= 128).astype(np.int64),
    "sentence_ends": (_C == ord(".")).astype(np.int64),
    "bars": (_C == ord("|")).astype(np.int64),
}


def _repeats(keys: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Share of each row's keys that repeat an earlier one of the row."""
    total = np.bincount(row, minlength=rows)
    packed = (row.astype(np.uint64) << tk.U64(40)) | (keys >> tk.U64(24))
    packed.sort()
    new = np.ones(len(packed), bool)
    new[1:] = packed[1:] != packed[:-1]
    distinct = np.bincount((packed[new] >> tk.U64(40)).astype(np.int64), minlength=rows)
    return (total - distinct) / np.maximum(total, 1)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """rows x len(STATS) floats."""
    rows = len(offsets) - 1
    size = np.diff(offsets)
    per = np.maximum(size, 1)
    out = {"chars": size.astype(float)}
    for name, table in _CLASSES.items():
        out[name] = tk.row_sums(table[data], offsets) / per
    start, end, row = tk.words(data, offsets)
    length = end - start
    n = np.bincount(row, minlength=rows)
    some = np.maximum(n, 1)
    tally = lambda mask: np.bincount(row, weights=mask, minlength=rows) / some
    out["n_words"] = n.astype(float)
    out["word_len"] = tally(length)
    out["long_words"], out["short_words"] = tally(length > 14), tally(length < 4)
    if len(start):
        uppers = np.concatenate(([0], np.cumsum(_UPPER[data])))
        alphas = np.concatenate(([0], np.cumsum(_ALPHA[data].astype(np.int64))))
        out["capitalised"] = tally(_UPPER[data[start]])
        out["symbol_ended"] = tally(_CLASSES["symbols"][data[end - 1]] + _CLASSES["marks"][data[end - 1]])
        out["upper_words"] = tally((uppers[end] - uppers[start]) * 2 > np.maximum(alphas[end] - alphas[start], 1))
    else:
        for k in ("capitalised", "symbol_ended", "upper_words"):
            out[k] = np.zeros(rows)
    breaks = np.flatnonzero(data == 10)
    edges = np.unique(np.concatenate((offsets[:-1][size > 0], breaks + 1)))
    edges = edges[edges < len(data)]
    line_row = np.searchsorted(offsets, edges, "right") - 1
    stop = np.concatenate((edges[1:], [len(data)])).astype(np.int64) if len(edges) else edges
    lines = np.bincount(line_row, minlength=rows)
    out["lines"] = lines.astype(float)
    out["line_words"] = n / np.maximum(lines, 1)
    prefix = tk.rolling(data)
    if len(edges):
        tail = (stop > edges) & (data[np.maximum(stop - 1, 0)] == 10)
        out["repeated_lines"] = _repeats(tk.span_hash(prefix, edges, stop - tail), line_row, rows)
    else:
        out["repeated_lines"] = np.zeros(rows)
    h, r = tk.word_hashes(data, offsets)
    out["repeated_words"] = _repeats(h, r, rows)
    h, r = tk.shingles(data, offsets)
    out["repeated_shingles"] = _repeats(h, r, rows)
    return np.column_stack([out[k] for k in STATS]).round(9)


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, one double per statistic) for every row of ``docs``."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = tk.flat(batch.column(1))
            for lo, hi in tk.pieces(offsets):
                a, b = offsets[lo], offsets[hi]
                x = statistics(data[a:b], offsets[lo : hi + 1] - a)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(pa.array(c) for c in x.T)], names=[id_col, *STATS])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(lean(run), f"`{id_col}` {kind}, " + ", ".join(f"{s} double" for s in STATS))


Path = tuple[tuple[int, bool, float], ...]  # (statistic, is above, threshold)


def tree_paths(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, bins: int = 48, rate: float = 0.3) -> list[Path]:
    """Boost shallow regression trees on the logistic gradient; every node's path is a rule."""
    cuts = []
    for column in x.T:
        q = np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1], method="lower"))
        values = np.unique(column)
        above = values[np.minimum(np.searchsorted(values, q, "right"), len(values) - 1)]
        cuts.append(np.unique(((q + above) / 2)[above > q]))
    binned = np.column_stack([np.searchsorted(c, column, "left") for c, column in zip(cuts, x.T, strict=True)])
    found: dict[Path, None] = {}
    f = np.zeros(len(y))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        todo: list[tuple[np.ndarray, Path]] = [(np.arange(len(y)), ())]
        while todo:
            rows, path = todo.pop()
            best = (1e-6, None)
            if len(path) < depth and len(rows) >= 20:
                base = g[rows].sum() ** 2 / (h[rows].sum() + 1)
                for k, c in enumerate(cuts):
                    if not len(c):
                        continue
                    b = binned[rows, k]
                    sg = np.cumsum(np.bincount(b, weights=g[rows], minlength=len(c) + 1))
                    sh = np.cumsum(np.bincount(b, weights=h[rows], minlength=len(c) + 1))
                    count = np.cumsum(np.bincount(b, minlength=len(c) + 1))
                    gain = sg[:-1] ** 2 / (sh[:-1] + 1) + (sg[-1] - sg[:-1]) ** 2 / (sh[-1] - sh[:-1] + 1) - base
                    gain[(count[:-1] < 8) | (count[-1] - count[:-1] < 8)] = -1
                    j = int(np.argmax(gain))
                    if gain[j] > best[0] + 1e-9:
                        best = (gain[j], (k, j))
            if best[1] is None:
                f[rows] += rate * g[rows].sum() / (h[rows].sum() + 1)
                continue
            k, j = best[1]
            low = binned[rows, k] <= j
            for side, above in ((rows[low], False), (rows[~low], True)):
                step = (*path, (k, above, float(cuts[k][j])))
                found[tuple(sorted(step))] = None
                todo.append((side, step))
    return list(found)


def rule_matrix(x: np.ndarray, paths: list[Path]) -> np.ndarray:
    out = np.ones((len(x), len(paths)))
    for i, path in enumerate(paths):
        for k, above, t in path:
            out[:, i] *= (x[:, k] > t) == above
    return out


def lasso_logistic(r: np.ndarray, y: np.ndarray, penalty: float = 0.002, steps: int = 400) -> tuple[float, np.ndarray]:
    """FISTA on mean logistic loss + penalty * |w|_1; the intercept is free."""
    m = np.column_stack([np.ones(len(r)), r])
    lip = np.linalg.norm(m, 2) ** 2 / (4 * len(y)) + 1e-9
    w = z = np.zeros(m.shape[1])
    t = 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(m @ z, -40, 40)))
        new = z - (m.T @ (p - y)) / len(y) / lip
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - penalty / lip, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / t2 * (new - w)
        w, t = new, t2
    return float(w[0]), w[1:]


def fit(x: np.ndarray, y: np.ndarray) -> tuple[float, list[tuple[float, Path]]]:
    """(intercept, [(weight, path)]) with only non-zero rules."""
    if len(y) == 0:
        return 0.0, []
    paths = tree_paths(x, y)
    if not paths or y.min() == y.max():
        p = min(max(float(y.mean()), 0.01), 0.99)
        return float(np.log(p / (1 - p))), []
    r = rule_matrix(x, paths)
    _, first = np.unique(r, axis=1, return_index=True)  # rules that fire alike count once
    first.sort()
    paths, r = [paths[i] for i in first], r[:, first]
    b, w = lasso_logistic(r, y)
    return b, [(float(v), path) for v, path in zip(w, paths, strict=True) if abs(v) > 1e-6]


def compile_rules(model: tuple[float, list[tuple[float, Path]]]) -> Column:
    """The ensemble as one Spark column over STATS."""
    b, rules = model
    total = F.lit(b)
    for w, path in rules:
        tests = [F.col(STATS[k]) > t if above else F.col(STATS[k]) <= t for k, above, t in path]
        total = total + F.when(reduce(lambda p, q: p & q, tests), F.lit(w)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def held_out(id_col: str = "doc_id") -> Column:
    """True where the row's label may not be learned."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> tuple[float, list[tuple[float, Path]]]:
    """Fit on at most ``max_labelled`` labelled training rows, chosen by a hash of their id."""
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", F.col("quality").cast("int").alias("quality"))
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_labelled)
    picked = F.broadcast(sample.groupBy("doc_id").agg(F.max("quality").alias("label")))  # at most max_labelled rows
    chosen = docs.select("doc_id", "text").join(picked.select("doc_id"), "doc_id", "left_semi")
    found = with_statistics(chosen).join(picked, "doc_id").orderBy("doc_id", *STATS).limit(2 * max_labelled).toPandas()
    return fit(found[list(STATS)].to_numpy(float), found["label"].to_numpy(float))


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    model = train(docs, labels, max_labelled)
    scored = with_statistics(docs).withColumn("score", compile_rules(model))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, columns unchanged.

    The score is computed beside each row in one Arrow pass; no join, no shuffle.
    """
    ship_package(docs.sparkSession)
    model = train(docs, labels, max_labelled)
    names = docs.columns
    fields = [f"__s_{s}" for s in STATS]
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = tk.flat(batch.column(at))
            for lo, hi in tk.pieces(offsets):
                a, b = offsets[lo], offsets[hi]
                x = statistics(data[a:b], offsets[lo : hi + 1] - a)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(c) for c in x.T)], names=[*(f"c{i}" for i in range(len(names))), *fields])

    kinds = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))
    beside = docs.mapInArrow(lean(run), kinds + ", " + ", ".join(f"{f} double" for f in fields))
    named = beside.toDF(*(f"c{i}" for i in range(len(names))), *STATS)
    kept = named.where(compile_rules(model) >= threshold)
    return kept.select(*(F.col(f"c{i}").alias(n) for i, n in enumerate(names)))


def op10(spark, sf_dir: str) -> DataFrame:
    from lexatlas.runtime import table

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
