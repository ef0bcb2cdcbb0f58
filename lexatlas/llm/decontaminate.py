"""Benchmark decontamination: a BM25 index of test items, searched with block-max WAND bounds.

Every window of a training document is a query against the inverted index of
test items (``2 L`` words every ``L`` words, L the longest item, so no item
falls between windows). An item's score is its share of its own BM25 weight
that the window holds. Windows whose terms cannot add up to the threshold are
skipped, and so are those without a block of items whose maxima can; the others
are searched by block-max WAND, which scores an item in full only where a pivot's
bounds and its block's maxima reach the threshold. Items above the threshold are verified:
the window must hold enough of the item's question and of its answer.

The items are read in shards of bounded size, each held by every task; the
documents are scanned once for each shard and never shuffled. Document counts
of words, mean length and window size are those of all items, so results do not
depend on the shards.

Words are lower-cased (A-Z) runs of letters, digits and bytes above 127, so
glued punctuation does not hide a copy. The answer is the last sentence of an
item that has words, the question what stands before; an item with words in one
sentence only is both.

Defined results: null and empty texts match nothing, neither do items without
words; rows that repeat a doc_id are searched one by one; items that repeat an
item_id count once for each document, with their best values; empty tables give
an empty result; further columns are ignored (``drop_contaminated`` keeps them).
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexatlas.llm import textkernel as tk
from lexatlas.runtime import lean, materialize, ship_package

K1, B = 1.2, 0.75
MIN_SCORE = 0.6
MIN_OVERLAP = 0.8
WIDTH = 5
#: Items of one index shard.
SHARD_ITEMS = 20_000
BLOCK_ITEMS = 4
#: Sums of block maxima held at a time.
CELLS = 1 << 21
#: Posting lists that a worker keeps as Python lists.
MAX_OPENED = 20_000

_INSIDE = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
#: Lower-cases, and turns every byte outside words into a space.
_FOLD = np.where(_INSIDE, tk.LOWER, 32).astype(np.uint8)
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=\S)")


def folded_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return tk.word_hashes(data, offsets, _FOLD)


def _text_words(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return folded_words(raw, np.array([0, len(raw)]))[0]


def _runs(h: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``width`` words (of all words where there are fewer)."""
    width = min(width, len(h))
    if not width:
        return np.zeros(0, np.uint64)
    acc = np.zeros(len(h) - width + 1, np.uint64)
    for k in range(width):
        acc = acc * tk.U64(0x9E3779B97F4A7C15) + h[k : len(h) - width + 1 + k]
    return np.unique(tk.mix(acc + tk.U64(width)))


def _has_words(text: str) -> bool:
    return bool(_INSIDE[np.frombuffer(text.encode(), np.uint8)].any())


def question_answer(text: str) -> tuple[str, str]:
    parts = [p for p in _SENTENCE.split(text.strip()) if _has_words(p)]
    at = text.rindex(parts[-1]) if len(parts) > 1 else 0
    return (text[:at], text[at:]) if at else (text, text)


@dataclass
class Statistics:
    """Of all items, with the document counts of one shard's words."""

    number: int
    mean: float  # words of an item
    span: int  # words of the longest item
    vocabulary: np.ndarray  # sorted term hashes
    df: np.ndarray


@dataclass
class Postings:
    items: list[int]
    impact: list[float]
    maxima: dict[int, float]  # greatest impact by block
    bound: float


@dataclass
class Index:
    ids: list
    vocabulary: np.ndarray  # sorted term hashes
    bound: np.ndarray  # a term's greatest impact on any item
    first: np.ndarray  # postings of term t: first[t]:first[t+1], by item
    items: np.ndarray
    impact: np.ndarray
    block_first: np.ndarray  # block maxima of term t, likewise
    blocks: np.ndarray
    block_max: np.ndarray
    span: int  # words of the longest item
    checks: list[tuple[tuple[int, np.ndarray], tuple[int, np.ndarray]]]
    opened: dict[int, Postings] = field(default_factory=dict)  # lists in use, per worker

    def postings(self, t: int) -> Postings:
        if t not in self.opened:
            if len(self.opened) > MAX_OPENED:
                self.opened.clear()
            a, b, c, e = self.first[t], self.first[t + 1], self.block_first[t], self.block_first[t + 1]
            self.opened[t] = Postings(self.items[a:b].tolist(), self.impact[a:b].tolist(), dict(zip(self.blocks[c:e].tolist(), self.block_max[c:e].tolist(), strict=True)), float(self.bound[t]))
        return self.opened[t]


def build_index(ids: list, texts: list[str | None], k1: float = K1, b: float = B, whole: Statistics | None = None) -> Index:
    """Index of some items; ``whole``: statistics of all items where these are only a part of them."""
    words = [_text_words(t or "") for t in texts]
    n = len(words)
    number, mean, span = (whole.number, whole.mean, whole.span) if whole else (n, sum(map(len, words)) / max(n, 1), max([1, *map(len, words)]))
    mean = max(1.0, mean)
    terms = [np.unique(w, return_counts=True) for w in words]
    vocabulary = np.unique(np.concatenate([t for t, _ in terms] or [np.zeros(0, np.uint64)]))
    df = np.zeros(len(vocabulary))
    at = [np.searchsorted(vocabulary, t) for t, _ in terms]
    for a in at:
        df[a] += 1
    if whole:
        df = whole.df[np.searchsorted(whole.vocabulary, vocabulary)].astype(float)
    idf = np.log(1 + (number - df + 0.5) / (df + 0.5))
    t_all, i_all, w_all = [], [], []
    for i, (a, (_, tf)) in enumerate(zip(at, terms, strict=True)):
        w = idf[a] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(words[i]) / mean))
        if len(a):
            t_all.append(a)
            i_all.append(np.full(len(a), i))
            w_all.append(w / w.sum())
    cat = lambda xs, kind: np.concatenate(xs) if xs else np.zeros(0, kind)
    t, i, w = cat(t_all, np.int64), cat(i_all, np.int64), cat(w_all, float)
    order = np.lexsort((i, t))
    t, i, w = t[order], i[order], w[order]
    edges = lambda x: np.concatenate(([0], np.cumsum(np.bincount(x, minlength=len(vocabulary)))))
    bound = np.zeros(len(vocabulary))
    np.maximum.at(bound, t, w)
    key = t * (n // BLOCK_ITEMS + 1) + i // BLOCK_ITEMS
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    checks = []
    for text in texts:
        q, a = (_text_words(x) for x in question_answer(text or ""))
        checks.append(((min(WIDTH, len(q)), _runs(q, WIDTH)), (min(WIDTH, len(a)), _runs(a, WIDTH))))
    return Index(ids, vocabulary, bound, edges(t), i, w, edges(t[starts]), i[starts] // BLOCK_ITEMS, np.maximum.reduceat(w, starts) if len(starts) else w, span, checks)


def _expand(first: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index into t, position) for every entry of the lists of the terms t."""
    size = first[t + 1] - first[t]
    owner = np.repeat(np.arange(len(t)), size)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first[t], size)


def wand(index: Index, terms: list[int], minimum: float) -> list[tuple[int, float]]:
    """(item, score) of all items whose score for the distinct ``terms`` is at least ``minimum``, by block-max WAND.

    Cursors stand on the terms' posting lists in the order of their items. The
    pivot is the first item that the bounds of the lists up to it can lift to the
    minimum; if the maxima of its block cannot, the cursors leave the block.
    """
    least = minimum - 1e-9
    cursors = [[p, 0] for p in map(index.postings, terms) if p.items]
    found = []
    while cursors:
        order = sorted(cursors, key=lambda c: c[0].items[c[1]])
        upper, pivot = 0.0, -1
        for n, (p, _) in enumerate(order):
            upper += p.bound
            if upper >= least:
                pivot = n
                break
        if pivot < 0:
            break
        item = order[pivot][0].items[order[pivot][1]]
        while pivot + 1 < len(order) and order[pivot + 1][0].items[order[pivot + 1][1]] == item:
            pivot += 1
        block = item // BLOCK_ITEMS
        if sum(p.maxima.get(block, 0.0) for p, _ in order[: pivot + 1]) < least:
            to = (block + 1) * BLOCK_ITEMS
            if pivot + 1 < len(order):
                to = min(to, order[pivot + 1][0].items[order[pivot + 1][1]])
        elif order[0][0].items[order[0][1]] == item:
            score = sum(p.impact[at] for p, at in order[: pivot + 1])
            if score >= least:
                found.append((item, score))
            to = item + 1
        else:
            to = item
        for c in order[: pivot + 1]:
            c[1] = bisect_left(c[0].items, to, c[1])
        cursors = [c for c in cursors if c[1] < len(c[0].items)]
    return found


def _hopeful(index: Index, window: np.ndarray, term: np.ndarray, least: float) -> np.ndarray:
    """Whether each of the pairs (window ascending) belongs to a window with a block whose maxima add up to ``least``."""
    blocks = int(index.items.max()) // BLOCK_ITEMS + 1
    edge = np.flatnonzero(np.concatenate(([True], window[1:] != window[:-1], [True])))
    number = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
    size = np.concatenate(([0], np.cumsum(index.block_first[term + 1] - index.block_first[term])))[edge]  # entries before each window
    out = np.zeros(len(window), bool)
    lo = 0
    while lo < len(edge) - 1:  # as many windows as fit in CELLS sums and entries
        hi = min(lo + max(1, CELLS // blocks), len(edge) - 1)
        hi = max(lo + 1, min(hi, int(np.searchsorted(size, size[lo] + CELLS, "right")) - 1))
        own = slice(edge[lo], edge[hi])
        owner, at = _expand(index.block_first, term[own])
        cells = (number[own][owner] - lo) * blocks + index.blocks[at]
        upper = np.bincount(cells, index.block_max[at], (hi - lo) * blocks).reshape(hi - lo, blocks)
        out[own] = (upper.max(1) >= least)[number[own] - lo]
        lo = hi
    return out


def candidates(index: Index, window: np.ndarray, term: np.ndarray, minimum: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, item, score) of all pairs with a score of at least ``minimum``.

    ``window``, ``term``: distinct pairs, in any order. Block maxima are added up for
    many windows at once; those without a block that reaches the minimum are done, ``wand`` searches the others.
    """
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    if not len(window):
        return none
    order = np.lexsort((term, window))
    window, term = window[order], term[order]
    hot = _hopeful(index, window, term, minimum - 1e-9)
    window, term = window[hot], term[hot]
    edges = np.flatnonzero(np.concatenate(([True], window[1:] != window[:-1], [True]))) if len(window) else np.zeros(1, np.int64)
    found = [(int(window[a]), i, s) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True) for i, s in wand(index, term[a:b].tolist(), minimum)]
    if not found:
        return none
    w, i, s = zip(*found, strict=True)
    return np.array(w), np.array(i), np.array(s)


def _overlap(check: tuple[int, np.ndarray], h: np.ndarray) -> float:
    width, runs = check
    if not len(runs) or len(h) < width:
        return 0.0
    return float(np.isin(runs, _runs(h, width)).mean())


def hits(index: Index, data: np.ndarray, offsets: np.ndarray, minimum: float = MIN_SCORE, overlap: float = MIN_OVERLAP) -> dict[tuple[int, int], tuple[float, float, float]]:
    """{(row, item): (score, question overlap, answer overlap)} of verified items, the best window's values."""
    if not len(index.vocabulary):
        return {}
    h, row = folded_words(data, offsets)
    if not len(h):
        return {}
    count = np.bincount(row, minlength=len(offsets) - 1)
    first = np.cumsum(count) - count
    span = index.span
    halves = -(-count // span)  # stretches of span words; a window is a stretch and the one after it
    half_first = np.cumsum(halves) - halves
    half = half_first[row] + (np.arange(len(h)) - first[row]) // span
    at = np.minimum(np.searchsorted(index.vocabulary, h), len(index.vocabulary) - 1)
    known = index.vocabulary[at] == h
    v = len(index.vocabulary)
    pairs = np.unique(half[known] * v + at[known])
    p_half, p_term = pairs // v, pairs % v
    total = int(halves.sum())
    half_row = np.repeat(np.arange(len(halves)), halves)
    has_next = np.zeros(total, bool)
    has_next[:-1] = half_row[1:] == half_row[:-1]
    mass = np.bincount(p_half, weights=index.bound[p_term], minlength=total + 1)
    bound = mass[:total] + np.where(has_next, mass[1 : total + 1], 0)
    live = bound >= minimum - 1e-9
    if not live.any():
        return {}
    own = live[p_half]
    after = (p_half > 0) & np.where(p_half > 0, live[p_half - 1] & has_next[p_half - 1], False)
    wt = np.unique(np.concatenate((p_half[own] * v + p_term[own], (p_half[after] - 1) * v + p_term[after])))
    out: dict[tuple[int, int], tuple[float, float, float]] = {}
    for w, i, s in zip(*candidates(index, wt // v, wt % v, minimum), strict=True):
        r = int(half_row[w])
        lo = first[r] + (w - half_first[r]) * span
        h_window = h[lo : min(lo + 2 * span, first[r] + count[r])]
        q, a = (_overlap(c, h_window) for c in index.checks[i])
        if q >= overlap and a >= overlap:
            out[r, int(i)] = max(out.get((r, int(i)), (0.0, 0.0, 0.0)), (round(float(s), 6), round(q, 6), round(a, 6)))
    return out


def _terms(items: DataFrame) -> DataFrame:
    """(term, n): the distinct words of every item with n = 1, and a row without a term with its number of words."""
    ship_package(items.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = _text_words(text or "")
                terms = np.unique(words).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([*terms.tolist(), None], pa.int64()), pa.array([*[1] * len(terms), len(words)], pa.int64())], names=["term", "n"])

    return items.select("text").mapInArrow(lean(run), "term long, n long")


def shards(items: DataFrame, size: int = SHARD_ITEMS) -> Iterator[Index]:
    """Indexes of at most about ``size`` items each, with the statistics of all items."""
    n = items.count()
    parts = max(1, -(-n // size))
    counts = materialize(_terms(items).groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("total"), F.max("n").alias("most")), "item-terms") if parts > 1 else None
    lengths = counts.where("term is null").first() if parts > 1 else None
    for k in range(parts):
        shard = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)
        rows = shard.select("item_id", "text").orderBy("item_id", "text").toPandas()
        whole = None
        if parts > 1:
            own = counts.join(_terms(shard).where("term is not null").select("term").distinct(), "term").select("term", "df").toPandas()  # the shard's words
            hashes = own["term"].to_numpy(np.int64).view(np.uint64)
            order = np.argsort(hashes)
            whole = Statistics(n, lengths.total / n, max(1, lengths.most), hashes[order], own["df"].to_numpy(np.int64)[order])
        yield build_index(rows["item_id"].tolist(), rows["text"].tolist(), whole=whole)


def find(docs: DataFrame, items: DataFrame, minimum: float = MIN_SCORE, overlap: float = MIN_OVERLAP, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap of every verified copy of an item in a document."""
    ship_package(docs.sparkSession)
    doc_kind, item_kind = (df.schema[c].dataType.simpleString() for df, c in ((docs, "doc_id"), (items, "item_id")))
    found = None
    for index in shards(items, shard_items):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                offsets, data = tk.flat(batch.column(1))
                for lo, hi in tk.pieces(offsets):
                    a, b = offsets[lo], offsets[hi]
                    got = hits(index, data[a:b], offsets[lo : hi + 1] - a, minimum, overlap)
                    if got:
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).take(pa.array([lo + r for r, _ in got])), pa.array([index.ids[i] for _, i in got]), *(pa.array([v[k] for v in got.values()]) for k in range(3))],
                            names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"],
                        )

        part = docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {doc_kind}, item_id {item_kind}, score double, question_overlap double, answer_overlap double")
        found = part if found is None else found.unionByName(part)
    return found.groupBy("doc_id", "item_id").agg(*(F.max(c).alias(c) for c in ("score", "question_overlap", "answer_overlap")))


def drop_contaminated(docs: DataFrame, items: DataFrame, minimum: float = MIN_SCORE, overlap: float = MIN_OVERLAP, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """The rows of ``docs`` that hold no verified copy of an item, columns unchanged; no shuffle."""
    ship_package(docs.sparkSession)
    names, at = docs.columns, docs.columns.index("text")
    kinds = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))
    out = docs.toDF(*(f"c{i}" for i in range(len(names))))
    for index in shards(items, shard_items):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                offsets, data = tk.flat(batch.column(at))
                keep = np.ones(len(offsets) - 1, bool)
                for lo, hi in tk.pieces(offsets):
                    a, b = offsets[lo], offsets[hi]
                    keep[[lo + r for r, _ in hits(index, data[a:b], offsets[lo : hi + 1] - a, minimum, overlap)]] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(lean(run), kinds)
    return out.toDF(*names)


def op3(spark, sf_dir: str) -> DataFrame:
    from lexatlas.runtime import table

    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
