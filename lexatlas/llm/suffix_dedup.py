"""Removal of repeated byte strings by suffix sorting around content-chosen anchors.

Every string of ``length`` bytes holds exactly one anchor, the position in it
whose k-gram hash is least (the first of equals), so equal strings have equal
anchors at equal offsets. Anchors whose hash occurs once cannot be in a
repeat and go at once. For each of the others the bytes around it are brought
together by hash: the suffixes to its right, and the reversed prefixes to its
left, are put in suffix order with their common prefix lengths by deep-shallow
sorting (multikey quicksort on 8-byte characters to a shallow depth, all open runs
at once, then blind tries for the groups that stay equal). Two occurrences share the string at
offset o exactly when their common left part reaches o and their common right
part reaches length - o; in suffix order that is a numbering of runs, so the
earliest occurrence of every string is found offset by offset.

Documents whose whole text an earlier one has are known from text hashes and
take no part further. A task first settles what it can among its own documents and passes on only
strings it has not seen, so a passage in a third of all rows costs one row per
batch. Anchors in more than HOT places, and those that a sample of the documents
shows to be frequent, are dealt by the bytes that all strings of a few offsets
have in common, so no group grows with the table.

Defined results: a null text is empty; strings shorter than ``length`` are never
removed; of rows that share a doc_id the order is that of a text hash, and
rows equal in doc_id and text are one document (each gets its result); a null
doc_id counts as later than all others; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexatlas.llm import textkernel as tk
from lexatlas.llm.uneven import join_uneven
from lexatlas.runtime import discard, lean, materialize, ship_package

LENGTH = 100
GRAM = 24
#: k-gram positions of one string.
WINDOW = LENGTH - GRAM + 1
SHALLOW = 24
HOT = 4096
#: One of so many documents is looked at for hashes in many places; they are at most MAX_HOT, seen at least OFTEN, in SALTS parts.
SAMPLE, MAX_HOT, OFTEN, SALTS = 64, 20_000, 16, 256
#: Offsets that a hot anchor's strings share a partition by.
STRIDE = 12
#: Occurrences sorted at a time.
HOLD = 20_000
#: Rows of an Arrow batch that are Python objects at a time.
SLICE = 500
#: Names of documents (8 bytes each) that may travel to every task; more of them are joined by a shuffle.
MAX_BROADCAST = 1_000_000
_LAST = np.iinfo(np.int64).max


# ------------------------------------------------------------ deep-shallow sorting


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
    return n - (x.bit_length() + 7) // 8


class BlindTrie:
    """Inner nodes keep a depth and branch bytes only; a string is compared once per insertion."""

    def __init__(self, strings: list[bytes]) -> None:
        self.strings = strings
        self.root: list | int = 0  # a leaf is an index into strings, a node [depth, {byte: child}]
        for i in range(1, len(strings)):
            self._insert(i)

    def _at(self, i: int, depth: int) -> int:
        s = self.strings[i]
        return s[depth] if depth < len(s) else -1

    def _insert(self, i: int) -> None:
        node = self.root
        while isinstance(node, list):  # blind descent
            node = node[1].get(self._at(i, node[0])) if self._at(i, node[0]) in node[1] else next(iter(node[1].values()))
        depth = common_prefix(self.strings[i], self.strings[node])
        other = self._at(node, depth)
        parent, byte, node = None, 0, self.root
        while isinstance(node, list) and node[0] < depth:
            parent, byte = node, self._at(i, node[0])
            node = node[1][byte]
        if isinstance(node, list) and node[0] == depth:
            node[1][self._at(i, depth)] = i
            return
        new = [depth, {other: node, self._at(i, depth): i}]
        if parent is None:
            self.root = new
        else:
            parent[1][byte] = new

    def walk(self) -> Iterator[tuple[int, int]]:
        """(string, common prefix with the one before) in order; the first has 0."""
        stack: list[tuple] = [(self.root, 0)]
        while stack:
            node, lcp = stack.pop()
            if not isinstance(node, list):
                yield node, lcp
                continue
            children = [node[1][b] for b in sorted(node[1])]
            stack += [(c, node[0]) for c in reversed(children[1:])]
            stack.append((children[0], lcp))


def multikey_quicksort(words: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, first): rows of ``words`` by group, then word by word; first marks the beginnings of runs of equal rows.

    Every open run is partitioned around the median of three of its rows at once:
    smaller and larger rows stay at their word, equal ones go on to the next.
    """
    n, depth = words.shape
    order = np.argsort(group, kind="stable")
    first = np.concatenate(([True], group[order][1:] != group[order][:-1]))[:n]
    live, word, start = np.arange(n), np.zeros(n, np.int64), first.copy()  # places of open runs, the word they are compared by, their beginnings
    while len(live):
        size = np.diff(np.append(np.flatnonzero(start), len(live)))
        open_ = np.repeat(size > 1, size) & (word < depth)
        live, word, start = live[open_], word[open_], start[open_]
        if not len(live):
            break
        head = np.flatnonzero(start)
        size = np.diff(np.append(head, len(live)))
        key = words[order[live], word]
        pivot = np.repeat(np.sort(np.stack([key[head], key[head + size // 2], key[head + size - 1]]), 0)[1], size)
        part = 2 * (key > pivot) + (key == pivot) + 3 * np.repeat(np.arange(len(head)), size)
        by = np.argsort(part.astype(np.uint16) if 3 * len(head) < 1 << 16 else part, kind="stable")  # 16 bits are sorted by radix
        order[live], part = order[live][by], part[by]
        word += part % 3 == 1
        start = np.concatenate(([True], part[1:] != part[:-1]))
        first[live[start]] = True
    return order, first


def suffix_order(group: np.ndarray, strings: list[bytes], shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): strings sorted within ascending groups; lcp[i] is the common prefix
    of the i-th and the one before it, -1 where a group begins."""
    n = len(strings)
    words = np.frombuffer(b"".join(s[:shallow].ljust(shallow, b"\0") for s in strings), ">u8").reshape(n, shallow // 8).astype(np.uint64)
    order, first = multikey_quicksort(words, group)
    lcp = np.full(n, shallow)
    for w in range(words.shape[1] - 1, -1, -1):
        x = words[order[1:], w] ^ words[order[:-1], w]
        lead = np.zeros(n - 1, np.int64)
        for b in range(8):
            lead += (x >> tk.U64(8 * (7 - b)) == 0) & (lead == b)
        lcp[1:] = np.where(x != 0, 8 * w + lead, lcp[1:])
    lcp[np.concatenate(([True], group[order][1:] != group[order][:-1]))] = -1
    size = np.array([len(s) for s in strings])[order]
    begin = np.flatnonzero(first)
    end = np.append(begin[1:], n)
    for lo, hi in zip(begin[end - begin > 1].tolist(), end[end - begin > 1].tolist(), strict=True):
        alike: dict[bytes, list[int]] = {}
        for i in order[lo:hi].tolist():
            alike.setdefault(strings[i], []).append(i)
        distinct = list(alike)
        at = lo
        for k, depth in [(0, 0)] if len(distinct) == 1 else BlindTrie(distinct).walk():
            for j, i in enumerate(alike[distinct[k]]):
                order[at] = i
                if at > lo:
                    lcp[at] = len(distinct[k]) if j else depth
                at += 1
        size[lo:hi] = [len(strings[i]) for i in order[lo:hi]]
    lcp[1:] = np.minimum(lcp[1:], np.minimum(size[1:], size[:-1]))
    return order, lcp


def later_occurrences(group: np.ndarray, left: list[bytes], right: list[bytes], low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """n x WINDOW booleans: occurrence i's string at offset o is one that an earlier occurrence has.

    Occurrences are in order of precedence. ``left``: the bytes before the
    anchor, reversed; ``right``: from the anchor on; ``low``..``high``: offsets
    of the strings the anchor stands for.
    """
    n = len(left)
    rank = []
    for strings in (left, right):
        order, lcp = suffix_order(group, strings)
        rank.append((order, lcp))
    out = np.zeros((n, WINDOW), bool)
    for o in range(int(low.min(initial=WINDOW)), int(high.max(initial=-1)) + 1):
        live = np.flatnonzero((low <= o) & (o <= high))
        if len(live) < 2:
            continue
        ids = []
        for (order, lcp), need in zip(rank, (o, LENGTH - o), strict=True):
            number = np.empty(n, np.int64)
            number[order] = np.cumsum(lcp < need)
            ids.append(number[live])
        key = ids[0] * (n + 1) + ids[1]
        by = np.argsort(key, kind="stable")
        key = key[by]
        out[live[by[1:]], o] = key[1:] == key[:-1]
    return out


# ------------------------------------------------------------ anchors


def _least(h: np.ndarray) -> np.ndarray:
    """Position of the first least value of every WINDOW consecutive ones."""
    n = len(h) - WINDOW + 1
    value, at, width = h, np.arange(len(h)), 1
    while width < WINDOW:
        step = min(width, WINDOW - width)
        a, b = value[:-step], value[step:]
        right = b < a
        value, at = np.where(right, b, a), np.where(right, at[step:], at[:-step])
        width += step
    return at[:n]


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, position, lowest offset, highest offset) of one text's anchors."""
    prefix = tk.rolling(data)
    start = np.arange(len(data) - GRAM + 1)
    h = tk.span_hash(prefix, start, start + GRAM)
    at = _least(h)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    last = np.append(first[1:], len(at)) - 1
    p = at[first]
    return h[p], p, p - last, p - first


def _hash64(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), signed=True)


def named(docs: DataFrame) -> DataFrame:
    """doc_id, text (null as empty), k (name of the row by id and text), t and u (hashes of the text), n (bytes)."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    return rows.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("k"), F.xxhash64("text").alias("t"), F.hash("text").alias("u"), F.octet_length("text").cast("long").alias("n"))


def later_copies(rows: DataFrame) -> DataFrame:
    """k of the documents of at least LENGTH bytes whose whole text an earlier document has."""
    meta = rows.where(F.col("n") >= LENGTH).select("doc_id", "k", "t", "u", "n")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "k")
    first = meta.groupBy("t", "u", "n").agg(F.min(order).alias("f"), F.min("k").alias("a"), F.max("k").alias("b"), F.count("*").alias("c")).where("a <> b")
    first = materialize(first.select("t", "u", "n", F.col("f.k").alias("first"), "c"), "copied-texts")
    return materialize(join_uneven(meta, first, ["t", "u", "n"], "c").where("k <> first").select("k").distinct(), "copies")


def small(keys: DataFrame) -> DataFrame:
    """``keys`` for a broadcast where their number is bounded; else as they are."""
    return F.broadcast(keys) if keys.count() <= MAX_BROADCAST else keys


def long_anchors(data: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``anchors`` of a text of any length, the strings that begin in ``limit`` bytes at a time (an anchor may come twice, with other offsets)."""
    for lo in range(0, len(data) - LENGTH + 1, limit):
        h, p, low, high = anchors(data[lo : min(lo + limit + LENGTH - 1, len(data))])
        yield h, p + lo, low, high


def anchor_rows(rows: DataFrame, hot: np.ndarray) -> DataFrame:
    """(hash, salt, k, place) of named rows: place packs position, lowest and highest offset.

    ``hot``: sorted hashes known to be in many places; a salt above 0 spreads them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list[tuple]) -> pa.RecordBatch:
            h, k, place = (np.concatenate(x) for x in zip(*held, strict=True))
            salt = np.zeros(len(h), np.int64)
            if len(hot):
                known = hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h
                salt[known] = 1 + k[known] % SALTS
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(salt), pa.array(k), pa.array(place)], names=["hash", "salt", "k", "place"])

        for batch in batches:
            offsets, data = tk.flat(batch.column(1))
            held, n = [], 0
            for r, k in enumerate(batch.column(0).to_pylist()):
                for h, p, low, high in long_anchors(data[offsets[r] : offsets[r + 1]]):
                    held.append((h.view(np.int64), np.full(len(h), k), p << 14 | low << 7 | high))
                    n += len(h)
                    if n > 1 << 17:
                        yield out(held)
                        held, n = [], 0
            if held:
                yield out(held)

    return rows.where(F.col("n") >= LENGTH).select("k", "text").mapInArrow(lean(run), "hash long, salt long, k long, place long")


def hot_hashes(rows: DataFrame) -> np.ndarray:
    """Sorted hashes with a share of 1 / MAX_HOT or more of the anchors of every SAMPLE-th document, and OFTEN of them at least.

    So there are at most MAX_HOT. They only spread work: such anchors are in
    several places, and any that are missed here are counted like all others.
    """
    counts = materialize(anchor_rows(rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0), np.zeros(0, np.int64)).groupBy("hash").agg(F.countDistinct("k", "place").alias("c")), "anchor-sample")
    total = counts.agg(F.sum("c")).first()[0] or 0
    found = counts.where(F.col("c") >= max(OFTEN, -(-total // MAX_HOT))).select("hash").toPandas()  # at most MAX_HOT
    discard(counts)
    return np.sort(found["hash"].to_numpy(np.int64))


def repeated_anchors(rows: DataFrame) -> DataFrame:
    """(k, hash, place, hot) of the anchors whose hash occurs more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((3, 0), np.int64)
        hot_hash = None

        def out(x: np.ndarray, hot: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x[1]), pa.array(x[0]), pa.array(x[2]), pa.array(hot)], names=["k", "hash", "place", "hot"])

        for batch in batches:
            x = np.stack([np.asarray(batch.column(i)) for i in (0, 2, 3)])
            salted = np.asarray(batch.column(1)) > 0
            if salted.any():
                yield out(x[:, salted], np.ones(salted.sum(), bool))
            x = np.concatenate((held, x[:, ~salted]), 1)
            new = np.ones(x.shape[1], bool)
            new[1:] = (x[:, 1:] != x[:, :-1]).any(0)
            x = x[:, new]
            last = int(np.searchsorted(x[0], x[0, -1])) if x.shape[1] else 0
            if x.shape[1] and (x.shape[1] - last > HOT or x[0, -1] == hot_hash):
                hot_hash, last = x[0, -1], x.shape[1]
            whole, held = x[:, :last], x[:, last:]
            if last:
                edge = np.flatnonzero(np.concatenate(([True], whole[0, 1:] != whole[0, :-1], [True])))
                size = np.repeat(np.diff(edge), np.diff(edge))
                hot = (size > HOT) | ((whole[0] == hot_hash) if hot_hash is not None else False)
                keep = (size > 1) | hot
                yield out(whole[:, keep], hot[keep])
        if held.shape[1] > 1 and held[0, 0] == held[0, -1]:
            yield out(held, np.full(held.shape[1], held[0, 0] == hot_hash))
        elif held.shape[1] and held[0, 0] == hot_hash:
            yield out(held, np.ones(held.shape[1], bool))

    return rows.repartition("hash", "salt").sortWithinPartitions("hash", "salt", "k", "place").mapInArrow(lean(run), "k long, hash long, place long, hot boolean")


# ------------------------------------------------------------ settling


class Occurrences:
    """Strings around anchors, settled among themselves.

    A row is (group, doc_id, text hash, k, position, low, high, left, right).
    """

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def settle(self) -> tuple[list[tuple[int, int, int]], list[tuple]]:
        """(spans (k, start, end) that are repeats, rows that stay first so far)."""
        rows = sorted(set(self.rows), key=lambda r: (_LAST if r[1] is None else r[1], r[1] is None, r[2], r[3], r[4], r[5], r[6]))
        self.rows = []
        if not rows:
            return [], []
        group, low, high = (np.array([r[i] for r in rows], np.int64) for i in (0, 5, 6))
        late = later_occurrences(group, [r[7] for r in rows], [r[8] for r in rows], low, high)
        spans, stay = [], []
        offsets = np.arange(WINDOW)
        valid = (offsets >= low[:, None]) & (offsets <= high[:, None])
        for flags, into in ((late & valid, spans), (~late & valid, stay)):
            edge = np.zeros((len(rows), WINDOW + 2), np.int8)
            edge[:, 1:-1] = flags
            turn = np.diff(edge, axis=1)
            r0, a = np.nonzero(turn == 1)
            _, b = np.nonzero(turn == -1)
            for i, lo, hi in zip(r0.tolist(), a.tolist(), (b - 1).tolist(), strict=True):
                r = rows[i]
                if into is spans:
                    spans.append((r[3], r[4] - hi, r[4] - lo + LENGTH))
                else:
                    stay.append((*r[:5], lo, hi, r[7][:hi], r[8][: LENGTH - lo]))
        return spans, stay


_ROW = [("kind", pa.int8()), ("k", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("c", pa.int64()), ("d", pa.int64()), ("e", pa.int64()), ("left", pa.binary()), ("right", pa.binary())]
_ROW_SQL = "kind byte, k long, a long, b long, c long, d long, e long, left binary, right binary"
_TEXT, _SPAN, _OPEN = range(3)


def _batch(key: pa.DataType, rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(cols[0], key), *(pa.array(c, t) for c, (_, t) in zip(cols[1:], _ROW, strict=True))], names=["doc_id", *(n for n, _ in _ROW)])


def _surroundings(doc_id, text: int, k: int, data: bytes, places: list[dict]) -> Iterator[tuple]:
    for x in places:
        p, low, high = x["place"] >> 14, x["place"] >> 7 & 127, x["place"] & 127
        if p - high < 0 or p - low + LENGTH > len(data):
            continue
        if not x["hot"]:
            yield (x["hash"], doc_id, text, k, p, low, high, data[p - high : p][::-1], data[p : p - low + LENGTH])
            continue
        for base in range(low // STRIDE * STRIDE, high + 1, STRIDE):
            a, b = max(low, base), min(high, base + STRIDE - 1)
            core = data[p - base : p - base - STRIDE + 1 + LENGTH]  # in all strings at offsets base .. base + STRIDE - 1
            group = _hash64(core + base.to_bytes(2) + x["hash"].to_bytes(8, signed=True))
            yield (group, doc_id, text, k, p, a, b, data[p - b : p][::-1], data[p : p - a + LENGTH])


def first_pass(rows: DataFrame, lists: DataFrame) -> DataFrame:
    """Settle each task's own documents (doc_id, text, k, t) by their repeated anchors (k, places): rows of kind text, span and open."""
    import zstandard

    kind = rows.schema["doc_id"].dataType.simpleString()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            offsets, data = tk.flat(batch.column(1))
            blobs = [z.compress(data[a:b].tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(blobs, pa.binary())], names=["doc_id", "k", "t", "z"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        held = Occurrences()
        key = None

        def settled() -> list[tuple]:
            spans, stay = held.settle()
            out = [(None, _SPAN, k, a, b, None, None, None, None, None) for k, a, b in by_name(spans)]
            return out + [(r[1], _OPEN, r[3], r[0], r[2], r[4], r[5], r[6], r[7], r[8]) for r in stay]

        for batch in batches:
            key = batch.schema.field(0).type
            out: list[tuple] = []
            for doc_id, k, t, blob, places in _rows(batch):
                data = z.decompress(blob)
                out.append((doc_id, _TEXT, k, None, None, None, None, None, blob, None))
                held.rows += _surroundings(doc_id, t, k, data, places)
                if len(held.rows) >= HOLD:
                    out += settled()
                if len(out) > 2 * HOLD:
                    yield _batch(key, out)
                    out = []
            if out:
                yield _batch(key, out)
        if out := settled():
            yield _batch(key, out)

    texts = rows.select("doc_id", "text", "k", "t").mapInArrow(lean(packed), f"doc_id {kind}, k long, t long, z binary")
    joined = texts.join(lists, "k").select("doc_id", "k", "t", "z", "places")
    return materialize(joined.mapInArrow(lean(run), f"doc_id {kind}, {_ROW_SQL}"), "first-pass")


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    """The batch's rows as tuples, a slice at a time."""
    for lo in range(0, batch.num_rows, SLICE):
        yield from zip(*(c.to_pylist() for c in batch.slice(lo, SLICE).columns), strict=True)


def by_name(spans: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
    """(k, start, end) with each document's spans merged."""
    own: dict[int, list[tuple[int, int]]] = {}
    for k, a, b in spans:
        own.setdefault(k, []).append((a, b))
    for k, found in own.items():
        for a, b in merged(found):
            yield k, a, b


def second_pass(opened: DataFrame) -> DataFrame:
    """(k, a, b): spans among what the tasks of the first pass left open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Occurrences()
        at = None

        def out(found: list[tuple[int, int, int]]) -> pa.RecordBatch:
            spans = list(by_name(found))
            return pa.RecordBatch.from_arrays([pa.array([s[i] for s in spans], pa.int64()) for i in range(3)], names=["k", "a", "b"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                full = len(held.rows) >= HOLD
                if full and (row[0] != at or len(held.rows) >= 4 * HOLD):
                    spans, stay = held.settle()
                    if row[0] == at:  # one group beyond what a task holds: its firsts stay
                        held.rows = [r for r in stay if r[0] == at]
                    if spans:
                        yield out(spans)
                at = row[0]
                held.rows.append(row)
        spans, _ = held.settle()
        if spans:
            yield out(spans)

    rows = opened.select(F.col("a").alias("group"), "doc_id", F.col("b").alias("t"), "k", F.col("c").alias("p"), F.col("d").alias("low"), F.col("e").alias("high"), "left", "right")
    order = ["group", F.col("doc_id").asc_nulls_last(), "t", "k", "p"]
    return rows.repartition("group").sortWithinPartitions(*order).mapInArrow(lean(run), "k long, a long, b long")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of touching or overlapping spans."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def deduplicate(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, removed (array of start, end), kept_sha256 and kept (bytes, null where all stay) of every row."""
    import zstandard

    ship_package(docs.sparkSession)
    rows = named(docs)
    copies = small(later_copies(rows))
    active = rows.join(copies, "k", "left_anti")
    lists = repeated_anchors(anchor_rows(active, hot_hashes(active))).groupBy("k").agg(F.collect_list(F.struct("place", "hash", "hot")).alias("places"))
    lists = materialize(lists, "repeated-anchors")
    held = small(lists.select("k"))
    found = first_pass(active.join(held, "k", "left_semi"), lists)
    spans = found.where(f"kind = {_SPAN}").select("k", "a", "b").unionByName(second_pass(found.where(f"kind = {_OPEN}")))
    joined = spans.groupBy("k").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    texts = found.where(f"kind = {_TEXT}").select("doc_id", "k", F.col("left").alias("z")).join(joined, "k", "left").select("doc_id", "z", "spans")
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for batch in (b.slice(lo, SLICE) for b in batches for lo in range(0, b.num_rows, SLICE)):
            size, removed, sha, rest = [], [], [], []
            for blob, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = z.decompress(blob)
                gone = merged([(s["a"], s["b"]) for s in found or ()])
                at, parts = 0, []
                for a, b in gone:
                    parts.append(data[at:a])
                    at = b
                kept = b"".join([*parts, data[at:]])
                size.append(len(data))
                removed.append([{"start": a, "end": b} for a, b in gone])
                sha.append(hashlib.sha256(kept).hexdigest())
                rest.append(kept if gone else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(removed, span), pa.array(sha, pa.string()), pa.array(rest, pa.binary())], names=["doc_id", "n_bytes", "removed", "kept_sha256", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    changed = texts.mapInArrow(lean(run), f"doc_id {kind}, n_bytes long, removed array<struct<start: bigint, end: bigint>>, kept_sha256 string, kept binary")
    none = F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)")
    null = F.lit(None).cast("binary")
    same = active.join(held, "k", "left_anti").select("doc_id", "n", none.alias("removed"), F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"), null.alias("kept"))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n").alias("end")))
    gone = rows.join(copies, "k", "left_semi").select("doc_id", "n", whole.alias("removed"), F.sha2(F.lit("").cast("binary"), 256).alias("kept_sha256"), F.lit(b"").alias("kept"))
    return same.unionByName(gone).withColumnRenamed("n", "n_bytes").unionByName(changed)


def op5(spark, sf_dir: str) -> DataFrame:
    from lexatlas.runtime import table

    found = deduplicate(table(spark, sf_dir, "documents"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return found.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), "kept_sha256")


OP5_SQL = """
with d as (select doc_id, coalesce(text, '') as text, count(*) as copies from documents group by 1, 2),
o as (select *, row_number() over (order by doc_id nulls last, text) as k, hex(encode(text)) as h from d),
p as (select k, h, unnest(range(0, length(h) // 2 - 99)) as i from o),
u as materialized (select k, i, md5_number(substring(h, 2 * i + 1, 200)) as m, k * 10000000000 + i as place from p),
e as (select min(place) as place from u group by m),
s as (select k, i from u anti join e on u.place = e.place),
g as (select k, i, sum(apart::int) over (partition by k order by i) as g from (select k, i, coalesce(i > lag(i) over (partition by k order by i) + 100, true) as apart from s)),
r as (select k, min(i) as a, max(i) + 100 as b from g group by k, g),
x as (select k, a, b, lag(b, 1, 0::bigint) over (partition by k order by a) as z from r),
kept as (select k, sum(b - a) as removed, count(*) as spans, max(b) as last, string_agg(substring(h, 2 * z + 1, 2 * (a - z)), '' order by a) as head from x join o using (k) group by 1),
f as (select o.*, coalesce(removed, 0) as removed, coalesce(spans, 0) as spans, coalesce(head, '') || substring(h, 2 * coalesce(last, 0) + 1) as rest from o left join kept using (k))
select doc_id, (length(h) // 2)::bigint as n_bytes, removed::bigint as n_removed, spans::bigint as n_spans, sha256(unhex(rest)) as kept_sha256 from f, unnest(range(0, copies)) as y(c)
"""
