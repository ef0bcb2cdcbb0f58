"""N-gram Jaccard self-join by signature trees, and the classes it makes.

Documents are sets of word shingles. Equal sets are one class from the start.
Classes are routed to each other by prefix keys: under a total order of
shingles (frequent ones last) two sets of Jaccard similarity t share a key
among the first n - ceil(t n) + 1, so no link is lost. Buckets of few classes
give pairs that pass size and position bounds and then a bound on the overlap
from token bitmaps; larger buckets chain their size-compatible members. What
hangs together is a family, and all links lie inside families.

Within a family a signature tree does the join: its nodes hold OR-combined
token bitmaps and size ranges, and a dual traversal drops a pair of nodes when
the largest possible overlap cannot reach the similarity, or when both nodes
already lie in one component; surviving leaf pairs are compared exactly. A
family beyond a block's size is dealt over blocks: trees per block, then
between representatives of what the blocks found, then between everything that
is still apart from the family's largest component and all blocks. So a group
of any size is never in one task, and pairs of one group are never listed.

Shingles are 64-bit hashes, classes 64-bit hashes of whole sets. A text of any
length is shingled in one piece; it takes about 30 times its bytes while that lasts.

Defined results: null and empty texts have empty sets, link with nothing and
are their own component; texts shorter than a shingle are one shingle; rows
that repeat a doc_id are rows of their own in the same component; a null doc_id
never names a component unless all of its ids are null; an empty table gives an
empty result; further columns are ignored (``one_of_each`` keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexatlas.llm import textkernel as tk
from lexatlas.llm.components import components
from lexatlas.llm.uneven import join_uneven
from lexatlas.runtime import discard, lean, materialize, ship_package

#: Similarity as a fraction.
NUM, DEN = 4, 5
WIDTH = 5
#: Buckets of more classes chain their members instead of listing pairs.
BUCKET = 200
#: Classes, and tokens, of one tree.
BLOCK = 2048
BLOCK_TOKENS = 1_000_000
#: Least and most bits of a class's bitmap; in between it has about as many as the class has tokens.
MIN_BITS, MAX_BITS = 256, 16_384
#: Frequent shingles known to all tasks (an order, never a filter): 8 bytes each.
MAX_FREQUENT = 400_000
FREQUENT_IN_BATCH = 2
FILTER_BITS = 1 << 25
REPRESENTATIVES = 4
#: Classes of families that may travel to every task (16 bytes each); more of them are joined by a shuffle.
MAX_BROADCAST = 1_000_000

def needed(n, m):
    """Least overlap of sets of n and m members at the similarity (integers)."""
    return -(-NUM * (n + m) // (NUM + DEN))


def class_id(s: np.ndarray) -> int:
    """Signed 64-bit name of a set; 0 is the empty set."""
    if not len(s):
        return 0
    h = tk.mix(np.array([tk.mix(s).sum(dtype=np.uint64) + tk.U64(len(s))], np.uint64))
    return int(h.view(np.int64)[0]) or 1


def bitmap(s: np.ndarray) -> bytes:
    """Bits of the set's tokens; the length, a power of two, follows from the set's size."""
    bits = MIN_BITS
    while bits < min(0.9 * len(s), MAX_BITS):
        bits *= 2
    b = np.zeros(bits, bool)
    b[(s >> tk.U64(20)).astype(np.int64) & (bits - 1)] = True
    return np.packbits(b).tobytes()


def room(x: bytes, y: bytes, n: int, m: int) -> bool:
    """Whether sets of n and m tokens with these bitmaps may overlap enough; the longer bitmap is folded."""
    u, v = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    size = min(len(u), len(v))
    u, v = (np.bitwise_or.reduce(w.reshape(-1, size)) if len(w) > size else w for w in (u, v))
    extra = min(n - int(np.bitwise_count(u).sum()), m - int(np.bitwise_count(v).sum()))
    return int(np.bitwise_count(u & v).sum()) + extra >= needed(n, m)


def _sets(batch_column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, set) of each row."""
    offsets, data = tk.flat(batch_column)
    for lo, hi in tk.pieces(offsets):
        values, bounds = tk.shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], WIDTH)
        for r in range(hi - lo):
            yield lo + r, values[bounds[r] : bounds[r + 1]]


def describe(docs: DataFrame) -> DataFrame:
    """For each row: doc_id, k (hash of id and text), n, cls, bits; and rows (key, seen) of shingles frequent in a batch."""
    ship_package(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("k"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, cls, bits, kept, known = [], [], [], [], set()
            for _, s in _sets(batch.column(1)):
                c = class_id(s)
                n.append(len(s))
                cls.append(c)
                bits.append(bitmap(s) if len(s) else None)
                if c not in known:
                    known.add(c)
                    kept.append(s.copy())
            rows = len(n)
            keys, seen = np.unique(np.concatenate(kept or [np.zeros(0, np.uint64)]), return_counts=True)
            often = seen >= FREQUENT_IN_BATCH
            keys, seen = keys[often].view(np.int64), seen[often]
            pad = lambda x, k: pa.concat_arrays([x, pa.nulls(k, x.type)])
            before = lambda x: pa.concat_arrays([pa.nulls(rows, pa.int64()), pa.array(x, pa.int64())])
            yield pa.RecordBatch.from_arrays(
                [pad(batch.column(0), len(keys)), pad(batch.column(2), len(keys)), pad(pa.array(n, pa.int64()), len(keys)), pad(pa.array(cls, pa.int64()), len(keys)), pad(pa.array(bits, pa.binary()), len(keys)), before(keys), before(seen)],
                names=["doc_id", "k", "n", "cls", "bits", "key", "seen"],
            )

    return rows.mapInArrow(lean(run), f"doc_id {kind}, k long, n long, cls long, bits binary, key long, seen long")


def prefix(s: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The keys of a set: its first members, frequent ones last, else by value."""
    size = len(s) - (-(-NUM * len(s) // DEN)) + 1
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
        often = frequent[at] == s
        if often.any():
            s = np.concatenate((s[~often], s[often]))
    return s[:size]


def keys_of(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(key, cls, np): np packs the set's size and the key's place in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        for batch in batches:
            keys, cls, size, place = [], [], [], []
            for _, s in _sets(batch.column(0)):
                c = class_id(s)
                if c and c not in known:
                    known.add(c)
                    p = prefix(s, frequent)
                    keys.append(p)
                    cls.append(np.full(len(p), c))
                    size.append(np.full(len(p), len(s)))
                    place.append(np.arange(len(p)))
            if keys:
                k, c, n, p = (np.concatenate(x) for x in (keys, cls, size, place))
                for lo in range(0, len(k), 1 << 17):
                    hi = lo + (1 << 17)
                    yield pa.RecordBatch.from_arrays([pa.array(k[lo:hi].view(np.int64)), pa.array(c[lo:hi]), pa.array(n[lo:hi] << 31 | p[lo:hi])], names=["key", "cls", "np"])

    return docs.select("text").mapInArrow(lean(run), "key long, cls long, np long")


def _bucket_links(key: np.ndarray, cls: np.ndarray, n: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, is a pair to test) of whole buckets, sorted by key, size, class; equal rows are gone."""
    edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    size = np.repeat(np.diff(edge), np.diff(edge))
    out = []
    for d in range(1, BUCKET):
        i = np.flatnonzero((key[:-d] == key[d:]) & (size[:-d] <= BUCKET)) if len(key) > d else np.zeros(0, np.int64)
        if not len(i):
            break
        j = i + d
        most = 1 + np.minimum(n[i] - 1 - place[i], n[j] - 1 - place[j])
        ok = (NUM * n[j] <= DEN * n[i]) & (most >= needed(n[i], n[j])) & (cls[i] != cls[j])
        out.append((cls[i[ok]], cls[j[ok]], np.ones(ok.sum(), bool)))
    if len(key) > 1:
        i = np.flatnonzero((key[:-1] == key[1:]) & (size[:-1] > BUCKET))
        ok = (NUM * n[i + 1] <= DEN * n[i]) & (cls[i] != cls[i + 1])
        out.append((cls[i][ok], cls[i + 1][ok], np.zeros(ok.sum(), bool)))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    a, b, test = (np.concatenate(x) for x in zip(*out, strict=True))
    a, b = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((test, b, a))
    a, b, test = a[order], b[order], test[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new], test[new]


def bucket_links(keys: DataFrame, hold: int = 1 << 17) -> DataFrame:
    """(a, b, test) of every bucket; a task holds at most ``hold`` rows of one bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((3, 0), np.int64)

        def out(rows: np.ndarray) -> pa.RecordBatch:
            a, b, test = _bucket_links(rows[0], rows[1], rows[2] >> 31, rows[2] & ((1 << 31) - 1))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(test)], names=["a", "b", "test"])

        for batch in batches:
            rows = np.concatenate((held, np.stack([np.asarray(c) for c in batch.columns])), 1)
            new = np.ones(rows.shape[1], bool)
            new[1:] = (rows[:2, 1:] != rows[:2, :-1]).any(0)
            rows = rows[:, new]
            last = int(np.searchsorted(rows[0], rows[0, -1])) if rows.shape[1] else 0
            if rows.shape[1] - last > hold:  # a bucket beyond what a task holds: chained so far, its last members stay
                yield out(rows)
                held = rows[:, -BUCKET - 1 :]
            else:
                if last:
                    yield out(rows[:, :last])
                held = rows[:, last:]
        if held.shape[1]:
            yield out(held)

    return keys.repartition("key").sortWithinPartitions("key", "np", "cls").mapInArrow(lean(run), "a long, b long, test boolean")


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)

    def roots(self) -> np.ndarray:
        return np.array([self.find(i) for i in range(len(self.up))], np.int64)


def token_bits(sets: list[np.ndarray]) -> np.ndarray:
    """One row of bits (as uint64 words) per set: a bit for every token that two or more of the sets hold."""
    every = np.concatenate(sets)
    tokens, count = np.unique(every, return_counts=True)
    tokens = tokens[count > 1]
    words = max(1, -(-len(tokens) // 64))
    out = np.zeros((len(sets), words * 8), np.uint8)
    if len(tokens):
        for i, s in enumerate(sets):
            at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
            at = at[tokens[at] == s]
            np.bitwise_or.at(out[i], at >> 3, (1 << (at & 7)).astype(np.uint8))
    return out.view(np.uint64)


def tree_links(sets: list[np.ndarray], label: np.ndarray | None = None, fan: int = 8) -> np.ndarray:
    """Component of each set, as the smallest index in it, of all links among ``sets``.

    ``label``: sets of one label are known to be together. The tokens of the
    group are numbered, so a leaf's bitmap is its set without the tokens that
    it shares with no other: the overlap of two leaves is exact, and that of
    two nodes is at most the overlap of their OR-combined bitmaps.
    """
    n = len(sets)
    forest = Forest(n)
    if label is not None:
        first: dict[int, int] = {}
        for i, x in enumerate(label.tolist()):
            forest.join(first.setdefault(x, i), i)
    if n < 2:
        return forest.roots()
    size = np.array([len(s) for s in sets])
    head = np.array([s[0] if len(s) else 0 for s in sets], np.uint64)
    order = np.lexsort((size, head))
    levels = [token_bits([sets[i] for i in order])]
    low, high = [size[order]], [size[order]]
    while len(levels[-1]) > 1:
        cut = np.arange(0, len(levels[-1]), fan)
        levels.append(np.bitwise_or.reduceat(levels[-1], cut))
        low.append(np.minimum.reduceat(low[-1], cut))
        high.append(np.maximum.reduceat(high[-1], cut))
    step = max(64, (1 << 22) // levels[0].shape[1] // 8)  # pairs looked at together: some MB of bitmaps

    def together() -> list[np.ndarray]:
        """A node's component, or -1 where it holds several."""
        out = [forest.roots()[order]]
        for x in levels[1:]:
            cut = np.arange(0, len(out[-1]), fan)
            a, b = np.minimum.reduceat(out[-1], cut), np.maximum.reduceat(out[-1], cut)
            out.append(np.where(a == b, a, -1))
        return out

    def possible(k: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Pairs whose greatest overlap reaches the similarity; at the leaves, pairs that are linked."""
        ok = (NUM * low[k][a] <= DEN * high[k][b]) & (NUM * low[k][b] <= DEN * high[k][a])
        at = np.flatnonzero(ok)
        for lo in range(0, len(at), step):
            i = at[lo : lo + step]
            x, y = a[i], b[i]
            both = np.bitwise_count(levels[k][x] & levels[k][y]).sum(1, dtype=np.int64)
            ok[i] = np.minimum(both, np.minimum(high[k][x], high[k][y])) >= needed(low[k][x], low[k][y])
        return ok

    chain = np.flatnonzero(possible(0, np.arange(n - 1), np.arange(1, n)))  # neighbours in order, to begin with
    for i, j in zip(order[chain].tolist(), order[chain + 1].tolist(), strict=True):
        forest.join(i, j)
    comp = together()
    stack = [(len(levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    inner_i, inner_j = np.repeat(np.arange(fan), fan), np.tile(np.arange(fan), fan)
    while stack:
        k, a, b = stack.pop()
        keep = (comp[k][a] < 0) | (comp[k][a] != comp[k][b])
        a, b = a[keep], b[keep]
        ok = possible(k, a, b)
        a, b = a[ok], b[ok]
        if not len(a):
            continue
        if k == 0:
            for i, j in zip(order[a].tolist(), order[b].tolist(), strict=True):
                forest.join(i, j)
            comp = together()
            continue
        m = len(levels[k - 1])
        i = (a[:, None] * fan + inner_i).ravel()
        j = (b[:, None] * fan + inner_j).ravel()
        fine = (i < m) & (j < m) & ((i < j) | ((i == j) & (k > 1)))
        i, j = i[fine], j[fine]
        stack += [(k - 1, i[lo : lo + 4096], j[lo : lo + 4096]) for lo in range(0, len(i), 4096)]
    return forest.roots()


def pack(s: np.ndarray) -> bytes:
    """A sorted set, whole."""
    return s.astype("<u8").tobytes()


def unpack(b: bytes) -> np.ndarray:
    return np.frombuffer(b, "<u8")


def _grouped(rows: DataFrame, by: list[str], labelled: bool = False, keep: bool = False) -> DataFrame:
    """Join trees over the rows (by..., cls, tokens[, label]) of each group: (by[0], cls, root).

    ``keep``: also whether the class is one of its component's representatives, and its tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(by)
        held: dict = {}
        at = None

        def out() -> pa.RecordBatch:
            cls = np.array(list(held), np.int64)
            sets = [unpack(v[0]) for v in held.values()]
            root = tree_links(sets, np.array([v[1] for v in held.values()], np.int64) if labelled else None)
            cols = [pa.array([at[0]] * len(cls), pa.int64()), pa.array(cls), pa.array(cls[root])]
            names = [by[0], "cls", "root"]
            if keep:
                size: dict[int, int] = {}
                chosen = np.zeros(len(cls), bool)
                several = np.bincount(root, minlength=len(cls)) > 1
                for i in np.argsort(tk.mix(cls.view(np.uint64)), kind="stable").tolist():
                    r = int(root[i])
                    if several[r] and size.get(r, 0) < REPRESENTATIVES:
                        chosen[i] = True
                        size[r] = size.get(r, 0) + 1
                cols += [pa.array(chosen), pa.array([v[0] for v in held.values()], pa.binary())]
                names += ["chosen", "tokens"]
            return pa.RecordBatch.from_arrays(cols, names=names)

        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            for row in zip(*cols, strict=True):
                if row[:k] != at:
                    if held:
                        yield out()
                    held, at = {}, row[:k]
                held.setdefault(row[k], (row[k + 1], row[k + 2] if labelled else 0))
        if held:
            yield out()

    cols = [*by, "cls", "tokens", *(["label"] if labelled else [])]
    schema = f"{by[0]} long, cls long, root long" + (", chosen boolean, tokens binary" if keep else "")
    return rows.select(*cols).repartition(*by).sortWithinPartitions(*by, "cls").mapInArrow(lean(run), schema)


def _filter(cls: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A bit array of fixed size in which each class's bit is set."""
    cell = F.pmod("cls", F.lit(bits))
    rows = cls.select(cell.alias("c")).groupBy(F.expr("bitmap_bucket_number(c)").alias("k")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(c))").alias("b")).collect()  # bits / 32768 rows of 4 kB
    out = np.zeros((bits // 32768 + 2, 4096), np.uint8)
    for r in rows:
        out[r.k] = np.frombuffer(bytes(r.b), np.uint8)
    return out


def _in_filter(table: np.ndarray, cls: int, bits: int = FILTER_BITS) -> bool:
    c = cls % bits
    k, at = (0, 0) if c == 0 else (1 + (c - 1) // 32768, (c - 1) % 32768)  # bucket 1 holds 1..32768
    if c == 0:
        return True
    return bool(table[k, at >> 3] >> (at & 7) & 1)


def sets_of(docs: DataFrame, cls: DataFrame) -> DataFrame:
    """(cls, tokens) of the classes of ``cls``, and a few others that share a filter bit."""
    table = _filter(cls)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        for batch in batches:
            ids, tokens = [], []
            for _, s in _sets(batch.column(0)):
                c = class_id(s)
                if c and c not in known and _in_filter(table, c):
                    known.add(c)
                    ids.append(c)
                    tokens.append(pack(s))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(tokens, pa.binary())], names=["cls", "tokens"])

    return docs.select("text").mapInArrow(lean(run), "cls long, tokens binary")


def _maybe(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs whose bitmaps leave room for a link."""
    side = lambda c: classes.select(F.col("cls").alias(c), F.col("bits").alias(f"bits_{c}"), F.col("n").alias(f"n_{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = pa.array([room(*row) for row in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["u", "v"])

    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    return joined.select("a", "b", "bits_a", "bits_b", "n_a", "n_b").mapInArrow(lean(run), "u long, v long")


def link_classes(docs: DataFrame, classes: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(cls, root) of the classes that are linked with others."""
    links = materialize(bucket_links(keys_of(docs, frequent)).groupBy("a", "b").agg(F.min("test").alias("test")), "links")
    maybe = _maybe(links.where("test").select("a", "b"), classes).unionByName(links.where("not test").select(F.col("a").alias("u"), F.col("b").alias("v")))
    family = materialize(components(maybe).select(F.col("node").alias("cls"), F.col("root").alias("family")), "families")
    sized = family.join(classes.select("cls", "n"), "cls")
    totals = sized.groupBy("family").agg(F.count("*").alias("f"), F.sum("n").alias("t"))
    totals = materialize(totals.select("family", "f", F.greatest(F.ceil(F.col("f") / BLOCK), F.ceil(F.col("t") / BLOCK_TOKENS)).alias("blocks")), "family-sizes")
    stats = totals.agg(F.max("blocks").alias("most"), F.sum("f").alias("rows")).first()
    placed = family.join(totals, "family").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks"))).select("cls", "family", "block")
    if (stats.rows or 0) <= MAX_BROADCAST:
        placed = F.broadcast(placed)
    sets = sets_of(docs, family).join(placed, "cls")
    if (stats.most or 0) <= 1:
        return _grouped(sets, ["family", "block"]).select("cls", "root")
    return _large(materialize(_grouped(sets, ["family", "block"], keep=True), "block-links"), totals)


def _large(first: DataFrame, totals: DataFrame) -> DataFrame:
    """(cls, root) where families take several blocks: ``first`` is what each block found by itself."""
    big = first.join(totals.where("blocks > 1"), "family")
    part = F.pmod(F.xxhash64("root"), F.greatest(F.lit(1), F.ceil(F.col("blocks") * REPRESENTATIVES / 64)))
    met = _grouped(big.where("chosen").withColumn("part", part).withColumn("label", F.col("root")), ["family", "part"], labelled=True)
    own = first.select("cls", "root")
    met = met.join(own.withColumnRenamed("root", "old"), "cls").join(own.select(F.col("cls").alias("root"), F.col("root").alias("new")), "root")
    second = _merge(own, met.select(F.col("old").alias("u"), F.col("new").alias("v")))
    # what is still apart from its family's largest component meets every block
    parts = big.select("family", "cls", "blocks").join(second, "cls").groupBy("family", "blocks", "root").agg(F.count("*").alias("k"))
    main = parts.groupBy("family", "blocks").agg(F.max_by("root", F.struct("k", "root")).alias("main"), F.sum("k").alias("total"), F.max("k").alias("most")).where("total > most")
    main = materialize(main.withColumn("outs", F.ceil((F.col("total") - F.col("most")) * F.col("blocks") / F.col("total"))), "open-families")
    if not main.head(1):
        return second
    open_ = first.select("family", "cls", "tokens").join(main, "family").join(second.withColumnRenamed("root", "label"), "cls")
    block = F.pmod(F.xxhash64("cls"), F.col("blocks"))
    out = open_.where("label <> main").withColumn("out", F.pmod(F.xxhash64("cls", F.lit(1)), F.col("outs"))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    every = open_.withColumn("block", block).withColumn("out", F.explode(F.sequence(F.lit(0).cast("long"), F.col("outs") - 1)))
    cols = ["family", "out", "block", "cls", "tokens", "label"]
    last = _grouped(out.select(*cols).unionByName(every.select(*cols)), ["family", "out", "block"], labelled=True)
    last = last.join(second.withColumnRenamed("root", "old"), "cls").join(second.select(F.col("cls").alias("root"), F.col("root").alias("new")), "root")
    return _merge(second, last.select(F.col("old").alias("u"), F.col("new").alias("v")))


def _merge(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``labels`` (cls, root) after the roots joined by ``edges`` are one."""
    roots = components(edges)
    moved = labels.join(roots.select(F.col("node").alias("root"), F.col("root").alias("x")), "root", "left")
    return materialize(moved.select("cls", F.coalesce("x", "root").alias("root")), "labels")


def frequent_keys(described: DataFrame) -> np.ndarray:
    """The sorted shingles seen in most places, at most MAX_FREQUENT: those seen at least so often that no more are left.

    Only the numbers of shingles by how often they were seen, and the chosen ones, reach the driver.
    """
    seen = materialize(described.where("key is not null").groupBy("key").agg(F.sum("seen").alias("seen")), "frequent")
    step = F.when(F.col("seen") < 256, F.col("seen")).otherwise(F.lit(256) * F.length(F.bin("seen")))  # at most 256 + 16,384 levels, in the order of seen
    levels = seen.groupBy(step.alias("level")).agg(F.count("*").alias("keys")).orderBy(F.desc("level")).collect()
    total, least = 0, None
    for r in levels:
        total += r.keys
        if total > MAX_FREQUENT:
            break
        least = r.level
    keys = np.zeros(0, np.int64)
    if least is not None:
        keys = seen.where(step >= least).select("key").toPandas()["key"].to_numpy(np.int64)  # at most MAX_FREQUENT
    discard(seen)
    return np.sort(keys.view(np.uint64))


def classified(docs: DataFrame) -> DataFrame:
    """doc_id, k, n, cls, component_id, lead (whether its class is the one that stays for its component) of every row; written."""
    ship_package(docs.sparkSession)
    described = materialize(describe(docs), "sets")
    frequent = frequent_keys(described)
    rows = described.where("key is null").select("doc_id", "k", "n", "cls")
    classes = materialize(described.where("key is null and n > 0").groupBy("cls").agg(F.min("doc_id").alias("first_id"), F.max("n").alias("n"), F.max("bits").alias("bits"), F.count("*").alias("copies")), "classes")
    roots = materialize(link_classes(docs, classes, frequent), "roots")
    order = F.struct(F.col("first_id").isNull().alias("none"), "first_id", "cls")
    lead = roots.join(classes.select("cls", "first_id"), "cls").groupBy("root").agg(F.min(order).alias("first"))
    named = roots.join(lead, "root").select("cls", F.col("first.first_id").alias("component_id"), (F.col("cls") == F.col("first.cls")).alias("lead"))
    own = classes.select("cls", "first_id", "copies").join(named, "cls", "left")
    own = materialize(own.select("cls", F.coalesce("component_id", "first_id").alias("component_id"), F.coalesce("lead", F.lit(True)).alias("lead"), "copies"), "named")
    full = join_uneven(rows.where("n > 0"), own, ["cls"], "copies").select("doc_id", "k", "n", "cls", "component_id", "lead")
    out = full.unionByName(rows.where("n = 0").select("doc_id", "k", "n", "cls", F.col("doc_id").alias("component_id"), F.lit(True).alias("lead")))
    return materialize(out, "components")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``."""
    return classified(docs).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of every component, columns unchanged: the smallest doc_id (null last), of rows that share it one.

    Rows are told apart by id and text, so another text under the same id stays
    or goes by its own component. Documents without words all stay.
    """
    found = classified(docs)
    own = found.where("n > 0").withColumn("stays", F.col("lead") & F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = own.where("stays").groupBy("doc_id", "cls").agg(F.min("k").alias("first"), F.count("*").alias("rows"), F.max("k").alias("last"))
    several = materialize(kept.where("rows > 1"), "several")  # texts of one set under one id
    gone = own.where("not stays").select("doc_id", "k")
    other = own.where("stays").join(several.select(F.col("doc_id").alias("i"), F.col("cls").alias("c"), "first"), F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("cls") == F.col("c")))
    gone = materialize(gone.unionByName(other.where("k <> first").select("doc_id", "k")).distinct(), "gone")
    out = without(docs, gone)
    if several.head(1):  # rows that repeat both id and text
        repeated = materialize(other.where("k = first").groupBy("doc_id", "k").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id", "k"), "repeated")
        again = docs.withColumn("__k", F.xxhash64("doc_id", "text")).join(repeated.select(F.col("k").alias("__k")).distinct(), "__k", "left_semi").drop("__k").dropDuplicates(["doc_id", "text"])
        out = without(out, repeated).unionByName(again)
    return out


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose (doc_id, hash of id and text) is not in ``gone`` (doc_id, k).

    A bit array of fixed size tells most rows that they stay; only the others are shuffled for the exact anti-join.
    """
    names = docs.columns
    table = _filter(gone.select(F.col("k").alias("cls")))
    kinds = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))
    inner = docs.toDF(*(f"c{i}" for i in range(len(names))))
    keys = [f"c{names.index(c)}" for c in ("doc_id", "text")]

    def part(inside: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hit = np.array([_in_filter(table, h) for h in batch.column(len(names)).to_pylist()], bool)
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(hit == inside)) for c in batch.columns[:-1]], names=batch.schema.names[:-1])

        return inner.withColumn("h", F.xxhash64(*keys)).mapInArrow(lean(run), kinds).toDF(*names)

    maybe = part(True).toDF(*(f"c{i}" for i in range(len(names)))).withColumn("h", F.xxhash64(*keys))
    other = gone.select(F.col("doc_id").alias("gone_id"), F.col("k").alias("gone_k"))
    stay = maybe.join(other, (F.col("h") == F.col("gone_k")) & F.col(keys[0]).eqNullSafe(F.col("gone_id")), "left_anti").drop("h").toDF(*names)
    return part(False).unionByName(stay)


def op1(spark, sf_dir: str) -> DataFrame:
    from lexatlas.runtime import table

    return near_duplicates(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
with recursive d as (
  select row_number() over () as row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
t as (
  select row, doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')))) end as s from d),
c as (select s, min(row) as class, any_value(len(s)) as n from t where len(s) > 0 group by s),
e as (select class, n, md5_number(unnest(s)) as h from c),
p as (select a.class as a, b.class as b, count(*) as shared, any_value(a.n) + any_value(b.n) as n from e a join e b on a.h = b.h and a.class < b.class and 4 * b.n <= 5 * a.n and 4 * a.n <= 5 * b.n group by 1, 2),
l as (select a, b from p where 100 * shared >= 80 * (n - shared) union all select b, a from p where 100 * shared >= 80 * (n - shared)),
r(a, b) as (select class, class from c union select r.a, l.b from r join l on l.a = r.b),
m as (select t.row, t.doc_id, len(t.s) as n, c.class from t left join c on c.s = t.s),
i as (select r.a as class, min(m.doc_id) as component_id from r join m on m.class = r.b group by 1)
select doc_id, n::bigint as n_shingles, case when n = 0 then doc_id else component_id end as component_id from m left join i on i.class = m.class
"""
