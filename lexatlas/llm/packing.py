"""Cost-balanced packing of token documents into sequences of fixed capacity.

The cost of a piece of n tokens is ``n + quadratic * n**2 / capacity`` (linear
layers plus attention). Pieces are taken in descending cost; each goes to the
open sequence of the lowest cost that still has token capacity, preferring
among the few cheapest one that takes it whole, and is cut where none does.

Documents of a partition are packed in windows of bounded size, without a
shuffle: whole sequences leave at the end of each window, the tokens that do
not fill one wait for the next, and what is left at the end of the partition
fills sequences whose lengths are powers of two. So no sequence is padded, and
a rerun of a lost task makes the same sequences under the same numbers.

Defined results: a null or empty text is the end token alone; repeated rows
and null ids are documents of their own; ties in cost go to the earlier piece
and the smaller sequence number; an empty table gives no pieces; further
columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexatlas.llm import tokens
from lexatlas.runtime import lean, ship_package

CAPACITY = 1024
END_ID = 0
#: Tokens gathered before a window is packed; bounds a task's memory.
WINDOW_TOKENS = 1 << 20

Piece = tuple[int, int, int]  # (document of the window, start, length)


def binary_parts(n: int) -> list[int]:
    """n as descending powers of two."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def balance(pieces: list[Piece], capacities: list[int], capacity: int = CAPACITY, quadratic: float = 1.0, tries: int = 8) -> list[tuple[Piece, int, int]]:
    """[(piece, sequence, offset)]; the capacities must add up to the pieces' tokens."""
    cost = lambda n: n + quadratic * n * n / capacity
    used = [0] * len(capacities)
    heap = [(0.0, i) for i in range(len(capacities))]
    out = []
    for doc, start, length in sorted(pieces, key=lambda p: (-cost(p[2]), p)):
        while length:
            looked, fit = [], None
            while heap and len(looked) < tries:
                looked.append(heapq.heappop(heap))
                if capacities[looked[-1][1]] - used[looked[-1][1]] >= length:
                    fit = looked.pop()
                    break
            fit = fit or looked.pop(0)
            for x in looked:
                heapq.heappush(heap, x)
            at = fit[1]
            take = min(length, capacities[at] - used[at])
            out.append(((doc, start, take), at, used[at]))
            used[at] += take
            start, length = start + take, length - take
            if used[at] < capacities[at]:
                heapq.heappush(heap, (fit[0] + cost(take), at))
    return out


def pack_window(lengths: list[int], carried: list[Piece], last: bool, capacity: int = CAPACITY, quadratic: float = 1.0) -> tuple[list[tuple[Piece, int, int]], int, list[Piece]]:
    """(placed, number of sequences, pieces for the next window).

    ``carried`` pieces belong to documents of earlier windows and have negative document numbers.
    """
    placed, rest, n = [], list(carried), 0
    for doc, length in enumerate(lengths):
        start = 0
        while length - start >= capacity:
            placed.append(((doc, start, capacity), n, 0))
            start, n = start + capacity, n + 1
        if length > start:
            rest.append((doc, start, length - start))
    total = sum(p[2] for p in rest)
    full, over = divmod(total, capacity)
    wait: list[Piece] = []
    if over and not last:
        rest.sort(key=lambda p: (p[2], p))  # the shortest wait, cut to the token
        while over:
            doc, start, length = rest.pop(0)
            take = min(over, length)
            wait.append((doc, start, take))
            if take < length:
                rest.append((doc, start + take, length - take))
            over -= take
    room = [capacity] * full + (binary_parts(over) if last else [])
    placed += [(p, n + at, offset) for p, at, offset in balance(rest, room, capacity, quadratic)]
    return placed, n + len(room), wait


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, quadratic: float = 1.0, window_tokens: int = WINDOW_TOKENS) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset and ids
    (the piece's token ids as little-endian unsigned 32-bit numbers)."""
    ship_package(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode: Callable[[str], bytes] = tokens.encoder(tokenizer_path)
        end = np.array([end_id], "<u4").tobytes()
        base = TaskContext.get().partitionId() << 36
        ids: list[bytes] = []
        keys: list = []
        waiting: list[tuple[object, bytes, int, Piece]] = []

        def flush(last: bool) -> pa.RecordBatch | None:
            nonlocal base, ids, keys, waiting
            source = {-1 - i: (k, b, total) for i, (k, b, total, _) in enumerate(waiting)}
            source |= {i: (k, b, len(b) // 4) for i, (k, b) in enumerate(zip(keys, ids, strict=True))}
            carried = [(-1 - i, p[1], p[2]) for i, (_, _, _, p) in enumerate(waiting)]
            placed, n, wait = pack_window([len(b) // 4 for b in ids], carried, last, capacity, quadratic)
            first = {-1 - i: p[1] for i, (_, _, _, p) in enumerate(waiting)}  # a carried document keeps only its open tokens
            cut = lambda d, s, m: source[d][1][4 * (s - first.get(d, 0)) : 4 * (s - first.get(d, 0) + m)]
            rows = [(source[d][0], s, m, source[d][2], base + q, o, cut(d, s, m)) for (d, s, m), q, o in placed]
            waiting = [(source[d][0], cut(d, s, m), source[d][2], (d, s, m)) for d, s, m in wait]
            base, ids, keys = base + n, [], []
            if not rows:
                return None
            c = list(zip(*rows, strict=True))
            i64 = pa.int64()
            return pa.RecordBatch.from_arrays([pa.array(c[0], id_type), *(pa.array(x, i64) for x in c[1:6]), pa.array(c[6], pa.binary())], names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

        held, id_type = 0, pa.int64()
        for batch in batches:
            id_type = batch.schema.field(0).type
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                b = encode(text.as_py() or "") + end
                keys.append(key)
                ids.append(b)
                held += len(b) // 4
                if held >= window_tokens:
                    if (out := flush(False)) is not None:
                        yield out
                    held = 0
        if (out := flush(True)) is not None:
            yield out

    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def op6(spark, sf_dir: str) -> DataFrame:
    from lexatlas.runtime import table

    packed = pack_documents(table(spark, sf_dir, "documents"), tokens.default_path())
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
