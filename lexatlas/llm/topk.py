"""Exact top-k inner products over norm-sorted, rotated vectors.

Vectors are quantised to integers, so scores are exact. An orthogonal rotation
from the Gram matrix of all vectors gathers their length in the leading
coordinates. Candidates lie in blocks of descending length; a query leaves out
blocks whose longest vector cannot reach its k-th best score (Cauchy-Schwarz),
and inside a block partial sums over leading coordinates plus the product of the
residual lengths bound every score, so only candidates whose bound reaches the
k-th best are scored in full. The longest vectors, a block of fixed size, give
every query its first k-th best.

Queries are written as shards of at most SHARD vectors, ordered by the length
that a candidate needs. Every shard has one scan over the candidate blocks that are
long enough for it, in which each task holds the shard and streams its blocks,
so blocks never move and a task passes on at most k rows of a query. Shard
and block sizes are fixed; only the number of scans grows with the table.
Besides, the rotation, the seed block and a row for each shard leave the executors.

Defined results: vectors that are null or hold null or non-finite components
take no part, and neither do null ids; shorter vectors read as padded with
zeros; rows that share an id are candidates (and queries) of their own, and only
the query's own row is left out; equal scores go to the smaller id; fewer
than k candidates give fewer rows; an empty table gives none; further columns are
ignored. Components beyond 2**25 may leave the exact range and are not supported.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexatlas.runtime import lean, materialize, open_uri, scratch, ship_package

#: Longest vectors every query looks at first.
SEED = 4096
#: Queries of one shard, and of those looked at together.
SHARD, TOGETHER = 1 << 15, 1 << 11
#: Candidates of one block, and of those looked at together.
BLOCK, STEP = 4096, 256
#: Shards whose scans are one job.
SCANS = 64
#: Numbers of leading coordinates after which scores are bounded.
LEADING = (12, 28)

_BLOCK = "rows binary, ids binary, vecs binary, longest double"


def quantised(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """row (a number), vec_id, q (array of whole doubles), norm; write it before the number is used twice."""
    fine = "embedding is not null and vec_id is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    q = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double"))
    one = vectors.where(F.expr(fine)).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), q.alias("q"))
    return one.withColumn("norm", F.sqrt(F.aggregate("q", F.lit(0.0), lambda a, x: a + x * x)))


def _dense(column: pa.Array, d: int) -> np.ndarray:
    off = np.asarray(column.offsets)
    flat = np.asarray(column.values.slice(off[0], off[-1] - off[0])) if len(column) else np.zeros(0)
    size = np.diff(off)
    if len(size) and (size == d).all():
        return flat.reshape(len(size), d).astype(float)
    out = np.zeros((len(size), d))
    for i, (a, b) in enumerate(zip(off[:-1] - off[0], off[1:] - off[0], strict=True)):
        out[i, : b - a] = flat[a:b]
    return out


def rotation(q: DataFrame, d: int) -> np.ndarray:
    """Columns: eigenvectors of the Gram matrix of all vectors, largest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros((d, d))
        for batch in batches:
            x = _dense(batch.column(0), d)
            g += x.T @ x
        i, j = np.divmod(np.arange(d * d), d)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(g.ravel())], names=["i", "j", "v"])

    cells = q.select("q").mapInArrow(lean(run), "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    g = np.zeros((d, d))
    g[cells.i, cells.j] = cells.v
    return np.linalg.eigh((g + g.T) / 2)[1][:, ::-1]


def _packed(rows: DataFrame, d: int, size: int) -> DataFrame:
    """Blocks of at most ``size`` rows (row, vec_id, q) in the rows' order inside each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def out() -> pa.RecordBatch:
            nonlocal held
            row, ids, x = (np.concatenate(c) for c in zip(*held, strict=True))
            held = [(row[size:], ids[size:], x[size:])]
            row, ids, x = row[:size], ids[:size], x[:size]
            longest = float(np.sqrt((x * x).sum(1)).max())
            return pa.RecordBatch.from_arrays([*(pa.array([c.tobytes()], pa.binary()) for c in (row, ids, x)), pa.array([longest])], names=["rows", "ids", "vecs", "longest"])

        for batch in batches:
            held.append((np.asarray(batch.column(0)), np.asarray(batch.column(1)), _dense(batch.column(2), d)))
            while sum(len(h[0]) for h in held) >= size:
                yield out()
        if sum(len(h[0]) for h in held):
            yield out()

    return rows.select("row", "vec_id", "q").mapInArrow(lean(run), _BLOCK)


class Vectors:
    """Vectors with their rotation and what is left of their length after the leading coordinates."""

    def __init__(self, row: np.ndarray, ids: np.ndarray, x: np.ndarray, turn: np.ndarray) -> None:
        self.row, self.ids, self.x, self.turned = row, ids, x, x @ turn
        square = self.turned**2
        self.norm = np.sqrt(square.sum(1))
        self.rest = {m: np.sqrt(np.maximum(square[:, m:].sum(1), 0)) for m in LEADING if m < x.shape[1]}

    @classmethod
    def of(cls, rows: bytes, ids: bytes, vecs: bytes, d: int, turn: np.ndarray) -> Vectors:
        return cls(np.frombuffer(rows, np.int64), np.frombuffer(ids, np.int64), np.frombuffer(vecs, float).reshape(-1, d), turn)


class Best:
    """The k best (score, -id) of each query, kept as arrays; ``kth``: a score that better ones reach."""

    def __init__(self, floor: np.ndarray, k: int) -> None:
        self.k = k
        self.score = np.full((len(floor), k), -np.inf)
        self.ids = np.zeros((len(floor), k), np.int64)
        self.kth = floor.astype(float).copy()

    def add(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores, ids: len(at) x m; -inf marks no candidate."""
        s = np.concatenate([self.score[at], scores], 1)
        i = np.concatenate([self.ids[at], np.broadcast_to(ids, scores.shape)], 1)
        order = np.lexsort((i, -s), axis=1)[:, : self.k]
        self.score[at], self.ids[at] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
        self.kth[at] = np.maximum(self.kth[at], self.score[at, -1])


def search(q: Vectors, c: Vectors, best: Best) -> None:
    """Improve the best of queries ``q`` by candidates ``c`` in descending length; scores below 2**53 are exact."""
    slack = lambda a, b: 1e-9 * a * b + 1e-6
    for begin in range(0, len(q.row), TOGETHER):
        live = np.arange(begin, min(begin + TOGETHER, len(q.row)))
        for lo in range(0, len(c.row), STEP):
            hi = min(lo + STEP, len(c.row))
            top = c.norm[lo:hi].max()
            live = live[q.norm[live] * top + slack(q.norm[live], top) >= best.kth[live]]
            if not len(live):
                break
            alive = np.ones((len(live), hi - lo), bool)
            for m in q.rest:
                bound = q.turned[live, :m] @ c.turned[lo:hi, :m].T + q.rest[m][live][:, None] * c.rest[m][lo:hi] + slack(q.norm[live][:, None], c.norm[lo:hi])
                alive &= bound >= best.kth[live][:, None]
                if not alive.any():
                    break
            at = np.flatnonzero(alive.any(1))
            if not len(at):
                continue
            cols = np.flatnonzero(alive[at].any(0))
            own = live[at]
            scores = np.rint(q.x[own] @ c.x[lo:hi][cols].T)
            out = (q.row[own][:, None] == c.row[lo:hi][cols]) | ~alive[np.ix_(at, cols)] | (scores < best.kth[own][:, None])
            best.add(own, np.where(out, -np.inf, scores), c.ids[lo:hi][cols])


def _shards(asked: DataFrame, d: int, turn: np.ndarray, seed: tuple[np.ndarray, np.ndarray, np.ndarray], k: int, shard: int) -> list[tuple[list[str], float]]:
    """(files, shortest candidate that can matter) of each shard of the queries (row, vec_id, q).

    Files of few queries share a shard, so their number does not follow the number of partitions.
    """
    spark = asked.sparkSession

    def seeded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = Vectors(*seed, turn)
        for batch in batches:
            q = Vectors(np.asarray(batch.column(0)), np.asarray(batch.column(1)), _dense(batch.column(2), d), turn)
            best = Best(np.full(len(q.row), -np.inf), k)
            search(q, first, best)
            need = np.where(best.kth > 0, (best.kth - 1e-6) / np.maximum(q.norm, 1e-9) * (1 - 1e-9), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(best.kth), pa.array(need)], names=["row", "vec_id", "q", "floor", "need"])

    known = materialize(asked.select("row", "vec_id", "q").mapInArrow(lean(seeded), "row long, vec_id long, q array<double>, floor double, need double"), "queries")
    folder = scratch(spark, "shards")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def out() -> pa.RecordBatch:
            nonlocal held
            row, ids, x, floor, need = (np.concatenate(c) for c in zip(*held, strict=True))
            held = [tuple(c[shard:] for c in (row, ids, x, floor, need))]
            path, data = f"{folder}/{uuid.uuid4().hex}", io.BytesIO()
            np.savez(data, row=row[:shard], ids=ids[:shard], x=x[:shard], floor=floor[:shard])
            with open_uri(path, "w") as f:
                f.write(data.getvalue())
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([float(need[:shard].min())]), pa.array([len(row[:shard])])], names=["path", "need", "n"])

        for batch in batches:
            held.append((np.asarray(batch.column(0)), np.asarray(batch.column(1)), _dense(batch.column(2), d), np.asarray(batch.column(3)), np.asarray(batch.column(4))))
            while sum(len(h[0]) for h in held) >= shard:
                yield out()
        if sum(len(h[0]) for h in held):
            yield out()

    parts = max(1, -(-known.count() // shard))
    ordered = known.repartitionByRange(parts, F.desc("need"), "row").sortWithinPartitions(F.desc("need"), "row")
    manifest = materialize(ordered.mapInArrow(lean(run), "path string, need double, n long"), "shard-manifest")  # only committed attempts
    out: list[tuple[list[str], float]] = []
    room = 0
    for r in manifest.orderBy(F.desc("need"), "path").collect():  # a row for each file
        if r.n > room:
            out.append(([], 0.0))
            room = shard
        out[-1] = ([*out[-1][0], r.path], r.need)
        room -= r.n
    return out


def _loaded(path: str) -> dict[str, np.ndarray]:
    with open_uri(path, "r") as f:
        return dict(np.load(io.BytesIO(f.read())))


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each row whose id ``every`` divides."""
    spark = vectors.sparkSession
    ship_package(spark)
    q = materialize(quantised(vectors, scale), "quantised")
    d = max(q.agg(F.max(F.size("q"))).first()[0] or 1, 1)
    turn = rotation(q, d)
    longest = q.orderBy(F.desc("norm"), "row").limit(SEED).select("row", "vec_id", "q").toPandas()  # fixed size
    x = np.zeros((len(longest), d))
    for i, v in enumerate(longest.q):
        x[i, : len(v)] = v
    seed = (longest.row.to_numpy(np.int64), longest.vec_id.to_numpy(np.int64), x)

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = q.repartitionByRange(parts, F.desc("norm"), "row").sortWithinPartitions(F.desc("norm"), "row")
    candidates = materialize(_packed(ordered, d, block), "candidates")

    def scan(paths: list[str], need: float) -> DataFrame:
        """query_row, query_id, vec_id, score of what each task's blocks give the queries of a shard."""

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            queries = best = None
            for batch in batches:
                for rows, ids, vecs in zip(*(batch.column(i) for i in range(3)), strict=True):
                    if queries is None:
                        held = [_loaded(path) for path in paths]
                        row, own, x, floor = (np.concatenate([h[c] for h in held]) for c in ("row", "ids", "x", "floor"))
                        queries, best = Vectors(row, own, x, turn), Best(floor, k)
                    search(queries, Vectors.of(rows.as_py(), ids.as_py(), vecs.as_py(), d, turn), best)
            if queries is not None:
                r, col = np.nonzero(np.isfinite(best.score))
                columns = (queries.row[r], queries.ids[r], best.ids[r, col], best.score[r, col].astype(np.int64))
                for lo in range(0, len(r), 1 << 17):
                    yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + (1 << 17)]) for c in columns], names=["query_row", "query_id", "vec_id", "score"])

        return candidates.where(F.col("longest") >= need).select("rows", "ids", "vecs").mapInArrow(lean(meet), "query_row long, query_id long, vec_id long, score long")

    def ranked(found: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    shards = _shards(q.where(F.col("vec_id") % every == 0), d, turn, seed, k, shard)
    jobs = [ranked(reduce(DataFrame.unionByName, [scan(*s) for s in shards[lo : lo + SCANS]])) for lo in range(0, len(shards), SCANS)]
    if not jobs:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if len(jobs) > 1:
        jobs = [materialize(j, "top") for j in jobs]
    return reduce(DataFrame.unionByName, jobs)


def op4(spark, sf_dir: str) -> DataFrame:
    from lexatlas.runtime import table

    return top_k(table(spark, sf_dir, "embeddings"))


OP4_SQL = """
with f as (
  select row_number() over () as row, vec_id, list_transform(embedding, lambda x: floor(x::double * 64)) as q
  from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
v as (select row, vec_id, list_resize(q, (select max(len(q)) from f), 0.0) as q from f),
s as (
  select a.row, a.vec_id as query_id, b.vec_id, coalesce(list_inner_product(a.q, b.q), 0)::bigint as score
  from v a join v b on a.row <> b.row where a.vec_id % 20 = 0)
select query_id, rank::int as rank, vec_id, score
from (select *, row_number() over (partition by row order by score desc, vec_id) as rank from s)
where rank <= 20
"""
