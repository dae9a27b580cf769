"""Nearest neighbours by learned partitions: a balanced cut of a neighbour graph, a small classifier that routes, exact reranking.

Vectors that are null, zero, of another than the most frequent length (ties: the shortest), or that hold
null or non-finite components take no part; neither do rows with a null id. A query never meets rows of its
own id; repeated rows of other ids are candidates each, but rows of one id and vector ask once. Where an id has several
vectors, each of them asks, and the ranks are those of all that they found. Other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.llm.common import stored, table

SAMPLE = 4096        # vectors, at most, on which graph, partitions and classifier are fitted; every vector is indexed
PARTS = 32
GRAPH = 10           # neighbours of a vertex of the graph
SLACK = 0.05         # a partition of the sample may exceed the mean by so much
GOAL = 0.95          # recall on the sample that sets the number of partitions a query visits
TRIALS = 512         # sample queries that measure it
NEAREST = 20
CANDIDATE_BLOCK = 4096
QUERY_BLOCK = 1024


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k vertices of largest inner product with each one."""
    k = min(k, len(x) - 1)
    out = np.zeros((len(x), k), dtype=np.int64)
    for a in range(0, len(x), 1024):
        s = x[a:a + 1024] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        out[a:a + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k] if k else out[a:a + 1024]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, slack: float = SLACK, sweeps: int = 12, seed: int = 5) -> np.ndarray:
    """Part of each vertex: halves along principal axes, then moves along edges that lower the cut while no part outgrows its room."""
    part = np.zeros(len(x), dtype=np.int64)
    groups, width = [np.arange(len(x))], 1
    while width < parts:
        halves = []
        for g in groups:
            y = x[g] - x[g].mean(axis=0)
            axis = np.linalg.svd(y, full_matrices=False)[2][0] if len(g) > 1 else np.zeros(x.shape[1])
            order = g[np.argsort(y @ axis, kind="stable")]
            halves += [order[:len(order) // 2], order[len(order) // 2:]]
        groups, width = halves, width * 2
    for p, g in enumerate(groups):
        part[g] = p
    near: list[list[int]] = [list(row) for row in graph]
    for v, row in enumerate(graph):
        for u in row:
            near[u].append(v)
    room = int(np.ceil(len(x) / width * (1 + slack)))
    size = np.bincount(part, minlength=width)
    rng = np.random.default_rng(seed)
    for _ in range(sweeps):
        moved = 0
        for v in rng.permutation(len(x)):
            links = np.bincount(part[near[v]], minlength=width)
            links[(size >= room) & (np.arange(width) != part[v])] = -1
            to = int(np.argmax(links))
            if links[to] > links[part[v]]:
                size[part[v]] -= 1
                size[to] += 1
                part[v] = to
                moved += 1
        if not moved:
            break
    return part


def train_router(x: np.ndarray, part: np.ndarray, parts: int, rounds: int = 150, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Softmax regression from a direction to its part, by Adam on the whole sample."""
    w, b = np.zeros((x.shape[1], parts)), np.zeros(parts)
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)]
    truth = np.zeros((len(x), parts))
    truth[np.arange(len(x)), part] = 1
    for t in range(1, rounds + 1):
        z = x @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        d = (p - truth) / len(x)
        for value, grad, m, v in ((w, x.T @ d + 1e-5 * w, state[0], state[1]), (b, d.sum(axis=0), state[2], state[3])):
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            value -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return w, b


class Router:
    """Fitted on a bounded sample; routes any vector to its most probable partitions."""

    def __init__(self, sample: np.ndarray, parts: int = PARTS, goal: float = GOAL, nearest: int = NEAREST) -> None:
        x = unit(sample.astype(np.float64))
        parts = min(parts, 1 << max(0, int(np.log2(max(1, len(x) // 8)))))
        self.parts, self.visits = parts, parts
        self.w, self.b = np.zeros((x.shape[1], parts)), np.zeros(parts)
        if parts == 1:
            return
        self.w, self.b = train_router(x, balanced_parts(x, neighbour_graph(x, GRAPH), parts), parts)
        self.visits = self.calibrated(sample.astype(np.float64), goal, nearest)

    def order(self, x: np.ndarray) -> np.ndarray:
        """Partitions by falling probability."""
        return np.argsort(-(unit(x) @ self.w + self.b), axis=1, kind="stable")

    def calibrated(self, x: np.ndarray, goal: float, nearest: int) -> int:
        """The least number of visits with which sample queries find ``goal`` of their exact sample neighbours.

        Neighbours in the sample lie farther off than those in all rows, so the estimate is on the safe side.
        """
        order = self.order(x)
        home, trials = order[:, 0], np.arange(min(TRIALS, len(x)))
        s = x[trials] @ x.T
        s[trials, trials] = -np.inf
        k = min(nearest, len(x) - 1)
        best = np.argpartition(-s, k - 1, axis=1)[:, :k]
        rank = np.argsort(order[trials], axis=1)
        needed = np.take_along_axis(rank, home[best], axis=1)
        found = np.array([(needed < t).mean() for t in range(1, self.parts + 1)])
        return int(np.argmax(found >= goal)) + 1


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v) of the rows that take part; v holds doubles."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).filter("vec_id is not null and v is not null")
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.filter(F.coalesce(sound, F.lit(False)))
    top = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    return rows.filter(F.size("v") == (top["d"] if top else 0))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), dtype=np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def routed(rows: DataFrame, router: Router, visits: int) -> DataFrame:
    """(vec_id, v, part): one row for each of a vector's ``visits`` most probable partitions."""
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                parts = router.order(matrix(b.column(1)))[:, :visits]
                at = pa.array(np.repeat(np.arange(b.num_rows), visits))
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(parts.reshape(-1), pa.int32())], names=["vec_id", "v", "part"])

    return rows.mapInArrow(assign, "vec_id long, v array<double>, part int")


def blocks_of(counts: dict[int, int], rows: int):
    """Number of blocks of a partition as a column: a crowded partition is split, so that no task holds more than about ``rows`` of it."""
    out = F.lit(1)
    for part, n in counts.items():
        out = F.when(F.col("part") == part, F.lit(max(1, -(-n // rows)))).otherwise(out)
    return out


def rerank(queries: pa.Table, candidates: pa.Table, nearest: int = NEAREST) -> pa.Table:
    """The nearest candidates of each query by exact inner products; ties at the limit are settled by the smaller id."""
    names = ["query_id", "vec_id", "score"]
    if not queries.num_rows or not candidates.num_rows:
        return pa.Table.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
    qid, cid = queries["vec_id"].to_numpy(), candidates["vec_id"].to_numpy()
    q, c = matrix(queries["v"]), matrix(candidates["v"])
    s = q @ c.T
    blur = 1e-13 * q.shape[1] * np.linalg.norm(q, axis=1) * np.linalg.norm(c, axis=1).max()
    out: list[tuple] = []
    for i in range(len(q)):
        row = np.where(cid == qid[i], -np.inf, s[i])
        k = min(nearest, len(row))
        limit = np.partition(row, len(row) - k)[len(row) - k] - blur[i]
        at = np.flatnonzero((row >= limit) & (cid != qid[i]))
        exact = (c[at] * q[i]).sum(axis=1)   # the same sum for equal vectors, wherever they stand
        best = np.lexsort((cid[at], -exact))[:nearest]
        out.append((np.full(len(best), qid[i]), cid[at][best], exact[best]))
    return pa.Table.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=names)


def search(vectors: DataFrame, is_query, nearest: int = NEAREST, parts: int = PARTS, goal: float = GOAL) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest found of each row that ``is_query`` (a column of vec_id) selects."""
    rows = usable(vectors)
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    if not drawn.num_rows:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    router = Router(matrix(drawn["v"]), parts, goal, nearest)
    index = stored(routed(rows, router, 1))
    asked = stored(routed(rows.filter(is_query).dropDuplicates(["vec_id", "v"]), router, router.visits))
    counts = {r["part"]: r["n"] for r in index.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}     # at most PARTS rows each
    asks = {r["part"]: r["n"] for r in asked.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    c_blocks, q_blocks = blocks_of(counts, CANDIDATE_BLOCK), blocks_of(asks, QUERY_BLOCK)
    here, salt = F.pmod(F.xxhash64("vec_id"), c_blocks).cast("int"), F.pmod(F.xxhash64("vec_id", F.lit(1)), q_blocks).cast("int")
    index = index.withColumn("cb", here).withColumn("qb", F.explode(F.sequence(F.lit(0), q_blocks - 1)))
    asked = asked.withColumn("qb", salt).withColumn("cb", F.explode(F.sequence(F.lit(0), c_blocks - 1)))
    keys = ["part", "qb", "cb"]
    found = asked.groupBy(*keys).cogroup(index.groupBy(*keys)).applyInArrow(lambda a, b: rerank(a, b, nearest), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
