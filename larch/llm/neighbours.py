"""Nearest neighbours by a block matrix join.

Queries and candidates are dealt to a grid of cells of bounded size.  In a cell, int8 product tiles
give approximate cosines with a bound on the quantisation error; pairs whose upper bound reaches the
k-th best lower bound of their query survive, are recomputed in double precision from the original
vectors, and go through a heap of k by query.  The cells' answers (k rows a query and cell) are
merged by heaps again.  Nothing is approximate in the result: recall is 1.

The error bound: with v = s q + e, |e_i| <= s / 2, the exact product differs from the quantised one
by at most |e_a|.|b| + |a^|.|e_b|, and these norms are computed from the actual errors.

The measure: dot(a, b) / sqrt(dot(a, a) dot(b, b)) in double precision, sums taken from the first component
on, so that any plain loop gives the same bits.  Rows are scaled by powers of two first, which changes no
bit and keeps large and small components from overflowing.

Defined cases: vectors that are null, empty, zero, or with null or non-finite components take no part;
vectors of different lengths are no candidates of each other (each length has its own grid); a null id
takes no part; ties go to the smaller id; repeated ids are candidates each, but never of a query of their
own id; fewer candidates than k give fewer rows; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K = 5
#: Rows of a cell's two sides, and of a product tile's.
QUERY_BLOCK, CANDIDATE_BLOCK, TILE = 8_192, 8_192, 2_048
#: Most tasks of the grid; beyond it a task has several cells, one after another.
MOST_TASKS = 20_000
OUT = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame) -> DataFrame:
    """id, vec (array<double>) of the vectors that take part."""
    v = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("vec")).filter("id is not null and vec is not null")
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.filter(~F.coalesce(bad, F.lit(True)) & F.exists("vec", lambda x: x != 0))


def _scaled(m: np.ndarray) -> np.ndarray:
    """Rows times the power of two that brings their largest component between 1/2 and 1; exact."""
    return np.ldexp(m, -np.frexp(np.abs(m).max(axis=1))[1][:, None]) if len(m) else m


def _unit(m: np.ndarray) -> np.ndarray:
    """Rows of length 1."""
    m = _scaled(m)
    return m / np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of rows, summed from the first component on."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d] * b[:, d]
    return out


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes, scale, norm of the rounded vector, norm of the error) of unit rows."""
    scale = np.abs(unit).max(axis=1) / 127
    code = np.rint(unit / scale[:, None]).astype(np.int8)
    near = code * scale[:, None]
    return code, scale, np.linalg.norm(near, axis=1), np.linalg.norm(unit - near, axis=1)


def search(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int = K) -> list[tuple[int, int, float]]:
    """(query id, candidate id, cosine): the k nearest candidates of each query within one cell."""
    order = np.argsort(cid, kind="stable")
    cid, c = cid[order], c[order]
    # Of equal vectors only the k + 1 smallest ids can be among a query's k nearest (one may be its own).
    if len(cid) > k + 1:
        _, kind = np.unique(c, axis=0, return_inverse=True)
        kind = kind.reshape(-1)
        by = np.argsort(kind, kind="stable")
        head = np.flatnonzero(np.diff(kind[by], prepend=-1))
        nth = np.arange(len(by)) - np.repeat(head, np.diff(np.append(head, len(by))))
        # Repeats of one id are not different candidates of a query with that id.
        keep = np.ones(len(by), dtype=bool)
        if len(np.unique(cid)) == len(cid):
            keep = nth <= k
        c, cid = c[np.sort(by[keep])], cid[np.sort(by[keep])]
    q, c = _scaled(q), _scaled(c)
    qu, cu = _unit(q), _unit(c)
    qq, own = products(q, q), products(c, c)
    qc, qs, qn, qe = quantise(qu)
    dim = q.shape[1]
    step = max(1, (2**24 - 1) // 127**2)  # so many int8 products sum up exactly in float32
    out: list[tuple[int, int, float]] = []
    heaps: list[list] = [[] for _ in qid]
    for at in range(0, len(cid), TILE):
        tile, ids = cu[at : at + TILE], cid[at : at + TILE]
        cc, cs, cn, ce = quantise(tile)
        dot = np.zeros((len(qid), len(ids)), dtype=np.float64 if dim > step else np.float32)
        for d in range(0, dim, step):
            dot += qc[:, d : d + step].astype(np.float32) @ cc[:, d : d + step].astype(np.float32).T
        near = dot * (qs[:, None] * cs[None, :])
        slack = qe[:, None] * 1.0 + qn[:, None] * ce[None, :] + 1e-9
        low = np.where(qid[:, None] == ids[None, :], -np.inf, near - slack)
        bar = np.array([h[0][0] if len(h) >= k else -np.inf for h in heaps])
        if len(ids) >= k:
            bar = np.maximum(bar, np.partition(low, len(ids) - k, axis=1)[:, len(ids) - k])
        i, j = np.nonzero((near + slack >= bar[:, None]) & (qid[:, None] != ids[None, :]))
        for lo in range(0, len(i), 65_536):
            a, b = i[lo : lo + 65_536], j[lo : lo + 65_536]
            exact = products(q[a], c[at + b]) / np.sqrt(qq[a] * own[at + b])
            for x, y, score in zip(a.tolist(), ids[b].tolist(), exact.tolist(), strict=True):
                h = heaps[x]
                if len(h) < k:
                    heapq.heappush(h, (score, -y))
                elif (score, -y) > h[0]:
                    heapq.heapreplace(h, (score, -y))
    for x, h in zip(qid.tolist(), heaps, strict=True):
        out += [(x, -y, score) for score, y in h]
    return out


def _cells(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []

        def close():
            t = pa.Table.from_batches(held)
            ids, vec, side = t["id"].to_numpy(), t["vec"].combine_chunks(), t["side"].to_numpy()
            m = vec.flatten().to_numpy().reshape(len(ids), -1)
            qs = side == 0
            q_ids, q = ids[qs], m[qs]
            for lo in range(0, len(q_ids) if (~qs).any() else 0, TILE):
                got = search(q_ids[lo : lo + TILE], q[lo : lo + TILE], ids[~qs], m[~qs], k)
                yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.float64())], names=["query_id", "vec_id", "score"])

        for batch in batches:
            cells, dims = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero((cells[1:] != cells[:-1]) | (dims[1:] != dims[:-1])) + 1).tolist(), len(cells)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi == lo:
                    continue
                if (cells[lo], dims[lo]) != cell:
                    if held:
                        yield from close()
                    cell, held = (cells[lo], dims[lo]), []
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from close()

    return run


def _merge(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, heap = None, []

        def close():
            best = sorted(heap, reverse=True)
            return [(query, r + 1, -y, s) for r, (s, y) in enumerate(best)]

        for batch in batches:
            done = []
            for x, y, s in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if x != query:
                    done += close()
                    query, heap = x, []
                if len(heap) < k:
                    heapq.heappush(heap, (s, -y))
                elif (s, -y) > heap[0]:
                    heapq.heapreplace(heap, (s, -y))
            yield _answers(done)
        yield _answers(close())

    return run


def _answers(rows: list) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["query_id", "rank", "vec_id", "score"])


def nearest(queries: DataFrame, candidates: DataFrame, k: int = K, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k candidates of largest cosine, its own id excepted.

    Every query meets every candidate once, in the cell of their two blocks: queries travel once per
    candidate block and candidates once per query block, and a cell holds a bounded number of rows.
    """
    q, c = (usable(x).withColumn("dim", F.size("vec")) for x in (queries, candidates))
    # The grid of each length: one row a length that both sides have.
    grid = q.select("dim", F.lit(1).alias("n_q")).unionByName(c.select("dim", F.lit(0).alias("n_q"))).groupBy(F.col("dim").alias("_dim")).agg(F.sum("n_q").alias("n_q"), F.sum(1 - F.col("n_q")).alias("n_c"))
    grid = [(r["_dim"], -(-r["n_q"] // query_block), -(-r["n_c"] // candidate_block)) for r in grid.filter("n_q > 0 and n_c > 0").collect()]
    tasks = max(1, min(MOST_TASKS, sum(rows * cols for _, rows, cols in grid)))
    grid = q.sparkSession.createDataFrame(grid, "_dim int, _rows long, _cols long")
    # A row a length; k lengths take k^2 / 2 components at least, so the grid is smaller than the root of the tables.
    q, c = (x.join(F.broadcast(grid), F.col("dim") == F.col("_dim")) for x in (q, c))
    deal = lambda n: F.pmod(F.xxhash64("id", F.lit(17)), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    q = q.withColumn("_at", each("_cols")).select((F.col("_at") + deal("_rows") * F.col("_cols")).alias("cell"), "dim", F.lit(0).alias("side"), "id", "vec")
    c = c.withColumn("_at", each("_rows")).select((deal("_cols") + F.col("_at") * F.col("_cols")).alias("cell"), "dim", F.lit(1).alias("side"), "id", "vec")
    found = q.unionByName(c).repartition(tasks, "dim", "cell").sortWithinPartitions("dim", "cell").mapInArrow(_cells(k), OUT)
    return found.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(_merge(k), "query_id long, rank int, vec_id long, score double")
