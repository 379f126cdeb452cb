"""Exact top-k search by inner product over norm-sorted, rotated vectors.

Vectors are turned into integers, rotated onto the right singular vectors of the
whole table and laid in blocks of descending length. A query's score with any
vector is at most the partial product over the leading dimensions plus the
product of the two residual lengths (Cauchy-Schwarz); vectors whose bound stays
below the query's k-th best score so far are passed over, and a block ends as
soon as the lengths alone settle it. Survivors are scored exactly in integers.

Blocks come in waves, the longest vectors first. Before each wave a small table
of lengths and floors tells which blocks of queries a block of vectors can still
better; no other pair of blocks is brought together, and what a wave finds
raises the floors for the next.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .storage import Scratch

_EXACT = float(1 << 52)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(-1, dims)


def _prepare(scale: int, dims: int):
    """Integer vectors, zero-padded to ``dims``, of the rows that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, norms = [], [], []
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                v = x.values if x.is_valid else None
                if i is None or v is None or v.null_count:
                    continue
                v = np.asarray(v, dtype=np.float64)
                if np.isfinite(v).all():
                    out = np.zeros(dims, np.int64)
                    out[: len(v)] = np.floor(v * scale)
                    ids.append(i)
                    rows.append(out.tobytes())
                    norms.append(float(np.sqrt((out.astype(np.float64) ** 2).sum())))
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(rows, pa.binary()), pa.array(norms, pa.float64())], ["vec_id", "ints", "norm"])

    return run


def _gram(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in batches:
            x = _matrix(batch.column(0), dims).astype(np.float64)
            total += x.T @ x
        i, j = np.divmod(np.arange(dims * dims, dtype=np.int32), dims)
        yield pa.record_batch([pa.array(i), pa.array(j.astype(np.int32)), pa.array(total.ravel())], ["i", "j", "x"])

    return run


def _blocks(dims: int, rows: int):
    """Packed blocks of a partition's vectors in the order they come, longest first, with the greatest length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0

        def packed() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            return pa.record_batch([pa.array([np.asarray(t.column(0)).tobytes()], pa.binary()), pa.array([b"".join(t.column(1).to_pylist())], pa.binary()), pa.array([t.column(2)[0].as_py()], pa.float64())], ["ids", "ints", "most"])

        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                if n + part.num_rows > rows and held:
                    yield packed()
                    held, n = [], 0
                held.append(part)
                n += part.num_rows
        if n:
            yield packed()

    return run


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows of a with all of b."""
    if len(a) and len(b) and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < _EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _search(dims: int, k: int, lead: int, rotation: bytes, step: int = 512):
    """Top k of one block for each query of one query block."""
    turn = np.frombuffer(rotation, np.float64).reshape(dims, dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, x = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["ints"], np.int64).reshape(-1, dims)
                qids, q = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["q_ints"], np.int64).reshape(-1, dims)
                floor = np.frombuffer(row["floor"], np.int64).astype(np.float64)
                xf, qf = x.astype(np.float64), q.astype(np.float64)
                xr, qr = xf @ turn, qf @ turn
                xn, qn = np.sqrt((xf**2).sum(1)), np.sqrt((qf**2).sum(1))
                rest = lambda m: np.sqrt((m[:, lead:] ** 2).sum(1))
                xe, qe = rest(xr), rest(qr)
                best: list[list[tuple[int, int]]] = [[] for _ in qids]
                slack = 1e-6 * (1.0 + float(qn.max(initial=0)) * float(xn.max(initial=0)))
                for at in range(0, len(ids), step):
                    part = slice(at, at + step)
                    live = np.flatnonzero(qn * xn[at] + slack >= floor)
                    if not len(live):
                        break
                    bound = qr[live, :lead] @ xr[part, :lead].T + np.outer(qe[live], xe[part]) + slack
                    hit = bound >= floor[live, None]
                    cols = np.flatnonzero(hit.any(axis=0))
                    if not len(cols):
                        continue
                    exact = _products(q[live], x[at + cols])
                    for r, i in enumerate(live):
                        ok = cols[(exact[r] >= floor[i]) & (ids[at + cols] != qids[i])]
                        if not len(ok):
                            continue
                        s = exact[r][np.searchsorted(cols, ok)]
                        top = sorted([*best[i], *zip((-s).tolist(), ids[at + ok].tolist(), strict=True)])[:k]
                        best[i] = top
                        if len(top) == k:
                            floor[i] = max(floor[i], -top[-1][0])
                found = [(int(qids[i]), v, -s) for i, b in enumerate(best) for s, v in b]
                cols3 = list(zip(*found, strict=True)) if found else [[], [], []]
                yield pa.record_batch([pa.array(c, pa.int64()) for c in cols3], ["query_id", "vec_id", "score"])

    return run


_NO_FLOOR = np.iinfo(np.int64).min // 2


def _floors(dims: int, k: int, seeds: tuple[bytes, bytes]):
    """Queries with the k-th best exact score among the seed vectors as ``floor``."""
    sid, sx = np.frombuffer(seeds[0], np.int64), np.frombuffer(seeds[1], np.int64).reshape(-1, dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                qids = np.asarray(part.column(0))
                floor = np.full(len(qids), _NO_FLOOR, np.int64)
                score = _products(_matrix(part.column(1), dims), sx)
                for i in range(len(qids)):
                    s = score[i][sid != qids[i]]
                    if len(s) >= k:
                        floor[i] = np.partition(s, len(s) - k)[len(s) - k]
                yield pa.record_batch([part.column(0), part.column(1), part.column(2), pa.array(floor)], ["vec_id", "ints", "norm", "floor"])

    return run


def _packed_queries(table: pa.Table) -> pa.Table:
    """One block of queries, with its greatest length and its least floor."""
    floor = np.asarray(table.column("floor").combine_chunks())
    col = lambda x: pa.array([x], pa.binary())
    return pa.table({
        "qb": table.column("qb").slice(0, 1), "q_ids": col(np.asarray(table.column("vec_id").combine_chunks()).tobytes()), "q_ints": col(b"".join(table.column("ints").to_pylist())),
        "floor": col(floor.tobytes()), "q_most": pa.array([max(table.column("norm").to_pylist())]), "least": pa.array([float(floor.min())]),
    })


@dataclass(frozen=True)
class InnerProductTopK:
    """Exact best ``k`` rows of each query by integer inner product.

    Input: ``vec_id`` (long), ``embedding`` (array of numbers); other columns
    are ignored. Each component x becomes ``floor(scale * x)``. Vectors null or
    with null or non-finite components, and rows without vec_id, take no part;
    shorter vectors count as padded with zeros. Rows repeated exactly count
    once; a query never meets rows of its own vec_id. Ties go to the smaller
    vec_id. Fewer than k other rows give them all; an empty table gives none.
    """

    k: int = 10
    every: int = 100
    scale: int = 1024
    lead: int = 16
    block: int = 4096
    query_block: int = 1024
    seeds: int = 2048
    #: Shares of all blocks, longest first, that the waves before the last take.
    waves: tuple[float, ...] = (0.02, 0.15)

    def search(self, vectors: DataFrame, scratch: Scratch | None = None) -> DataFrame:
        spark = vectors.sparkSession
        scratch = scratch or Scratch(spark, "topk")
        vectors = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
        dims = vectors.agg(F.max(F.size("embedding"))).first()[0] or 0
        schema = "query_id long, rank int, vec_id long, score long"
        if dims <= 0:
            return spark.createDataFrame([], schema)
        rows = scratch.write(vectors.mapInArrow(_prepare(self.scale, dims), "vec_id long, ints binary, norm double").dropDuplicates(["vec_id", "ints"]), "rows")
        total, queries = rows.agg(F.count("*"), F.count_if(F.col("vec_id") % self.every == 0)).first()
        if not queries:
            return spark.createDataFrame([], schema)
        gram = np.zeros((dims, dims))
        for r in rows.select("ints").mapInArrow(_gram(dims), "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect():  # dims squared rows
            gram[r["i"], r["j"]] = r["x"]
        turn = np.linalg.eigh((gram + gram.T) / 2)[1][:, ::-1].copy()
        top = scratch.write(rows.orderBy(F.desc("norm"), "vec_id").limit(self.seeds).select("vec_id", "ints"), "seeds").collect()  # a fixed number of rows
        seeds = (np.array([r["vec_id"] for r in top], np.int64).tobytes(), b"".join(bytes(r["ints"]) for r in top))
        bars, cols = -(-queries // self.query_block), -(-total // self.block)
        found_schema = "query_id long, vec_id long, score long"
        asked = rows.where(F.col("vec_id") % self.every == 0).select("vec_id", "ints", "norm").mapInArrow(_floors(dims, self.k, seeds), "vec_id long, ints binary, norm double, floor long")
        asked = scratch.write(asked.withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.lit(bars)).cast("int")), "asked")
        ranged = rows.repartitionByRange(cols, F.desc("norm"), "vec_id").sortWithinPartitions(F.desc("norm"), "vec_id")
        blocks = scratch.write(ranged.mapInArrow(_blocks(dims, self.block), "ids binary, ints binary, most double").withColumn("at", F.monotonically_increasing_id()), "blocks")
        limits = [float("-inf")]
        if cols > 1:
            # lengths at which the waves end; by rank of the blocks' greatest lengths, a number a block
            limits = [*blocks.agg(F.percentile_approx("most", [1 - w for w in self.waves], 10_000)).first()[0], float("-inf")]
        over, best, order = float("inf"), None, Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        top_k = lambda df: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= self.k)
        for n, limit in enumerate(limits):
            if limit >= over:
                continue
            floors = asked
            if best is not None:
                reached = best.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") == self.k)
                floors = asked.join(reached.select("vec_id", "kth"), "vec_id", "left").withColumn("floor", F.greatest("floor", F.coalesce("kth", "floor"))).drop("kth")
            queries_ = scratch.write(floors.groupBy("qb").applyInArrow(_packed_queries, "qb int, q_ids binary, q_ints binary, floor binary, q_most double, least double"), f"queries-{n}")
            part = blocks.where((F.col("most") < over) & (F.col("most") >= limit))
            # a number or two a block on either side: which blocks can still better which queries
            can = F.col("q_most") * F.col("most") * (1 + 1e-6) + 1e-3 >= F.col("least")
            pairs = scratch.write(part.select("at", "most").join(queries_.select("qb", "q_most", "least"), can).select("at", "qb"), f"pairs-{n}")
            met = pairs.join(queries_.drop("q_most", "least"), "qb").join(part.drop("most"), "at").select("ids", "ints", "q_ids", "q_ints", "floor")
            found = met.mapInArrow(_search(dims, self.k, min(self.lead, dims), turn.tobytes()), found_schema)
            if best is not None:
                found = found.unionByName(best.select("query_id", "vec_id", "score"))
            best = scratch.write(top_k(found), f"best-{n}")
            over = limit
        scratch.keep(f"best-{n}")
        return best.select("query_id", F.col("rank").cast("int"), "vec_id", "score")
