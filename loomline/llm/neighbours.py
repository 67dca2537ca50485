"""Operator 10: approximate nearest neighbours by multiprobe p-stable hashing.

Method: vectors get one more component so that the largest inner product is the smallest Euclidean distance. Each of
TABLES tables cuts k random projections into cells of one width. A query visits a table's cells in the order of their
estimated success (the chance that a neighbour, at a distance learned from a sample, falls in the cell) until the
table's share of the wanted recall is reached; candidates of all tables are ranked by the exact inner product.

k grows with the logarithm of the number of vectors, so that a cell keeps about CELL of them, and is 1 at least. Vectors of
another length than a query's have no inner product with it, so each length has tables of its own. A cell with more is cut
into blocks; queries of a cell stream past one block at a time. Equal vectors are one candidate with its smallest ids,
of which no query can need more than it wants neighbours (and one more for itself).
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.llm import common

TABLES, CELL, WIDTH = 6, 2048, 1.2
#: Estimated recall to reach (the estimate is of one neighbour, and the distance is the farthest wanted one's).
RECALL = 0.97
#: Vectors of which distances are learned, and how many of them are queries there.
SAMPLE, SAMPLE_QUERIES = 4096, 64


def usable(vector: Column) -> Column:
    """Not null, not empty, all components finite, and not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _vectors(column: pa.ListArray) -> list[np.ndarray]:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.split(flat, np.cumsum(pc.list_value_length(column).to_numpy())[:-1]) if len(column) else []


def _by_length(column: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each length of vectors in a column, the places of those that have it, and their matrix."""
    vectors, lengths = _vectors(column), pc.list_value_length(column).to_numpy()
    for size in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == size)
        yield size, at, np.array([vectors[i] for i in at])


def exact_scores(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision, the same for equal rows wherever they stand."""
    return np.add.reduce(np.ascontiguousarray(vectors * query), axis=1)


class Tables:
    def __init__(self, size: int, k: int, longest: float, distance: float):
        rng = np.random.RandomState(2)
        self.k, self.longest, self.distance, self.width = k, longest, distance, WIDTH * longest
        self.directions = rng.standard_normal((TABLES, size + 1, k))
        self.shift = rng.uniform(0, self.width, (TABLES, k))

    def _places(self, vectors: np.ndarray, last: np.ndarray) -> np.ndarray:
        return np.einsum("nd,tdk->tnk", np.column_stack([vectors, last]), self.directions) + self.shift[:, None, :]

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        """The cell of each vector in each table, as one number."""
        rest = np.sqrt(np.maximum(0.0, self.longest**2 - (vectors**2).sum(axis=1)))
        return self._number(np.floor(self._places(vectors, rest) / self.width).astype(np.int64))

    @staticmethod
    def _number(cells: np.ndarray) -> np.ndarray:
        out = np.zeros(cells.shape[:-1], np.uint64)
        with np.errstate(over="ignore"):
            for j in range(cells.shape[-1]):
                out = (out ^ cells[..., j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                out ^= out >> np.uint64(29)
        return out.view(np.int64)

    def probes(self, queries: np.ndarray, recall: float) -> list[list[np.ndarray]]:
        """For each query and table: cells by estimated success, until recall is reached over all tables."""
        share = 1 - (1 - recall) ** (1 / TABLES)
        norms = np.linalg.norm(queries, axis=1, keepdims=True)
        # Neighbours of a query are those of its multiple with the longest vector's length.
        places = self._places(queries / norms * self.longest, np.zeros(len(queries)))
        return [[self._ordered(places[t, n] / self.width, share) for t in range(TABLES)] for n in range(len(queries))]

    def _ordered(self, place: np.ndarray, share: float) -> np.ndarray:
        if not self.k:
            return np.zeros(1, np.int64)
        reach = 2 + int(4 * self.distance / self.width)
        scale = self.width / (self.distance * math.sqrt(2))
        options = []
        for x in place.tolist():
            cells = range(math.floor(x) - reach, math.floor(x) + reach + 1)
            options.append(sorted(((0.5 * (math.erf((c + 1 - x) * scale) - math.erf((c - x) * scale)), c) for c in cells), reverse=True))
        first = (0,) * self.k
        heap, seen, out, total = [(-math.prod(o[0][0] for o in options), first)], {first}, [], 0.0
        while heap and total < share:
            chance, at = heapq.heappop(heap)
            total -= chance
            out.append([o[i][1] for o, i in zip(options, at, strict=True)])
            for j in range(self.k):
                if at[j] + 1 < len(options[j]):
                    following = at[:j] + (at[j] + 1,) + at[j + 1 :]
                    if following not in seen:
                        seen.add(following)
                        heapq.heappush(heap, (-math.prod(o[i][0] for o, i in zip(options, following, strict=True)), following))
        return self._number(np.array(out, np.int64))


def _fit(distinct: DataFrame, wanted: int) -> dict[int, Tables]:
    """Tables of each length of vectors. The driver gets two numbers of each length and, to learn the distance of
    neighbours from, at most SAMPLE vectors in all (64 of each length)."""
    squares = F.aggregate(F.transform("vector", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, b: a + b)
    sizes = distinct.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("n"), F.sqrt(F.max(squares)).alias("longest")).collect()
    each = max(64, SAMPLE // max(1, len(sizes)))
    place = F.row_number().over(Window.partitionBy(F.size("vector")).orderBy(F.xxhash64("vector"), "vector"))
    samples: dict[int, list] = {}
    for r in distinct.select("vector").withColumn("place", place).filter(F.col("place") <= each).orderBy("place").select("vector").collect():
        samples.setdefault(len(r.vector), []).append(r.vector)
    out = {}
    for r in sizes:
        x = np.array(samples[r["size"]], dtype=np.float64)
        q = x[:SAMPLE_QUERIES]
        products = np.sort((q / np.linalg.norm(q, axis=1, keepdims=True) * r.longest) @ x.T, axis=1)
        far = products[:, -1 - min(wanted, len(x) - 1)]  # of its own vector's too
        distance = math.sqrt(max(1e-6, float(np.median(2 * r.longest**2 - 2 * far))))
        # Where every vector is wanted by every query, no projection could leave one out.
        k = max(1, math.ceil(math.log(r.n / CELL) / math.log(5))) if r.n > wanted + 1 else 0
        out[r["size"]] = Tables(r["size"], k, float(r.longest), distance)
    return out


PAIRS = "query_id long, found array<struct<less:double,vec_id:long>>"
_CELLS = pa.list_(pa.struct([("t", pa.int64()), ("cell", pa.int64())]))
_PAIR = pa.list_(pa.struct([("less", pa.float64()), ("vec_id", pa.int64())]))


def nearest(vectors: DataFrame, queries: DataFrame, folder: str, wanted: int = 20, recall: float = RECALL, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row of queries the wanted nearest rows of vectors found.

    Nearness is the largest inner product in double precision, ties go to the smaller id; a query's own id is no
    candidate. Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without
    id. Candidates of a query are vectors of its own length. Repeated rows count once. Empty tables give an empty result. Only the two
    named columns are read. Tables for the run are written to folder.
    """
    spark = vectors.sparkSession
    named = lambda df: df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector")).filter(F.col("vec_id").isNotNull() & usable(F.col("vector"))).distinct()
    rows, asked = named(vectors), named(queries)
    # Spark cuts each task's rows to the first ones of a vector before they are dealt out.
    place = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    distinct = rows.withColumn("place", place).filter(F.col("place") <= wanted + 1).groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    distinct = common.written(distinct, f"{folder}/vectors", compression="none")
    shared = spark.sparkContext.broadcast(_fit(distinct, wanted))  # TABLES * size * k numbers of each size

    # Tables of all lengths are numbered in one row.
    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list = [None] * batch.num_rows
            for size, at, x in _by_length(batch.column(0)):
                for i, own in zip(at.tolist(), shared.value[size].cells(x).T.tolist(), strict=True):
                    out[i] = [{"t": size * TABLES + t, "cell": c} for t, c in enumerate(own)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, _CELLS)], names=["vector", "ids", "cells"])

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, None, rows=200):
                out: list = [[] for _ in range(part.num_rows)]
                for size, at, x in _by_length(part.column(1)):
                    if size in shared.value:
                        for i, own in zip(at.tolist(), shared.value[size].probes(x, recall), strict=True):
                            out[i] = [{"t": size * TABLES + t, "cell": c} for t, cells in enumerate(own) for c in cells.tolist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, _CELLS)], names=["vec_id", "vector", "cells"])

    kind = distinct.schema["vector"].dataType.simpleString()
    places = "cells array<struct<t:long,cell:long>>"
    entries = distinct.mapInArrow(cells, f"vector {kind}, ids array<long>, {places}").select("vector", "ids", F.inline("cells"))
    blocks = entries.groupBy("t", "cell").agg(F.ceil(F.count("*") / (4 * CELL)).cast("int").alias("n_blocks"))
    blocks = common.written(blocks, f"{folder}/cells")
    visits = asked.mapInArrow(probes, f"vec_id long, vector {kind}, {places}").select("vec_id", "vector", F.inline("cells"))
    visits = visits.join(blocks, ["t", "cell"]).select("t", "cell", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("block"), F.lit(1).alias("side"), "vector", F.array("vec_id").alias("ids"))
    own_block = F.pmod(F.xxhash64("vector"), F.col("n_blocks")).cast("int")
    held = entries.join(blocks, ["t", "cell"]).select("t", "cell", own_block.alias("block"), F.lit(0).alias("side"), "vector", "ids")
    met = held.unionByName(visits).repartition(common.partitions(spark), "t", "cell", "block").sortWithinPartitions("t", "cell", "block", "side")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, part, own, matrix = None, [], [], None

        def answer(questions: list) -> pa.RecordBatch:
            q = np.array([v for v, _ in questions], dtype=np.float64)
            scores = q @ matrix.T
            # One more than wanted, as one may be the query itself; what the two ways to sum can differ by is allowed for.
            keep = min(wanted + 1, len(own))
            size = q.shape[1]
            slack = 4 * size * np.finfo(np.float64).eps * np.linalg.norm(q, axis=1) * shared.value[size].longest
            least = np.partition(scores, len(own) - keep, axis=1)[:, len(own) - keep] - slack
            best = [np.flatnonzero(s >= x) for s, x in zip(scores, least, strict=True)]
            out = []
            for n, (_, query_id) in enumerate(questions):
                exact = exact_scores(matrix[best[n]], q[n])
                found = heapq.nsmallest(wanted, ((-s, i) for s, b in zip(exact.tolist(), best[n].tolist(), strict=True) for i in own[b] if i != query_id))
                out.append([{"less": s, "vec_id": i} for s, i in found])
            return pa.RecordBatch.from_arrays([pa.array([i for _, i in questions], pa.int64()), pa.array(out, _PAIR)], names=["query_id", "found"])

        asking: list = []
        for batch in batches:
            columns = [_vectors(c) if k == 4 else c.to_pylist() for k, c in enumerate(batch.columns)]
            for t, cell, block, side, vector, ids in zip(*columns, strict=True):
                if (t, cell, block) != key:
                    if asking:
                        yield answer(asking)
                    key, part, own, matrix, asking = (t, cell, block), [], [], None, []
                if side == 0:
                    part.append(vector)
                    own.append(ids)
                    continue
                if matrix is None:
                    matrix = np.array(part, dtype=np.float64)
                asking.append((vector, ids[0]))
                if len(asking) == 512:
                    yield answer(asking)
                    asking = []
        if asking:
            yield answer(asking)

    # As many lists of wanted neighbours as a query visits cells; a neighbour found in several tables stands side by side.
    found = met.mapInArrow(rank, PAIRS).groupBy("query_id").agg(F.sort_array(F.flatten(F.collect_list("found"))).alias("found"))
    once = F.filter("found", lambda x, k: (k == 0) | (x != F.get("found", k - 1)))
    best = found.select("query_id", F.posexplode(F.slice(once, 1, wanted)).alias("p", "x"))
    return best.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.less")).alias("score"))
