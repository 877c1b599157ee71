"""Nearest neighbours by inner product, over a forest of random-projection trees.

Every tree splits by random directions at the median of a bounded sample (``FIT_ROWS``); every
row is then routed to a leaf of each tree. A query searches all trees at once through one
priority queue, ordered by how far it would have to cross to the wrong side, until the leaves
it has taken hold ``search_share`` of all entries, and enough different ones; it is compared with every row of those
leaves, and the best are scored again in double precision.

Equal vectors are one entry until the end, which keeps as many ids of each as a result can
hold. Leaves are packed into pages of bounded size (a leaf beyond that is cut up), and pages
are copied where very many queries would meet in one, so no task grows with a hot leaf.
A vector's length is made part of it, so that inner products, not angles, decide; each range of
lengths has trees of its own.
"""
from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import map_batches, saved, slices, spark_partitions

FIT_ROWS = 20_000
TREES = 12
LEAF_ROWS = 200
MIN_DEPTH = 6
MAX_DEPTH = 12
# Share of the forest's entries that a query visits. Random vectors without structure need
# this much for a recall above 0.9; it may be lowered for clustered ones.
SEARCH_SHARE = 0.1
# Entries that a query visits in each tree at least, where there are so many.
LEAST_ROWS = 600
# Ratio of the lengths that share a forest.
BAND = 1.25
PAGE_ROWS = 8192
PAGE_QUERIES = 50_000
# Queries whose best a task holds until it sends them on.
HELD_QUERIES = 50_000
# Relative error of a fast product, generously.
_SLACK = 1e-9


@dataclass
class Forest:
    """Complete binary trees: level by level, ``directions`` and ``thresholds`` of all nodes."""
    depth: int
    reach: float
    directions: list[list[np.ndarray]]
    thresholds: list[list[np.ndarray]]

    @property
    def trees(self) -> int:
        return len(self.directions)

    def lifted(self, vectors: np.ndarray) -> np.ndarray:
        """With one more component that makes all lengths ``reach``."""
        rest = self.reach ** 2 - (vectors * vectors).sum(axis=1)
        return np.hstack([vectors, np.sqrt(np.maximum(rest, 0.0))[:, None]])

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """``(rows, trees)`` leaf numbers."""
        lifted = self.lifted(vectors)
        out = np.zeros((len(vectors), self.trees), dtype=np.int64)
        for t in range(self.trees):
            node = out[:, t]
            for level in range(self.depth):
                side = np.einsum(
                    "ij,ij->i", lifted, self.directions[t][level][node]
                ) > self.thresholds[t][level][node]
                node = node * 2 + side
            out[:, t] = node
        return out

    def margins(self, vectors: np.ndarray) -> list[list[np.ndarray]]:
        """Of queries, at all nodes, by tree and level; in shares of ``reach``."""
        lifted = np.hstack([vectors, np.zeros((len(vectors), 1))])
        return [[(lifted @ self.directions[t][level].T - self.thresholds[t][level]) / self.reach
                 for level in range(self.depth)] for t in range(self.trees)]


@dataclass
class Bands:
    """A forest for each range of lengths: lifted to one length, a few long vectors would leave
    all others alike. ``top`` is the greatest length; the entries of a forest, ``tree * width +
    leaf``, follow those of the forest before."""
    top: float
    forests: dict[int, Forest]

    def __post_init__(self) -> None:
        self.base, self.tree_starts = {}, []
        size = 0
        for band, forest in self.forests.items():
            self.base[band] = size
            for _ in range(forest.trees):
                self.tree_starts.append(size)
                size += 1 << forest.depth
        self.size = size

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """``(rows, trees)`` entries."""
        trees = next(iter(self.forests.values())).trees
        out = np.zeros((len(vectors), trees), dtype=np.int64)
        bands = band_of(vectors, self.top)
        for band in np.unique(bands).tolist():
            forest, inside = self.forests[band], bands == band
            out[inside] = (self.base[band] + forest.leaves(vectors[inside])
                           + np.arange(trees) * (1 << forest.depth))
        return out

    def search(
        self, vectors: np.ndarray, sizes: np.ndarray, budget: float, least: int,
    ) -> list[list[int]]:
        """For each query the entries to visit, nearest first, from one queue over the trees of
        all forests, until they hold ``budget`` rows and one tree of each forest, ``least`` rows
        of which are all different, or all it has."""
        found = [(self.base[band], f, f.margins(vectors)) for band, f in self.forests.items()]
        whole = [int(sizes[base:base + (1 << f.depth)].sum()) for base, f, _ in found]
        result = []
        for q in range(len(vectors)):
            queue = [(-math.inf, b, t, 0, 0) for b, (_, f, _) in enumerate(found) for t in range(f.trees)]
            held_by = [[0] * f.trees for _, f, _ in found]
            short = {b for b, n in enumerate(whole) if n}
            taken, held = [], 0
            while queue and (held < budget or short):
                crossed, b, t, level, node = heapq.heappop(queue)
                base, forest, margins = found[b]
                while level < forest.depth:
                    margin = float(margins[t][level][q, node])
                    near, far = (node * 2 + 1, node * 2) if margin > 0 else (node * 2, node * 2 + 1)
                    heapq.heappush(queue, (max(crossed, abs(margin)), b, t, level + 1, far))
                    level, node = level + 1, near
                entry = base + t * (1 << forest.depth) + node
                if sizes[entry]:
                    taken.append(entry)
                    held += int(sizes[entry])
                    held_by[b][t] += int(sizes[entry])
                    if held_by[b][t] >= min(least, whole[b]):
                        short.discard(b)
            result.append(taken)
        return result


def band_of(vectors: np.ndarray, top: float) -> np.ndarray:
    """Which range of lengths each vector falls in, 0 the longest."""
    lengths = np.sqrt((vectors * vectors).sum(axis=1))
    return np.floor(np.log(top / lengths) / math.log(BAND)).astype(np.int64)


def plant(sample: np.ndarray, rows: int, reach: float, trees: int, leaf_rows: int) -> Forest:
    """Trees deep enough for leaves of about ``leaf_rows`` of ``rows`` and for a choice of
    leaves, as far as the sample has a few vectors for each leaf."""
    most = int(math.log2(max(1, len(sample) / 4))) if len(sample) >= 4 else 0
    depth = max(0, min(
        MAX_DEPTH, most, max(MIN_DEPTH, math.ceil(math.log2(max(1.0, rows / leaf_rows))))))
    forest = Forest(depth, reach, [], [])
    random = np.random.default_rng(5)
    lifted = forest.lifted(sample)
    for _ in range(trees):
        node = np.zeros(len(sample), dtype=np.int64)
        directions, thresholds = [], []
        for level in range(depth):
            d = random.normal(size=(1 << level, lifted.shape[1]))
            d /= np.linalg.norm(d, axis=1)[:, None]
            along = np.einsum("ij,ij->i", lifted, d[node])
            cut = np.zeros(1 << level)
            order = np.lexsort((along, node))
            starts = np.searchsorted(node[order], np.arange((1 << level) + 1))
            for k in range(1 << level):
                if starts[k + 1] > starts[k]:
                    cut[k] = np.median(along[order[starts[k]:starts[k + 1]]])
            directions.append(d)
            thresholds.append(cut)
            node = node * 2 + (along > cut[node])
        forest.directions.append(directions)
        forest.thresholds.append(thresholds)
    return forest


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, vec)``: one row per id, of vectors without null or non-finite components, not
    all zero, of the most common length. An id with several vectors has the smallest."""
    good = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).alias("vec")).where(
        F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (
            F.abs(x) < F.lit(math.inf))) & F.exists("vec", lambda x: x != 0))
    common = good.groupBy(F.size("vec").alias("n")).count().orderBy(
        F.desc("count"), F.desc("n")).limit(1).collect()
    if not common:
        return good.limit(0)
    return good.where(F.size("vec") == common[0]["n"]).groupBy("vec_id").agg(
        F.min("vec").alias("vec"))


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column of equally long, complete vectors."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _pages(sizes: np.ndarray, tree_starts: list[int], page_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """First page and number of pages of each leaf: small leaves of one tree share pages, so
    that no page holds a row twice; large leaves have several of their own."""
    first, count = np.zeros(len(sizes), dtype=np.int64), np.ones(len(sizes), dtype=np.int64)
    page = held = 0
    starts = set(tree_starts)
    for entry, size in enumerate(sizes.tolist()):
        if size > page_rows:
            page += held > 0
            first[entry], count[entry] = page, -(-size // page_rows)
            page, held = page + int(count[entry]), 0
            continue
        if held + size > page_rows or (entry in starts and held):
            page, held = page + 1, 0
        first[entry] = page
        held += size
    return first, count


def nearest(
    vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id",
    vector_col: str = "embedding", trees: int = TREES, leaf_rows: int = LEAF_ROWS,
    search_share: float = SEARCH_SHARE, fit_rows: int = FIT_ROWS,
    page_rows: int = PAGE_ROWS, page_queries: int = PAGE_QUERIES,
    least_rows: int = LEAST_ROWS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of each row whose id is
    divisible by ``every``, by inner product, ties to the smaller id, itself left out; all
    there are, if fewer: a query goes on until it has seen ``least_rows`` different entries of
    each range of lengths (``k + 1`` at least), or all. Vectors that ``usable`` leaves out take no part; an empty table or a
    single vector gives no rows."""
    spark = vectors.sparkSession
    rows = saved(usable(vectors, id_col, vector_col))
    # Equal vectors are one entry; k + 1 smallest ids are all a result can show of one.
    ranked = rows.withColumn("_n", F.expr(
        "row_number() OVER (PARTITION BY vec ORDER BY vec_id)")).where(F.col("_n") <= k + 1)
    entries = saved(ranked.groupBy("vec").agg(
        F.min("vec_id").alias("entry"), F.sort_array(F.collect_list("vec_id")).alias("ids")))
    queries = rows.where(F.pmod("vec_id", F.lit(every)) == 0).select(
        F.col("vec_id").alias("query_id"), "vec")
    length = F.sqrt(F.aggregate("vec", F.lit(0.0).cast("double"), lambda s, x: s + x.cast(
        "double") * x.cast("double")))
    facts = entries.agg(F.count(F.lit(1)).alias("n"), F.max(length).alias("reach")).first()
    if not facts["n"]:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    top = facts["reach"] * (1 + 1e-12)

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        matrix = _matrix(batch.column(0))
        lengths = np.sqrt((matrix * matrix).sum(axis=1))
        return pa.RecordBatch.from_arrays(
            [pa.array(band_of(matrix, top)), pa.array(lengths)], names=["band", "length"])

    ranges = map_batches(entries.select("vec"), measure, "band bigint, length double").groupBy(
        "band").agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("reach")).orderBy("band").collect()
    chosen = entries.orderBy(F.xxhash64("entry"), "entry").limit(fit_rows).select("vec").toArrow()
    matrix = _matrix(chosen.column(0).combine_chunks())
    bands = band_of(matrix, top)
    forests = Bands(top, {
        r["band"]: plant(matrix[bands == r["band"]], r["n"], r["reach"] * (1 + 1e-12), trees, leaf_rows)
        for r in ranges})
    slack = _SLACK * facts["reach"] ** 2

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, n = np.unique(forests.leaves(_matrix(batch.column(0))), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], names=["leaf", "n"])

    sizes = np.zeros(forests.size, dtype=np.int64)
    for row in map_batches(entries.select("vec"), count, "leaf bigint, n bigint").groupBy(
            "leaf").agg(F.sum("n").alias("n")).collect():
        sizes[row["leaf"]] = row["n"]
    first, pages = _pages(sizes, forests.tree_starts, page_rows)
    copies = -(-queries.count() // page_queries) or 1
    budget = search_share * float(sizes.sum())
    kind = "<f8" if dict(rows.dtypes)["vec"] == "array<double>" else "<f4"

    schema = "page bigint, copy bigint, kind int, id bigint, vec binary, leaves binary"
    names = ["page", "copy", "kind", "id", "vec", "leaves"]

    def emit(page, copy, kind, ids, vec, leaves) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            pa.array(page, pa.int64()), pa.array(copy, pa.int64()),
            pa.array([kind] * len(ids), pa.int32()), pa.array(ids, pa.int64()),
            pa.array(vec, pa.binary()), pa.array(leaves, pa.binary())], names=names)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            ids = batch.column(0).to_numpy()
            matrix = _matrix(batch.column(1))
            leaves = forests.leaves(matrix)
            page = first[leaves] + (ids[:, None] * 2654435761 >> 7) % pages[leaves]
            rows = [v.tobytes() for v in matrix.astype(kind)]
            rows = [v for v in rows for _ in range(trees)]
            at = [x.tobytes() for x in leaves.astype("<i4").reshape(-1)]
            for copy in range(copies):
                yield emit(page.reshape(-1), np.full(page.size, copy), 0, np.repeat(ids, trees),
                           rows, at)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            ids, matrix = batch.column(0).to_numpy(), _matrix(batch.column(1))
            page, row, wanted = [], [], []
            for q, taken in enumerate(
                    forests.search(matrix, sizes, budget, max(k + 1, least_rows))):
                taken = np.array(taken, dtype=np.int64)
                leaf = np.repeat(taken, pages[taken])
                step = np.arange(len(leaf)) - np.repeat(
                    np.cumsum(pages[taken]) - pages[taken], pages[taken])
                where = first[leaf] + step
                order = np.lexsort((leaf, where))
                leaf, where = leaf[order].astype("<i4"), where[order]
                cuts = np.flatnonzero(np.diff(where)) + 1
                parts = np.split(leaf, cuts)
                page.extend(where[np.concatenate(([0], cuts))].tolist())
                row.extend([q] * len(parts))
                wanted.extend(p.tobytes() for p in parts)
            row = np.array(row, dtype=np.int64)
            packed = [v.tobytes() for v in matrix.astype(kind)]
            yield emit(page, ids[row] % copies, 1, ids[row],
                       [packed[r] for r in row.tolist()], wanted)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, best = None, [], Best(k + 1, slack)
        for batch in slices(batches, 512):
            where = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(3)])
            cuts = np.flatnonzero((where[:, 1:] != where[:, :-1]).any(axis=0)) + 1
            edges = [0, *cuts.tolist(), batch.num_rows]
            for start, stop in zip(edges, edges[1:]):
                part = batch.slice(start, stop - start)
                spot, what = tuple(where[:2, start].tolist()), where[2, start]
                ids = part.column(3).to_numpy()
                matrix = np.frombuffer(b"".join(part.column(4).to_pylist()), dtype=kind).reshape(
                    len(ids), -1).astype(np.float64)
                leaves = [np.frombuffer(x, dtype="<i4") for x in part.column(5).to_pylist()]
                if what == 0:
                    if spot != current:
                        current, held = spot, []
                    held.append((ids, matrix, np.concatenate(leaves)))
                elif spot == current:
                    if len(held) > 1:
                        held = [tuple(np.concatenate(c) for c in zip(*held))]
                    best.add(ids, matrix, leaves, *held[0])
                    if best.queries >= HELD_QUERIES:
                        yield best.taken()
        yield best.taken()

    placed = entries.select("entry", "vec").mapInArrow(place, schema)
    asked = queries.mapInArrow(ask, schema)
    together = placed.unionByName(asked).repartition(
        spark_partitions(spark), "page", "copy").sortWithinPartitions("page", "copy", "kind")
    found = together.mapInArrow(compare, "query_id bigint, entry bigint, score double")
    best = found.groupBy("query_id", "entry").agg(F.max("score").alias("score"))
    order = "OVER (PARTITION BY query_id ORDER BY score DESC, {} ASC)"
    near = best.withColumn("_r", F.expr(f"row_number() {order.format('entry')}")).where(
        F.col("_r") <= k + 1)
    return (
        near.join(entries.select("entry", "ids"), "entry")
        .select("query_id", "score", F.explode("ids").alias("vec_id"))
        .where("query_id <> vec_id")
        .withColumn("rank", F.expr(f"row_number() {order.format('vec_id')}"))
        .where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))


class Best:
    """The nearest entries that a task has found so far for each query."""

    def __init__(self, most: int, slack: float):
        self.most, self.slack = most, slack
        self.clear()

    def clear(self) -> None:
        self.at: dict[int, int] = {}
        self.entry = np.zeros((0, self.most), dtype=np.int64)
        self.score = np.zeros((0, self.most))

    @property
    def queries(self) -> int:
        return len(self.at)

    def add(self, ids, queries, wanted, entries, matrix, leaves) -> None:
        """Meets queries with a page, of which each looks at its ``wanted`` leaves. A fast
        product rules out what cannot be among the best; a plain sum in double precision scores
        the rest."""
        row = np.array([self.at.setdefault(i, len(self.at)) for i in ids.tolist()])
        new = len(self.at) - len(self.entry)
        self.entry = np.vstack([self.entry, np.full((new, self.most), -1)])
        self.score = np.vstack([self.score, np.full((new, self.most), -np.inf)])
        known, codes = np.unique(leaves, return_inverse=True)
        visit = np.zeros((len(ids), len(known)), dtype=bool)
        for q, some in enumerate(wanted):
            at = np.minimum(np.searchsorted(known, some), len(known) - 1)
            visit[q, at[known[at] == some]] = True
        scores = queries @ matrix.T
        scores[~visit[:, codes]] = -np.inf
        floor = self.score[row, -1]
        fresh = floor == -np.inf
        if fresh.any() and scores.shape[1] > self.most:
            edge = scores.shape[1] - self.most
            floor[fresh] = np.partition(scores[fresh], edge, axis=1)[:, edge]
        q, e = np.nonzero((scores >= floor[:, None] - self.slack) & (scores > -np.inf))
        exact = np.concatenate([
            (matrix[e[i:i + 65536]] * queries[q[i:i + 65536]]).sum(axis=1)
            for i in range(0, len(q), 65536)] or [np.zeros(0)])
        touched = np.unique(q)
        old = self.entry[row[touched]] >= 0
        where = np.concatenate([q, np.repeat(touched, old.sum(axis=1))])
        entry = np.concatenate([entries[e], self.entry[row[touched]][old]])
        score = np.concatenate([exact, self.score[row[touched]][old]])
        order = np.lexsort((entry, -score, where))
        where, entry, score = where[order], entry[order], score[order]
        # An entry of another tree's page comes with the same score, so right behind itself.
        keep = np.ones(len(where), dtype=bool)
        keep[1:] = (where[1:] != where[:-1]) | (entry[1:] != entry[:-1])
        where, entry, score = where[keep], entry[keep], score[keep]
        rank = np.arange(len(where)) - np.searchsorted(where, where)
        few = rank < self.most
        at = (row[where[few]], rank[few])
        self.entry[at], self.score[at] = entry[few], score[few]

    def taken(self) -> pa.RecordBatch:
        ids = np.array(list(self.at), dtype=np.int64)
        there = self.entry >= 0
        out = pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(ids, there.sum(axis=1))), pa.array(self.entry[there]),
             pa.array(self.score[there])], names=["query_id", "entry", "score"])
        self.clear()
        return out
