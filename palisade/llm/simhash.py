"""SimHash near-duplicates by bit-sliced comparison.

A fingerprint holds, per bit, whether more than half of a text's three-word shingles have it
set. Fingerprints within the radius agree in one of ``radius + 1`` bands, and again in one of
as many parts of the remaining bits, so each distinct fingerprint goes to
``(radius + 1) ** 2`` buckets; buckets with one member drop out before anything is compared.
A bucket beyond ``block`` members is cut into chunks that meet pairwise, so no task compares
an unbounded group.

In a bucket, bits are stored vertically: one machine word holds the same bit of 64
fingerprints. Carry-save counters add up differing bits of all of them at once and overflow
when a distance passes the radius; a query row is abandoned once all its counters overflowed.
Only spanning links leave a bucket, and components are found by contraction.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from palisade.llm.common import columns_of, map_batches, saved, slices, unused
from palisade.llm.components import components

BITS = 64
RADIUS = 3
SHINGLE = 3
# Members compared at once; larger buckets are cut into chunks of half this size.
BLOCK = 2048
_CHECK_PLANES = 16


def fingerprint(text: str | None, width: int = SHINGLE, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash; 0 for a text without words. Only A-Z are lower-cased, words
    are runs without ASCII white space."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], seed) for a, b in zip(
            starts[:1 - width].tolist(), ends[width - 1:].tolist())]
    planes = np.unpackbits(
        np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    majority = 2 * planes.sum(axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(majority, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)``; a null text has no words."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], dtype=np.uint64)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    narrow = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col))
    return map_batches(narrow, run, "doc_id bigint, fp bigint")


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """``(64, words)``: bit ``j`` of fingerprint ``i`` is bit ``i % 64`` of ``[j, i // 64]``."""
    padded = np.zeros(-(-len(fps) // 64) * 64, dtype="<u8")
    padded[:len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def near_rows(planes: np.ndarray, queries: np.ndarray, radius: int) -> np.ndarray:
    """``(queries, words)`` masks of the stored fingerprints within ``radius``.

    ``k`` counter planes start at ``2**k - 1 - radius``, so they overflow exactly when a
    distance passes the radius; overflow sticks."""
    width = max(1, int(radius).bit_length())
    start = (1 << width) - 1 - radius
    shape = (len(queries), planes.shape[1])
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    counters = [np.full(shape, full if start >> i & 1 else 0, dtype=np.uint64)
                for i in range(width)]
    over = np.zeros(shape, dtype=np.uint64)
    rows = np.arange(len(queries))
    result = np.zeros(shape, dtype=np.uint64)
    flip = np.where(
        (queries[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1), full, np.uint64(0))
    for bit in range(0, BITS, 2):
        # Carry-save adder: two planes and the ones counter give a sum and a carry.
        x = planes[bit] ^ flip[:, bit, None]
        y = planes[bit + 1] ^ flip[:, bit + 1, None]
        xy = x ^ y
        carry = (x & y) | (counters[0] & xy)
        counters[0] = counters[0] ^ xy
        for i in range(1, width):
            counters[i], carry = counters[i] ^ carry, counters[i] & carry
        over |= carry
        if (bit + 2) % _CHECK_PLANES == 0 and bit + 2 < BITS:
            alive = (over != full).any(axis=1)
            if not alive.all():
                rows, over, flip = rows[alive], over[alive], flip[alive]
                counters = [c[alive] for c in counters]
                if not len(rows):
                    return result
    result[rows] = ~over
    return result


def spanning_links(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """``(member, root)`` for the members of each group linked within the radius."""
    count = len(fps)
    if count == 2:
        return [(1, 0)] if int(fps[0] ^ fps[1]).bit_count() <= radius else []
    planes = bit_planes(fps)
    reach = np.vstack([
        near_rows(planes, fps[i:i + 256], radius) for i in range(0, count, 256)])
    unseen = bit_mask(count, planes.shape[1])
    links = []
    for root in range(count):
        if not unseen[root >> 6] >> np.uint64(root & 63) & np.uint64(1):
            continue
        unseen[root >> 6] &= ~(np.uint64(1) << np.uint64(root & 63))
        frontier = [root]
        while frontier:
            found = reach[frontier.pop()] & unseen
            if found.any():
                unseen &= ~found
                new = np.flatnonzero(np.unpackbits(found.view(np.uint8), bitorder="little"))
                frontier.extend(new.tolist())
                links.extend((int(i), root) for i in new)
    return links


def bit_mask(count: int, words: int) -> np.ndarray:
    """``count`` low bits set."""
    bits = np.zeros(words * 64, dtype=np.uint8)
    bits[:count] = 1
    return np.packbits(bits, bitorder="little").view("<u8").copy()


def near_links(fps: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Links ``(u, v)`` that connect exactly what pairs within ``radius`` connect.

    ``fps`` holds distinct fingerprints in column ``fp``."""
    bands = radius + 1
    band = BITS // bands

    def key(first: int, second: int):
        """Bits of one band, and of one part of what the other bands leave."""
        rest = [b for b in range(BITS) if not first * band <= b < (first + 1) * band]
        share = len(rest) // bands
        part = rest[second * share:(second + 1) * share]
        mask = sum(1 << b for b in [*range(first * band, (first + 1) * band), *part])
        signed = mask - (1 << 64) if mask >> 63 else mask
        return F.struct(F.lit(first * bands + second).alias("table"),
                        F.col("fp").bitwiseAND(F.lit(signed)).alias("bits"))

    keyed = fps.select("fp", F.explode(F.array(*(
        key(i, j) for i in range(bands) for j in range(bands)))).alias("_k")).select(
            "fp", "_k.table", "_k.bits")
    shared = keyed.groupBy("table", "bits").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    half = block // 2
    members = keyed.join(shared, ["table", "bits"]).withColumn(
        "chunks", F.expr(f"IF(n <= {block}, 1L, (n + {half} - 1) div {half})"))
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("chunks"))
    meetings = members.withColumn("own", own).select(
        "fp", "table", "bits", F.explode(F.transform(
            F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1),
            lambda c: F.struct(F.least(c, F.col("own")).alias("p"),
                               F.greatest(c, F.col("own")).alias("q")))).alias("_m")).select(
        "table", "bits", "_m.p", "_m.q", "fp")
    group = ["table", "bits", "p", "q"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(fps: np.ndarray):
            for member, root in spanning_links(fps, radius):
                us.append(fps[member])
                vs.append(fps[root])

        held_key, held = None, []
        for batch in slices(batches, 65536):
            us, vs = [], []
            values = batch.column(4).to_numpy().view(np.uint64)
            keys = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(4)])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            edges = [0, *cuts.tolist(), len(values)]
            for start, stop in zip(edges, edges[1:]):
                this = tuple(keys[:, start].tolist())
                if this != held_key:
                    if held_key is not None and sum(map(len, held)) > 1:
                        linked(np.concatenate(held))
                    held_key, held = this, []
                held.append(values[start:stop])
            yield _links(us, vs)
        us, vs = [], []
        if sum(map(len, held)) > 1:
            linked(np.concatenate(held))
        yield _links(us, vs)

    return (
        meetings.repartition(*group).sortWithinPartitions(*group)
        .mapInArrow(run, "u bigint, v bigint"))


def _links(us: list, vs: list) -> pa.RecordBatch:
    columns = [pa.array(np.array(c, dtype=np.uint64).view(np.int64)) for c in (us, vs)]
    return pa.RecordBatch.from_arrays(columns, names=["u", "v"])


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS,
) -> DataFrame:
    """One row per document: ``doc_id``, ``fp`` and ``component_id``, the smallest id that links
    reach.

    Texts that are null or have no words share fingerprint 0 and are linked like any other.
    Rows with a null id get a fingerprint and the smallest id of their component, null where
    no member has an id. Repeated rows and ids give a row each. Other columns are ignored.
    """
    return _grouped(docs, id_col, text_col, radius).drop("root")


def _grouped(docs: DataFrame, id_col: str, text_col: str, radius: int = RADIUS) -> DataFrame:
    """``near_duplicates`` with ``root``, which tells components of the same smallest id apart."""
    printed = saved(fingerprints(docs, id_col, text_col))
    distinct = saved(printed.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(near_links(distinct.select("fp"), radius))
    labelled = distinct.join(roots, distinct["fp"] == roots["vertex"], "left").select(
        "fp", "first_id", F.coalesce("root", F.xxhash64("fp")).alias("root"))
    smallest = labelled.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_fp = labelled.join(smallest, "root").select("fp", "component_id", "root")
    return printed.join(by_fp, "fp").select("doc_id", "fp", "component_id", "root")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, one of each group: that with the smallest id, of rows that repeat it in
    the group one, chosen by content. An id with texts in several groups is judged in each of
    them. Rows with a null id are kept: nothing could name them."""
    found = saved(_grouped(docs, id_col, text_col))
    own = found.where("doc_id = component_id")
    others = found.where("doc_id <> component_id").select(F.col("doc_id").alias(id_col)).distinct()
    again = saved(
        found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
            F.count(F.lit(1)).alias("n"), F.max(F.expr("doc_id = component_id")).alias("own"))
        .where("n > 1 AND own").select(F.col("doc_id").alias(id_col)))
    left = docs.join(others, id_col, "left_anti").select(*columns_of(docs))
    if again.isEmpty():
        return left
    key, print_, fp, root, mark, number = (
        unused(docs, n) for n in ("_key", "_print", "_fp", "_root", "_mark", "_number"))
    repeated = docs.join(again, id_col, "left_semi").select(*columns_of(docs))
    at = docs.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t) for t in batch.column(at).to_pylist()], dtype=np.uint64)
        return batch.append_column(print_, pa.array(fps.view(np.int64)))

    schema = T.StructType([*docs.schema.fields, T.StructField(print_, T.LongType())])
    first = own.select(
        F.col("doc_id").alias(key), F.col("fp").alias(fp), F.col("root").alias(root)).distinct()
    once = map_batches(repeated, run, schema).join(
        first, (F.col(id_col).cast("bigint") == F.col(key))
        & (F.col(print_) == F.col(fp))).withColumn(
        mark, F.xxhash64(*columns_of(docs))).withColumn(
        number, F.row_number().over(Window.partitionBy(key, root).orderBy(mark)))
    return left.join(again, id_col, "left_anti").select(*columns_of(docs)).unionByName(
        once.where(F.col(number) == 1).select(*columns_of(docs)))
