"""Benchmark decontamination by greedy string tiling.

Texts and benchmark items are compared as lower-case word tokens. A document and an item meet
when they share a seed of ``seed`` tokens; Karp-Rabin tiling then marks the longest
non-overlapping common runs again and again, longest first, so passages that were reordered
are found piece by piece. A pair counts as contaminated when tiles cover ``coverage`` of the
item's tokens.

The benchmark is the query set: it is sent to the tasks in blocks of a checked size, each of
which meets all rows, so documents are neither shuffled nor exploded, whatever their size or
skew, and no item is left out.
"""
from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import SLICE_ROWS, slices

SEED = 4
COVERAGE = 0.5
# Characters of benchmark text in one broadcast block; an index takes some 40 bytes for each.
BLOCK_CHARS = 4_000_000
_WORD = re.compile(r"\w+")
_MOD = (1 << 61) - 1
_BASE = 1_000_003


def tokens(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def tiles(item: Sequence[int], doc: Sequence[int], least: int) -> list[tuple[int, int, int]]:
    """``(item_start, doc_start, length)`` of the greedy tiling; negative doc tokens match
    nothing. Each round looks, by rolling hashes of the current length, for the longest
    matches among unmarked tokens, marks them without overlap, then tries shorter ones."""
    free_item, free_doc = bytearray(b"\1") * len(item), bytearray(
        0 if t < 0 else 1 for t in doc)
    found: list[tuple[int, int, int]] = []
    length = min(len(item), len(doc))
    while length >= least:
        places: dict[int, list[int]] = defaultdict(list)
        for start, code in _rolling(doc, free_doc, length):
            places[code].append(start)
        best: dict[int, list[tuple[int, int]]] = defaultdict(list)
        if places:
            for i, code in _rolling(item, free_item, length):
                for j in places.get(code, ()):
                    n = _extent(item, free_item, i, doc, free_doc, j)
                    if n >= length:
                        best[n].append((i, j))
        if not best:
            length = length - 1 if length <= 2 * least else max(least, length // 2)
            continue
        longest = max(best)
        if longest > length:
            length = longest
        for i, j in sorted(best[longest]):
            if all(free_item[i:i + longest]) and all(free_doc[j:j + longest]):
                found.append((i, j, longest))
                free_item[i:i + longest] = bytes(longest)
                free_doc[j:j + longest] = bytes(longest)
        # Marked tokens shorten what is left, so the same length is tried again.
    return found


def _rolling(
    sequence: Sequence[int], free: bytearray, length: int,
) -> Iterator[tuple[int, int]]:
    """Karp-Rabin hashes of each unmarked run of ``length`` tokens."""
    top = pow(_BASE, length - 1, _MOD)
    code = run = 0
    for at, token in enumerate(sequence):
        if not free[at]:
            code = run = 0
            continue
        if run == length:
            code = (code - (sequence[at - length] + 1) * top) % _MOD
            run -= 1
        code = (code * _BASE + token + 1) % _MOD
        run += 1
        if run == length:
            yield at - length + 1, code


def _extent(item, free_item, i, doc, free_doc, j) -> int:
    n = 0
    while (i + n < len(item) and j + n < len(doc) and free_item[i + n] and free_doc[j + n]
           and item[i + n] == doc[j + n]):
        n += 1
    return n


class Index:
    """Seeds of a block of benchmark items. An item under ``seed`` tokens is a seed of its own
    length, so only a whole copy matches; items with equal tokens share one entry."""

    def __init__(self, items: Sequence[tuple[int, str]], seed: int):
        self.vocabulary: dict[str, int] = {}
        self.items: list[list[int]] = []
        self.ids: list[list[int]] = []
        # Seed length -> seed -> (item, places in it).
        self.holders: dict[int, dict[int, list[tuple[int, int]]]] = {}
        entries: dict[tuple[int, ...], int] = {}
        for item_id, text in items:
            words = tokens(text)
            if not words:
                continue
            coded = tuple(self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words)
            if coded not in entries:
                entries[coded] = len(self.items)
                self.items.append(list(coded))
                self.ids.append([])
                size = min(seed, len(coded))
                holders = self.holders.setdefault(size, defaultdict(list))
                for gram, n in zip(*(c.tolist() for c in np.unique(
                        grams(np.array(coded, dtype=np.int64), size), return_counts=True))):
                    holders[gram].append((entries[coded], n))
            self.ids[entries[coded]].append(item_id)
        self.seeds = {size: np.array(sorted(h), dtype=np.uint64)
                      for size, h in sorted(self.holders.items())}

    def hits(self, coded: np.ndarray, size: int) -> np.ndarray:
        """Positions at which a seed of ``size`` tokens starts."""
        seeds = self.seeds[size]
        if len(coded) < size:
            return np.zeros(0, dtype=np.int64)
        run = np.concatenate(([0], np.cumsum(coded >= 0)))
        at = np.flatnonzero(run[size:] - run[:-size] == size)
        if not len(at):
            return at
        own = grams(coded, size)[at]
        place = np.minimum(np.searchsorted(seeds, own), len(seeds) - 1)
        return at[seeds[place] == own]

    def matches(self, coded: np.ndarray, at: np.ndarray, size: int, coverage: float):
        """``(item, covered tokens, tiles)`` of the items covered enough. A tile is at least a
        seed long, so only tokens inside the item's seeds need tiling.

        Items are weighed by the different seeds they share, however often those stand in the
        text, and only those that may be covered enough are looked for in it."""
        found = grams(coded, size)[at]
        shared: dict[int, int] = defaultdict(int)
        different = np.unique(found)
        for gram in different.tolist():
            for item, n in self.holders[size][gram]:
                shared[item] += n
        for item, places in shared.items():
            own = self.items[item]
            # Each place of a seed covers its tokens at most.
            if places * size < coverage * len(own):
                continue
            seeds = grams(np.array(own, dtype=np.int64), size)
            if _inside(np.flatnonzero(np.isin(seeds, different)), size, len(own)).sum() < (
                    coverage * len(own)):
                continue
            used = np.flatnonzero(_inside(at[np.isin(found, seeds)], size, len(coded)))
            if len(used) < coverage * len(own):
                continue
            gaps = np.flatnonzero(np.diff(used) > 1) + 1
            pieces = np.insert(coded[used], gaps, -1)
            marked = tiles(own, pieces.tolist(), size)
            covered = sum(n for _, _, n in marked)
            if covered >= coverage * len(own):
                yield item, covered, len(marked)


def grams(coded: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` tokens from each position on."""
    n = len(coded) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    values = coded.astype(np.uint64) + np.uint64(1)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + values[i:i + n]
        out ^= out >> np.uint64(29)
    return out


def _inside(starts: np.ndarray, size: int, length: int) -> np.ndarray:
    """Which of ``length`` tokens lie in a run of ``size`` from one of ``starts``."""
    edges = np.zeros(length + 1, dtype=np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + size, -1)
    return np.cumsum(edges[:-1]) > 0


def _found(index: Index, texts: list[str | None], coverage: float):
    """``(row, item, covered, tiles)``; texts are hashed together, a gap between them."""
    get = index.vocabulary.get
    coded, bounds = [], [0]
    for text in texts:
        coded.extend([get(w, -1) for w in tokens(text)])
        coded.append(-1)
        bounds.append(len(coded))
    ids = np.array(coded, dtype=np.int64)
    for size in index.seeds:
        at = index.hits(ids, size)
        cuts = np.searchsorted(at, bounds)
        for row in np.flatnonzero(np.diff(cuts)).tolist():
            start, stop = bounds[row], bounds[row + 1]
            for hit in index.matches(
                    ids[start:stop], at[cuts[row]:cuts[row + 1]] - start, size, coverage):
                yield row, *hit


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, seed: int, block_chars: int):
    """Broadcast indexes of the benchmark, each over about ``block_chars`` characters. Items
    are dealt by hash; one block is on the driver at a time."""
    items = benchmark.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = int(total // block_chars) + 1
    context = benchmark.sparkSession.sparkContext
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b)
        rows = part.distinct().orderBy("id", "text").toArrow()
        yield context.broadcast(Index(
            list(zip(rows.column("id").to_pylist(), rows.column("text").to_pylist())), seed))


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_id: str = "item_id", item_text: str = "text", seed: int = SEED,
    coverage: float = COVERAGE, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """One row per contaminated pair: ``doc_id``, ``item_id``, ``item_tokens``,
    ``covered_tokens``, ``tiles``, ``coverage``.

    Null and empty texts match nothing, in documents and items alike, nor do items without a
    word; an item under ``seed`` tokens matches where all of it stands; repeated rows give
    repeated pairs; a document with a null id is reported with a null id. No benchmark, no rows.
    """
    schema = ("doc_id bigint, item_id bigint, item_tokens int, covered_tokens int, tiles int,"
              " coverage double")
    narrow = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col))

    def by_block(block) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = block.value
            for batch in slices(batches):
                ids, out = batch.column(0).to_pylist(), []
                for row, item, covered, n in _found(index, batch.column(1).to_pylist(), coverage):
                    size = len(index.items[item])
                    out.extend((ids[row], i, size, covered, n, covered / size)
                               for i in index.ids[item])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 6, _TYPES)],
                    names=_NAMES)

        return narrow.mapInArrow(run, schema)

    return reduce(DataFrame.unionByName, (
        by_block(b) for b in _blocks(benchmark, item_id, item_text, seed, block_chars)))


_NAMES = ["doc_id", "item_id", "item_tokens", "covered_tokens", "tiles", "coverage"]
_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]


def keep_clean(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id",
    item_text: str = "text", seed: int = SEED, coverage: float = COVERAGE,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """The documents that no benchmark item contaminates, all columns as they were. One pass
    for each block of the benchmark, none of them a shuffle. Null and empty texts stay, rows
    with a null id are judged like any other, repeated rows stay or go together, and without
    benchmark items all rows stay."""
    at = docs.columns.index(text_col)

    def without(kept: DataFrame, block) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = block.value
            for batch in slices(batches, SLICE_ROWS):
                clean = np.ones(batch.num_rows, dtype=bool)
                clean[[f[0] for f in _found(index, batch.column(at).to_pylist(), coverage)]] = False
                yield batch.filter(pa.array(clean))

        return kept.mapInArrow(run, docs.schema)

    return reduce(without, _blocks(benchmark, item_id, item_text, seed, block_chars), docs)
