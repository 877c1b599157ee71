"""Line dedup by pairwise alignment.

A rare line is a long enough line that stands once in its document. The first document that
holds a line is its owner, and every later holder is paired with the owner: a line shared by
``m`` documents makes ``m - 1`` pairs, however frequent it is, so neither pairs within a group
nor a limit on frequency are needed. For each pair the shared lines are aligned with patience
diff: rare lines unique to both sides are chained by their longest increasing run, and the
chain is grown line by line over neighbours that match. Aligned blocks of enough text are
deleted from the later document.

One first holder a line misses blocks that only some other document holds in one piece. With
``whole`` pairs are therefore found by windows: from each line on, and up to each line, the
fewest lines that hold ``min_block`` code points. Every run of lines of that size that an
earlier document holds in one piece is covered exactly by the windows inside it, and a window
is the same in all its holders; so pairing each window with its first holder alone leaves out
nothing that an alignment with any other document would find. The windows of a pair are the
anchors of its patience diff: those that stand once on both sides are chained by their longest
increasing run, links that touch on one diagonal grow together to blocks, and what a chain
leaves (moved or repeated passages) is dealt to further increasing chains, until every shared
window lies in a block of some chain. The blocks go from the later document.

Only line hashes, numbers and lengths are shuffled; texts move once, to meet their deletions.
"""
from __future__ import annotations

import struct
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator, Sequence

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import columns_of, map_batches, saved, slices, unused

# Code points of a line that may start an alignment.
MIN_LINE = 20
# Code points of an aligned block that is deleted.
MIN_BLOCK = 100
_SPACE = " \t\r\x0b\x0c"


def aligned(
    pairs: Sequence[tuple[int, int, bool]],
) -> list[tuple[int, int]]:
    """Patience alignment of one pair of documents.

    ``pairs`` are ``(line in the earlier, line in the later, rare)`` of all equal lines.
    Rare pairs, unique on both sides, are chained by a longest increasing run; the chain then
    takes in directly adjacent equal lines, before and after each link, within the gap that
    its neighbours leave."""
    by_early, by_late = defaultdict(int), defaultdict(int)
    for early, late, _ in pairs:
        by_early[early] += 1
        by_late[late] += 1
    seeds = sorted(
        (late, early) for early, late, rare in pairs
        if rare and by_early[early] == 1 and by_late[late] == 1)
    chain = _increasing(seeds)
    equal = {(early, late) for early, late, _ in pairs}
    result: list[tuple[int, int]] = []
    for k, (late, early) in enumerate(chain):
        below = result[-1] if result else (-1, -1)
        if below[0] >= early or below[1] >= late:
            continue
        back = []
        e, l = early - 1, late - 1
        while e > below[0] and l > below[1] and (e, l) in equal:
            back.append((e, l))
            e, l = e - 1, l - 1
        result.extend(reversed(back))
        result.append((early, late))
        next_late, next_early = chain[k + 1] if k + 1 < len(chain) else (1 << 62, 1 << 62)
        e, l = early + 1, late + 1
        while e < next_early and l < next_late and (e, l) in equal:
            result.append((e, l))
            e, l = e + 1, l + 1
    return result


def _increasing(seeds: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest run, by late line, with increasing early lines."""
    tails: list[int] = []
    at: list[int] = []
    before = [-1] * len(seeds)
    for i, (_, early) in enumerate(seeds):
        k = bisect_left(tails, early)
        before[i] = at[k - 1] if k else -1
        if k == len(tails):
            tails.append(early)
            at.append(i)
        else:
            tails[k], at[k] = early, i
    chain, i = [], at[-1] if at else -1
    while i >= 0:
        chain.append(seeds[i])
        i = before[i]
    return chain[::-1]


def deletions(
    shared: Sequence[dict], min_block: int,
) -> tuple[list[int], list[int]]:
    """``(deleted line numbers, owners they were aligned with)`` of one later document, from
    its rows ``owner, early lines, late lines, length, rare``."""
    by_owner = defaultdict(list)
    size: dict[int, int] = {}
    for row in shared:
        key = (row["owner_id"], row["owner_v"])
        # A line that repeats on both sides can only be grown into along one diagonal or
        # another; lengths of lists multiply within this document alone.
        by_owner[key].append(row)
        for late in row["late"]:
            size[late] = row["length"]
    gone, owners = set(), set()
    for (owner, _), rows in by_owner.items():
        pairs = _equal_lines(rows)
        block: list[int] = []
        last = None
        for early, late in [*aligned(pairs), (None, None)]:
            if last is not None and (early, late) != (last[0] + 1, last[1] + 1):
                if sum(size[i] for i in block) >= min_block:
                    gone.update(block)
                    owners.add(owner)
                block = []
            if early is not None:
                block.append(late)
            last = (early, late)
    return sorted(gone), sorted(owners)


def _equal_lines(rows: Sequence[dict]) -> list[tuple[int, int, bool]]:
    """Equal line numbers of a pair. Lines that repeat are only reachable by growing a chain of
    unique ones, so of their combinations those next to another match are enough: they are
    listed outward from unique lines, diagonal by diagonal."""
    code_early: dict[int, int] = {}
    code_late: dict[int, int] = {}
    pairs = []
    for n, row in enumerate(rows):
        if len(row["early"]) == 1 and len(row["late"]) == 1:
            pairs.append((row["early"][0], row["late"][0], row["rare"]))
        code_early.update(dict.fromkeys(row["early"], n))
        code_late.update(dict.fromkeys(row["late"], n))
    seen = {(e, l) for e, l, _ in pairs}
    for early, late, _ in list(pairs):
        for step in (1, -1):
            e, l = early + step, late + step
            while (e, l) not in seen and code_early.get(e, -1) == code_late.get(l, -2):
                seen.add((e, l))
                pairs.append((e, l, False))
                e, l = e + step, l + step
    return pairs


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(a, b, doc_id, v, lines, length)``: each distinct line of each document, by two halves
    of its hash without surrounding white space, with its places. Lines of a document are
    gathered where it is read, so a line that everybody holds is shuffled once per document
    and adaptive execution may split its join."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for i, v, text in zip(*(c.to_pylist() for c in batch.columns)):
            places: dict[str, list[int]] = {}
            for no, line in enumerate(text.split("\n")):
                places.setdefault(line.strip(_SPACE), []).append(no)
            for line, at in places.items():
                if line:
                    code = xxhash.xxh3_128_digest(line.encode("utf-8", "replace"))
                    rows.append((*struct.unpack("<qq", code), i, v, at, len(line)))
        columns = zip(*rows) if rows else [()] * 6
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, _LINE_TYPES)],
            names=["a", "b", "doc_id", "v", "lines", "length"])

    whole = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text_col).alias("v"),
        F.col(text_col).alias("text"))
    return map_batches(
        whole, run, "a bigint, b bigint, doc_id bigint, v bigint, lines array<int>, length int")


_LINE_TYPES = [pa.int64()] * 4 + [pa.list_(pa.int32()), pa.int32()]


def windows_of(text: str, min_block: int) -> dict[bytes, tuple[int, list[int]]]:
    """``(lines, starts)`` of the windows of a text, by 128-bit hashes of their lines. Blank
    lines do not count: the others are numbered without them, from 0."""
    codes, sizes = [], []
    for line in text.split("\n"):
        line = line.strip(_SPACE)
        if line:
            codes.append(xxhash.xxh3_128_digest(line.encode("utf-8", "replace")))
            sizes.append(len(line))
    spans, start, held = set(), 0, 0
    low, back = 0, 0
    for end, length in enumerate(sizes):
        held += length
        back += length
        # Each start is left at the first end that suffices; the last start that suffices at
        # an end begins the shortest window up to that end.
        while start <= end and held >= min_block:
            spans.add((start, end))
            held -= sizes[start]
            start += 1
        while low < end and back - sizes[low] >= min_block:
            back -= sizes[low]
            low += 1
        if back >= min_block:
            spans.add((low, end))
    found: dict[bytes, tuple[int, list[int]]] = {}
    for a, b in sorted(spans):
        key = codes[a] if a == b else xxhash.xxh3_128_digest(b"".join(codes[a:b + 1]))
        found.setdefault(key, (b - a + 1, []))[1].append(a)
    return found


def _windows(docs: DataFrame, id_col: str, text_col: str, min_block: int) -> DataFrame:
    """``(a, b, doc_id, v, lines, starts)``: each distinct window of each document, by two
    halves of its hash, with its places."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            columns = zip(*rows) if rows else [()] * 6
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, _WINDOW_TYPES)],
                names=["a", "b", "doc_id", "v", "lines", "starts"])

        for batch in slices(batches, 64):
            for i, v, text in zip(*(c.to_pylist() for c in batch.columns)):
                for code, (lines, starts) in windows_of(text, min_block).items():
                    rows.append((*struct.unpack("<qq", code), i, v, lines, starts))
                if len(rows) > _HELD_WINDOWS:
                    yield out()
                    rows.clear()
        yield out()

    whole = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text_col).alias("v"),
        F.col(text_col).alias("text"))
    return whole.mapInArrow(
        run, "a bigint, b bigint, doc_id bigint, v bigint, lines int, starts array<int>")


_WINDOW_TYPES = [pa.int64()] * 4 + [pa.int32(), pa.list_(pa.int32())]
_HELD_WINDOWS = 50_000


def chains(anchors: Sequence[tuple[int, int, int, bool]]) -> list[list[tuple[int, int, int]]]:
    """Increasing chains of the anchors of a pair, ``(late start, early start, lines, rare)``,
    so that each lies in one.

    The first is the patience diff proper: the longest increasing run of rare anchors. The rest
    are dealt in late order, each to the chain whose early end is the nearest below it, or to a
    new one: as few chains as the longest falling run has anchors, in one sorted pass."""
    longest: dict[tuple[int, int], int] = {}
    rare = set()
    for late, early, lines, once in anchors:
        longest[late, early] = max(lines, longest.get((late, early), 0))
        if once:
            rare.add((late, early))
    # Of anchors at one place of either side, the chain may hold one; seeds that fall within
    # a line are ordered so that no run takes two.
    seeds = sorted(rare, key=lambda x: (x[0], -x[1]))
    result = [_increasing(seeds)] if seeds else []
    taken = set(result[0]) if result else set()
    tails: list[int] = []
    rows: list[list[tuple[int, int]]] = []
    for late, early in sorted(longest.keys() - taken, key=lambda x: (x[0], -x[1])):
        # Tails fall, so that the nearest below is the first that is.
        k = bisect_left(tails, -early + 1)
        if k == len(tails):
            tails.append(-early)
            rows.append([(late, early)])
        else:
            tails[k] = -early
            rows[k].append((late, early))
    return [[(late, early, longest[late, early]) for late, early in row]
            for row in [*result, *rows]]


def blocks_of(chain: Sequence[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """``(late start, early start, lines)`` of the blocks of a chain: links on one diagonal
    that overlap or touch are one."""
    blocks: list[tuple[int, int, int]] = []
    for late, early, lines in chain:
        if blocks:
            at, of, size = blocks[-1]
            if late - early == at - of and late <= at + size:
                blocks[-1] = (at, of, max(size, late - at + lines))
                continue
        blocks.append((late, early, lines))
    return blocks


def aligned_runs(shared: Sequence[dict]) -> tuple[list[int], list[int]]:
    """``(runs, owners)`` of one later document, from its windows ``owner_id, owner_v, early,
    once, lines, starts``: runs of lines that go, first and last in turn, and the documents
    they are aligned with."""
    anchors = defaultdict(list)
    for row in shared:
        once = row["once"] and len(row["starts"]) == 1
        anchors[row["owner_id"], row["owner_v"]].extend(
            (late, row["early"], row["lines"], once) for late in row["starts"])
    spans = sorted(
        (late, late + lines - 1) for pair in anchors.values() for chain in chains(pair)
        for late, _, lines in blocks_of(chain))
    runs: list[int] = []
    for a, b in spans:
        if runs and a <= runs[-1] + 1:
            runs[-1] = max(runs[-1], b)
        else:
            runs += [a, b]
    return runs, sorted({owner for owner, _ in anchors})


def _aligned_windows(docs: DataFrame, id_col: str, text_col: str, min_block: int) -> DataFrame:
    """What ``find_blocks`` returns with ``whole``."""
    windows = _windows(docs, id_col, text_col, min_block)
    # Of the owner's places the first is enough: a later copy aligns with one of them.
    first = saved(windows.groupBy("a", "b").agg(
        F.min(F.struct("doc_id", "v", F.col("starts")[0].alias("early"),
                       (F.size("starts") == 1).alias("once"))).alias("owner"),
        F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    shared = (
        windows.join(first, ["a", "b"])
        .where("(doc_id, v) <> (owner.doc_id, owner.v)")
        # Rows that repeat id and text bring the same windows again.
        .groupBy("doc_id", "v").agg(F.collect_set(F.struct(
            F.col("owner.doc_id").alias("owner_id"), F.col("owner.v").alias("owner_v"),
            F.col("owner.early").alias("early"), F.col("owner.once").alias("once"),
            "lines", "starts")).alias("shared")))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [aligned_runs(rows) for rows in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([
            batch.column(0), batch.column(1), pa.array([r for r, _ in found], pa.list_(pa.int32())),
            pa.array([o for _, o in found], pa.list_(pa.int64()))],
            names=["doc_id", "v", "runs", "owners"])

    return map_batches(
        shared, run, "doc_id bigint, v bigint, runs array<int>, owners array<bigint>")


def _runs(numbers: Sequence[int]) -> list[int]:
    runs: list[int] = []
    for n in numbers:
        if runs and runs[-1] == n - 1:
            runs[-1] = n
        else:
            runs += [n, n]
    return runs


def cut(text: str, runs: Sequence[int], dense: bool) -> tuple[str, int]:
    """The text without runs of lines (first and last in turn), and how many lines went.
    ``dense`` numbers leave blank lines out; blank lines inside a run go with it."""
    lines = text.split("\n")
    places = [no for no, line in enumerate(lines) if not dense or line.strip(_SPACE)]
    kept, at = [], 0
    for a, b in zip(runs[::2], runs[1::2]):
        kept += lines[at:places[a]]
        at = places[b] + 1
    kept += lines[at:]
    return "\n".join(kept), len(lines) - len(kept)


def find_blocks(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    min_line: int = MIN_LINE, min_block: int = MIN_BLOCK, whole: bool = False,
) -> DataFrame:
    """``(doc_id, v, runs, owners)`` of each document that loses lines: ``runs`` are the first
    and last numbers, from 0, of their runs in turn, ``v`` the XXH64 of its text, ``owners`` the
    earlier documents it was aligned with. With ``whole``, pairs come from windows, lines of
    any length count, and numbers leave blank lines out."""
    if whole:
        return _aligned_windows(docs, id_col, text_col, min_block)
    lines = _lines(docs, id_col, text_col)
    # An owner is the smallest (id, text hash); ids may repeat, equal rows are one document.
    # Kept, so that the join has shuffles of its own, which adaptive execution may split.
    first = saved(lines.groupBy("a", "b").agg(F.min(F.struct(
        "doc_id", "v", F.col("lines").alias("early"))).alias("owner"),
        F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    shared = (
        lines.join(first, ["a", "b"])
        .where("(doc_id, v) <> (owner.doc_id, owner.v)")
        # Rows that repeat id and text bring the same lines again.
        .groupBy("doc_id", "v").agg(F.collect_set(F.struct(
            F.col("owner.doc_id").alias("owner_id"), F.col("owner.v").alias("owner_v"),
            F.col("owner.early").alias("early"), F.col("lines").alias("late"), "length",
            (F.col("length") >= min_line).alias("rare"))).alias("shared")))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [deletions(rows, min_block) for rows in batch.column(2).to_pylist()]
        out = pa.RecordBatch.from_arrays([
            batch.column(0), batch.column(1),
            pa.array([_runs(g) for g, _ in found], pa.list_(pa.int32())),
            pa.array([o for _, o in found], pa.list_(pa.int64()))],
            names=["doc_id", "v", "runs", "owners"])
        return out.filter(pa.array([bool(g) for g, _ in found], pa.bool_()))

    return map_batches(
        shared, run, "doc_id bigint, v bigint, runs array<int>, owners array<bigint>")


def _cleaned(
    docs: DataFrame, id_col: str, text_col: str, min_line: int, min_block: int, whole: bool,
) -> tuple[DataFrame, str, str]:
    """All columns, the text cleaned, and two more: the number of deleted lines and owners."""
    key, version, text_key, runs, left, gone, owners = (
        unused(docs, n) for n in ("_id", "_v", "_h", "_runs", "_left", "_gone", "_owners"))
    found = find_blocks(docs, id_col, text_col, min_line, min_block, whole).select(
        F.col("doc_id").alias(key), F.col("v").alias(version), F.col("runs").alias(runs),
        F.col("owners").alias(owners))

    @F.arrow_udf("struct<text string, lines int>")
    def without(texts: pa.Array, runs: pa.Array) -> pa.Array:
        return pa.array(
            [r and dict(zip(("text", "lines"), cut(t, r, whole)))
             for t, r in zip(texts.to_pylist(), runs.to_pylist())],
            pa.struct([("text", pa.string()), ("lines", pa.int32())]))

    text = F.col(text_col)
    changed = F.col(runs).isNotNull()
    joined = docs.withColumn(text_key, F.xxhash64(text)).join(
        found, (F.col(id_col) == F.col(key)) & (F.col(text_key) == F.col(version)), "left",
    ).withColumn(left, without(F.when(changed, text), F.col(runs)))
    cleaned = F.when(changed, F.col(left)["text"]).otherwise(text).alias(text_col)
    kept = [cleaned if name == text_col else column
            for name, column in zip(docs.columns, columns_of(docs))]
    return joined.select(
        *kept, F.coalesce(F.col(left)["lines"], F.lit(0)).alias(gone), owners), gone, owners


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    min_line: int = MIN_LINE, min_block: int = MIN_BLOCK, whole: bool = False,
) -> DataFrame:
    """The documents, all columns kept, with ``text`` cleared of blocks that an earlier document
    holds.

    "Earlier" is the smaller id. Line numbers and blocks are judged on the input. Rows with a
    null id or text stay as they are; rows that repeat id and text count as one document and
    are all cleaned alike; rows that share only the id are told apart by their text. Blank
    lines are never matched; with ``whole`` they do not part a block and go with it."""
    cleaned, gone, owners = _cleaned(docs, id_col, text_col, min_line, min_block, whole)
    return cleaned.drop(gone, owners)


def report(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    min_line: int = MIN_LINE, min_block: int = MIN_BLOCK, whole: bool = False,
) -> DataFrame:
    """``doc_id, text, gone_lines, owners`` of each row: the cleaned text, how many lines it
    lost, and the ids of the earlier documents that hold them."""
    narrow = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    cleaned, gone, owners = _cleaned(narrow, "doc_id", "text", min_line, min_block, whole)
    return cleaned.select(
        "doc_id", "text",
        F.col(gone).alias("gone_lines"),
        F.coalesce(owners, F.array().cast("array<bigint>")).alias("owners"))
