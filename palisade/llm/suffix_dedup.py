"""Removal of repeated byte strings by sorting suffixes, deep-shallow.

Wanted: every byte inside a string of ``length`` bytes that also starts earlier. Sorting all
suffixes of a corpus would move each byte ``length`` times, so suffixes are first bucketed:

1. Each window of ``length`` bytes is owned by the smallest ``GRAM``-byte string in it (by
   hash, leftmost). Neighbouring windows with one owner form a run; equal windows have equal
   owners at equal offsets, so they meet in the bucket of that owner. One narrow row per run,
   some forty bytes apart, is shuffled, and runs that are equal as a whole are settled by it:
   all but the first are removed.
2. Only buckets with different runs need their bytes. There all suffixes of the runs are
   sorted: a multikey quicksort, eight bytes a step, down to a shallow depth drops most
   suffixes; those that still share their prefix go to blind tries, which branch on single
   bytes and compare each suffix in full once. Equal windows end in one leaf; all but the
   first are removed.

Buckets beyond ``BUCKET`` runs, as at the edge of a passage that very many documents hold, are
dealt out by whole windows instead. Repeats inside a task's share of the input are settled
before any shuffle. Hashes have 64 bits and are compared only within a bucket of a second
64-bit hash; what tries compare are the bytes.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import saved, slices, spark_partitions

LENGTH = 100
GRAM = 24
# Different runs of one owner sorted in one task.
BUCKET = 4096
# Bytes of text hashed at once, and most windows of one piece of a long text.
CHUNK = 1 << 20
SHALLOW = 32
_SORT_WINDOWS = 400_000
# Packed place of a run: 23 bits of the text's hash, 33 of its start, 7 of its further windows.
_KNOWN = 127
_U = np.uint64
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.copy()
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


class Hashes:
    """Hashes of substrings of a buffer from prefix sums, equal wherever a substring stands."""

    def __init__(self, which: int, size: int):
        base = _BASES[which]
        self.up = self._powers(base, size + 1)
        self.down = self._powers(pow(base, -1, 1 << 64), size + 1)

    @staticmethod
    def _powers(base: int, size: int) -> np.ndarray:
        out = np.full(size, base, dtype=np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, dtype=np.uint64)
        # Bytes count from 1, so that leading zeros matter.
        np.cumsum((data.astype(np.uint64) + _U(1)) * self.up[:len(data)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _mix((sums[stop] - sums[start]) * self.down[start])


def _sliding_minimum(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of ``keys[i:i + width]`` for every full window."""
    count = len(keys) - width + 1
    blocks = -(-len(keys) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:len(keys)] = keys
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:count], ahead[width - 1:width - 1 + count])


def _order_keys(grams: np.ndarray) -> np.ndarray:
    """What owners are chosen by: 40 bits of hash, then the position."""
    return (grams & ~_U(0xFFFFFF)) | np.arange(len(grams), dtype=np.uint64)


def _place(v: np.ndarray, start: np.ndarray, more: np.ndarray | int) -> np.ndarray:
    return (v << 40) | (start << 7) | more


class _Settler:
    """Collects ``(key, sub, o, place)`` of runs or windows. Of equal ones only the first goes
    on; the others become known repeats, merged into stretches."""

    def __init__(self, length: int, most: int = 400_000):
        self.length, self.most, self.rows, self.count = length, most, [], 0

    def add(self, key, sub, o, place) -> pa.RecordBatch | None:
        if len(key):
            self.rows.append((key, sub, o, place))
            self.count += len(key)
        return self.flush() if self.count >= self.most else None

    def flush(self) -> pa.RecordBatch:
        if not self.rows:
            return _rows(*[np.zeros(0, dtype=np.int64)] * 4)
        key, sub, o, place = (np.concatenate(c) for c in zip(*self.rows))
        self.rows, self.count = [], 0
        order = np.lexsort((place, o, sub, key))
        key, sub, o, place = key[order], sub[order], o[order], place[order]
        first = np.ones(len(key), dtype=bool)
        first[1:] = (key[1:] != key[:-1]) | (sub[1:] != sub[:-1])
        again = _after_first(first, o, place)
        o2, v2, start, stop = _stretches(o[again], place[again], self.length)
        spread = _mix(o2.view(np.uint64) ^ start.view(np.uint64)).view(np.int64)
        return _rows(
            np.concatenate([key[first].view(np.int64), spread]),
            np.concatenate([sub[first].view(np.int64), stop]),
            np.concatenate([o[first], o2]),
            np.concatenate([place[first], _place(v2, start, _KNOWN)]))


def _after_first(first: np.ndarray, *places: np.ndarray) -> np.ndarray:
    """Rows that stand later than the first of their group; a repeated row of the same document
    stands where the first does."""
    at = np.flatnonzero(first)[np.cumsum(first) - 1]
    later = np.zeros(len(first), dtype=bool)
    for place in places:
        later |= place != place[at]
    return later


def _stretches(o: np.ndarray, place: np.ndarray, length: int):
    """Merged ``(o, v, start, stop)`` byte ranges of runs that are repeats."""
    v, start = place >> 40, (place >> 7) & ((1 << 33) - 1)
    return _merged(o, v, start, start + (place & 127) + length)


def _merged(o, v, start, stop):
    if not len(o):
        return o, v, start, stop
    order = np.lexsort((start, v, o))
    o, v, start, stop = o[order], v[order], start[order], stop[order]
    same = (o[1:] == o[:-1]) & (v[1:] == v[:-1])
    # Ranges from runs of one text grow with their start, or nearly so: a running maximum per
    # text, made monotone by an offset for each text, finds where a stretch ends.
    text = np.concatenate(([0], np.cumsum(~same)))
    high = np.maximum.accumulate(stop + text * (1 << 34))
    new = np.concatenate(([True], start[1:] + text[1:] * (1 << 34) > high[:-1]))
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:] - 1, [len(o) - 1]))
    return o[first], v[first], start[first], high[last] - text[last] * (1 << 34)


_NAMES = ["key", "sub", "o", "place"]


def _rows(key, sub, o, place) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c.view(np.int64)) for c in (key, sub, o, place)], names=_NAMES)


def _runs_of(pieces, length: int, grams: Hashes, whole: Hashes):
    """``(owner, content, o, place)`` of all runs. ``pieces`` are ``(o, v, offset, bytes)``."""
    sizes = np.array([len(p[3]) for p in pieces], dtype=np.int64)
    data = np.frombuffer(b"".join(p[3] for p in pieces), dtype=np.uint8)
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    sums = grams.sums(data)
    at = np.arange(len(data) - GRAM + 1)
    codes = grams.of(sums, at, at + GRAM)
    owner = (_sliding_minimum(_order_keys(codes), length - GRAM + 1) & _U(0xFFFFFF)).astype(
        np.int64)
    inside = np.repeat(bounds[1:] - length, sizes)[:len(owner)]
    valid = np.arange(len(owner)) <= inside
    change = np.ones(len(owner), dtype=bool)
    change[1:] = (owner[1:] != owner[:-1]) | ~valid[:-1]
    first = np.flatnonzero(change & valid)
    stops = np.ones(len(owner), dtype=bool)
    stops[:-1] = change[1:] | ~valid[1:]
    last = np.flatnonzero(stops & valid)
    piece = np.searchsorted(bounds, first, side="right") - 1
    o = np.array([p[0] for p in pieces], dtype=np.int64)[piece]
    v = np.array([p[1] for p in pieces], dtype=np.int64)[piece]
    offset = np.array([p[2] for p in pieces], dtype=np.int64)[piece]
    content = whole.of(whole.sums(data), first, last + length)
    return codes[owner[first]], content, o, _place(v, first - bounds[piece] + offset, last - first)


def _find_runs(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    grams, whole = Hashes(0, 2 * CHUNK + length), Hashes(1, 2 * CHUNK + length)
    settler = _Settler(length)
    pieces, held = [], 0

    def done():
        return settler.add(*_runs_of(pieces, length, grams, whole)) if pieces else None

    for batch in slices(batches):
        o, v = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for i, text in enumerate(batch.column(2).cast(pa.binary()).to_pylist()):
            if text is None or len(text) < length:
                continue
            for offset in range(0, len(text) - length + 1, CHUNK):
                pieces.append((o[i], v[i], offset, text[offset:offset + CHUNK + length - 1]))
                held += len(pieces[-1][3])
                if held >= CHUNK:
                    if (out := done()) is not None:
                        yield out
                    pieces, held = [], 0
    if (out := done()) is not None:
        yield out
    yield settler.flush()


def _settle(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by ``key, sub, o, place``: emits known repeats, repeats of the row before,
    and, as open, the first of each different run of a shared owner."""
    last = None  # key, sub, o, place, whether it is out
    for batch in slices(batches, 65536):
        key, sub, o, place = (c.to_numpy() for c in batch.columns)
        known = place & 127 == _KNOWN
        yield _found(o[known], place[known] >> 40, (place[known] >> 7) & ((1 << 33) - 1),
                     sub[known])
        key, sub, o, place = key[~known], sub[~known], o[~known], place[~known]
        if not len(key):
            continue
        before = last[:4] if last else (~key[0], 0, 0, 0)
        same_key = np.concatenate(([key[0] == before[0]], key[1:] == key[:-1]))
        same = same_key & np.concatenate(([sub[0] == before[1]], sub[1:] == sub[:-1]))
        # The row before stands in front, in case it is the first of its group.
        again = _after_first(
            np.concatenate(([True], ~same)), np.concatenate(([before[2]], o)),
            np.concatenate(([before[3]], place)))[1:]
        yield _found(*_stretches(o[again], place[again], length))
        # A run is open if its owner has another one, before it or after it.
        distinct = ~same
        joins = same_key & distinct
        opens = joins.copy()
        firsts = np.flatnonzero(distinct)
        opens[firsts[:-1][joins[firsts[1:]]]] = True
        if last and not last[4] and len(firsts) and joins[firsts[0]]:
            yield _open([last[0]], [last[2]], [last[3]])
            last = (*last[:4], True)
        yield _open(key[opens], o[opens], place[opens])
        if len(firsts):
            f = firsts[-1]
            last = (key[f], sub[f], o[f], place[f], bool(opens[f]))


def _found(o, v, start, stop) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(o, pa.int64()), pa.array(v, pa.int64()), pa.array(start, pa.int64()),
         pa.array(stop, pa.int64()), pa.nulls(len(o), pa.int64())], names=_FOUND)


def _open(key, o, place) -> pa.RecordBatch:
    o, place = np.asarray(o, dtype=np.int64), np.asarray(place, dtype=np.int64)
    start = (place >> 7) & ((1 << 33) - 1)
    return pa.RecordBatch.from_arrays(
        [pa.array(o), pa.array(place >> 40), pa.array(start), pa.array(start + (place & 127)),
         pa.array(np.asarray(key, dtype=np.int64))], names=_FOUND)


_FOUND = ["o", "v", "start", "stop", "owner"]
_FOUND_SCHEMA = "o bigint, v bigint, start bigint, stop bigint, owner bigint"


class BlindTrie:
    """Groups equal strings of one length. Inner nodes hold only the position they branch on;
    a string runs down by single bytes, is compared once in full with the leaf it reaches, and
    branches off where they first differ."""

    def __init__(self):
        self.root = None

    def add(self, text: bytes, value: int) -> list[int]:
        """The values of this text so far, ``value`` the last of them."""
        if self.root is None:
            self.root = (None, text, [value])
            return self.root[2]
        node, path = self.root, []
        while node[0] is not None:
            path.append(node)
            child = node[1].get(text[node[0]])
            if child is None:
                child = next(iter(node[1].values()))
            node = child
        while node[0] is not None:
            node = next(iter(node[1].values()))
        if node[1] == text:
            node[2].append(value)
            return node[2]
        depth = _mismatch(node[1], text)
        leaf = (None, text, [value])
        parent, below = None, self.root
        while below[0] is not None and below[0] < depth:
            parent, below = below, below[1].get(text[below[0]])
            if below is None:
                parent[1][text[parent[0]]] = leaf
                return leaf[2]
        if below[0] == depth:
            below[1][text[depth]] = leaf
            return leaf[2]
        inner = (depth, {node[1][depth]: below, text[depth]: leaf})
        if parent is None:
            self.root = inner
        else:
            parent[1][text[parent[0]]] = inner
        return leaf[2]


def _mismatch(a: bytes, b: bytes) -> int:
    low, high = 0, len(a)
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def equal_windows(
    data: bytes, starts: np.ndarray, buckets: np.ndarray, length: int, shallow: int = SHALLOW,
) -> np.ndarray:
    """For each suffix the number of its class, -1 if no other in its bucket has the same first
    ``length`` bytes. Multikey quicksort to ``shallow`` bytes, blind tries beyond."""
    raw = np.frombuffer(data + bytes(16), dtype=np.uint8)
    eight = np.zeros(len(raw) - 7, dtype=np.uint64)
    for i in range(8):
        eight = (eight << _U(8)) | raw[i:len(raw) - 7 + i].astype(np.uint64)
    alive = np.arange(len(starts))
    group = np.unique(buckets, return_inverse=True)[1].astype(np.int64)
    group, alive = _shared(group, alive)
    for depth in range(0, min(shallow, length - 7), 8):
        if not len(alive):
            break
        letters = eight[starts[alive] + depth]
        order = np.lexsort((letters, group))
        letters, group, alive = letters[order], group[order], alive[order]
        new = np.ones(len(alive), dtype=bool)
        new[1:] = (group[1:] != group[:-1]) | (letters[1:] != letters[:-1])
        group, alive = _shared(np.cumsum(new) - 1, alive)
    result = np.full(len(starts), -1, dtype=np.int64)
    if not len(alive):
        return result
    classes = 0
    order = np.argsort(group, kind="stable")
    cuts = np.flatnonzero(np.diff(group[order])) + 1
    for members in np.split(alive[order], cuts):
        trie, tops = BlindTrie(), {}
        for m in members.tolist():
            at = int(starts[m])
            values = trie.add(data[at:at + length], m)
            tops[id(values)] = values
        for values in tops.values():
            if len(values) > 1:
                result[values] = classes
                classes += 1
    return result


def _shared(group: np.ndarray, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without members of groups of one."""
    keep = np.bincount(group)[group] > 1 if len(group) else np.zeros(0, dtype=bool)
    return group[keep], alive[keep]


def _sort_suffixes(rows, length: int, grams: Hashes) -> pa.RecordBatch:
    """Repeats among the windows of open runs ``(owner, o, place, bytes)``."""
    owners = np.array([r[0] for r in rows], dtype=np.int64)
    o = np.array([r[1] for r in rows], dtype=np.int64)
    place = np.array([r[2] for r in rows], dtype=np.int64)
    data = b"".join(r[3] for r in rows)
    sizes = np.array([len(r[3]) for r in rows], dtype=np.int64)
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    raw = np.frombuffer(data, dtype=np.uint8)
    at = np.arange(len(raw) - GRAM + 1)
    keys = _order_keys(grams.of(grams.sums(raw), at, at + GRAM))
    # Positions whose string would cross into the next run own nothing.
    crossing = np.repeat(bounds[1:] - GRAM, sizes)[:len(at)] < at
    keys[crossing] = np.iinfo(np.uint64).max
    owner_at = (np.minimum.reduceat(keys, bounds[:-1]) & _U(0xFFFFFF)).astype(np.int64) - bounds[:-1]
    windows = sizes - length + 1
    run = np.repeat(np.arange(len(rows)), windows)
    step = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
    # Equal windows have their owner at equal offsets: the first level of the sort.
    offset = owner_at[run] - step
    codes = np.unique(owners, return_inverse=True)[1].astype(np.int64)[run] * 256 + offset
    found = equal_windows(data, bounds[:-1][run] + step, codes, length)
    shared = np.flatnonzero(found >= 0)
    v, start = place >> 40, ((place >> 7) & ((1 << 33) - 1))
    o_w, v_w, start_w = o[run[shared]], v[run[shared]], start[run[shared]] + step[shared]
    order = np.lexsort((start_w, v_w, o_w, found[shared]))
    klass = found[shared][order]
    if not len(order):
        return _found(*[order] * 4)
    again = order[_after_first(
        np.concatenate(([True], klass[1:] != klass[:-1])), o_w[order], v_w[order], start_w[order])]
    return _found(*_merged(o_w[again], v_w[again], start_w[again], start_w[again] + length))


def _deal(batches, length: int) -> Iterator[pa.RecordBatch]:
    """Texts with their open runs to ``key, sub, o, place, bytes``: whole runs by owner, or,
    for owners of very many, single windows by hash."""
    one = two = None
    settler = _Settler(length)
    for batch in slices(batches, 256):
        cold = []
        texts = batch.column(2).cast(pa.binary()).to_pylist()
        o, v = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        hot = []
        for i, runs in enumerate(batch.column(3).to_pylist()):
            for r in runs:
                content = texts[i][r["start"]:r["stop"] + length]
                if r["hot"]:
                    hot.append((o[i], v[i], r["start"], content))
                else:
                    more = r["stop"] - r["start"]
                    cold.append((r["owner"], 0, o[i], (int(v[i]) << 40) | (r["start"] << 7) | more,
                                 content))
        if cold:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*cold), [pa.int64()] * 4 + [pa.binary()])],
                names=[*_NAMES, "bytes"])
        if hot and one is None:
            one, two = (Hashes(i, 4096 * 2 * length) for i in (0, 1))
        for at in range(0, len(hot), 4096):
            out = settler.add(*_windows_of(hot[at:at + 4096], length, one, two))
            if out is not None:
                yield _plain(out)
    yield _plain(settler.flush())


def _plain(rows: pa.RecordBatch) -> pa.RecordBatch:
    return rows.append_column("bytes", pa.nulls(rows.num_rows, pa.binary()))


def _windows_of(pieces, length: int, one: Hashes, two: Hashes):
    sizes = np.array([len(p[3]) for p in pieces], dtype=np.int64)
    data = np.frombuffer(b"".join(p[3] for p in pieces), dtype=np.uint8)
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    windows = sizes - length + 1
    piece = np.repeat(np.arange(len(pieces)), windows)
    step = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
    at = bounds[:-1][piece] + step
    o = np.array([p[0] for p in pieces], dtype=np.int64)[piece]
    v = np.array([p[1] for p in pieces], dtype=np.int64)[piece]
    start = np.array([p[2] for p in pieces], dtype=np.int64)[piece] + step
    return (one.of(one.sums(data), at, at + length), two.of(two.sums(data), at, at + length), o,
            _place(v, start, 0))


def _sort_dealt(batches, length: int) -> Iterator[pa.RecordBatch]:
    """Settles dealt windows, sorts the suffixes of dealt runs, owner by owner."""
    grams = Hashes(0, 2 * _SORT_WINDOWS + 4 * BUCKET * length)
    held, current, rows, count = [], None, [], 0

    def windows():
        for batch in slices(batches, 8192):
            nonlocal rows, count, held, current
            cold = batch.column(4).is_valid()
            part = batch.filter(cold)
            for row in zip(*(part.column(i).to_pylist() for i in (0, 2, 3, 4))):
                if row[0] != current:
                    if len(held) > 1:
                        rows.extend(held)
                        count += sum(len(r[3]) for r in held)
                    held, current = [], row[0]
                    if count >= _SORT_WINDOWS:
                        done.append(_sort_suffixes(rows, length, grams))
                        rows, count = [], 0
                held.append(row)
            yield batch.filter(pc.invert(cold)).select(_NAMES)

    done: list[pa.RecordBatch] = []
    for out in _settle(windows(), length):
        # Windows are compared in full, so none stays open.
        yield out.filter(out.column(4).is_null())
        while done:
            yield done.pop()
    if len(held) > 1:
        rows.extend(held)
    if rows:
        yield _sort_suffixes(rows, length, grams)
    while done:
        yield done.pop()


def _cut(text: bytes | None, ranges, keep: bool):
    """``(bytes, removed, spans, sha256, kept text)`` of one document."""
    text = text or b""
    spans: list[list[int]] = []
    for start, stop in sorted((r["start"], r["stop"]) for r in ranges or ()):
        if spans and start <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], stop)
        else:
            spans.append([start, stop])
    kept, at = [], 0
    for start, stop in spans:
        kept.append(text[at:start])
        at = stop
    kept.append(text[at:])
    left = b"".join(kept)
    return (len(text), sum(b - a for a, b in spans), len(spans), hashlib.sha256(left).hexdigest(),
            left if keep else None)


def _bucket_sizes(opened: DataFrame, bucket: int) -> DataFrame:
    return opened.groupBy("owner").agg(F.count(F.lit(1)).alias("n")).where(
        F.col("n") > bucket).select("owner", F.lit(True).alias("hot"))


def find_repeats(
    texts: DataFrame, placed: DataFrame, length: int = LENGTH, bucket: int = BUCKET,
) -> DataFrame:
    """``(o, v, ranges)``: byte ranges ``(start, stop)`` to remove from texts ``(o, v, text)``,
    which ``o, v`` order. ``placed`` are the same texts, partitioned by ``o, v``."""
    parts = spark_partitions(texts.sparkSession)
    schema = "key bigint, sub bigint, o bigint, place bigint"
    runs = texts.mapInArrow(lambda b: _find_runs(b, length), schema)
    settled = saved(
        runs.repartition(parts, "key").sortWithinPartitions(*_NAMES)
        .mapInArrow(lambda b: _settle(b, length), _FOUND_SCHEMA))
    opened = settled.where("owner IS NOT NULL")
    # Kept, so that the join has shuffles of its own, which adaptive execution may split.
    large = saved(_bucket_sizes(opened, bucket))
    wanted = (
        opened.join(large, "owner", "left")
        .groupBy("o", "v").agg(F.collect_list(F.struct(
            "owner", "start", "stop", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("runs")))
    dealt = (
        # All columns of the placed texts, so that their one shuffle serves both joins.
        placed.join(wanted.hint("shuffle_hash"), ["o", "v"])
        .select("o", "v", "text", "runs", "doc_id")
        .mapInArrow(lambda b: _deal(b, length), schema + ", bytes binary"))
    sorted_out = (
        dealt.repartition(parts, "key").sortWithinPartitions(*_NAMES)
        .mapInArrow(lambda b: _sort_dealt(b, length), _FOUND_SCHEMA))
    return settled.where("owner IS NULL").unionByName(sorted_out).groupBy("o", "v").agg(
        F.collect_list(F.struct("start", "stop")).alias("ranges"))


def text_version(text_col: str) -> Column:
    """Tells apart the texts of a repeated id."""
    return F.xxhash64(F.lit("suffix"), F.col(text_col)).bitwiseAND(F.lit((1 << 23) - 1))


def owner(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """A number per document, in the order of ids. The bits that ids leave free are a hash of the
    text, so that rows which share an id, or have none, are told apart by it and by the text's
    version together; rows without an id come last."""
    key = F.col(id_col).cast("bigint")
    ends = docs.agg(F.min(key).alias("low"), F.max(key).alias("high")).first()
    used = max(abs(ends["low"] or 0), abs(ends["high"] or 0)).bit_length()
    free = max(0, 61 - used)
    text = F.xxhash64(F.lit("owner"), F.col(text_col))
    return F.coalesce(
        F.shiftleft(key, free) + text.bitwiseAND(F.lit((1 << free) - 1)),
        F.lit(1 << 62) + text.bitwiseAND(F.lit((1 << 61) - 1)))


def dedup_substrings(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
    bucket: int = BUCKET, keep_text: bool = False,
) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of each row, and ``kept`` (bytes, as
    a cut may fall inside a character) with ``keep_text``.

    A null text is empty. Rows with a null id come after all others (below 2^61),
    ordered by a hash. Rows that repeat id and
    text are one document, so they are cut alike; texts that share only the id are ordered by
    a hash. Other columns are ignored."""
    if length < GRAM + 8:
        raise ValueError(f"length must be at least {GRAM + 8}")
    texts = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        owner(docs, id_col, text_col).alias("o"),
        F.coalesce(text_version(text_col), F.lit(0).cast("bigint")).alias("v"),
        F.col(text_col).cast("string").alias("text"))
    placed = texts.repartition(spark_partitions(docs.sparkSession), "o", "v")
    ranges = find_repeats(texts.select("o", "v", "text"), placed, length, bucket)
    joined = placed.join(ranges.hint("shuffle_hash"), ["o", "v"], "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            found = [_cut(t, r, keep_text) for t, r in zip(texts, batch.column(2).to_pylist())]
            columns = list(zip(*found)) if found else [()] * 5
            out = [batch.column(0), *(pa.array(columns[i], pa.int64()) for i in range(3)),
                   pa.array(columns[3], pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if keep_text:
                out.append(pa.array(columns[4], pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(out, names=names)

    schema = ("doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint,"
              " kept_sha256 string" + (", kept binary" if keep_text else ""))
    return joined.select("doc_id", "text", "ranges").mapInArrow(cut, schema)

