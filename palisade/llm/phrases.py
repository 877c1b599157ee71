"""Phrase collocations: frequent word sequences by Rabin-Karp fingerprints.

Texts are packed into blocks of one language and stored. In a block, prefix polynomials in numpy
(modulo 2^64) give the fingerprint of every word and every sequence of words at once; occurrences
are counted in the block, each fingerprint with a pointer to its first one. Inside a block,
sequences of one fingerprint are compared with their text, so that a collision makes two entries.
One shuffle sums the entries by fingerprint; those below the least count cannot be frequent,
whatever they stand for. Pointers of the rest go back to their blocks, where the phrases are read
from the text, and counts are summed once more by phrase: a collision between blocks ends there.
No text of a rare sequence is ever built.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palisade.llm.common import packed, saved, slices, spark_partitions, unpacked

# Bytes of text in a block; a longer word makes a longer block.
BLOCK_BYTES = 6 << 20
# Bytes of a block that are hashed at once.
_STRIDE = 1 << 20
# Bits of a fingerprint that travel. Collisions end in the text, so this is a matter of size only.
PRINT_BITS = 52
# Blocks whose entries meet in one group of the shuffle.
_BLOCKS_A_GROUP = 4
# Lots in which a language's candidates are ranked first.
_LOTS = 8
# An entry's pointer is the number of its first word times this, plus its number of words.
_STEP = 8
_BREAKS = b".,;:!?\n\x0b\x0c\r"
_KIND = np.zeros(256, np.uint8)
_KIND[list(b" \t")] = 1
_KIND[list(_BREAKS)] = 2
_LAST_BREAK = re.compile(rb"(?s).*[.,;:!?\n-\r]")
_LAST_SPACE = re.compile(rb"(?s).*[ \t]")
_NEXT_CUT = re.compile(rb"[ \t.,;:!?\n-\r]")
_WORD_AHEAD = re.compile(rb"[ \t]*[^ \t.,;:!?\n-\r]+")
_BASE = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(7).integers(0, 1 << 64, 256, dtype=np.uint64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(size: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, kept between blocks."""
    if len(_powers[0]) <= size:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            row = np.full(size + 1, base, np.uint64)
            row[0] = 1
            _powers[i] = np.cumprod(row)
    return _powers


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _windows(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial of each ``values[start:end]``, wherever it stands."""
    up, down = _powers_to(len(values))
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:len(values)], out=prefix[1:])
    return (prefix[ends] - prefix[starts]) * down[starts]


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes, each word's start and end, and the piece it stands in."""
    a = np.frombuffer(data, np.uint8)
    kind = _KIND[a]
    edges = np.diff((kind == 0).view(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    return a, starts, ends, np.cumsum(kind == 2, dtype=np.int32)[starts]


def _runs(starts: np.ndarray, ends: np.ndarray) -> Iterator[slice]:
    """The words in runs of about ``_STRIDE`` bytes."""
    at = 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + _STRIDE, "right")))
        yield slice(at, stop)
        at = stop


def _word_prints(a: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Fingerprint of each word."""
    prints = np.zeros(len(starts), np.uint64)
    for run in _runs(starts, ends):
        base = starts[run.start]
        prints[run] = _windows(
            _BYTES[a[base:ends[run.stop - 1]]], starts[run] - base, ends[run] - base)
    return _mixed(prints)


def _word_ids(a: np.ndarray, starts: np.ndarray, ends: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Equal numbers for equal words: by fingerprint, checked byte by byte."""
    _, first, ids = np.unique(prints, return_index=True, return_inverse=True)
    lengths, like = ends - starts, first[ids]

    def same(run: slice) -> bool:
        # Every byte against the byte at its place in the first word of that fingerprint.
        n = lengths[run]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return bool((a[np.repeat(starts[run], n) + within]
                     == a[np.repeat(starts[like[run]], n) + within]).all())

    if (lengths == lengths[like]).all() and all(same(run) for run in _runs(starts, ends)):
        return ids
    data, seen = a.tobytes(), {}
    return np.array([seen.setdefault(data[s:e], len(seen))
                     for s, e in zip(starts.tolist(), ends.tolist())], dtype=np.int64)


def _counted(prints: np.ndarray, at: np.ndarray, columns: list[np.ndarray]):
    """``(fingerprint, first place, count)`` of the sequences at ``at``; ``columns`` hold the
    numbers of their words, which tell sequences of one fingerprint apart."""
    found, first, groups, counts = np.unique(
        prints, return_index=True, return_inverse=True, return_counts=True)
    if all((c == c[first][groups]).all() for c in columns):
        return found, at[first].astype(np.uint32), counts.astype(np.uint32)
    rows = np.column_stack([prints, *(c.astype(np.uint64) for c in columns)])
    found, first, counts = np.unique(rows, axis=0, return_index=True, return_counts=True)
    return found[:, 0], at[first].astype(np.uint32), counts.astype(np.uint32)


def block_entries(
    data: bytes, own: int, seed: int, longest: int, bits: int = PRINT_BITS,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints, pointers and counts of all sequences of up to ``longest`` words that start
    in the first ``own`` bytes, ordered by fingerprint. ``bits`` fewer than 64 make collisions."""
    a, starts, ends, piece = _words(data)
    drop = np.uint64(64 - bits)
    words = _word_prints(a, starts, ends) >> drop
    ids = _word_ids(a, starts, ends, words)
    parts = []
    for n in range(1, longest + 1):
        size = max(0, len(words) - n + 1)
        at = np.flatnonzero((piece[:size] == piece[n - 1:]) & (starts[:size] < own))
        prints = _mixed(_windows(words, at, at + n) + np.uint64((seed * _STEP + n) % (1 << 64)))
        found, first, counts = _counted(prints >> drop, at, [ids[at + i] for i in range(n)])
        parts.append((found << drop, first * np.uint32(_STEP) + np.uint32(n), counts))
    prints, pointers, counts = (np.concatenate(x) for x in zip(*parts))
    del parts, words, ids, starts, ends, piece
    order = np.argsort(prints, kind="stable")
    return prints[order], pointers[order], counts[order]


def cut_long(data: bytes, most: int) -> Iterator[tuple[bytes, int]]:
    """``(part, own)``: the text in parts of about ``most`` bytes. A part ends at the end of a
    piece; inside a longer piece it ends between words, and what starts in its first ``own``
    bytes is its own, the words after that stand there for the sequences across."""
    at = 0
    while len(data) - at > most:
        end = _LAST_BREAK.match(data, at, at + most)
        if end:
            yield data[at:end.end()], end.end() - at
            at = end.end()
            continue
        end = _LAST_SPACE.match(data, at, at + most)
        stop = end.end() if end else next(
            (m.start() + 1 for m in [_NEXT_CUT.search(data, at + most)] if m), len(data))
        ahead = stop
        if data[stop - 1:stop] in (b" ", b"\t"):
            for _ in range(_STEP - 2):
                m = _WORD_AHEAD.match(data, ahead)
                ahead = m.end() if m else ahead
        yield data[at:ahead], stop - at
        at = stop
    if at < len(data):
        yield data[at:], len(data) - at


def blocks(docs: DataFrame, lang_col: str = "lang", text_col: str = "text",
           size: int = BLOCK_BYTES) -> DataFrame:
    """Lower-cased texts of one language each, ``size`` bytes or so: ``block``, ``lang``,
    ``words`` (how many are its own), ``own``, ``length``, ``data``. Null texts count as empty,
    a null language as ``und``."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no = TaskContext.get().partitionId() << 32
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}

        def block(lang: str, data: bytes, own: int) -> pa.RecordBatch:
            nonlocal no
            no += 1
            words = int((_words(data)[1] < own).sum())
            return pa.RecordBatch.from_pylist([{
                "block": no, "lang": lang, "words": words, "own": own, "length": len(data),
                "data": pa.compress(data, codec="zstd", asbytes=True)}], schema=arrow)

        def flush(lang: str) -> pa.RecordBatch:
            data = b"\n".join(held.pop(lang))
            sizes.pop(lang)
            return block(lang, data, len(data))

        for batch in slices(batches, 64):
            for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                for part, own in cut_long(text.encode().lower(), size):
                    if own < len(part):
                        yield block(lang, part, own)
                        continue
                    held.setdefault(lang, []).append(part)
                    sizes[lang] = sizes.get(lang, 0) + own + 1
                    if sizes[lang] >= size:
                        yield flush(lang)
                if sum(sizes.values()) >= 4 * size:
                    yield flush(max(sizes, key=sizes.get))
        for lang in list(held):
            yield flush(lang)

    arrow = pa.schema([
        ("block", pa.int64()), ("lang", pa.string()), ("words", pa.int64()), ("own", pa.int64()),
        ("length", pa.int64()), ("data", pa.binary())])
    return docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
        F.col(text_col).alias("text")).where("text <> ''").mapInArrow(
        pack, "block long, lang string, words long, own long, length long, data binary")


def frequent_phrases(
    stored: DataFrame, least: int, longest: int, bits: int = PRINT_BITS,
) -> DataFrame:
    """``lang, phrase, n_words, f``: every sequence of up to ``longest`` words with ``f``
    occurrences, ``least`` or more, from stored blocks."""
    if not 1 <= longest < _STEP:
        raise ValueError(f"phrases of 1 to {_STEP - 1} words")
    spark = stored.sparkSession
    groups = max(spark_partitions(spark), stored.count() // _BLOCKS_A_GROUP)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            row = batch.to_pylist()[0]
            data = pa.decompress(row["data"], row["length"], codec="zstd", asbytes=True)
            seed = int.from_bytes(row["lang"].encode()[:64], "little") % ((1 << 61) - 1)
            prints, pointers, counts = block_entries(data, row["own"], seed, longest, bits)
            group = ((prints >> np.uint64(32)) * np.uint64(groups)) >> np.uint64(32)
            edges = np.searchsorted(group, np.arange(groups + 1, dtype=np.uint64)).tolist()
            chosen = [k for k in range(groups) if edges[k] < edges[k + 1]]
            payload = [packed(np.diff(prints[s:e], prepend=np.uint64(0)), pointers[s:e], counts[s:e])
                       for s, e in ((edges[k], edges[k + 1]) for k in chosen)]
            yield pa.RecordBatch.from_arrays([
                pa.array(chosen, pa.int32()), pa.array([row["block"]] * len(chosen), pa.int64()),
                pa.array([edges[k + 1] - edges[k] for k in chosen], pa.int32()),
                pa.array(payload, pa.binary())], names=["part", "block", "size", "data"])

    def summed(table: pa.Table) -> pa.Table:
        rows = list(zip(*(table.column(c).to_pylist() for c in ("block", "size", "data"))))
        entries = [unpacked(d, n, np.uint64, np.uint32, np.uint32) for _, n, d in rows]
        prints = np.concatenate([np.cumsum(p) for p, _, _ in entries])
        counts = np.concatenate([c for _, _, c in entries])
        _, which = np.unique(prints, return_inverse=True)
        often = np.bincount(which, counts)[which] >= least
        out, at = [], 0
        for (block, size, _), (_, pointers, own) in zip(rows, entries):
            take = often[at:at + size]
            at += size
            if take.any():
                out.append((block, int(take.sum()), packed(pointers[take], own[take])))
        blocks_, sizes, data = zip(*out) if out else ((), (), ())
        return pa.Table.from_arrays(
            [pa.array(blocks_, pa.int64()), pa.array(sizes, pa.int32()), pa.array(data, pa.binary())],
            names=["block", "size", "data"])

    def read(wanted: pa.Table, block: pa.Table) -> pa.Table:
        rows = block.to_pylist()
        if not rows or not wanted.num_rows:
            return pa.table({"lang": pa.array([], pa.string()), "phrase": pa.array([], pa.string()),
                             "f": pa.array([], pa.int64())})
        data = pa.decompress(rows[0]["data"], rows[0]["length"], codec="zstd", asbytes=True)
        _, starts, ends, _ = _words(data)
        phrases, counts = [], []
        for size, data_ in zip(wanted.column("size").to_pylist(), wanted.column("data").to_pylist()):
            pointers, own = unpacked(data_, size, np.uint32, np.uint32)
            first = (pointers // _STEP).astype(np.int64)
            last = first + pointers % _STEP - 1
            phrases.extend(
                b" ".join(data[s:e].split()).decode()
                for s, e in zip(starts[first].tolist(), ends[last].tolist()))
            counts.append(own)
        return pa.table({"lang": pa.array([rows[0]["lang"]] * len(phrases), pa.string()),
                         "phrase": pa.array(phrases, pa.string()),
                         "f": pa.array(np.concatenate(counts).astype(np.int64))})

    wanted = (
        stored.mapInArrow(dealt, "part int, block long, size int, data binary")
        .groupBy("part").applyInArrow(summed, "block long, size int, data binary"))
    texts = stored.select("block", "lang", "length", "data")
    return (
        wanted.groupBy("block").cogroup(texts.groupBy("block"))
        .applyInArrow(read, "lang string, phrase string, f long")
        .groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
        .select("lang", "phrase", F.size(F.split("phrase", " ")).alias("n_words"), "f"))


def collocations(
    docs: DataFrame, least: int = 10, most: int = 2_000, longest: int = 3, inside: int = 50,
    lang_col: str = "lang", text_col: str = "text", bits: int = PRINT_BITS, size: int = BLOCK_BYTES,
) -> DataFrame:
    """Per language the first ``most`` phrases of two to ``longest`` words by score.

    A phrase occurs ``a`` times, ``least`` at least. Of its cuts in two the one of the lowest
    score counts, the first of equals: ``floor(1000000 a^2 / (l r))`` for parts that occur ``l``
    and ``r`` times. Phrases inside a longer one that occurs in ``inside`` per cent of their
    places or more are left out. Returns ``lang, rank, phrase, a, l, r, n, score``, ``n`` being
    all words of the language; order: score, then ``a``, then bytes of the phrase.

    Null and empty texts hold no words; a null language is ``und``; repeated rows count each
    time; ids are not used, nor any other column; an empty table gives no rows. Texts of any
    length are cut between words."""
    stored = saved(blocks(docs, lang_col, text_col, size))
    phrases = saved(frequent_phrases(stored, least, longest, bits))
    totals = stored.groupBy("lang").agg(F.sum("words").alias("n"))
    words = F.split("phrase", " ")
    candidates = phrases.where("n_words > 1").withColumn("w", words)

    longer = (
        candidates.where("n_words > 2").select("lang", "f", F.explode(F.expr(
            "flatten(transform(sequence(2, n_words - 1), m -> transform("
            "sequence(1, n_words - m + 1), i -> array_join(slice(w, i, m), ' '))))")).alias("phrase"))
        .groupBy("lang", "phrase").agg(F.max("f").alias("longer")))
    left = phrases.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    right = phrases.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    wide = {c: f"cast({c} as decimal(38, 0))" for c in ("f", "l", "r")}
    scored = (
        candidates.join(longer, ["lang", "phrase"], "left")
        .where(F.expr(f"longer is null or cast(longer as decimal(38, 0)) * 100 < {wide['f']} * {inside}"))
        .select("lang", "phrase", "f", "w", "n_words",
                F.explode(F.expr("sequence(1, n_words - 1)")).alias("k"))
        .select("lang", "f", "k",
                F.expr("array_join(slice(w, 1, k), ' ')").alias("left"),
                F.expr("array_join(slice(w, k + 1, n_words - k), ' ')").alias("right"))
        .join(left, ["lang", "left"]).join(right, ["lang", "right"])
        .select("lang", F.concat_ws(" ", "left", "right").alias("phrase"), "f", F.struct(
            F.expr(f"{wide['f']} * {wide['f']} * 1000000 div ({wide['l']} * {wide['r']})").alias("score"),
            "k", "l", "r").alias("cut"))
        .groupBy("lang", "phrase", "f").agg(F.min("cut").alias("cut")))
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    lot = F.pmod(F.hash("phrase"), F.lit(_LOTS))
    return (
        scored.select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "cut.score")
        # Lots first, so that no task ranks more than a fixed number of rows of a language.
        .withColumn("rank", F.row_number().over(Window.partitionBy("lang", lot).orderBy(*order)))
        .where(F.col("rank") <= most)
        .withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
        .where(F.col("rank") <= most)
        .join(totals, "lang")
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
