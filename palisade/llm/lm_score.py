"""Document scores by cross-entropy difference of two n-gram models.

Word bigram models of a target set and of the whole corpus share one vocabulary, all words of
the corpus, one form and one smoothing; background counts are scaled to the target's size, so
both are smoothed alike. A document's score is its mean loss per token under the target model
less that under the background model: low where it reads like the target.

Word and bigram counts grow with the corpus, so no task and no driver holds them. Documents are
dealt into blocks. Each block sends its distinct words and bigrams, as 64-bit hashes, with their
counts to shards of the count table, packed in one message per shard; a shard sums the counts
of all blocks and answers each block with the totals of what it asked for. Blocks then score
their documents. Texts are shuffled once, and each distinct bigram of a block crosses the
network twice.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import slices, spark_partitions

# Documents of a block: what one task holds.
BLOCK_DOCS = 4096
MOST_PARTITIONS = 4096
# Pseudo-counts of the unigram and the bigram estimates.
UNIGRAM_PRIOR = 1000.0
BIGRAM_PRIOR = 20.0
_HELD_WORDS = 300_000


def words_of(text: str | bytes | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    if not text:
        return []
    data = text.encode("utf-8", "replace") if isinstance(text, str) else text
    return data.lower().split()


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(word, n)`` over all documents, partly summed before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())],
                names=["word", "n"])

        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                counts.update(words_of(text))
            if len(counts) > _HELD_WORDS:
                yield out()
                counts.clear()
        yield out()

    return docs.select(text_col).mapInArrow(run, "word binary, n bigint").groupBy("word").agg(
        F.sum("n").alias("n"))


class _Numbers(dict):
    """Numbers of a block's words, given as they are met; after the start and the end of a
    text, and the unknown word, which stands for all but ``known``, if that is given."""

    def __init__(self, known: frozenset[bytes] | None):
        super().__init__()
        self.known, self.words = known, list(_MARKS)

    def __missing__(self, word: bytes) -> int:
        if self.known is not None and word not in self.known:
            self[word] = _UNKNOWN
        else:
            self[word] = len(self.words)
            self.words.append(word)
        return self[word]


# No word holds white space.
_MARKS = (b" start", b" end", b" unknown")
_START, _END, _UNKNOWN = range(3)


class Block:
    """Words and bigrams of texts, each between its start and end, by local numbers."""

    def __init__(self, texts: list, known: frozenset[bytes] | None = None):
        of = _Numbers(known)
        flat: list[int] = []
        bounds = [0]
        for text in texts:
            flat.append(_START)
            flat.extend([of[w] for w in words_of(text)])
            flat.append(_END)
            bounds.append(len(flat))
        ids = np.array(flat, dtype=np.int64)
        self.size = len(of.words)
        pairs = ids[:-1] * self.size + ids[1:]
        # The step from one text's end to the next one's start is no bigram.
        real = np.ones(len(pairs), dtype=bool)
        real[np.array(bounds[1:-1], dtype=np.int64) - 1] = False
        self.lengths = np.diff(bounds) - 1
        self.starts = np.cumsum(self.lengths) - self.lengths
        uniq, self.at = np.unique(pairs[real], return_inverse=True)
        self.context, self.word = uniq // self.size, uniq % self.size
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, of.words), np.uint64, self.size)
        keys = np.concatenate([_mixed(hashes[self.context], hashes[self.word]), hashes])
        self.order = np.argsort(keys, kind="stable")
        # Hashes of all bigrams and words, in order; each shard has a range of them.
        self.keys = keys[self.order]

    def bounds(self, shards: int) -> np.ndarray:
        """Where the keys of each shard begin."""
        shard = (self.keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)
        return np.searchsorted(shard, np.arange(shards + 1, dtype=np.uint64))

    def counted(self, chosen: np.ndarray | None = None) -> np.ndarray:
        """Occurrences of ``keys`` in the ``chosen`` texts. A word counts where it is predicted,
        and the start, which never is, where it is a context."""
        weights = None if chosen is None else np.repeat(chosen, self.lengths).astype(float)
        n = np.bincount(self.at, weights, len(self.word))
        single = np.bincount(self.word, n, self.size)
        single[_START] = n[self.context == _START].sum()
        return np.concatenate([n, single])[self.order].astype(np.int64)

    def losses(
        self, total: np.ndarray, target: np.ndarray, n_total: float, n_target: float,
    ) -> tuple[np.ndarray, np.ndarray]:
        """Target and background losses of all bigrams of the texts, by the counts of ``keys``."""
        all_of, target_of = np.zeros(len(self.keys)), np.zeros(len(self.keys))
        all_of[self.order], target_of[self.order] = total, target
        cut = len(self.word)
        scale = n_target / n_total if n_total else 0.0
        background = all_of[cut:] / max(n_total, 1.0)
        own = (target_of[cut:] + UNIGRAM_PRIOR * background) / (n_target + UNIGRAM_PRIOR)

        def loss(pair, unigram, before):
            return -np.log((pair + BIGRAM_PRIOR * unigram[self.word]) / (
                before[self.context] + BIGRAM_PRIOR))[self.at]

        return (loss(target_of[:cut], own, target_of[cut:]),
                loss(scale * all_of[:cut], background, scale * all_of[cut:]))


def _mixed(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of bigrams by those of their words."""
    x = context * np.uint64(0x9E3779B97F4A7C15) + word
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def _block(id_col: str, blocks: int, other: Column | None = None) -> Column:
    spread = F.xxhash64(F.col(id_col).cast("bigint"))
    if other is not None:
        # Rows without an id are spread by their text.
        spread = F.when(F.col(id_col).isNull(), F.xxhash64(other)).otherwise(spread)
    return F.pmod(spread, F.lit(blocks))


def score(
    docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    vocabulary: int | None = None, block_docs: int = BLOCK_DOCS,
) -> DataFrame:
    """``doc_id, n_tokens, target_loss, background_loss, score`` of each row; losses are means
    in nats over the words and the end of the text. With ``vocabulary`` only so many most
    frequent words are told apart, the others are one unknown word.

    ``targets`` holds the ids of the target set in ``id_col``. A null or empty text has no
    words and is scored by its end alone. Repeated rows count as often as they occur, in the
    models as well; all rows of a target id are target. Null ids are never target. Without a
    target both models are the same and scores are 0. An empty table gives no rows."""
    spark = docs.sparkSession
    blocks = max(spark_partitions(spark), -(-docs.count() // block_docs))
    shared = None
    if vocabulary is not None:
        top = word_counts(docs, text_col).orderBy(F.desc("n"), "word").limit(vocabulary).toArrow()
        shared = spark.sparkContext.broadcast([bytes(w) for w in top.column("word").to_pylist()])

    texts = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ids = targets.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("doc_id")).distinct()
    # Tokens with the end of each text.
    lengths = texts.mapInArrow(_lengths, "doc_id bigint, n bigint")
    sums = lengths.join(ids.withColumn("target", F.lit(1)), "doc_id", "left").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_total"),
        F.coalesce(F.sum(F.expr("IF(target = 1, n, 0L)")), F.lit(0)).alias("n_target")).first()
    n_total, n_target = float(sums["n_total"]), float(sums["n_target"])

    # More partitions than blocks, so that few hold several of them.
    parts = max(spark_partitions(spark), min(4 * blocks, MOST_PARTITIONS))
    placed = texts.withColumn("block", _block("doc_id", blocks, F.col("text"))).repartition(
        parts, "block")
    wanted = ids.withColumn("block", _block("doc_id", blocks))

    def block_of(table: pa.Table) -> Block:
        return Block(table.column("text").to_pylist(),
                     None if shared is None else frozenset(shared.value))

    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _messages([])
        block = left.column("block")[0].as_py()
        chosen = set(right.column("doc_id").to_pylist())
        own = block_of(left)
        total = own.counted()
        target = own.counted(np.array([i in chosen for i in left.column("doc_id").to_pylist()]))
        bounds = own.bounds(blocks).tolist()
        return _messages([
            (s, block, _packed(own.keys[a:b], total[a:b], target[a:b]))
            for s, (a, b) in enumerate(zip(bounds, bounds[1:])) if b > a])

    def answer(table: pa.Table) -> pa.Table:
        parts = [_unpacked(m) for m in table.column("payload").to_pylist()]
        keys = np.concatenate([p[0] for p in parts])
        uniq, where = np.unique(keys, return_inverse=True)
        total, target = (np.bincount(
            where, np.concatenate([p[i] for p in parts]), len(uniq)).astype(np.int64)
            for i in (1, 2))
        cuts = np.cumsum([0, *(len(p[0]) for p in parts)])
        return _messages([
            (s, b, _packed(None, total[where[x:y]], target[where[x:y]]))
            for s, b, x, y in zip(table.column("shard").to_pylist(),
                                  table.column("block").to_pylist(), cuts, cuts[1:])])

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _scored([], [], [], [])
        own = block_of(left)
        bounds = own.bounds(blocks)
        total, target = (np.zeros(len(own.keys), dtype=np.int64) for _ in range(2))
        for s, payload in zip(right.column("shard").to_pylist(), right.column("payload").to_pylist()):
            total[bounds[s]:bounds[s + 1]], target[bounds[s]:bounds[s + 1]] = _answered(payload)
        means = [np.add.reduceat(x, own.starts) / own.lengths
                 for x in own.losses(total, target, n_total, n_target)]
        return _scored(left.column("doc_id"), own.lengths - 1, *means)

    messages = placed.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(
        ask, _MESSAGE)
    answers = messages.groupBy("shard").applyInArrow(answer, _MESSAGE)
    return placed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        judge, "doc_id bigint, n_tokens bigint, target_loss double, background_loss double,"
               " score double")


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        n = [len(words_of(t)) + 1 for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64())], names=["doc_id", "n"])


_MESSAGE = "shard bigint, block bigint, payload binary"


def _messages(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [(), (), ()]
    return pa.table({
        "shard": pa.array(columns[0], pa.int64()), "block": pa.array(columns[1], pa.int64()),
        "payload": pa.array(columns[2], pa.binary())})


def _packed(keys: np.ndarray | None, total: np.ndarray, target: np.ndarray) -> bytes:
    """Columns one after the other, steps between sorted keys in 8 bytes and counts in 5, by
    rank of their bytes, which the shuffle's compression then shortens."""
    parts = [] if keys is None else [
        _planes(np.diff(keys.astype(np.uint64), prepend=np.uint64(0)), 8)]
    return b"".join([*parts, _planes(total, 5), _planes(target, 5)])


def _planes(column: np.ndarray, width: int) -> bytes:
    return column.astype("<u8").view(np.uint8).reshape(-1, 8).T[:width].tobytes()


def _columns(payload: bytes, widths: list[int]) -> list[np.ndarray]:
    planes = np.frombuffer(payload, dtype=np.uint8).reshape(sum(widths), -1)
    out, at = [], 0
    for width in widths:
        wide = np.zeros((planes.shape[1], 8), dtype=np.uint8)
        wide[:, :width] = planes[at:at + width].T
        out.append(wide.view("<u8").reshape(-1))
        at += width
    return out


def _unpacked(payload: bytes) -> list[np.ndarray]:
    steps, total, target = _columns(payload, [8, 5, 5])
    return [np.cumsum(steps, dtype=np.uint64), total, target]


def _answered(payload: bytes) -> list[np.ndarray]:
    return _columns(payload, [5, 5])


def _scored(ids, n, target, background) -> pa.Table:
    target, background = np.asarray(target, dtype=float), np.asarray(background, dtype=float)
    if isinstance(ids, list):
        ids = pa.array(ids, pa.int64())
    return pa.table({
        "doc_id": ids, "n_tokens": pa.array(np.asarray(n, dtype=np.int64)),
        "target_loss": pa.array(target), "background_loss": pa.array(background),
        "score": pa.array(target - background)})
