"""Edit-aware token counts.

A tokenizer of the byte-pair kind first splits a text into pre-tokens and encodes each on its
own, so a text has as many tokens as its pre-tokens together. A document keeps a segment tree
over its pre-tokens: leaves hold runs of them, inner nodes the sums of lengths and tokens.
An edit finds its place by descending on lengths, re-splits the text from a safe boundary
before the edit until boundaries meet the old ones again after it, re-encodes only that, and
updates the sums above the leaves it touched.
"""
from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import slices

# A public byte-level vocabulary and the pattern it was made with (fixed values).
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
# Pre-tokens of one leaf.
LEAF = 64
# Pre-tokens taken back before an edit: the pattern looks at most past one pre-token's end, and
# a contraction reaches three characters on.
BACK = 4
# Distinct pre-tokens whose counts a worker remembers, at most.
REMEMBERED = 300_000

Edit = tuple[int, int, str]


class _Known(dict):
    """Tokens of pre-tokens, encoded when first asked for."""

    def __init__(self, encode: Callable[[str], list[int]]):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        n = self[piece] = len(self.encode(piece))
        return n


class Counter:
    """Pre-token splitting and counts of one vocabulary."""

    def __init__(self, ranks: str = RANKS, pattern: str = PATTERN):
        with open(ranks, "rb") as lines:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding(
            "counter", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.tokens = _Known(self.encoding.encode_ordinary).__getitem__

    def split(self, text: str, start: int = 0) -> Iterator[str]:
        for found in self.pattern.finditer(text, start):
            yield found[0]

    def total(self, text: str) -> int:
        return sum(map(self.tokens, self.pattern.findall(text)))


class Document:
    """A text as a segment tree of pre-tokens."""

    def __init__(self, text: str, counts: Counter, leaf: int = LEAF):
        self.counts, self.leaf = counts, leaf
        self.reencoded = 0
        pieces = counts.pattern.findall(text)
        self.leaves = [pieces[i:i + leaf] for i in range(0, len(pieces), leaf)] or [[]]
        self._build()

    def _build(self) -> None:
        self.width = 1
        while self.width < len(self.leaves):
            self.width *= 2
        self.chars = [0] * (2 * self.width)
        self.sums = [0] * (2 * self.width)
        tokens = self.counts.tokens
        for i, pieces in enumerate(self.leaves):
            self.chars[self.width + i] = sum(map(len, pieces))
            self.sums[self.width + i] = sum(map(tokens, pieces))
        for node in range(self.width - 1, 0, -1):
            self._pull(node)

    def _pull(self, node: int) -> None:
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
        self.sums[node] = self.sums[2 * node] + self.sums[2 * node + 1]

    @property
    def tokens(self) -> int:
        return self.sums[1]

    @property
    def length(self) -> int:
        return self.chars[1]

    def text(self) -> str:
        return "".join(p for leaf in self.leaves for p in leaf)

    def _find(self, at: int) -> tuple[int, int, int]:
        """``(leaf, pre-token, start)`` of the pre-token that holds position ``at``; past the
        end, one after the last."""
        node, start = 1, 0
        while node < self.width:
            left = 2 * node
            if at < start + self.chars[left] or not self.chars[left + 1]:
                node = left
            else:
                start += self.chars[left]
                node = left + 1
        leaf = node - self.width
        pieces = self.leaves[leaf] if leaf < len(self.leaves) else []
        for i, piece in enumerate(pieces):
            if at < start + len(piece):
                return leaf, i, start
            start += len(piece)
        return leaf, len(pieces), start

    def _before(self, leaf: int, i: int, start: int) -> tuple[int, int, int]:
        """A boundary that no edit from here on can move: some pre-tokens back, and not next to
        white space, whose runs are read to their end."""
        back = 0
        while start > 0:
            while i == 0:
                leaf -= 1
                i = len(self.leaves[leaf])
            i -= 1
            piece = self.leaves[leaf][i]
            start -= len(piece)
            back += 1
            if back >= BACK and not piece.isspace() and not piece[0].isspace():
                break
        return leaf, i, start

    def edit(self, start: int, stop: int, new: str) -> None:
        """Replaces ``[start, stop)`` by ``new``."""
        if not 0 <= start <= stop <= self.length:
            raise ValueError(f"edit [{start}, {stop}) outside a text of {self.length}")
        first, i, at = self._before(*self._find(start))
        # Old pre-tokens from the boundary on are taken as far as the new split needs them.
        old = self._pieces(first, i)
        tail, tail_ends, leaf, j = "", [], first, i
        shift = len(new) - (stop - start)
        rewritten: list[str] = []
        reach = 0
        need = stop - at
        while True:
            grew = False
            for leaf, j, piece in old:
                tail += piece
                tail_ends.append((len(tail), leaf, j))
                grew = True
                if len(tail) >= need:
                    break
            ended = not grew or len(tail) + at >= self.length
            edited = tail[:start - at] + new + tail[stop - at:]
            ends = {e + shift: (leaf_, j_) for e, leaf_, j_ in tail_ends if e >= stop - at}
            rewritten, reach, met = [], 0, None
            for piece in self.counts.split(edited):
                if not ended and reach + len(piece) >= len(edited) - 1:
                    break
                rewritten.append(piece)
                reach += len(piece)
                # Splitting depends only on what follows a boundary, so from a boundary that both
                # splits have, all later ones are the same.
                if reach >= start - at + len(new) and reach in ends and (
                        reach < len(edited) or ended):
                    met = ends[reach]
                    break
            if met is not None or ended:
                break
            need = max(need, len(tail)) + 64
        self.reencoded += reach
        if met is None:
            last, last_i = len(self.leaves) - 1, len(self.leaves[-1])
        else:
            last, last_i = met[0], met[1] + 1
        self._replace(first, i, last, last_i, rewritten)

    def _pieces(self, leaf: int, i: int) -> Iterator[tuple[int, int, str]]:
        while leaf < len(self.leaves):
            pieces = self.leaves[leaf]
            while i < len(pieces):
                yield leaf, i, pieces[i]
                i += 1
            leaf, i = leaf + 1, 0

    def _replace(self, first: int, i: int, last: int, last_i: int, pieces: list[str]) -> None:
        merged = self.leaves[first][:i] + pieces + self.leaves[last][last_i:]
        self.leaves[first] = merged
        for leaf in range(first + 1, last + 1):
            self.leaves[leaf] = []
        if len(merged) > 4 * self.leaf:
            # A leaf that outgrew its size is cut up; sums of whole leaves are rebuilt.
            flat = [p for leaf in self.leaves for p in leaf]
            self.leaves = [flat[k:k + self.leaf] for k in range(0, len(flat), self.leaf)] or [[]]
            self._build()
            return
        tokens = self.counts.tokens
        touched = set()
        for leaf in range(first, last + 1):
            node = self.width + leaf
            self.chars[node] = sum(map(len, self.leaves[leaf]))
            self.sums[node] = sum(map(tokens, self.leaves[leaf]))
            touched.add(node // 2)
        while touched and max(touched) >= 1:
            above = set()
            for node in touched:
                if node:
                    self._pull(node)
                    above.add(node // 2)
            touched = above - {0}


# Edits of a usual clean-up: mail addresses, long digit runs and repeated blanks. Each rule is a
# pattern, what replaces it, and a string without which it cannot match.
CLEAN_UP = (
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "<mail>", "@"),
    (r"\d[\d ()-]{6,}\d", "<number>", ""),
    (r" {2,}", " ", "  "),
    (r"\t+", " ", "\t"),
)


def clean_up_edits(text: str, rules: Sequence[tuple[str, str, str]] = CLEAN_UP) -> list[Edit]:
    """Non-overlapping edits by pattern, in text order; of overlapping ones the first counts."""
    used = [r for r in rules if r[2] in text]
    if not used:
        return []
    return [(m.start(), m.end(), used[m.lastindex - 1][1])
            for m in re.finditer("|".join(f"({r[0]})" for r in used), text)]


def counted(
    text: str | None, edits: Sequence[Edit], counts: Counter,
) -> tuple[int, int, int, int, int]:
    """``(tokens before, tokens after, edits, characters after, characters re-encoded)``. Edits
    are places in the original text, do not overlap, and are applied from the last on, so that
    none moves another. Without edits no tree is needed."""
    text = text or ""
    if not edits:
        n = counts.total(text)
        return n, n, 0, len(text), 0
    document = Document(text, counts)
    before = document.tokens
    for start, stop, new in sorted(edits, reverse=True):
        document.edit(start, stop, new)
    return before, document.tokens, len(edits), document.length, document.reencoded


def count_tokens(
    docs: DataFrame, edits_of: Callable[[str], Sequence[Edit]] = clean_up_edits,
    id_col: str = "doc_id", text_col: str = "text", edits_col: str | None = None,
    ranks: str = RANKS, pattern: str = PATTERN,
) -> DataFrame:
    """``doc_id, n_tokens, n_tokens_edited, n_edits, n_chars_edited, n_reencoded`` of each row.

    Edits come from ``edits_col`` (an array of ``start, stop, new``; null for none) or, without
    it, from ``edits_of`` the text. ``ranks`` is a vocabulary file that every executor has. A
    null text counts as empty; rows are independent, so repeats and null ids are counted like
    any other; other columns are ignored."""
    chosen = [F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("_text")]
    if edits_col is not None:
        chosen.append(F.col(edits_col).alias("_edits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter(ranks, pattern)
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            if edits_col is None:
                edits = [edits_of(t) if t else [] for t in texts]
            else:
                edits = [[(e["start"], e["stop"], e["new"]) for e in es or ()]
                         for es in batch.column(2).to_pylist()]
            found = np.array([counted(t, e, counts) for t, e in zip(texts, edits)],
                             dtype=np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(found[:, i]) for i in range(5))], names=_NAMES)

    return docs.select(*chosen).mapInArrow(run, ", ".join(f"{n} bigint" for n in _NAMES))


_NAMES = ["doc_id", "n_tokens", "n_tokens_edited", "n_edits", "n_chars_edited", "n_reencoded"]
