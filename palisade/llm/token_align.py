"""Cross-tokenizer alignment: groups of tokens of two tokenizers between common boundaries.

Tokens of both cover the same bytes. Where both end, a group ends; every token of one side is
linked to every token of the other side of its group. Alignments form a monoid of fragments: the
tokens up to the first common end of a byte range (open prefix), the groups after it (closed) and
the tokens after its last common end (open suffix). Putting two fragments side by side closes one
group at most, from the left suffix and the right prefix; this is associative, so a text may be cut
into byte ranges anywhere, also inside a group, and put together in any tree.

Neither tokenizer joins a space to what stands before it, so a space between two other characters
is a boundary of both. What lies between such spaces (a unit, mostly a word) is a closed fragment
of its own, encoded once and remembered. Texts beyond ``CHUNK`` characters are cut into byte
ranges that Spark deals out and combines in a tree.
"""
from __future__ import annotations

import hashlib
import os
from array import array
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import packed, saved, slices, spark_partitions, unpacked

TOKENIZER_A = "/opt/tokenizers/byte_bpe_50k.json"
TOKENIZER_B = "/opt/tokenizers/piece_bpe_32k.model"
# Characters of a byte range of a long text.
CHUNK = 1 << 16
# Ranges combined at once, level by level.
FAN = 8
# Pairs whose counts every task gets, the most frequent ones; the others meet theirs in a join.
HOT_PAIRS = 1 << 18
# Units a worker remembers; they may hold as many characters as so many units of 50.
REMEMBERED = 250_000
# Links of a group from which its ids are counted before they are paired.
_WIDE = 256
# Spaces of one tokenizer's pattern or the other's beyond those that Python strips.
_ODD_SPACES = "᠎▁"


def units(text: str) -> list[str]:
    """The text cut at its spaces that stand between two characters that are no space of any
    kind."""
    parts = text.split(" ")
    odd = any(c in text for c in _ODD_SPACES)
    if not odd and all(parts) and list(map(str.strip, parts)) == parts:
        return parts
    found, held = [], [parts[0]]
    for left, right in zip(parts, parts[1:]):
        if left and right and _inside(left[-1]) and _inside(right[0]):
            found.append(" ".join(held))
            held = []
        held.append(right)
    found.append(" ".join(held))
    return found


def _inside(character: str) -> bool:
    return not character.isspace() and character not in _ODD_SPACES


def _byte_of() -> dict[str, int]:
    """The byte-level alphabet: visible Latin-1 characters stand for themselves, all other bytes
    for the code points from 256 on, in order."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {**{chr(b): b for b in visible}, **{chr(256 + i): b for i, b in enumerate(hidden)}}


class Tokenizers:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, a_path: str = TOKENIZER_A, b_path: str = TOKENIZER_B):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte_of = _byte_of()
        # Added tokens are plain text; their entries are never produced.
        self.a_bytes = [b""] * (max(self.a.get_vocab().values()) + 1)
        for piece, i in self.a.get_vocab().items():
            if all(c in byte_of for c in piece):
                self.a_bytes[i] = bytes(byte_of[c] for c in piece)
        self.b_bytes = [
            bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()
            for i, piece in ((i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))]

        self.a_lengths, self.b_lengths = (
            np.fromiter(map(len, t), np.int64, len(t)) for t in (self.a_bytes, self.b_bytes))
        # Ids in decimal, padded with zero bytes and with room for a separator.
        written = [str(i).encode() for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        self.n_digits = np.fromiter(map(len, written), np.int64, len(written))
        room = int(self.n_digits.max()) + 1
        self.digits = np.frombuffer(
            b"".join(w.ljust(room, b"\0") for w in written), np.uint8).reshape(-1, room)

    def ids(self, texts: Sequence[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both for a space and each text."""
        found = self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
        return [x.ids for x in found], self.b.encode(list(texts), num_threads=1)

    def encode(self, texts: Sequence[str]) -> Iterator[tuple[list[int], list[int], bool]]:
        """Ids of both for a space and each text, and whether their bytes are just that."""
        for text, a, b in zip(texts, *self.ids(texts)):
            data = (" " + text).encode()
            yield a, b, (b"".join([self.a_bytes[i] for i in a]) == data
                         and b"".join([self.b_bytes[i] for i in b]) == data)


@dataclass
class Fragment:
    """``closed`` is set where a common end lies inside or at its left edge; else all tokens are
    in the prefix. ``text`` holds the closed groups, ``codes`` and ``weights`` their links."""
    ok: bool = True
    closed: bool = False
    n_a: int = 0
    n_b: int = 0
    prefix: tuple[list[int], list[int]] = field(default_factory=lambda: ([], []))
    suffix: tuple[list[int], list[int]] = field(default_factory=lambda: ([], []))
    n_groups: int = 0
    n_links: int = 0
    text: bytes = b""
    codes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint32))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))


def group_text(a: Sequence[int], b: Sequence[int]) -> bytes:
    return f"{','.join(map(str, a))}|{','.join(map(str, b))}".encode()


def group_pairs(a: Sequence[int], b: Sequence[int]) -> tuple[list[int], list[int]]:
    """Codes of linked ids (``a * 65536 + b``) and how often they are linked."""
    if len(a) * len(b) < _WIDE:
        return [x << 16 | y for x in a for y in b], [1] * (len(a) * len(b))
    left, right = Counter(a), Counter(b)
    return ([x << 16 | y for x in left for y in right],
            [m * n for m in left.values() for n in right.values()])


def merged(codes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each code once, with its weights summed."""
    if not len(codes):
        return codes.astype(np.uint32), weights.astype(np.uint64)
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    starts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    return codes[starts].astype(np.uint32), np.add.reduceat(weights[order].astype(np.uint64), starts)


def closed_groups(groups: Sequence[tuple[Sequence[int], Sequence[int]]]) -> Fragment:
    """Whole groups, one after the other."""
    codes, weights = [], []
    for a, b in groups:
        c, w = group_pairs(a, b)
        codes += c
        weights += w
    return Fragment(
        True, True, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups),
        n_groups=len(groups), n_links=sum(len(a) * len(b) for a, b in groups),
        text=b";".join(group_text(a, b) for a, b in groups),
        codes=np.array(codes, np.uint32), weights=np.array(weights, np.uint64))


def cut_groups(
    a: Sequence[int], b: Sequence[int], a_ends: Sequence[int], b_ends: Sequence[int],
) -> tuple[list[tuple[Sequence[int], Sequence[int]]], tuple[Sequence[int], Sequence[int]]]:
    """Groups up to the last common end, and the tokens after it."""
    groups, i, j, x, y = [], 0, 0, 0, 0
    while i < len(a) and j < len(b):
        if a_ends[i] == b_ends[j]:
            i, j = i + 1, j + 1
            groups.append((a[x:i], b[y:j]))
            x, y = i, j
        elif a_ends[i] < b_ends[j]:
            i += 1
        else:
            j += 1
    return groups, (a[x:], b[y:])


def fragment_of(a, b, a_ends, b_ends) -> Fragment:
    """Fragment of tokens that end in one byte range; what stands left of it is not known."""
    groups, rest = cut_groups(a, b, a_ends, b_ends)
    if not groups:
        return Fragment(n_a=len(a), n_b=len(b), prefix=(list(a), list(b)))
    part = closed_groups(groups[1:])
    part.n_a, part.n_b = len(a), len(b)
    part.prefix = tuple(map(list, groups[0]))
    part.suffix = tuple(map(list, rest))
    return part


def combine(parts: Sequence[Fragment]) -> Fragment:
    """The fragments side by side, from left to right; none gives the empty fragment."""
    out = Fragment()
    open_a, open_b = out.prefix
    between: list[Fragment] = []
    for part in parts:
        out.ok &= part.ok
        out.n_a += part.n_a
        out.n_b += part.n_b
        open_a += part.prefix[0]
        open_b += part.prefix[1]
        if not part.closed:
            continue
        if out.closed and (open_a or open_b):
            between.append(closed_groups([(open_a, open_b)]))
        between.append(part)
        out.closed = True
        open_a, open_b = out.suffix = (list(part.suffix[0]), list(part.suffix[1]))
    out.n_groups = sum(p.n_groups for p in between)
    out.n_links = sum(p.n_links for p in between)
    out.text = b";".join(p.text for p in between if p.n_groups)
    if between:
        out.codes, out.weights = merged(
            np.concatenate([p.codes for p in between]), np.concatenate([p.weights for p in between]))
    return out


@dataclass
class Aligned:
    """Fragments of many units, column by column; ``codes`` and ``weights`` lie one unit behind
    the other, ``n_codes`` of each."""
    ok: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    text: list[bytes]
    n_codes: np.ndarray
    codes: np.ndarray
    weights: np.ndarray


def _flat(ids: Sequence[Sequence[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids in one row, and the unit of each."""
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    return (np.fromiter(chain.from_iterable(ids), np.int64, int(sizes.sum())),
            np.repeat(np.arange(len(ids)), sizes))


def _given_back(
    data: Sequence[bytes], ids: np.ndarray, unit: np.ndarray, table: list[bytes], lengths: np.ndarray,
) -> np.ndarray:
    """Which units the tokens give back byte by byte."""
    joined = b"".join(map(table.__getitem__, ids.tolist()))
    got = np.bincount(unit, lengths[ids], len(data)).astype(np.int64)
    same = got == np.fromiter(map(len, data), np.int64, len(data))
    if same.all() and joined == b"".join(data):
        return same
    ends = np.cumsum(got)
    return np.array([joined[e - n:e] == d for d, e, n in zip(data, ends.tolist(), got.tolist())], bool)


def aligned(
    tokenizers: Tokenizers, data: Sequence[bytes], left: Sequence[Sequence[int]],
    right: Sequence[Sequence[int]],
) -> Aligned:
    """All units at once: ends in one row of bytes, common ends by one search."""
    n = len(data)
    (a, unit_a), (b, unit_b) = _flat(left), _flat(right)
    ok = (_given_back(data, a, unit_a, tokenizers.a_bytes, tokenizers.a_lengths)
          & _given_back(data, b, unit_b, tokenizers.b_bytes, tokenizers.b_lengths))
    a, unit_a, b, unit_b = a[ok[unit_a]], unit_a[ok[unit_a]], b[ok[unit_b]], unit_b[ok[unit_b]]
    # Units that hold stand side by side, so running lengths are ends in one common row.
    a_ends, b_ends = np.cumsum(tokenizers.a_lengths[a]), np.cumsum(tokenizers.b_lengths[b])
    at = np.searchsorted(b_ends, a_ends)
    closes_a = b_ends[at] == a_ends if len(b) else np.zeros(0, bool)
    closes_b = np.zeros(len(b), bool)
    closes_b[at[closes_a]] = True
    group_a, group_b = np.cumsum(closes_a) - closes_a, np.cumsum(closes_b) - closes_b
    groups = int(closes_a.sum())
    size_a, size_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
    start_a, start_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
    unit = unit_a[start_a]

    # Links: each token of A meets all of B in its group; wide groups count their ids first.
    narrow = size_a * size_b < _WIDE
    token = np.flatnonzero(narrow[group_a])
    times = size_b[group_a[token]]
    partner = np.arange(times.sum()) + np.repeat(start_b[group_a[token]] - np.cumsum(times) + times, times)
    keys = [np.repeat(unit_a[token] << 32 | a[token] << 16, times) | b[partner]]
    weights = [np.ones(len(partner), np.uint64)]
    for g in np.flatnonzero(~narrow).tolist():
        codes, counts = group_pairs(a[start_a[g]:start_a[g] + size_a[g]].tolist(),
                                    b[start_b[g]:start_b[g] + size_b[g]].tolist())
        keys.append(np.array(codes, np.int64) | int(unit[g]) << 32)
        weights.append(np.array(counts, np.uint64))
    keys, weights = np.concatenate(keys), np.concatenate(weights)
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else order
    weights = np.add.reduceat(weights, first) if len(keys) else weights
    keys = keys[first]

    # Groups as text: ids and separators in the order in which they are written.
    ids, seps, owner = (np.zeros(len(a) + len(b), kind) for kind in (np.int64, np.uint8, np.int64))
    for tokens, place, closes, end, whose in (
            (a, np.arange(len(a)) + start_b[group_a], closes_a, b"|", unit_a),
            (b, np.arange(len(b)) + (start_a + size_a)[group_b], closes_b, b";", unit_b)):
        ids[place], owner[place] = tokens, whose
        seps[place] = np.where(closes, end[0], b","[0])
    cells, width = tokenizers.digits[ids], tokenizers.n_digits[ids]
    cells[np.arange(len(ids)), width] = seps
    written = cells[cells != 0].tobytes()
    stops = np.cumsum(np.bincount(owner, width + 1, n).astype(np.int64)).tolist()
    per_unit = lambda which, of=None: np.bincount(which, of, n).astype(np.int64)
    return Aligned(
        ok, per_unit(unit_a), per_unit(unit_b), per_unit(unit), per_unit(unit, size_a * size_b),
        [written[s:e - 1] if e > s else b"" for s, e in zip([0, *stops], stops)],
        per_unit(keys >> 32), (keys & 0xFFFFFFFF).astype(np.uint32), weights)


class Units:
    """Fragments of units, remembered: token counts, groups as text, links in one flat table."""

    def __init__(self, tokenizers: Tokenizers):
        self.tokenizers = tokenizers
        self.reset()

    def reset(self) -> None:
        self.index: dict[str, int] = {}
        self.held = 0
        self.ok, self.n_a, self.n_b = array("b"), array("q"), array("q")
        self.n_groups, self.n_links = array("q"), array("q")
        self.text: list[bytes] = []
        self.codes, self.weights, self.starts = array("I"), array("Q"), array("q", [0])

    def add(self, texts: Sequence[str]) -> None:
        """Encodes those not known yet; forgets all first where too much is held."""
        if len(self.index) > REMEMBERED or self.held > REMEMBERED * 50:
            self.reset()
        new = [t for t in dict.fromkeys(texts) if t not in self.index]
        if not new:
            return
        self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
        self.held += sum(map(len, new))
        left, right = self.tokenizers.ids(new)
        found = aligned(self.tokenizers, [(" " + t).encode() for t in new], left, right)
        self.ok.frombytes(found.ok.astype(np.int8).tobytes())
        for column, values in ((self.n_a, found.n_a), (self.n_b, found.n_b),
                               (self.n_groups, found.n_groups), (self.n_links, found.n_links)):
            column.frombytes(values.astype(np.int64).tobytes())
        self.text += found.text
        self.starts.frombytes((len(self.codes) + np.cumsum(found.n_codes)).astype(np.int64).tobytes())
        self.codes.frombytes(found.codes.tobytes())
        self.weights.frombytes(found.weights.tobytes())

    def run(self, texts: Sequence[str]) -> Fragment:
        """Closed fragment of units that stand side by side; all must have been added."""
        which = np.fromiter(map(self.index.__getitem__, texts), np.int64, len(texts))
        column = lambda values: np.frombuffer(values, values.typecode)
        if not column(self.ok)[which].all():
            return Fragment(ok=False)
        found, times = np.unique(which, return_counts=True)
        starts = column(self.starts)
        sizes = starts[found + 1] - starts[found]
        at = np.arange(sizes.sum()) + np.repeat(starts[found] - np.cumsum(sizes) + sizes, sizes)
        codes, weights = merged(
            column(self.codes)[at], column(self.weights)[at] * np.repeat(times, sizes).astype(np.uint64))
        return Fragment(
            True, True, *(int(column(c)[which].sum()) for c in (self.n_a, self.n_b)),
            n_groups=int(column(self.n_groups)[which].sum()),
            n_links=int(column(self.n_links)[which].sum()),
            text=b";".join([self.text[i] for i in which.tolist()]), codes=codes, weights=weights)

    def edge(self, text: str, low: int, high: int) -> Fragment:
        """Fragment of a unit's tokens that end beyond byte ``low``, at ``high`` at most."""
        a, b, ok = next(self.tokenizers.encode([text]))
        a_ends, b_ends = _ends(a, self.tokenizers.a_bytes), _ends(b, self.tokenizers.b_bytes)
        takes = [[i for i, e in enumerate(ends) if low < e <= high] for ends in (a_ends, b_ends)]
        part = fragment_of(*([ids[i] for i in take] for ids, take in zip((a, b), takes)),
                           *([ends[i] for i in take] for ends, take in zip((a_ends, b_ends), takes)))
        part.ok = ok
        return part


def _ends(ids: Sequence[int], table: Sequence[bytes]) -> list[int]:
    ends, at = [], 0
    for i in ids:
        at += len(table[i])
        ends.append(at)
    return ends


def cut_ranges(text: str, chunk: int = CHUNK) -> Iterator[tuple[str, int, int]]:
    """``(units, low, high)`` of each byte range of a space and the text: the text of the units
    it touches, and where in it (a space before) the range begins and ends, in bytes. Ranges end
    every ``chunk`` characters, but never inside a longer unit."""
    parts = units(text)
    starts = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=starts[1:])
    edges = [0]
    for p in range(chunk, int(starts[-1]), chunk):
        i = int(np.searchsorted(starts, p, "right")) - 1
        p = p if starts[i + 1] - starts[i] <= chunk else int(starts[i])
        if p > edges[-1]:
            edges.append(p)
    edges.append(int(starts[-1]))
    for low, high in zip(edges, edges[1:]):
        first = int(np.searchsorted(starts, low, "right")) - 1
        last = int(np.searchsorted(starts, high, "left"))
        whole = " " + " ".join(parts[first:last])
        base = int(starts[first])
        yield (whole[1:], len(whole[:low - base].encode()), len(whole[:high - base].encode()))


def range_fragment(known: Units, window: str, low: int, high: int) -> Fragment:
    """Fragment of the tokens of a range's units that end in it."""
    parts = units(window)
    size = len(window.encode()) + 1
    left, right, found = [], [], []
    if low > 0 and (len(parts) > 1 or high == size):
        left, parts = parts[:1], parts[1:]
    elif low > 0:
        return known.edge(parts[0], low, high)
    if high < size:
        parts, right = parts[:-1], parts[-1:]
    if left:
        found.append(known.edge(left[0], low, 1 << 62))
    if parts:
        known.add(parts)
        found.append(known.run(parts))
    if right:
        found.append(known.edge(right[0], -1, high - (size - len(right[0].encode()) - 1)))
    return combine(found)


def digest(part: Fragment) -> dict:
    """What is kept of a document: counts, the hash of its groups, its links. A fragment that
    begins a text has its first group in the prefix unless it begins with whole units."""
    if part.prefix[0] or part.prefix[1]:
        part = combine([Fragment(closed=True), part])
    if not part.ok or not part.n_a:
        return {"n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups_sha256": "", "size": 0,
                "data": b""}
    return {"n_a": part.n_a, "n_b": part.n_b, "n_groups": part.n_groups, "n_links": part.n_links,
            "groups_sha256": hashlib.sha256(part.text).hexdigest(), "size": len(part.codes),
            "data": packed(np.diff(part.codes, prepend=np.uint32(0)), part.weights)}


def links(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """The codes of a digest, ascending, and their weights."""
    if not row["size"]:
        return np.zeros(0, np.uint32), np.zeros(0, np.uint64)
    codes, weights = unpacked(row["data"], row["size"], np.uint32, np.uint64)
    return np.cumsum(codes, dtype=np.uint32), weights


_DIGEST = ("n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, size int, "
           "data binary")
_PART = ("ok boolean, closed boolean, n_a long, n_b long, n_groups long, n_links long, "
         "pre_a array<int>, pre_b array<int>, suf_a array<int>, suf_b array<int>, text binary, "
         "size int, data binary")


def _arrow(kinds: str) -> pa.Schema:
    names = {"boolean": pa.bool_(), "long": pa.int64(), "int": pa.int32(), "string": pa.string(),
             "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(c.split()[0], names[c.split()[1]]) for c in kinds.split(", ")])


def _part_row(part: Fragment) -> dict:
    return {"ok": part.ok, "closed": part.closed, "n_a": part.n_a, "n_b": part.n_b,
            "n_groups": part.n_groups, "n_links": part.n_links,
            "pre_a": part.prefix[0], "pre_b": part.prefix[1],
            "suf_a": part.suffix[0], "suf_b": part.suffix[1], "text": part.text,
            "size": len(part.codes),
            "data": packed(part.codes, part.weights) if len(part.codes) else b""}


def _row_part(row: dict) -> Fragment:
    codes, weights = (unpacked(row["data"], row["size"], np.uint32, np.uint64) if row["size"]
                      else (np.zeros(0, np.uint32), np.zeros(0, np.uint64)))
    return Fragment(row["ok"], row["closed"], row["n_a"], row["n_b"], (row["pre_a"], row["pre_b"]),
                    (row["suf_a"], row["suf_b"]), row["n_groups"], row["n_links"], row["text"],
                    codes, weights)


def digests(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str = TOKENIZER_A,
    b_path: str = TOKENIZER_B, chunk: int = CHUNK,
) -> DataFrame:
    """``uid, doc_id`` and the digest of each row; ``uid`` tells rows apart."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    long = F.coalesce(F.length("text") > chunk, F.lit(False))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Units(Tokenizers(a_path, b_path))
        uid = TaskContext.get().partitionId() << 33
        schema = _arrow("uid long, doc_id long, " + _DIGEST)
        for batch in slices(batches, 256):
            texts = [units(t) if t else None for t in batch.column(1).to_pylist()]
            known.add([u for t in texts if t for u in t])
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), texts):
                uid += 1
                out.append({"uid": uid, "doc_id": doc_id,
                            **digest(known.run(text) if text else Fragment())})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = -(TaskContext.get().partitionId() << 33) - 1
        schema = _arrow("uid long, doc_id long, no long, low long, high long, window string")
        for batch in slices(batches, 1):
            row = batch.to_pylist()[0]
            uid -= 1
            for no, (window, low, high) in enumerate(cut_ranges(row["text"], chunk)):
                yield pa.RecordBatch.from_pylist([{
                    "uid": uid, "doc_id": row["doc_id"], "no": no, "low": low, "high": high,
                    "window": window}], schema=schema)

    def fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Units(Tokenizers(a_path, b_path))
        schema = _arrow("uid long, doc_id long, no long, " + _PART)
        for batch in slices(batches, 8):
            yield pa.RecordBatch.from_pylist([
                {"uid": r["uid"], "doc_id": r["doc_id"], "no": r["no"],
                 **_part_row(range_fragment(known, r["window"], r["low"], r["high"]))}
                for r in batch.to_pylist()], schema=schema)

    def level(table: pa.Table) -> pa.Table:
        found = sorted(table.to_pylist(), key=lambda r: r["no"])
        return pa.Table.from_pylist([{
            "uid": found[0]["uid"], "doc_id": found[0]["doc_id"], "no": found[0]["no"] // FAN,
            **_part_row(combine([_row_part(r) for r in found]))}],
            schema=_arrow("uid long, doc_id long, no long, " + _PART))

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _arrow("uid long, doc_id long, " + _DIGEST)
        for batch in slices(batches, 1):
            row = batch.to_pylist()[0]
            yield pa.RecordBatch.from_pylist([
                {"uid": row["uid"], "doc_id": row["doc_id"], **digest(_row_part(row))}], schema=schema)

    done = rows.where(~long).mapInArrow(short, "uid long, doc_id long, " + _DIGEST)
    dealt = saved(rows.where(long).mapInArrow(
        ranges, "uid long, doc_id long, no long, low long, high long, window string"))
    top = dealt.agg(F.max("no")).first()[0]
    if top is None:
        return done
    kind = "uid long, doc_id long, no long, " + _PART
    parts = dealt.repartition(spark_partitions(spark), "uid", "no").mapInArrow(fragments, kind)
    while top > 0:
        parts = parts.groupBy("uid", F.expr(f"no div {FAN}")).applyInArrow(level, kind)
        top //= FAN
    return done.unionByName(parts.mapInArrow(finished, "uid long, doc_id long, " + _DIGEST))


def align(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str = TOKENIZER_A,
    b_path: str = TOKENIZER_B, chunk: int = CHUNK, hot: int = HOT_PAIRS,
) -> DataFrame:
    """Per row ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    The count of a pair of ids is the number of rows that hold it linked; ``n_best`` counts the
    links whose pair has the highest count of its id of A, ties included, ``count_sum`` sums the
    counts over links. Texts that are null or empty, or whose tokens do not give back a space and
    the text, have no tokens: zeros and an empty hash. Rows that repeat an id or a text count each;
    null ids stay; other columns are ignored; an empty table gives no rows. Texts of any length
    are encoded whole, long ones by ranges in several tasks; a run of ``chunk`` characters without
    a space stays in one.

    The ``hot`` most frequent pairs are sent to every task, which bounds their size; all other
    links find their counts by a join, however many they are."""
    kept = saved(digests(docs, id_col, text_col, a_path, b_path, chunk))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def summed() -> pa.RecordBatch:
            codes, n = merged(np.concatenate([c for c, _ in held]), np.concatenate([n for _, n in held]))
            held[:] = [(codes, n)]
            return pa.RecordBatch.from_arrays(
                [pa.array(codes.astype(np.int64)), pa.array(n.astype(np.int64))], names=["code", "n"])

        for batch in slices(batches, 256):
            for row in batch.to_pylist():
                codes, _ = links(row)
                held.append((codes, np.ones(len(codes), np.uint64)))
                size += len(codes)
            if size > 4_000_000:
                out = summed()
                size = out.num_rows
                if size > 2_000_000:
                    yield out
                    held, size = [], 0
        if held:
            yield summed()

    counts = saved(
        kept.select("size", "data").where("size > 0").mapInArrow(pairs, "code long, n long")
        .groupBy("code").agg(F.sum("n").alias("n")))
    best = counts.groupBy(F.expr("code div 65536").alias("a")).agg(F.max("n").alias("most"))
    judged = saved(
        counts.withColumn("a", F.expr("code div 65536")).join(best, "a")
        .select("code", "n", (F.col("n") == F.col("most")).alias("best")))
    top = judged.orderBy(F.desc("n"), "code").limit(hot).toArrow().sort_by("code")
    shared = docs.sparkSession.sparkContext.broadcast(
        tuple(top.column(c).to_numpy() for c in ("code", "n", "best")))

    def looked_up(batches: Iterator[pa.RecordBatch], rest: bool) -> Iterator[pa.RecordBatch]:
        known, n, is_best = shared.value
        for batch in slices(batches, 256):
            out = []
            for row in batch.to_pylist():
                codes, weights = links(row)
                codes, weights = codes.astype(np.int64), weights.astype(np.int64)
                at = np.searchsorted(known, codes)
                hit = np.zeros(len(codes), bool)
                hit[at < len(known)] = known[at[at < len(known)]] == codes[at < len(known)]
                if rest:
                    out.append((np.full((~hit).sum(), row["uid"]), codes[~hit], weights[~hit]))
                    continue
                at, w = at[hit], weights[hit]
                out.append({**{c: row[c] for c in (
                    "uid", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")},
                    "hot_best": int(w[is_best[at]].sum()), "hot_sum": int((w * n[at]).sum())})
            if rest:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c)) for c in zip(*out)], names=["uid", "code", "w"])
            else:
                yield pa.RecordBatch.from_pylist(out, schema=_arrow(
                    "uid long, doc_id long, n_a long, n_b long, n_groups long, n_links long, "
                    "groups_sha256 string, hot_best long, hot_sum long"))

    found = kept.mapInArrow(
        lambda b: looked_up(b, False),
        "uid long, doc_id long, n_a long, n_b long, n_groups long, n_links long, "
        "groups_sha256 string, hot_best long, hot_sum long")
    others = (
        kept.mapInArrow(lambda b: looked_up(b, True), "uid long, code long, w long")
        .join(judged, "code").groupBy("uid").agg(
            F.sum(F.when(F.col("best"), F.col("w")).otherwise(0)).alias("cold_best"),
            F.sum(F.col("w") * F.col("n")).alias("cold_sum")))
    total = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0)))
    return found.join(others, "uid", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        total("hot_best", "cold_best").alias("n_best"),
        total("hot_sum", "cold_sum").alias("count_sum"), "groups_sha256")
