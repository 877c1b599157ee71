import bisect
import hashlib
import os
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cases import CLASHING, DOCS, ODD_IDS, ODD_TEXTS, documents
from palisade.llm import token_align as ta

pytestmark = pytest.mark.skipif(not os.path.exists(ta.TOKENIZER_A), reason="no tokenizers")
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def tokenizers():
    return ta.Tokenizers()


def whole(tokenizers, text):
    """Groups of a text encoded in one go."""
    if not text:
        return []
    a, b, ok = next(tokenizers.encode([text]))
    if not ok:
        return []
    ends = [np.cumsum([len(table[i]) for i in ids]).tolist() for ids, table in (
        (a, tokenizers.a_bytes), (b, tokenizers.b_bytes))]
    common = sorted(set(ends[0]) & set(ends[1]))
    out = [([], []) for _ in common]
    for side, (ids, e) in enumerate(zip((a, b), ends)):
        for i, end in zip(ids, e):
            out[bisect.bisect_left(common, end)][side].append(i)
    return out


def brute(tokenizers, rows):
    docs = [(i, whole(tokenizers, t)) for i, t in rows]
    links = [Counter((x, y) for a, b in groups for x in a for y in b) for _, groups in docs]
    counts = Counter(p for found in links for p in found)
    most = Counter()
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    out = []
    for (i, groups), found in zip(docs, links):
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        out.append((i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups),
                    sum(found.values()), sum(n for p, n in found.items() if counts[p] == most[p[0]]),
                    sum(n * counts[p] for p, n in found.items()),
                    hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def texts(seed, n=60, size=40):
    r = random.Random(seed)
    words = ["the", "unbelievable", "é", "naïve", "日本語テキスト", "x" * 40, "don't", "a\nb", "1234567",
             "#!$", "ﬁ", "<s>", "<|endoftext|>", "<0x41>", "🙂🙂", "thonerble", " ", "\t", "Ünder", " "]
    return ["".join(r.choice(words) + r.choice([" ", " ", " ", "  ", "\n", "", "  "])
                    for _ in range(r.randrange(size))) for _ in range(n)]


def test_units_and_their_fragments_equal_the_whole(tokenizers):
    known = ta.Units(tokenizers)
    for text in texts(1, 300) + ["a  b", " a", "a ", "᠎ x", "a   b", "x\x1c y", "q  r"]:
        if not text:
            continue
        parts = ta.units(text)
        assert " ".join(parts) == text
        known.add(parts)
        groups = whole(tokenizers, text)
        got = known.run(parts)
        assert got.ok == bool(groups)
        if groups:
            assert got.text == b";".join(ta.group_text(a, b) for a, b in groups)
            pairs = Counter(x << 16 | y for a, b in groups for x in a for y in b)
            assert dict(zip(got.codes.tolist(), got.weights.tolist())) == pairs


def test_no_piece_joins_a_space_to_what_stands_before(tokenizers):
    pieces = [tokenizers.b.id_to_piece(i) for i in range(tokenizers.b.get_piece_size())]
    assert not [p for p in pieces if "▁" in p.lstrip("▁")]


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_fragments_form_a_monoid(data):
    """Any cutting of two token rows into byte ranges, put together in any tree, is the whole."""
    length = data.draw(st.integers(1, 30))
    ends = [sorted(data.draw(st.sets(st.integers(1, length))) | {length}) for _ in range(2)]
    ids = [[data.draw(st.integers(0, 5)) for _ in e] for e in ends]
    groups, rest = ta.cut_groups(*ids, *ends)
    assert rest == ([], [])
    edges = [0, *sorted(data.draw(st.sets(st.integers(1, length)))), length + 5]
    parts = []
    for low, high in zip(edges, edges[1:]):
        takes = [[i for i, e in enumerate(es) if low < e <= high] for es in ends]
        parts.append(ta.fragment_of(*([x[i] for i in t] for x, t in zip(ids, takes)),
                                    *([x[i] for i in t] for x, t in zip(ends, takes))))
    while len(parts) > 1:
        at = data.draw(st.integers(0, len(parts) - 2))
        wide = data.draw(st.integers(2, 4))
        if data.draw(st.booleans()):
            parts.insert(at, ta.Fragment())
        parts[at:at + wide] = [ta.combine(parts[at:at + wide])]
    got = ta.combine([ta.Fragment(closed=True), parts[0]])
    assert got.text == b";".join(ta.group_text(a, b) for a, b in groups)
    assert (got.n_groups, got.n_links) == (len(groups), sum(len(a) * len(b) for a, b in groups))
    assert dict(zip(got.codes.tolist(), got.weights.tolist())) == Counter(
        x << 16 | y for a, b in groups for x in a for y in b)
    assert got.suffix == ([], []) and (got.n_a, got.n_b) == tuple(map(len, ids))


@pytest.mark.parametrize("chunk", [1, 7, 50])
def test_ranges_equal_the_whole(tokenizers, chunk):
    known = ta.Units(tokenizers)
    for text in texts(chunk, 60):
        if not text:
            continue
        cut = ta.combine([ta.range_fragment(known, *r) for r in ta.cut_ranges(text, chunk)])
        groups = whole(tokenizers, text)
        row = ta.digest(cut)
        assert row["n_groups"] == len(groups) and row["groups_sha256"] == (hashlib.sha256(
            b";".join(ta.group_text(a, b) for a, b in groups)).hexdigest() if groups else "")


def test_wide_groups_count_their_ids_first():
    a, b = [1, 2] * 40, [3] * 90 + [4]
    assert Counter(dict(zip(*ta.group_pairs(a, b)))) == Counter(x << 16 | y for x in a for y in b)


@pytest.mark.parametrize("chunk,hot", [(1 << 16, 1 << 18), (60, 5), (9, 0)])
def test_equals_brute_force(spark, tokenizers, chunk, hot):
    """Whole texts and ranges combined in trees; counts from the broadcast and from the join."""
    some = texts(3, 70) + ["the cat", "the cat", ""]
    docs = documents(spark, some).repartition(4)
    assert found(ta.align(docs, chunk=chunk, hot=hot)) == brute(tokenizers, list(enumerate(some)))


def test_odd_rows(spark, tokenizers):
    """Nulls, repeated ids and texts, a long run without spaces, a long text, clashing names."""
    some = ODD_TEXTS + ["y" * 3_000, "word " * 30_000, "double  space ▁ here"]
    ids = ODD_IDS + [None, 12, 13]
    docs = documents(spark, some, ids, CLASHING)
    want = brute(tokenizers, list(zip(ids, some)))
    assert found(ta.align(docs)) == want
    assert found(ta.align(docs, chunk=1_000, hot=3)) == want
    assert ta.align(spark.createDataFrame([], DOCS)).collect() == []
    assert found(ta.align(documents(spark, [None, ""]))) == [(0, 0, 0, 0, 0, 0, 0, ""), (1, 0, 0, 0, 0, 0, 0, "")]
