import hashlib
import random

import numpy as np
import pytest

from cases import CLASHING, DOCS, ODD_IDS, ODD_TEXTS, documents
from palisade.llm import suffix_dedup


def slow(texts, length):
    """``(n_bytes, n_removed, n_spans, sha256)`` by a set of all strings seen."""
    seen, out = set(), []
    for text in texts:
        data = (text or "").encode()
        gone = [False] * len(data)
        for i in range(len(data) - length + 1):
            piece = data[i:i + length]
            if piece in seen:
                gone[i:i + length] = [True] * length
            seen.add(piece)
        spans = sum(g and not p for g, p in zip(gone, [False, *gone]))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def texts(seed, n=60):
    r = random.Random(seed)
    words = ["aa", "é", "the", "ab", "b", "longer", "\n"]
    passages = [" ".join(r.choice(words) for _ in range(60)) for _ in range(5)]
    out = ["", "a" * 700, "ab" * 200]
    for _ in range(n):
        parts = [" ".join(r.choice(words) for _ in range(r.randint(0, 80)))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            a = r.randint(0, 60)
            parts.append(p[a:a + r.randint(20, 300)])
            parts.append(" ".join(r.choice(words) for _ in range(r.randint(0, 30))))
        out.append(" ".join(parts))
    out += out[5:9]
    return out


def run(docs, **more):
    rows = suffix_dedup.dedup_substrings(docs, **more).collect()
    return sorted((r["doc_id"], (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]))
                  for r in rows)


@pytest.mark.parametrize("length,bucket", [(40, 4096), (40, 1), (100, 4096), (100, 2)])
def test_equals_brute_force(spark, length, bucket):
    """With a small bucket, windows are dealt one by one."""
    some = texts(length)
    found = run(documents(spark, some).repartition(5), length=length, bucket=bucket)
    assert [f for _, f in found] == slow(some, length)


def test_texts_longer_than_a_chunk(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 300)
    some = texts(7, 30)
    # Pieces are cut in the worker as they are here.
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(len(some))), pa.array([1] * len(some)), pa.array(some)],
        names=["o", "v", "text"])
    runs = pa.Table.from_batches(list(suffix_dedup._find_runs(iter([batch]), 40)))
    rows = runs.sort_by([(n, "ascending") for n in suffix_dedup._NAMES]).combine_chunks()
    out = pa.Table.from_batches(list(suffix_dedup._settle(iter(rows.to_batches()), 40))).to_pylist()
    windows = {}
    for r in out:
        if r["owner"] is not None:
            windows.setdefault(r["owner"], []).append(r)
    gone = {i: set() for i in range(len(some))}
    for r in out:
        if r["owner"] is None:
            gone[r["o"]].update(range(r["start"], r["stop"]))
    first = {}
    for i, text in enumerate(some):
        for p in range(len(text.encode()) - 39):
            first.setdefault(text.encode()[p:p + 40], (i, p))
    opened = {(r["o"], p) for r in out if r["owner"] is not None
              for p in range(r["start"], r["stop"] + 1)}
    for i, text in enumerate(some):
        data = text.encode()
        for p in range(len(data) - 39):
            if first[data[p:p + 40]] != (i, p):
                # A repeat is known already, or left to the sort.
                assert gone[i] >= set(range(p, p + 40)) or (i, p) in opened


def test_equal_windows_equal_brute_force():
    r = random.Random(3)
    data = bytes(r.choice(b"ab") for _ in range(3000)) + b"a" * 200
    starts = np.array([r.randrange(len(data) - 40) for _ in range(2000)] + [5, 5, 3100, 3101])
    buckets = np.array([r.randrange(3) for _ in starts])
    found = suffix_dedup.equal_windows(data, starts, buckets, 40, shallow=8)
    by_text = {}
    for i, s in enumerate(starts.tolist()):
        by_text.setdefault((buckets[i], data[s:s + 40]), []).append(i)
    for members in by_text.values():
        classes = set(found[members].tolist())
        assert classes == {-1} if len(members) == 1 else len(classes) == 1 and -1 not in classes
    assert len(set(found.tolist()) - {-1}) == sum(len(m) > 1 for m in by_text.values())


def test_odd_rows(spark):
    docs = documents(spark, ODD_TEXTS, ODD_IDS, CLASHING)
    rows = suffix_dedup.dedup_substrings(docs, keep_text=True).collect()
    assert len(rows) == len(ODD_TEXTS)
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in rows)
    twice = documents(spark, ["z" * 60 + "y" * 60] * 3, [4, 4, 5])
    found = {(r["doc_id"], r["n_removed"]) for r in suffix_dedup.dedup_substrings(twice).collect()}
    assert found == {(4, 0), (5, 120)}
    assert suffix_dedup.dedup_substrings(spark.createDataFrame([], DOCS)).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.dedup_substrings(docs, length=20)


def test_many_texts_without_an_id_or_with_one(spark):
    """Thousands of texts share an id, or have none: each is judged as a document of its own."""
    r = random.Random(12)
    passage = "".join(r.choice("abcdefgh ") for _ in range(150))
    texts = ["".join(r.choice("abcdefghijklmnop ") for _ in range(130)) for _ in range(6_000)]
    rows = [(1, passage), *((None if n % 2 else 5, t) for n, t in enumerate(texts)),
            (None, "x" + passage), (5, passage + "y")]
    found = suffix_dedup.dedup_substrings(
        spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8))
    cut = sorted((r["doc_id"] or -1, r["n_bytes"], r["n_removed"]) for r in found.where("n_removed > 0").collect())
    assert cut == [(-1, 151, 150), (5, 151, 150)] and found.count() == len(rows)
