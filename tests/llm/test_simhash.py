import random

import numpy as np
import pytest
import xxhash

from cases import CLASHING, DOCS, ODD_IDS, ODD_TEXTS, documents
from palisade.llm import simhash
from palisade.llm.components import components


def slow_print(text):
    words, word = [], b""
    for byte in (text or "").encode():
        if byte in b" \t\n\v\f\r":
            words, word = words + [word] * bool(word), b""
        else:
            word += bytes([byte + 32 if 65 <= byte <= 90 else byte])
    words += [word] * bool(word)
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def slow_components(prints, radius=3):
    root = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius and root[i] != root[j]:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    return root


def texts(n, seed=1):
    r = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "DELTA", "éta", "zeta\t", "theta\n", "io ta"]
    out = []
    for _ in range(n):
        if out and r.random() < 0.5:
            base = r.choice(out).split(" ")
            base[r.randrange(len(base))] = r.choice(words)
            out.append(" ".join(base))
        else:
            out.append(" ".join(r.choice(words) for _ in range(r.choice([0, 1, 2, 3, 40, 300]))))
    return out


def test_fingerprint_is_the_majority_of_shingles():
    for t in [None, "", " \n", "One", "one two", *texts(60)]:
        assert simhash.fingerprint(t) == slow_print(t)


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5, 8])
def test_counters_find_what_popcounts_find(radius):
    r = np.random.default_rng(radius)
    base = r.integers(0, 1 << 63, 4, dtype=np.uint64)
    fps = np.array(
        [int(base[i % 4]) ^ sum(1 << int(b) for b in r.choice(64, i % 10, replace=False))
         for i in range(150)], dtype=np.uint64)
    near = simhash.near_rows(simhash.bit_planes(fps), fps[:40], radius)
    bits = np.unpackbits(near.view(np.uint8), axis=1, bitorder="little")[:, :150]
    slow = [[(int(a) ^ int(b)).bit_count() <= radius for b in fps] for a in fps[:40]]
    assert (bits == np.array(slow)).all()


@pytest.mark.parametrize("block", [4, 2048])
def test_components_equal_brute_force(spark, block):
    """With a small block, buckets are cut into chunks."""
    r = random.Random(block)
    prints = []
    for _ in range(12):
        prints.append(r.getrandbits(64))
        for _ in range(14):
            prints.append(prints[-1] ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 4))))
    prints = sorted(set(prints))
    signed = [int(np.uint64(p).astype(np.int64)) for p in prints]
    links = simhash.near_links(spark.createDataFrame([(p,) for p in signed], "fp bigint"), 3, block)
    roots = {r["vertex"]: r["root"] for r in components(links).collect()}
    slow = slow_components(prints)
    fast = [roots.get(p, p) for p in signed]
    assert len(set(zip(fast, slow))) == len(set(fast)) == len(set(slow))


def test_whole_operator_equals_brute_force(spark):
    some = texts(150, 5)
    found = {r["doc_id"]: r for r in simhash.near_duplicates(documents(spark, some)).collect()}
    prints = [slow_print(t) for t in some]
    assert [found[i]["fp"] % (1 << 64) for i in range(150)] == prints
    assert [found[i]["component_id"] for i in range(150)] == slow_components(prints)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(300)] + [(5000, 5000)]
    found = {r["vertex"]: r["root"] for r in components(
        spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert len({found[i] for i in range(301)}) == 1
    assert len({found[1000 + i] for i in range(300)}) == 1
    assert found[0] != found[1000] != found[5000]
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_odd_rows(spark):
    docs = documents(spark, ODD_TEXTS, ODD_IDS, CLASHING)
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(ODD_TEXTS)
    assert {r["component_id"] for r in rows if r["fp"] == 0} == {3}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, -1, 3, 7, 9]
    empty = spark.createDataFrame([], DOCS)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_every_group_keeps_one_where_ids_repeat(spark):
    """Id 5 has one text alone and another in the group of id 1, id 8 two texts alone."""
    r = random.Random(9)
    a, b, c, d = (" ".join(f"{x}{r.randrange(500)}" for _ in range(60)) for x in "abcd")
    docs = documents(spark, [a, a, b, b, c, d], [1, 5, 5, 5, 8, 8])
    kept = sorted((r["doc_id"], r["text"]) for r in simhash.keep_one(docs).collect())
    assert kept == sorted([(1, a), (5, b), (8, c), (8, d)])
