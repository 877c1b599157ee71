import math
import random
from collections import Counter

import numpy as np
import pytest

from cases import CLASHING, DOCS, ODD_IDS, ODD_TEXTS, documents
from palisade.llm import lm_score

IDS = "doc_id bigint"


def slow(texts, target, size):
    """Scores by two models in plain dictionaries."""
    words = [lm_score.words_of(t) for t in texts]
    top = Counter(w for ws in words for w in ws)
    known = {w for w, _ in sorted(top.items(), key=lambda x: (-x[1], x[0]))[:size]}
    runs = [["<s>", *(w if w in known else "<unk>" for w in ws), "</s>"] for ws in words]
    total = sum(len(r) - 1 for r in runs)
    mine = sum(len(r) - 1 for i, r in enumerate(runs) if i in target)

    def model(chosen, scale):
        uni, bi, before = Counter(), Counter(), Counter()
        for i in chosen:
            uni.update(runs[i][1:])
            before.update(runs[i][:-1])
            bi.update(zip(runs[i], runs[i][1:]))
        return ({k: scale * v for k, v in c.items()} for c in (uni, bi, before))

    uni, bi, before = model(range(len(runs)), mine / total)
    t_uni, t_bi, t_before = model(target, 1.0)
    base = Counter(w for r in runs for w in r[1:])
    out = []
    for r in runs:
        sums = [0.0, 0.0]
        for v, w in zip(r, r[1:]):
            p = base[w] / total
            own = (t_uni.get(w, 0) + lm_score.UNIGRAM_PRIOR * p) / (mine + lm_score.UNIGRAM_PRIOR)
            k = lm_score.BIGRAM_PRIOR
            sums[0] -= math.log((t_bi.get((v, w), 0) + k * own) / (t_before.get(v, 0) + k))
            sums[1] -= math.log((bi.get((v, w), 0) + k * p) / (before.get(v, 0) + k))
        out.append(tuple(s / (len(r) - 1) for s in sums))
    return out


def texts(n=90):
    r = random.Random(6)
    good, bad = ["Alpha", "beta", "gamma", "é"], ["delta", "zeta", "beta", "eta", "x1"]
    return [" ".join(r.choice(good if i % 3 else bad) for _ in range(r.randint(0, 40)))
            for i in range(n)]


@pytest.mark.parametrize("block_docs,vocabulary", [(4096, 1000), (4, 1000), (7, 3)])
def test_equals_brute_force(spark, block_docs, vocabulary):
    some = texts()
    target = {i for i in range(len(some)) if i % 3 and i % 2}
    rows = {r["doc_id"]: r for r in lm_score.score(
        documents(spark, some), spark.createDataFrame([(i,) for i in target], IDS),
        block_docs=block_docs, vocabulary=vocabulary).collect()}
    for i, (own, background) in enumerate(slow(some, target, vocabulary)):
        assert abs(rows[i]["target_loss"] - own) < 1e-9
        assert abs(rows[i]["background_loss"] - background) < 1e-9
        assert abs(rows[i]["score"] - (own - background)) < 1e-9
        assert rows[i]["n_tokens"] == len(some[i].split())
    if vocabulary == 1000:
        like = [rows[i]["score"] for i in range(len(some)) if i % 3 and some[i]]
        unlike = [rows[i]["score"] for i in range(len(some)) if not i % 3 and some[i]]
        assert np.mean(like) < np.mean(unlike)


def test_messages_survive_packing():
    keys = np.array([0, 7, 2_500_150_008, 5_000_400_011], dtype=np.int64)
    total, target = np.array([1, 300, 70_000, 1 << 35]), np.array([0, 1, 65_536, 5])
    back = lm_score._unpacked(lm_score._packed(keys, total, target))
    assert all((a == b).all() for a, b in zip(back, (keys, total, target)))
    assert (lm_score._answered(lm_score._packed(None, total, target))[1] == target).all()


def test_odd_rows(spark):
    docs = documents(spark, ODD_TEXTS, ODD_IDS, CLASHING)
    ids = spark.createDataFrame([(3,), (3,), (None,), (77,)], IDS)
    rows = lm_score.score(docs, ids).collect()
    assert len(rows) == len(ODD_IDS) and all(math.isfinite(r["score"]) for r in rows)
    rows = lm_score.score(docs, ids.limit(0)).collect()
    assert all(abs(r["score"]) < 1e-12 for r in rows)
    assert lm_score.score(spark.createDataFrame([], DOCS), ids).count() == 0


def test_every_word_counts(spark):
    """Far more words than any fixed vocabulary: all are told apart, in both models."""
    r = random.Random(8)
    some = [" ".join(f"w{r.randrange(90_000)}" for _ in range(1500)) for _ in range(80)]
    assert len({w for t in some for w in t.split()}) > 60_000
    target = set(range(0, 80, 2))
    rows = {r["doc_id"]: r for r in lm_score.score(
        documents(spark, some), spark.createDataFrame([(i,) for i in target], IDS),
        block_docs=16).collect()}
    for i, (own, background) in enumerate(slow(some, target, None)):
        assert abs(rows[i]["target_loss"] - own) < 1e-9
        assert abs(rows[i]["background_loss"] - background) < 1e-9


def test_whole_64_bit_keys_survive_packing():
    keys = np.sort(np.array([1, 1 << 40, (1 << 63) + 5, (1 << 64) - 1], dtype=np.uint64))
    n = np.array([1, 2, 3, 4])
    assert (lm_score._unpacked(lm_score._packed(keys, n, n))[0] == keys).all()
