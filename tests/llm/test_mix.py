import random

import numpy as np
import pandas as pd

from cases import CLASHING, DOCS, ODD_IDS, ODD_TEXTS, documents
from palisade.llm import mix


def cells(seed, n=40):
    r = random.Random(seed)
    rows = [(f"s{r.randrange(4)}", r.choice(["en", "de", None]), r.randrange(3),
             r.randrange(1, 5000)) for _ in range(n)]
    return pd.DataFrame(rows, columns=[*mix.MARGINS, "tokens"]).groupby(
        list(mix.MARGINS), dropna=False, as_index=False)["tokens"].sum()


TARGETS = {"source": {"s0": 0.4, "s1": 0.3, "s2": 0.2, "s3": 0.1},
           "lang": {"en": 0.5, "de": 0.3, None: 0.2}, "topic": {0: 0.3, 1: 0.4, 2: 0.3}}


def value(v):
    return None if v is None or v != v else v


def slow_rake(table, targets, budget, rounds):
    rows = [(tuple(value(r[m]) for m in mix.MARGINS), float(r["tokens"]))
            for _, r in table.iterrows()]
    wanted = [t * budget for _, t in rows]
    total = sum(wanted)
    for _ in range(rounds):
        for k, m in enumerate(mix.MARGINS):
            for v in {key[k] for key, _ in rows}:
                own = sum(w for (key, _), w in zip(rows, wanted) if key[k] == v)
                f = targets[m].get(v, 0.0) * total / own if own else 0.0
                wanted = [min(w * f, t) if key[k] == v else w
                          for (key, t), w in zip(rows, wanted)]
    return wanted


def test_raking_equals_loops():
    for seed in range(4):
        table = cells(seed)
        for budget in (0.05, 0.6):
            fast = mix.rake(table, TARGETS, budget, rounds=9, tolerance=0)
            assert np.allclose(fast, slow_rake(table, TARGETS, budget, 9))


def test_margins_are_met_where_they_can_be():
    table = cells(3, 400)
    wanted = mix.rake(table, TARGETS, 0.1)
    for margin, shares in TARGETS.items():
        sums = pd.Series(wanted).groupby(table[margin], dropna=False).sum() / wanted.sum()
        for v, share in sums.items():
            assert abs(share - TARGETS[margin][value(v)]) < 1e-3
    assert (wanted <= table["tokens"]).all()


def test_distributed_raking_equals_local(spark):
    table = cells(5)
    rows = [(value(r["source"]), value(r["lang"]), int(r["topic"]), int(r["tokens"]))
            for _, r in table.iterrows()]
    df = spark.createDataFrame(rows, "source string, lang string, topic int, tokens bigint")
    found = {tuple(r[m] for m in mix.MARGINS): r["wanted"]
             for r in mix.rake_distributed(df, TARGETS, 0.4, rounds=2).collect()}
    expected = mix.rake(table, TARGETS, 0.4, rounds=2, tolerance=0)
    for (s, l, t, _), w in zip(rows, expected):
        assert abs(found[(s, l, t)] - w) < 1e-6


def texts(n):
    r = random.Random(1)
    words = ["apples", "orange", "the", "of", "lemons", "quinces", "pears", "cherry"]
    return [" ".join(r.choice(words) for _ in range(r.randint(1, 60))) for _ in range(n)]


def test_sample_follows_the_rates(spark):
    docs = documents(spark, texts(3000))
    rows = mix.mixed(docs, budget=0.4).toPandas()
    assert len(rows) == 3000 and rows["rate"].between(0, 1).all()
    for _, cell in rows.groupby(list(mix.MARGINS), dropna=False):
        spread = (len(cell) * 0.25) ** 0.5
        assert abs(cell["sampled"].sum() - cell["rate"].sum()) <= 5 * spread + 1
    drawn = rows.loc[rows["sampled"], "tokens"].sum() / rows["tokens"].sum()
    assert abs(drawn - 0.4) < 0.05
    kept = {r["doc_id"] for r in mix.sample(docs, budget=0.4).collect()}
    assert kept == set(rows.loc[rows["sampled"], "doc_id"])


def test_topic_is_the_most_frequent_long_word():
    assert mix.topic_and_tokens(None) == (-1, 0) == mix.topic_and_tokens("")
    assert mix.topic_and_tokens("the of a")[0] == -1
    assert mix.topic_and_tokens("pears lemons orange lemons") == mix.topic_and_tokens(
        "lemons lemons orange the")
    assert mix.topic_and_tokens("orange lemons")[0] == mix.topic_and_tokens("lemons")[0]


def test_odd_rows(spark):
    docs = documents(spark, ODD_TEXTS, ODD_IDS, CLASHING)
    rows = mix.mixed(docs).collect()
    assert len(rows) == len(ODD_IDS) and all(0 <= r["rate"] <= 1 for r in rows)
    kept = mix.sample(docs, budget=1.0, power=1.0)
    assert kept.schema == docs.schema and kept.count() == len(ODD_IDS)
    empty = spark.createDataFrame([], DOCS)
    assert mix.mixed(empty).count() == 0 and mix.sample(empty).count() == 0


def test_targets_as_tables_and_one_stopping_rule(spark):
    """Shares as a table equal those of the driver, missing values included; where they are the
    observed ones the first round moves nothing, and both forms stop there."""
    rows = [(f"s{i % 97}" if i % 5 else None, f"l{i % 3}", i % 4, i % 50) for i in range(400)]
    schema = "source string, lang string, topic int, tokens bigint"
    df = spark.createDataFrame(rows, schema)
    table = pd.DataFrame(rows, columns=schema.replace(",", "").split()[::2])
    for margin in ("source", "topic"):
        found = {r["_value"]: r["_share"] for r in mix._even_shares(df, margin, 0.7).collect()}
        expected = mix.smoothed(mix._shares(table, margin), 0.7)
        assert found.keys() == expected.keys()
        assert all(abs(found[k] - v) < 1e-12 for k, v in expected.items())
    rates = mix.cell_rates(df, budget=0.4, power=1.0, local_cells=0).collect()
    assert len(rates) == len({r[:3] for r in rows})
    assert all(abs(r["rate"] - 0.4) < 1e-9 for r in rates)
