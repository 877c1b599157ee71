"""Mixing sources to target weights by iterative proportional fitting.

Token counts are summed per cell (source, language, topic). Raking scales the expected sampled
tokens of each cell, margin after margin, until sources, languages and topics have their
target shares, never beyond what a cell holds. A cell's tokens divided by what it holds is the
probability with which each of its documents is drawn, by a hash of its id.

Cells are few where sources are; up to ``LOCAL_CELLS`` of them (checked) are raked on the
driver, beyond that the same steps, with the same stopping rule, run as joins and sums on Spark;
targets then are tables as well, so a margin may have any number of values.
"""
from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.llm.common import columns_of, map_batches, saved, slices, unused

TOPICS = 8
# Letters of a word that may name a topic: shorter ones are mostly function words.
TOPIC_WORD = 6
LOCAL_CELLS = 100_000
MARGINS = ("source", "lang", "topic")
ROUNDS = 50
TOLERANCE = 1e-6
# Target shares are observed shares to this power, evened out: 1 keeps them, 0 makes all equal.
TEMPERATURE = 0.7
# Share of all tokens to sample.
BUDGET = 0.8


def topic_and_tokens(text: str | None) -> tuple[int, int]:
    """``(topic, tokens)``: a bucket of the most frequent long word (ties: the smaller word), -1
    without one, and the number of words between white space."""
    words = text.split() if text else []
    long = Counter(w for w in words if len(w) >= TOPIC_WORD)
    if not long:
        return -1, len(words)
    most = max(long.values())
    word = min(w for w, n in long.items() if n == most)
    return zlib.crc32(word.lower().encode("utf-8", "replace")) % TOPICS, len(words)


def with_topics(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    source_col: str = "source", lang_col: str = "lang",
) -> DataFrame:
    """``doc_id, source, lang, topic, tokens`` of each row; a null source or language is a value
    of its own, an empty text has no tokens."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [topic_and_tokens(t) for t in batch.column(3).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array([t for t, _ in found], pa.int32()),
             pa.array([n for _, n in found], pa.int64())],
            names=["doc_id", "source", "lang", "topic", "tokens"])

    narrow = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.col(source_col).cast("string"),
        F.col(lang_col).cast("string"), F.col(text_col))
    return map_batches(
        narrow, run, "doc_id bigint, source string, lang string, topic int, tokens bigint")


def smoothed(shares: Mapping, power: float) -> dict:
    raised = {k: v ** power for k, v in shares.items() if v > 0}
    total = sum(raised.values())
    return {k: v / total for k, v in raised.items()}


def rake(
    cells: pd.DataFrame, targets: Mapping[str, Mapping], budget: float,
    rounds: int = ROUNDS, tolerance: float = TOLERANCE,
) -> np.ndarray:
    """Sampled tokens per cell. ``cells`` has the margin columns and ``tokens``; ``targets`` the
    share of each value. Margin values without a target get nothing."""
    held = cells["tokens"].to_numpy(dtype=float)
    wanted = budget * held
    codes, goals = [], []
    total = float(wanted.sum())
    for margin, shares in targets.items():
        code, values = pd.factorize(cells[margin], use_na_sentinel=False)
        codes.append(code)
        goals.append(np.array([_share(shares, v) for v in values]) * total)
    for _ in range(rounds):
        before = wanted.copy()
        for code, goal in zip(codes, goals):
            sums = np.bincount(code, wanted, len(goal))
            factor = np.divide(goal, sums, out=np.zeros_like(goal), where=sums > 0)
            wanted = np.minimum(wanted * factor[code], held)
        if np.abs(wanted - before).max(initial=0.0) <= tolerance * max(total, 1.0):
            break
    return wanted


def _share(shares: Mapping, value) -> float:
    missing = value is None or (isinstance(value, float) and math.isnan(value))
    return float(shares.get(None if missing else value, 0.0))


def rake_distributed(
    cells: DataFrame, targets: Mapping[str, Mapping] | Mapping[str, DataFrame], budget: float,
    rounds: int = ROUNDS, tolerance: float = TOLERANCE,
) -> DataFrame:
    """``rake`` as joins and sums, for any number of cells; adds ``wanted``. ``targets`` are
    shares by value, or tables ``_value, _share`` of them."""
    total = budget * float(cells.agg(F.sum("tokens")).first()[0] or 0)
    goals = {m: t if isinstance(t, DataFrame) else _share_table(cells, m, t)
             for m, t in targets.items()}
    rows = saved(cells.withColumn("wanted", F.col("tokens") * F.lit(budget)))
    for _ in range(rounds):
        rows = rows.withColumn("_before", F.col("wanted"))
        for margin, shares in goals.items():
            sums = rows.groupBy(margin).agg(F.sum("wanted").alias("_sum"))
            factors = sums.join(shares, F.col(margin).eqNullSafe(F.col("_value")), "left").select(
                F.col(margin).alias("_m"),
                F.when(F.col("_sum") > 0, F.coalesce("_share", F.lit(0.0)) * total / F.col("_sum"))
                .otherwise(0.0).alias("_factor"))
            rows = rows.join(factors, F.col(margin).eqNullSafe(F.col("_m"))).withColumn(
                "wanted", F.least(F.col("wanted") * F.col("_factor"), F.col("tokens").cast(
                    "double"))).drop("_m", "_factor")
        rows = saved(rows)
        moved = rows.agg(F.max(F.abs(F.col("wanted") - F.col("_before")))).first()[0] or 0.0
        rows = rows.drop("_before")
        if moved <= tolerance * max(total, 1.0):
            break
    return rows


def _share_table(cells: DataFrame, margin: str, shares: Mapping) -> DataFrame:
    return cells.sparkSession.createDataFrame(
        [(k, float(v)) for k, v in shares.items()], T.StructType([
            T.StructField("_value", cells.schema[margin].dataType),
            T.StructField("_share", T.DoubleType())]))


def _even_shares(cells: DataFrame, margin: str, power: float) -> DataFrame:
    """``smoothed`` observed shares of a margin as a table."""
    sums = cells.groupBy(F.col(margin).alias("_value")).agg(
        F.sum("tokens").alias("_tokens")).where("_tokens > 0")
    raised = F.pow(F.col("_tokens").cast("double"), F.lit(power))
    total = sums.agg(F.sum(raised)).first()[0] or 1.0
    return saved(sums.select("_value", (raised / total).alias("_share")))


def cell_rates(
    described: DataFrame, targets: Mapping[str, Mapping] | None = None,
    budget: float = BUDGET, power: float = TEMPERATURE, local_cells: int = LOCAL_CELLS,
) -> DataFrame:
    """``source, lang, topic, rate``: the probability for each cell. Without ``targets``, shares
    are evened out by ``power``. Cells without tokens have rate ``budget``."""
    cells = saved(described.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")))
    spark = cells.sparkSession
    if cells.count() <= local_cells:
        table = cells.orderBy(*MARGINS).toPandas()
        table["wanted"] = rake(table, targets or {
            m: smoothed(_shares(table, m), power) for m in MARGINS}, budget)
        raked = spark.createDataFrame(
            pa.table({
                "source": pa.array(table["source"], pa.string(), from_pandas=True),
                "lang": pa.array(table["lang"], pa.string(), from_pandas=True),
                "topic": pa.array(table["topic"], pa.int32()),
                "tokens": pa.array(table["tokens"], pa.int64()),
                "wanted": pa.array(table["wanted"], pa.float64())}))
    else:
        raked = rake_distributed(
            cells, targets or {m: _even_shares(cells, m, power) for m in MARGINS}, budget)
    return raked.select(*MARGINS, F.when(
        F.col("tokens") > 0, F.col("wanted") / F.col("tokens")).otherwise(budget).alias("rate"))


def _shares(cells: pd.DataFrame, margin: str) -> dict:
    """Observed shares by value; None stands for a missing one."""
    sums = cells.groupby(margin, dropna=False)["tokens"].sum()
    total = float(sums.sum()) or 1.0
    return {None if pd.isna(k) else k: float(n) / total for k, n in sums.items()}


def draw(id_col: str = "doc_id", seed: int = 17):
    """A uniform number in [0, 1) that an id always gets."""
    return F.pmod(F.xxhash64(F.col(id_col).cast("bigint"), F.lit(seed)), F.lit(1 << 40)) / F.lit(
        float(1 << 40))


def mixed(
    docs: DataFrame, targets: Mapping[str, Mapping] | None = None, budget: float = BUDGET,
    power: float = TEMPERATURE, id_col: str = "doc_id", text_col: str = "text",
    source_col: str = "source", lang_col: str = "lang", local_cells: int = LOCAL_CELLS,
) -> DataFrame:
    """``doc_id, source, lang, topic, tokens, rate, sampled`` of each row.

    Rows that repeat an id share their draw; a null id draws as one id. Null sources and
    languages are values of their own. An empty table gives no rows."""
    described = saved(with_topics(docs, id_col, text_col, source_col, lang_col))
    rates = cell_rates(described, targets, budget, power, local_cells)
    on = [F.col(m).eqNullSafe(F.col(f"_{m}")) for m in MARGINS]
    named = rates.select(*(F.col(m).alias(f"_{m}") for m in MARGINS), "rate")
    return described.join(named, on, "left").select(
        "doc_id", *MARGINS, "tokens", "rate", (draw("doc_id") < F.col("rate")).alias("sampled"))


def sample(
    docs: DataFrame, targets: Mapping[str, Mapping] | None = None, budget: float = BUDGET,
    power: float = TEMPERATURE, id_col: str = "doc_id", text_col: str = "text",
    source_col: str = "source", lang_col: str = "lang", local_cells: int = LOCAL_CELLS,
) -> DataFrame:
    """The documents drawn, all columns as they were. Topics are found again in the pass that
    reads the texts, so no text is shuffled for them. Nulls and repeats are treated as by
    ``mixed``; a cell without tokens is drawn at the rate of the budget."""
    described = with_topics(docs, id_col, text_col, source_col, lang_col)
    rates = cell_rates(described, targets, budget, power, local_cells)
    at = docs.columns.index(text_col)
    source, lang, topic, own, rate = (
        unused(docs, n) for n in ("_source", "_lang", "_topic", "_own_topic", "_rate"))
    schema = T.StructType([*docs.schema.fields, T.StructField(own, T.IntegerType())])

    def run(batches):
        for batch in slices(batches):
            topics = [topic_and_tokens(t)[0] for t in batch.column(at).to_pylist()]
            yield batch.append_column(own, pa.array(topics, pa.int32()))

    named = rates.select(
        F.col("source").alias(source), F.col("lang").alias(lang), F.col("topic").alias(topic),
        F.col("rate").alias(rate))
    return (
        docs.mapInArrow(run, schema).join(
            named, F.col(source_col).cast("string").eqNullSafe(F.col(source))
            & F.col(lang_col).cast("string").eqNullSafe(F.col(lang))
            & F.col(own).eqNullSafe(F.col(topic)), "left")
        .where(draw(id_col) < F.col(rate)).select(*columns_of(docs)))
