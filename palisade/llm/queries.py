"""Registered queries of the operators, with production parameters over whole tables.

Only the collocations have an SQL twin: alignments, learned models and the like cannot be written
in SQL that finishes on whole tables. ``tests/llm`` holds each against a brute-force version.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm import (
    ann, decontaminate, html_text, line_dedup, lm_score, mix, phrases, quality, quality_rules,
    simhash, suffix_dedup, token_align, token_count)
from palisade.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op4_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = quality.learn(docs, table(spark, sf_dir, "labels"), metadata=["n_chars"])
    scored = quality.score(docs, model, metadata=["n_chars"])
    return scored.select(
        "doc_id", quality.held_out().alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


@query
def op8_simhash(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op1_line_dedup(spark, sf_dir):
    cleaned = line_dedup.report(table(spark, sf_dir, "documents"), whole=True)
    return cleaned.select(
        "doc_id", "gone_lines", "owners", F.length("text").cast("bigint").alias("kept_chars"),
        F.sha2("text", 256).alias("kept_sha256"))


@query
def op2_decontamination(spark, sf_dir):
    return decontaminate.contaminated(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op7_source_mix(spark, sf_dir):
    return mix.mixed(table(spark, sf_dir, "documents"))


@query
def op3_html_text(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


@query
def op6_nearest_neighbours(spark, sf_dir):
    return ann.nearest(table(spark, sf_dir, "embeddings"))


@query
def op10_suffix_dedup(spark, sf_dir):
    return suffix_dedup.dedup_substrings(table(spark, sf_dir, "documents"))


@query
def op5_token_counts(spark, sf_dir):
    return token_count.count_tokens(table(spark, sf_dir, "documents"))


@query
def op9_lm_score(spark, sf_dir):
    """Target: the documents labelled as good."""
    good = table(spark, sf_dir, "labels").where("quality = 1")
    return lm_score.score(table(spark, sf_dir, "documents"), good)


@query
def op11_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.learn(docs, table(spark, sf_dir, "labels")))


@query
def op12_collocations(spark, sf_dir):
    return phrases.collocations(table(spark, sf_dir, "documents"))


@query
def op13_token_alignment(spark, sf_dir):
    return token_align.align(table(spark, sf_dir, "documents"))


ORACLES["op12_collocations"] = """
WITH texts AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
    FROM documents),
pieces AS (
    SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS words
    FROM texts),
counted AS (
    SELECT lang, size, phrase, count(*) AS f FROM (
        SELECT lang, 1 AS size, unnest(words) AS phrase FROM pieces
        UNION ALL
        SELECT lang, 2, array_to_string(words[i:i + 1], ' ')
        FROM (SELECT lang, words, unnest(range(1, len(words))) AS i FROM pieces)
        UNION ALL
        SELECT lang, 3, array_to_string(words[i:i + 2], ' ')
        FROM (SELECT lang, words, unnest(range(1, len(words) - 1)) AS i FROM pieces))
    GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counted WHERE size = 1 GROUP BY lang),
candidates AS (
    SELECT *, string_split(phrase, ' ') AS w FROM counted WHERE size > 1 AND f >= 10),
longer AS (
    SELECT lang, phrase, max(f) AS most FROM (
        SELECT lang, array_to_string(w[1:2], ' ') AS phrase, f FROM candidates WHERE size = 3
        UNION ALL
        SELECT lang, array_to_string(w[2:3], ' '), f FROM candidates WHERE size = 3)
    GROUP BY ALL),
cuts AS (
    SELECT lang, phrase, f, 1 AS k, w[1] AS lw, array_to_string(w[2:], ' ') AS rw FROM candidates
    UNION ALL
    SELECT lang, phrase, f, 2, array_to_string(w[1:2], ' '), w[3] FROM candidates WHERE size = 3),
scored AS (
    SELECT c.lang, c.phrase, c.f AS a, c.k, l.f AS l, r.f AS r,
        CAST(1000000::HUGEINT * c.f * c.f // (l.f::HUGEINT * r.f) AS BIGINT) AS score
    FROM cuts c
    JOIN counted l ON l.lang = c.lang AND l.phrase = c.lw
    JOIN counted r ON r.lang = c.lang AND r.phrase = c.rw),
lowest AS (
    SELECT * FROM scored
    QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (
    SELECT s.lang, CAST(row_number() OVER (
        PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS INTEGER) AS rank,
        s.phrase, a, l, r, score
    FROM lowest s LEFT JOIN longer o ON o.lang = s.lang AND o.phrase = s.phrase
    WHERE o.most IS NULL OR 100::HUGEINT * o.most < 50::HUGEINT * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
