from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from helpers import raw, raw_frame, rows_of
from palisade.functions import scoring
from palisade.functions.text import has_text, jtrim, normalise, or_unknown
from palisade.operators.enrich import enrich, score
from palisade.policy import Policy, parse_duration

# The scoring table uses 50 for CRITICAL, unlike the shipped policy.
SCORING = replace(Policy(), severity_scores={"CRITICAL": 50, "HIGH": 30, "MEDIUM": 20, "LOW": 10})


@pytest.mark.parametrize("policy,cases", [
    (SCORING, [
        ("/api/data", "HIGH", "ALERT", False, 40),
        ("/admin/settings", "MEDIUM", "MONITOR", False, 35),
        ("/login", "LOW", "ALERT", False, 35),
        ("/api/v1/products", "HIGH", "DENY", False, 50),
        ("/api/data", "HIGH", "ALERT", True, 55),
        ("/admin/login", "CRITICAL", "DENY", True, 100),
        ("/Api/LOGIN", "LOW", "MONITOR", False, 25),
        ("/wp-login.php", "LOW", "MONITOR", False, 10),
        (None, None, None, False, 0),
        ("/x", "ODD", "ODD", False, 0),
    ]),
    (replace(SCORING, max_score=60), [("/admin", "CRITICAL", "DENY", True, 60)]),
    (replace(SCORING, severity_scores={"LOW": -50}), [("/x", "LOW", "ALERT", False, 0)]),
    (replace(SCORING, sensitive_paths=("", " ", "/X")), [
        ("/a/x", "LOW", "MONITOR", False, 25), ("/admin", "LOW", "MONITOR", False, 10)]),
    (Policy(), [("/login", "CRITICAL", "DENY", True, 90)]),
])
def test_threat_score(spark, policy, cases):
    df = spark.createDataFrame(
        cases, "path string, sev string, act string, rep boolean, want int")
    got = df.select("want", scoring.threat_score(
        F.col("sev"), F.col("act"), F.col("path"), F.col("rep"), policy).alias("got"))
    assert [r for r in got.collect() if r["want"] != r["got"]] == []


def test_attack_type(spark):
    policy = replace(Policy(), categories={"INJECTION": "SQL/Command Injection"})
    df = spark.createDataFrame(
        [("INJECTION",), (" injection\t",), ("BOT",), (" ",), (None,)], "c string")
    got = [r[0] for r in df.select(scoring.attack_type(F.col("c"), policy)).collect()]
    assert got == ["SQL/Command Injection", "SQL/Command Injection", "BOT", None, None]


def test_enrichment_overwrites_client_values_and_keeps_the_rest(spark):
    df = raw_frame(spark, [
        raw(0, attackType="mine", threatScore=1, repeatOffender=True, userAgent="ua"),
        raw(1, rule=None, geoLocation=None)])
    got = {r["arrival_seq"]: r for r in enrich(df, Policy()).collect()}
    assert (got[0]["attackType"], got[0]["threatScore"], got[0]["repeatOffender"]) == (
        "SQL/Command Injection", 50, False)
    assert got[0]["userAgent"] == "ua" and got[0]["rule"]["category"] == "INJECTION"
    assert (got[1]["attackType"], got[1]["threatScore"], got[1]["geoLocation"]) == (None, 0, None)
    with pytest.raises(ValueError):
        enrich(df, Policy(), mode="other")


def test_score_adds_the_repeat_bonus(spark):
    df = raw_frame(spark, [raw(0, repeatOffender=True)])
    assert rows_of(score(df, Policy()), "threatScore") == [(65,)]


def test_round_tenth_is_half_up(spark):
    df = spark.createDataFrame([(0.25,), (64.04,), (64.05,), (90.0,), (None,)], "v double")
    assert [r[0] for r in df.select(scoring.round_tenth(F.col("v"))).collect()] == [
        0.3, 64.0, 64.1, 90.0, 0.0]


def test_text_rules(spark):
    values = [None, "", "  ", "\t\n", " ", " ", "\x01", " a ", "\x00\x1fb\t", "é "]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = df.select(has_text(F.col("v")), jtrim(F.col("v")), normalise(F.col("v")),
                    or_unknown(F.col("v"))).collect()
    assert [r[0] for r in got] == [False, False, False, False, False, True, True, True, True, True]
    assert [r[1] for r in got][7:9] == ["a", "b"] and got[3][1] == ""
    assert got[9][2] == "É" and got[2][3] == "UNKNOWN" and got[7][3] == " a "


def test_policy_from_mapping():
    policy = Policy.from_mapping({
        "categories": {"bot": "Bot"}, "severity-scores": {"HIGH": 3},
        "scoring": {"sensitive-path-bonus": 1, "repeat-offender-bonus": 2, "max-score": 9,
                    "sensitive-paths": ["/a"]},
        "rate-limit": {"window": "30s", "threshold": 2}})
    assert policy.window_ms == 30_000 and policy.threshold == 2 and policy.max_score == 9
    assert policy.action_scores == {} and policy.sensitive_paths == ("/a",)
    bare = Policy.from_mapping({})
    assert (bare.window_ms, bare.threshold, bare.max_score) == (600_000, 5, 100)
    assert parse_duration("2h").total_seconds() == 7200 and parse_duration(250).microseconds == 250_000
    with pytest.raises(ValueError):
        parse_duration("soon")
