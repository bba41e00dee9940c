"""Scoring of replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathe.functions.text import strip, strip_fences

#: Answers that a query type allows.
ALLOWED = {"YES_NO": ["yes", "no"], "YES_NO_VERIFICATION": ["correct", "incorrect"], "RANKING": ["a", "b"]}


def answer_line(reply: Column) -> Column:
    """First line of the reply in small letters, without outer blanks and final dots."""
    first = F.split(F.lower(strip(reply)), "\n", 2)[0]
    return F.regexp_replace(strip(first), r"\.+\z", "")


def is_match(reply: Column, expected: Column, query_type: Column) -> Column:
    """Whether a reply of a deterministic query type gives the expected answer."""
    want, line = F.lower(strip(F.coalesce(expected, F.lit("")))), answer_line(F.coalesce(reply, F.lit("")))
    word = F.regexp_extract(line, r"(?U)^(\S+)", 1)
    out = F.when(query_type == "SINGLE_WORD", (word == want) | (line == want))
    for kind, answers in ALLOWED.items():
        out = out.when(query_type == kind, line.isin(answers) & (line == want))
    return out.otherwise(False)


def score(replies: DataFrame) -> DataFrame:
    """E1 over reply, expected, query_type and has_criteria: adds passed and score. Without criteria a reply passes with 1."""
    passed = F.when(~F.col("has_criteria"), True).otherwise(is_match(F.col("reply"), F.col("expected"), F.col("query_type")))
    return replies.withColumn("passed", passed).withColumn("score", F.col("passed").cast("double"))


VERDICT = "struct<passed:boolean,score:double,rationale:string,criteria_met:int,criteria_total:int>"


def judge_verdict(reply: Column) -> Column:
    """A judge's JSON reply as a struct; missing fields get defaults; broken JSON fails with 0 and says so.

    ``passed`` is taken as given; it need not agree with the score.
    """
    body = strip_fences(reply)
    parsed = F.from_json(body, VERDICT)
    broken = ~F.coalesce(body.rlike(r"(?s)\A\s*\{.*\}\s*\z"), F.lit(False)) | F.try_parse_json(body).isNull()
    get = lambda name, default: F.coalesce(parsed[name], F.lit(default))
    good = F.struct(get("passed", False).alias("passed"), get("score", 0.0).alias("score"), get("rationale", "").alias("rationale"), get("criteria_met", 0).alias("criteria_met"), get("criteria_total", 0).alias("criteria_total"))
    bad = F.struct(F.lit(False).alias("passed"), F.lit(0.0).alias("score"), F.concat(F.lit("Failed to parse judge response: "), F.substring(reply, 1, 200)).alias("rationale"), F.lit(0).alias("criteria_met"), F.lit(0).alias("criteria_total"))
    return F.when(broken, bad).otherwise(good)


def flatten_steps(episodes: DataFrame) -> DataFrame:
    """One row per step of an episode."""
    return episodes.select("task_uid", "model", "condition", "mode", F.explode("steps").alias("s")).select("task_uid", "model", "condition", "mode", "s.*")


def step_totals(episodes: DataFrame) -> DataFrame:
    """num_steps, and tokens and seconds summed over the steps."""
    total = lambda f, kind: F.aggregate("steps", F.lit(0).cast(kind), lambda n, s: n + F.coalesce(s[f], F.lit(0)).cast(kind))
    return episodes.withColumn("num_steps", F.size("steps")).withColumn("tokens", total("tokens", "bigint")).withColumn("elapsed_s", total("elapsed_s", "double"))
