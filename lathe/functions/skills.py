"""Columns over skill names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COMPOSED = "^(seq|par|cond)-"


def skill_operator(name: Column) -> Column:
    """Baseline for an empty name, seq, par or cond by prefix, else atomic."""
    return F.when(F.coalesce(name, F.lit("")) == "", "baseline").when(name.rlike(COMPOSED), F.regexp_extract(name, COMPOSED, 1)).otherwise("atomic")


def skill_k(name: Column) -> Column:
    """0 for baseline, 1 for atomic; else one more than the connectors after the prefix, counted without overlap."""
    body = F.regexp_replace(name, COMPOSED, "")
    return F.when(F.coalesce(name, F.lit("")) == "", 0).when(name.rlike(COMPOSED), F.regexp_count(body, F.lit("-(?:then|and)-")) + 1).otherwise(1)


def skill_label(name: Column) -> Column:
    """``[operator k=n] body`` with the body's first 25 characters; atomic names are cut to 35."""
    op, k = skill_operator(name), skill_k(name)
    body = F.regexp_replace(name, COMPOSED, "")
    return F.when(op == "atomic", F.substring(name, 1, 35)).when(op == "baseline", "[baseline k=0] ").otherwise(F.concat(F.lit("["), op, F.lit(" k="), k.cast("string"), F.lit("] "), F.substring(body, 1, 25)))


def inferred_sources(name: Column) -> Column:
    """Source skill names of a composed name: the prefix goes, then a split on the first of then, and, if, with, or that occurs."""
    body = F.regexp_replace(name, COMPOSED, "")
    out = F.array(body)
    for word in ("or", "with", "if", "and", "then"):
        out = F.when(body.contains(f"-{word}-"), F.split(body, f"-{word}-")).otherwise(out)
    return F.filter(out, lambda x: F.trim(x) != "")
