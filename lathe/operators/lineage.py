"""Lineage from documents over tasks to skills (L1-L4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _links(skills: DataFrame) -> DataFrame:
    return skills.select("skill_uid", "name", F.explode("source_task_uids").alias("task_uid"))


def lineage(skills: DataFrame, tasks: DataFrame) -> DataFrame:
    """L1: one row per skill and source task; an unknown task gives blanks; passage_uid is not tracked and empty."""
    known = tasks.select("task_uid", "source_document_uid", "source_artifact", F.col("title").alias("task_title"))
    rows = _links(skills).join(known, "task_uid", "left")
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return rows.select(blank("source_document_uid"), blank("source_artifact"), F.lit("").alias("passage_uid"), "task_uid", blank("task_title"), "skill_uid", F.col("name").alias("skill_name"))


def orphaned_tasks(tasks: DataFrame) -> DataFrame:
    """L2: tasks without a source document."""
    return tasks.where(F.coalesce("source_document_uid", F.lit("")) == "").select("task_uid")


def orphaned_skills(skills: DataFrame) -> DataFrame:
    """L2: skills without source tasks."""
    return skills.where(F.coalesce(F.size("source_task_uids"), F.lit(0)) <= 0).select("skill_uid")


def unlinked_tasks(tasks: DataFrame, skills: DataFrame) -> DataFrame:
    """L2: tasks that no skill lists."""
    return tasks.join(_links(skills), "task_uid", "left_anti").select("task_uid")


def document_tasks(tasks: DataFrame) -> DataFrame:
    """L2: per source document its last artifact (by ord) and number of tasks."""
    return tasks.where("source_document_uid <> ''").groupBy("source_document_uid").agg(F.max_by("source_artifact", "ord").alias("source_artifact"), F.count("*").alias("n_tasks"))


def summary(tasks: DataFrame, skills: DataFrame, passages: DataFrame | None = None) -> DataFrame:
    """L2: one row of counts."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    out = tasks.agg(F.count_distinct(F.nullif("source_document_uid", F.lit(""))).alias("documents"), F.count("*").alias("tasks"))
    parts = [one(skills, "skills"), one(_links(skills), "records"), one(orphaned_tasks(tasks), "orphaned_tasks"), one(orphaned_skills(skills), "orphaned_skills"), one(unlinked_tasks(tasks, skills), "unlinked_tasks")]
    if passages is not None:
        parts.append(one(passages, "passages"))
    for part in parts:
        out = out.crossJoin(part)  # one row each
    return out


def source_documents(tasks: DataFrame) -> DataFrame:
    """L3: documents with their first artifact (by ord) and its type: dataset, pdf or file."""
    first = tasks.where("source_document_uid <> ''").groupBy(F.col("source_document_uid").alias("document_uid")).agg(F.min_by(F.coalesce("source_artifact", F.lit("")), "ord").alias("source_name"))
    name = F.col("source_name")
    kind = F.when(name.startswith("dataset:"), "dataset").when(name.endswith(".pdf"), "pdf").otherwise("file")
    return first.select("document_uid", kind.alias("source_type"), "source_name").orderBy("document_uid")


def passages_export(passages: DataFrame) -> DataFrame:
    """L4: passages with the first 500 characters of their text."""
    return passages.select("passage_uid", F.col("source_document_uid").alias("document_uid"), F.substring("text", 1, 500).alias("text"), "chunk_index", "total_chunks")


def skills_export(skills: DataFrame) -> DataFrame:
    """L4: skills with the number of their steps and instances."""
    return skills.select("skill_uid", "name", "description", F.size("procedure").alias("procedure_steps"), F.size("source_task_uids").alias("instance_count"))


def skill_instances(skills: DataFrame) -> DataFrame:
    """L4: one row per skill and source task."""
    return _links(skills).select("skill_uid", "task_uid")
