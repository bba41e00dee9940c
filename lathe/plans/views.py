"""Views of the driver's tables in the shapes that the operators take.

The same SQL text runs on Spark and in DuckDB, so queries and their SQL start
from equal rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

EPISODES = """
SELECT event_id AS ord, 'task-' || lpad(CAST(event_id % 97 AS STRING), 3, '0') AS task_uid, 'model-' || CAST(user_id % 5 AS STRING) AS model,
  CASE WHEN event_type IN ('view', 'error') THEN 'baseline' WHEN event_type IN ('click', 'signup') THEN 'curated' ELSE 'self_generated' END AS condition,
  CASE event_id % 3 WHEN 0 THEN 'singlecall' WHEN 1 THEN 'stepwise' ELSE 'guided' END AS mode,
  CASE WHEN event_type NOT IN ('click', 'signup') THEN '' WHEN event_id % 5 = 0 THEN 'seq-scan-text-then-pick-claim'
    WHEN event_id % 5 = 1 THEN 'par-scan-text-and-pick-claim-and-rank-claim' WHEN event_id % 5 = 2 THEN 'cond-scan-text-then-pick-claim' ELSE 'pick-claim' END AS skill_name,
  CAST((event_id * 37 + user_id * 11) % 101 AS DOUBLE) / 100 AS score, (event_id * 37 + user_id * 11) % 101 >= 60 AS passed,
  CAST((event_id * 7919) % 900 AS BIGINT) AS tokens
FROM events
"""

COMPOSED_EPISODES = """
SELECT event_id AS ord, 'task-' || lpad(CAST(event_id % 97 AS STRING), 3, '0') AS task_uid, 'model-' || CAST(user_id % 5 AS STRING) AS model,
  CASE WHEN event_type IN ('view', 'error') THEN 'baseline' WHEN event_type IN ('click', 'signup') THEN 'skill_injected' ELSE 'self_generated' END AS condition,
  CASE WHEN event_type NOT IN ('click', 'signup') THEN '' WHEN event_id % 5 = 0 THEN 'seq-scan-text-then-pick-claim'
    WHEN event_id % 5 = 1 THEN 'par-scan-text-and-pick-claim-and-rank-claim' WHEN event_id % 5 = 2 THEN 'cond-scan-text-then-pick-claim' ELSE 'pick-claim' END AS skill_name,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST((event_id * 37 + user_id * 11) % 101 AS DOUBLE) / 100 END AS score, (event_id * 37 + user_id * 11) % 101 >= 60 AS passed
FROM events
"""

BENCHMARK_RECORDS = """
SELECT CAST(l_orderkey AS STRING) AS problem_id, CASE l_linestatus WHEN 'F' THEN 'law' ELSE 'rhetoric' END AS domain, 'model-' || CAST(l_suppkey % 8 AS STRING) AS model, 'local' AS provider,
  CASE l_returnflag WHEN 'A' THEN 'baseline' WHEN 'R' THEN 'curated' ELSE 'self_generated' END AS condition,
  CASE WHEN l_returnflag = 'R' THEN 'skill-' || CAST(l_partkey % 50 AS STRING) ELSE '' END AS skill_name, CAST(l_partkey % 5 + 1 AS INT) AS k_value,
  CASE CAST(l_partkey % 4 AS INT) WHEN 0 THEN '' WHEN 1 THEN 'seq' WHEN 2 THEN 'par' ELSE 'cond' END AS composition_type,
  l_linenumber AS repetition, l_quantity >= 25 AS passed, CAST(l_discount * 10 AS DOUBLE) AS score, CAST(l_quantity * 20 AS BIGINT) AS tokens
FROM lineitem
"""

#: Exploded source_task_uids of skills: the orders of which a part was returned.
EDGES = """
SELECT DISTINCT 'skill-' || CAST(l_partkey AS STRING) AS skill_uid, 'task-' || CAST(l_orderkey AS STRING) AS task_uid
FROM lineitem WHERE l_returnflag = 'R'
"""

#: All orders; some are in no skill.
TASKS = """
SELECT 'task-' || CAST(o_orderkey AS STRING) AS task_uid, 'Title ' || CAST(o_orderkey AS STRING) AS title,
  CASE CAST(o_custkey % 3 AS INT) WHEN 0 THEN 'law' WHEN 1 THEN 'rhetoric' ELSE 'history' END AS domain,
  CASE CAST(o_custkey % 4 AS INT) WHEN 0 THEN 'easy' WHEN 1 THEN 'hard' ELSE 'medium' END AS difficulty,
  CASE WHEN o_custkey % 11 = 0 THEN '' ELSE 'doc-' || CAST(o_custkey % 40 AS STRING) END AS source_document_uid,
  CASE CAST(o_custkey % 3 AS INT) WHEN 0 THEN 'dataset:corpus-' WHEN 1 THEN 'report-' ELSE 'notes-' END || CAST(o_custkey % 40 AS STRING) || CASE CAST(o_custkey % 3 AS INT) WHEN 1 THEN '.pdf' WHEN 2 THEN '.txt' ELSE '' END AS source_artifact,
  CAST(o_orderkey AS BIGINT) AS ord
FROM orders
"""

#: Registry skills: name, related names (neighbours by key, one missing), description, collection.
SKILLS = """
SELECT CAST(p_partkey AS BIGINT) AS ord, 'skill-' || CAST(p_partkey AS STRING) AS skill_uid, 'p' || CAST(p_partkey AS STRING) || '-' || replace(lower(p_type), ' ', '-') AS name, 'Handles ' || lower(p_name) AS description,
  p_brand AS collection, 'When ' || lower(p_brand) || ' applies' AS trigger_a, 'When ' || 'size ' || CAST(p_size AS STRING) || ' is used' AS trigger_b, 'Read the ' || lower(p_type) AS step_a, 'Compare ' || 'size ' || CAST(p_size AS STRING) || ' and pick one' AS step_b,
  CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE 'Never skip ' || 'size ' || CAST(p_size AS STRING) END AS constraint_a, CAST(p_partkey AS BIGINT) AS key, replace(p_name, ' ', '-') || '-' || lower(p_type) || '-' || lower(p_brand) AS merge_name
FROM part
"""

#: Trial records with unique keys: each event is a repetition of its own.
TRIALS = """
SELECT 'task-' || CAST(event_id % 97 AS STRING) AS problem_id, 'local' AS provider, 'model-' || CAST(user_id % 5 AS STRING) AS model, CASE WHEN event_type IN ('view', 'error') THEN 'baseline' ELSE 'curated' END AS condition,
  CASE WHEN event_type IN ('view', 'error') THEN '' ELSE 'pick-claim' END AS skill_name, CAST(event_id % 3 AS INT) AS k_value, CAST(event_id AS BIGINT) AS repetition,
  (event_id * 37 + user_id * 11) % 101 >= 60 AS passed, CAST((event_id * 37 + user_id * 11) % 101 AS DOUBLE) / 100 AS score, CAST((event_id * 7919) % 900 AS BIGINT) AS tokens
FROM events
"""

VIEWS = {"trials": TRIALS, "episodes": EPISODES, "composed_episodes": COMPOSED_EPISODES, "benchmark_records": BENCHMARK_RECORDS, "edges": EDGES, "tasks": TASKS, "skills": SKILLS}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEWS[name]
    used = [t for t in TABLES if re.search(rf"\bFROM {t}\b", sql)]
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used}
    for t in used:
        sql = re.sub(rf"\bFROM {t}\b", f"FROM {{{t}}}", sql)
    return spark.sql(sql, **frames)


def with_views(*names: str) -> str:
    """``WITH`` clause that defines the views in SQL."""
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n].strip()})" for n in names)
