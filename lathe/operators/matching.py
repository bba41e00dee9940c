"""Matching skills to tasks and planning trials."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lathe.functions.text import strip, strip_right
from lathe.operators.numbering import numbered

#: Size up to which the skill list of a cross-task plan is broadcast.
BROADCAST_ROWS = 100_000


def edges(skills: DataFrame) -> DataFrame:
    """One row per (skill, source task): skill_uid, name, ord, n_tasks, pos, task_uid."""
    tasks = F.col("source_task_uids")
    return skills.select("skill_uid", "name", "ord", F.size(tasks).alias("n_tasks"), F.posexplode(tasks).alias("pos", "task_uid"))


def match_skills(skills: DataFrame) -> DataFrame:
    """M1: for each task the skill with the fewest source tasks among those listing it, ties to the lower ord.

    The top-1 is an aggregate, so a task in very many skills is combined map-side.
    """
    best = F.min_by(F.struct("skill_uid", "name"), F.struct("n_tasks", "ord", "skill_uid"))
    return edges(skills).groupBy("task_uid").agg(best.alias("s")).select("task_uid", F.col("s.skill_uid").alias("skill_uid"), F.col("s.name").alias("skill_name"))


def _trials(rows: DataFrame, models: Sequence[str], modes: Sequence[str] = ("singlecall",)) -> DataFrame:
    return rows.withColumn("model", F.explode(F.array(*map(F.lit, models)))).withColumn("mode", F.explode(F.array(*map(F.lit, modes))))


def plan_one_to_one(tasks: DataFrame, skills: DataFrame, models: Sequence[str], modes: Sequence[str] = ("singlecall",)) -> DataFrame:
    """M2: a baseline trial of every task and a curated one of every matched task, for each model and mode."""
    matched = match_skills(skills)
    base = tasks.select("task_uid", F.lit("baseline").alias("condition"), F.lit("").alias("skill_name"))
    curated = tasks.select("task_uid").join(matched, "task_uid").select("task_uid", F.lit("curated").alias("condition"), "skill_name")
    return _trials(base.unionByName(curated), models, modes)


def plan_cross_task(tasks: DataFrame, skills: DataFrame, models: Sequence[str], conditions: Sequence[str] = ("baseline", "curated"), repetitions: int = 1) -> DataFrame:
    """M3: every task with no skill and with every skill (as the conditions ask), for each model and repetition.

    The grid is the output that is asked for; skills are broadcast up to a checked
    number of names, and otherwise joined in shuffled blocks of tasks.
    """
    names = skills.select(F.col("name").alias("skill_name"))
    rows = [tasks.select("task_uid", F.lit(c).alias("condition"), F.lit("").alias("skill_name")) for c in conditions if c != "curated"]
    if "curated" in conditions:
        if names.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
            grid = tasks.select("task_uid").crossJoin(F.broadcast(names))
        else:
            grid = tasks.select("task_uid").crossJoin(names)
        rows.append(grid.select("task_uid", F.lit("curated").alias("condition"), "skill_name"))
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return _trials(out, models).drop("mode").withColumn("repetition", F.explode(F.sequence(F.lit(0), F.lit(repetitions - 1))))


def trial_key(task: Column, provider: Column, model: Column, condition: Column, skill: Column, base_url: Column | None = None) -> Column:
    """``task:provider/model[@url]:condition:skill``."""
    url = F.coalesce(base_url, F.lit("")) if base_url is not None else F.lit("")
    return F.concat_ws("|", task, F.concat(provider, F.lit("/"), model, F.when(url != "", F.concat(F.lit("@"), url)).otherwise("")), condition, skill)


def pending(planned: DataFrame, recorded: DataFrame, keys: Sequence[str] = ("trial_key", "repetition")) -> DataFrame:
    """Planned trials that have no record yet."""
    return planned.join(recorded.select(*keys).distinct(), list(keys), "left_anti")


#: Buckets of a trial log; a fixed property of the stored table.
LOG_BUCKETS = 64


def open_trial_log(spark: SparkSession, name: str, path: str, buckets: int = LOG_BUCKETS) -> str:
    """The trial log at ``path`` as the table ``name``, stored in buckets of its keys; a new session opens the same files again."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (trial_key STRING, repetition BIGINT) USING parquet CLUSTERED BY (trial_key, repetition) SORTED BY (trial_key, repetition) INTO {buckets} BUCKETS LOCATION '{path}'")
    return name


def record_trials(trials: DataFrame, log: str, buckets: int = LOG_BUCKETS) -> None:
    """Add trials (trial_key, repetition) to a log, a file a bucket."""
    trials.select("trial_key", F.col("repetition").cast("bigint")).repartition(buckets, "trial_key", "repetition").write.insertInto(log)


def pending_in_log(planned: DataFrame, log: str) -> DataFrame:
    """``pending`` against a log: only the planned trials are shuffled, to the log's buckets; the log, however long it grew, is read where it lies."""
    recorded = planned.sparkSession.table(log).select("trial_key", F.col("repetition").alias("_repetition")).hint("merge")
    numbered_plan = planned.withColumn("_repetition", F.col("repetition").cast("bigint"))
    return numbered_plan.join(recorded, ["trial_key", "_repetition"], "left_anti").select(*planned.columns)


def filter_tasks(tasks: DataFrame, domain: str | None = None, difficulty: str | None = None, skills: Sequence[str] | None = None) -> DataFrame:
    """Tasks of a domain, a difficulty, or with any of the required skills."""
    if domain is not None:
        tasks = tasks.where(F.col("domain") == domain)
    if difficulty is not None:
        tasks = tasks.where(F.col("difficulty") == difficulty)
    if skills is not None:
        tasks = tasks.where(F.arrays_overlap("required_skills", F.array(*map(F.lit, skills))))
    return tasks


def combine_tasks(*sources: DataFrame) -> DataFrame:
    """One row per task_uid; a later source overrides an earlier one, a later row (ord) an earlier one."""
    out = None
    for n, source in enumerate(sources):
        source = source.withColumn("source_ord", F.lit(n))
        out = source if out is None else out.unionByName(source, allowMissingColumns=True)
    last = F.row_number().over(Window.partitionBy("task_uid").orderBy(F.desc("source_ord"), F.desc("ord")))
    return out.withColumn("_n", last).where("_n = 1").drop("_n")


def bench_prompt(passage: Column, challenge: Column) -> Column:
    """The prompt of a corpus task."""
    return F.concat(F.lit("Passage: "), passage, F.lit("\n\nChallenge: "), challenge)


def validation_subset(skills: DataFrame, tasks: DataFrame, names: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The tasks that the named skills reference, and the number of such tasks per skill."""
    chosen = edges(skills.where(F.col("name").isin(list(names))))
    kept = tasks.join(chosen, "task_uid", "left_semi")
    found = chosen.join(tasks.select("task_uid").distinct(), "task_uid").groupBy("name").agg(F.count("*").alias("n_tasks"))
    return kept, found


def rename_tasks(skills: DataFrame, tasks: DataFrame) -> DataFrame:
    """task_uid -> ``{skill}-{NN}``: the first skill (by ord) that lists the task names it; numbered per skill in task order (ord)."""
    first = edges(skills).groupBy("task_uid").agg(F.min_by("name", F.struct("ord", "pos")).alias("name"))
    return numbered(tasks.select("task_uid", "ord").join(first, "task_uid"), ["name"], ["ord", "task_uid"], "n").select("task_uid", F.format_string("%s-%02d", "name", "n").alias("new_uid"))


def rename_sources(skills: DataFrame, tasks: DataFrame) -> DataFrame:
    """Skills with their source ids rewritten in place; unmatched ids stay."""
    names = rename_tasks(skills, tasks)
    rows = edges(skills).join(names, "task_uid", "left").withColumn("t", F.struct("pos", F.coalesce("new_uid", "task_uid").alias("uid")))
    lists = rows.groupBy("skill_uid").agg(F.transform(F.sort_array(F.collect_list("t")), lambda x: x.uid).alias("_tasks"))
    return skills.join(lists, "skill_uid", "left").withColumn("source_task_uids", F.coalesce("_tasks", F.array().cast("array<string>"))).drop("_tasks")


# Block markers and default prompts.
SKILL_OPEN, SKILL_CLOSE = "--- SKILL: %s ---", "--- END SKILL ---"
READING_PROMPT = (
    "You are an expert in reading comprehension and cognitive science. Analyze the given passage and challenge carefully. "
    "Provide a thorough, well-structured answer that addresses all aspects of the challenge. Support your analysis with specific evidence from the passage."
)
CODING_PROMPT = "You are an expert software developer. Solve the given programming task step by step. You have access to a bash tool to execute commands."


def default_prompt(domain: Column) -> Column:
    """M4: the system prompt of a domain."""
    return F.when(domain.isin("coding", "code_bugfix"), CODING_PROMPT).otherwise(READING_PROMPT)


def skill_text(description: Column, when_to_use: Column, procedure: Column, constraints: Column) -> Column:
    """M4: a skill's non-empty parts, one line each, with a blank line after every part but the last."""
    empty = F.array().cast("array<string>")
    some = lambda c, lines: F.when(F.coalesce(c, F.lit("")) != "", lines).otherwise(empty)
    steps = F.transform(procedure, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))
    parts = F.concat(
        some(description, F.array(description, F.lit(""))), some(when_to_use, F.array(F.lit("## When to Use"), when_to_use, F.lit(""))),
        F.when(F.size(procedure) > 0, F.concat(F.array(F.lit("## Procedure")), steps, F.array(F.lit("")))).otherwise(empty),
        F.when(F.size(constraints) > 0, F.concat(F.array(F.lit("## Constraints")), F.transform(constraints, lambda x: F.concat(F.lit("- "), x)))).otherwise(empty),
    )
    return F.array_join(parts, "\n")


def inject_skill(system_prompt: Column, name: Column, content: Column) -> Column:
    """M4: the system prompt with the skill block behind it."""
    return F.concat(strip_right(system_prompt), F.lit("\n\n"), F.format_string(SKILL_OPEN, name), F.lit("\n"), strip(content), F.lit("\n" + SKILL_CLOSE))


def hint_skill(user_message: Column, name: Column, description: Column) -> Column:
    """M4: the user message with a hint to the skill behind it."""
    return F.concat(user_message, F.lit("\n\nSkill hint ("), name, F.lit("): "), description)


def stepwise_state(passage: Column, challenge: Column, steps: Column, context: Column | None = None) -> Column:
    """M4: the state message before the next reasoning step."""
    numbered = F.transform(steps, lambda x, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), x))
    lines = F.when(F.size(steps) > 0, F.array_join(numbered, "\n")).otherwise("  (no steps yet)")
    head = F.lit("") if context is None else F.when(F.coalesce(context, F.lit("")) != "", F.concat(context, F.lit("\n\n"))).otherwise("")
    return F.concat(head, F.lit("Passage: "), passage, F.lit("\n\nChallenge: "), challenge, F.lit("\n\nReasoning so far:\n"), lines, F.lit("\n\nWrite the next reasoning step:"))


def guided_state(passage: Column, challenge: Column, step: Column, index: Column, total: Column, findings: Column) -> Column:
    """M4: the message of one guided turn."""
    numbered = F.array_join(F.transform(findings, lambda x, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), x)), "\n")
    so_far = F.when(F.size(findings) > 0, F.concat(F.lit("\n\nFindings so far:\n"), numbered)).otherwise("")
    return F.concat(F.lit("Passage: "), passage, F.lit("\n\nChallenge: "), challenge, so_far, F.lit("\n\nStep "), index.cast("string"), F.lit(" of "), total.cast("string"), F.lit(": "), step)
