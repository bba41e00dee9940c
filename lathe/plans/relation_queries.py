"""Queries of matching, planning, lineage, verification and composition, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lathe.operators import compose as C
from lathe.operators import fusion as G
from lathe.operators import lineage as L
from lathe.operators import matching as M
from lathe.operators import skill_merge as P
from lathe.operators import verify as V
from lathe.plans.views import view, with_views
from lathe.sources.tables import count_operators, new_folder, spread

MODELS, MODES = ["m-a", "m-b"], ["singlecall", "stepwise"]


def skills_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skills with their source tasks; those without edges are orphans."""
    lists = view(spark, sf_dir, "edges").groupBy("skill_uid").agg(F.array_sort(F.collect_set("task_uid")).alias("source_task_uids"))
    rows = view(spark, sf_dir, "skills").select("ord", "skill_uid", "name", "description", F.array("step_a", "step_b").alias("procedure"))
    return rows.join(lists, "skill_uid", "left").withColumn("source_task_uids", F.coalesce("source_task_uids", F.array().cast("array<string>")))


def registry_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry skills with arrays; related are the next two by key."""
    s = view(spark, sf_dir, "skills")
    some = lambda c: F.when(F.col(c).isNull(), F.array().cast("array<string>")).otherwise(F.array(c))
    related = F.array(F.concat(F.lit("r"), (F.col("key") + 1).cast("string")), F.concat(F.lit("r"), (F.col("key") % 5).cast("string")))
    none = F.array().cast("array<struct<title:string,input:string,process:string,output:string>>")
    return s.select("collection", "ord", "name", "description", F.array("trigger_a", "trigger_b").alias("when_to_use"), F.array("step_a", "step_b").alias("procedure"), some("constraint_a").alias("constraints"), related.alias("related_skills"), none.alias("examples"))


def tasks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "tasks")


def _joined(df: DataFrame, *arrays: str) -> DataFrame:
    """Arrays as text, so that both engines give equal values."""
    for c in arrays:
        df = df.withColumn(c, F.array_join(c, "~"))
    return df


def _composed(op: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = C.COMPOSE[op](C.windows(registry_of(spark, sf_dir)))
        out = _joined(out, "when_to_use", "procedure", "constraints", "related_skills", "source_skills").withColumn("example", F.col("examples")[0].process)
        return out.drop("examples", "start")

    return query


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.plan_one_to_one(tasks_of(spark, sf_dir), skills_of(spark, sf_dir), MODELS, MODES)


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = M.trial_key(F.col("task_uid"), F.lit("local"), F.col("model"), F.col("condition"), F.col("skill_name"))
    return _plan(spark, sf_dir).where("mode = 'singlecall'").withColumn("trial_key", key).withColumn("repetition", F.lit(0))


def _pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = _keyed(spark, sf_dir)
    recorded = planned.where(F.substring(F.sha2("trial_key", 256), 1, 1) < "8")
    return M.pending(planned, recorded).select("trial_key")


def _pending_in_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same trials recorded in two runs, and asked for of the log that they left."""
    path = new_folder(spark, "trial-log")
    log = M.open_trial_log(spark, f"lathe_trials_{path[-32:]}", path)
    planned = _keyed(spark, sf_dir)
    first = F.substring(F.sha2("trial_key", 256), 1, 1)
    for run in (planned.where(first < "4"), planned.where((first >= "4") & (first < "8"))):
        M.record_trials(run, log)
    return M.pending_in_log(planned, log).select("trial_key")


def _combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tasks_of(spark, sf_dir).select("task_uid", "title", "domain", "ord")
    later = t.where("ord % 3 = 0").withColumn("title", F.concat("title", F.lit(" (new)")))
    return M.combine_tasks(t, later).select("task_uid", "title", "domain", F.col("source_ord").cast("bigint").alias("source_ord"))


def _filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.filter_tasks(tasks_of(spark, sf_dir), domain="law", difficulty="easy").select("task_uid")


def _subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    skills = skills_of(spark, sf_dir)
    return M.validation_subset(skills.withColumn("name", F.when(F.col("ord") % 7 == 0, F.concat(F.lit("chosen-"), F.col("ord").cast("string"))).otherwise("other")), tasks_of(spark, sf_dir), ["other"])[1]


def _cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole grid of tasks and nations, which stand for a short list of skills."""
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_name").alias("name"))
    grid = M.plan_cross_task(tasks_of(spark, sf_dir), nations, MODELS, ("baseline", "curated", "self_generated"), repetitions=2)
    return grid.groupBy("condition", "model", "repetition").agg(F.count("*").alias("n"), F.count_distinct("skill_name").alias("n_skills"))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Related skills as a graph with cycles: p -> p+7 and p -> 3p, within key blocks of 50; promo parts have no entry."""
    s = view(spark, sf_dir, "skills")
    at = lambda e: F.concat(F.lit("n"), F.expr(e).cast("string"))
    nxt = F.array(at("key - key % 50 + (key % 50 + 7) % 50"), at("key - key % 50 + (key % 50) * 3 % 50"))
    return s.where("step_a not like '%promo'").select(F.concat(F.lit("n"), F.col("key").cast("string")).alias("name"), F.explode(nxt).alias("ref")).distinct()


def _invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _edges(spark, sf_dir)
    return _joined(C.invalid_references(e, e.select("name").distinct()), "missing")


def _verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as skills: the first line describes, the second says when to use, of the others every third is a constraint and the rest are steps."""
    d = spread(spark.read.parquet(f"{sf_dir}/documents.parquet")).where("text is not null").select("doc_id", F.split("text", "\n").alias("_l"))
    line = lambda i: F.coalesce(F.get("_l", F.lit(i)), F.lit(""))
    rest = F.slice("_l", F.lit(3), F.greatest(F.size("_l") - 2, F.lit(0)))
    steps, limits = F.filter(rest, lambda x, i: i % 3 != 2), F.filter(rest, lambda x, i: i % 3 == 2)
    return V.verify(d.select(F.col("doc_id").alias("skill_uid"), line(0).alias("description"), line(1).alias("when_to_use"), steps.alias("procedure"), limits.alias("constraints")))


def _defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defects with their texts; of passive phrases without, as DuckDB's words are ASCII."""
    shown = F.when(F.col("defect_type") != "passive_voice", F.col("description"))
    return V.each_defect(_verified(spark, sf_dir), "skill_uid").groupBy("skill_uid", "defect_type", "location", shown.alias("description")).agg(F.count("*").alias("n"))


def _revised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skills under revision: a reply rewrites the description, and the steps of large parts only."""
    s = view(spark, sf_dir, "skills")
    rows = s.select("skill_uid", "description", F.lit("").alias("when_to_use"), F.array("step_a", "step_b").alias("procedure"), F.array("trigger_b").alias("constraints"))
    large = F.regexp_extract(F.col("constraints")[0], r"size (\d+)", 1).cast("int") > 25
    fix = lambda bad: bad.withColumn("procedure", F.when(large, F.array(F.lit("The analyst reads it"))).otherwise(F.col("procedure"))).withColumn("description", F.lit("Reads."))
    return V.roll_up(V.revise_loop(rows, fix))


def _covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A task requires a part and up to three that follow it in its collection; four are never in one composition."""
    composed = C.COMPOSE["seq"](C.windows(registry_of(spark, sf_dir))).select(F.col("name").alias("composed"), F.explode("source_skills").alias("skill"))
    w = Window.partitionBy("collection").orderBy("ord")
    following = registry_of(spark, sf_dir).select("ord", F.array("name", *[F.lead("name", n).over(w) for n in (1, 2, 3)]).alias("all"))
    wanted = F.filter(F.slice("all", F.lit(1), (F.col("ord") % 4 + 1).cast("int")), lambda x: x.isNotNull())
    return C.covering_tasks(composed, following.select(F.col("ord").cast("string").alias("task_uid"), F.explode(wanted).alias("skill")))


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Promo parts have lost their tasks."""
    lost = F.col("name").endswith("-promo")
    return L.orphaned_skills(skills_of(spark, sf_dir).withColumn("source_task_uids", F.when(~lost, F.col("source_task_uids")).otherwise(F.array())))


def _alike(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skills under names of which many are alike."""
    names = view(spark, sf_dir, "skills").select("ord", "merge_name")
    return skills_of(spark, sf_dir).join(names, "ord").withColumn("name", F.col("merge_name")).drop("merge_name")


QUERIES = {
    "m1_task_skill_match": lambda s, d: M.match_skills(skills_of(s, d)),
    "m2_one_to_one_plan": _plan,
    "m3_cross_task_plan": _cross,
    "s10_pending_trials": _pending,
    "s10_pending_in_log": _pending_in_log,
    "n7_filter_tasks": _filtered,
    "n8_combine_tasks": _combined,
    "n10_validation_subset": _subset,
    "p13_rename_tasks": lambda s, d: M.rename_tasks(skills_of(s, d), tasks_of(s, d)),
    "p13_rename_sources": lambda s, d: _joined(M.rename_sources(skills_of(s, d), tasks_of(s, d)).select("skill_uid", "source_task_uids"), "source_task_uids"),
    "p12_similar_pairs": lambda s, d: P.similar_pairs(_alike(s, d)),
    "p12_representatives": lambda s, d: P.representatives(_alike(s, d)),
    "p12_merge_skills": lambda s, d: _joined(P.merge_skills(_alike(s, d)).select("skill_uid", "name", "source_task_uids"), "source_task_uids"),
    "l1_lineage": lambda s, d: L.lineage(skills_of(s, d), tasks_of(s, d)),
    "l2_summary": lambda s, d: L.summary(tasks_of(s, d), skills_of(s, d)),
    "l2_unlinked_tasks": lambda s, d: L.unlinked_tasks(tasks_of(s, d), skills_of(s, d)),
    "l2_orphaned_tasks": lambda s, d: L.orphaned_tasks(tasks_of(s, d)),
    "l2_orphaned_skills": _orphans,
    "l2_document_tasks": lambda s, d: L.document_tasks(tasks_of(s, d)),
    "l3_source_documents": lambda s, d: L.source_documents(tasks_of(s, d)),
    "l4_skills_export": lambda s, d: L.skills_export(skills_of(s, d)),
    "l4_skill_instances": lambda s, d: L.skill_instances(skills_of(s, d)),
    "c1_window_counts": lambda s, d: count_operators(C.compose_all(registry_of(s, d))),
    "c2_compose_seq": _composed("seq"),
    "c3_compose_par": _composed("par"),
    "c4_compose_cond": _composed("cond"),
    "c5_render_markdown": lambda s, d: C.with_markdown(C.COMPOSE["cond"](C.windows(registry_of(s, d), [2]))).select("name", F.sha2("markdown", 256).alias("markdown_sha256")),
    "c6_semantic_fusion": lambda s, d: _joined(G.fuse(C.windows(registry_of(s, d), [2])).select("collection", "name", "description", "when_to_use", "procedure", "source_skills"), "when_to_use", "procedure", "source_skills"),
    "c7_dependencies": lambda s, d: C.dependencies(_edges(s, d)),
    "c8_invalid_references": _invalid,
    "c9_covering_tasks": _covering,
    "v7_defects": _defects,
    "v9_revise_loop": _revised,
    "v8_roll_up": lambda s, d: V.roll_up(_verified(s, d)),
    "v8_defects_by_type": lambda s, d: V.defects_by_type(_verified(s, d)),
}

ET, ETS, S = with_views("edges", "tasks"), with_views("edges", "tasks", "skills"), with_views("skills")
EDGE = "x AS (SELECT s.skill_uid, s.name, s.ord, e.task_uid, count(*) OVER (PARTITION BY s.skill_uid) AS n_tasks FROM skills s JOIN edges e ON e.skill_uid = s.skill_uid)"
MATCH = "m AS (SELECT task_uid, skill_uid, name AS skill_name FROM (SELECT *, row_number() OVER (PARTITION BY task_uid ORDER BY n_tasks, ord) AS rn FROM x) WHERE rn = 1)"
PLAN = "p AS (SELECT task_uid, 'baseline' AS condition, '' AS skill_name FROM tasks UNION ALL SELECT t.task_uid, 'curated', m.skill_name FROM tasks t JOIN m ON m.task_uid = t.task_uid)"
KEY = "task_uid || '|local/' || model || '|' || condition || '|' || skill_name"
RENAMED = "f AS (SELECT task_uid, name FROM (SELECT *, row_number() OVER (PARTITION BY task_uid ORDER BY ord) AS rn FROM x) WHERE rn = 1), r AS (SELECT t.task_uid, f.name || '-' || CASE WHEN row_number() OVER (PARTITION BY f.name ORDER BY t.ord) < 10 THEN '0' ELSE '' END || CAST(row_number() OVER (PARTITION BY f.name ORDER BY t.ord) AS VARCHAR) AS new_uid FROM tasks t JOIN f ON f.task_uid = t.task_uid)"
REG = """reg AS (SELECT collection, ord, name, description, [trigger_a, trigger_b] AS when_to_use, [step_a, step_b] AS procedure, CASE WHEN constraint_a IS NULL THEN []::VARCHAR[] ELSE [constraint_a] END AS constraints,
['r' || CAST(key + 1 AS VARCHAR), 'r' || CAST(key % 5 AS VARCHAR)] AS related FROM skills),
n AS (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY ord) AS i, list_aggregate(list_transform(string_split(replace(name, '-', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ' ') AS title FROM reg),
w AS (SELECT collection, k, s, list(n.name ORDER BY i) AS names, list(n.title ORDER BY i) AS titles, list(n.description ORDER BY i) AS ds, list(n.when_to_use ORDER BY i) AS ws, list(n.procedure ORDER BY i) AS ps, list(n.constraints ORDER BY i) AS cs, list(n.related ORDER BY i) AS rs
  FROM (SELECT *, unnest(range(greatest(1, i - k + 1), i + 1)) AS s FROM n, (VALUES (2), (3)) v(k)) n GROUP BY collection, k, s HAVING count(*) = k)"""


def _text(items: str, joiner: str = "~") -> str:
    return f"array_to_string({items}, '{joiner}')"


RELATED = _text("list_filter(list_distinct_ordered, lambda r: NOT list_contains(names, r))")


def _composition(kind: str, name: str, description: str, when: str, procedure: str, constraints: str, example: str) -> str:
    related = "array_to_string((SELECT list(r ORDER BY p) FROM (SELECT r, min(p) AS p FROM (SELECT unnest(flatten(rs)) AS r, generate_subscripts(flatten(rs), 1) AS p) GROUP BY r) WHERE NOT list_contains(names, r)), '~')"
    return f"""{S}, {REG} SELECT collection, {name} AS name, {description} AS description, {_text(when)} AS when_to_use, {_text(procedure)} AS procedure, {_text(constraints)} AS constraints, coalesce({related}, '') AS related_skills,
'{kind}' AS composition_type, {_text('names')} AS source_skills, CAST(k AS INTEGER) AS k_value, {example} AS example FROM w"""


DISTINCT_WHEN = "(SELECT list(t ORDER BY p) FROM (SELECT t, min(p) AS p FROM (SELECT unnest(flatten(ws)) AS t, generate_subscripts(flatten(ws), 1) AS p) GROUP BY t))"
SEQ = _composition(
    "seq", "'seq-' || " + _text("names", "-then-"), "'Apply skills in sequence: ' || " + _text("ds", " -> ") + " || '. Use when multiple capabilities are needed in order.'", DISTINCT_WHEN,
    "flatten(list_transform(range(1, len(names) + 1), lambda i: list_transform(ps[i], lambda p: CASE WHEN i > 1 THEN 'Apply ' || titles[i] || ': ' || p ELSE p END)))", "flatten(cs)",
    "'Apply the following skills in sequence:' || chr(10) || array_to_string(list_transform(range(1, len(names) + 1), lambda i: CAST(i AS VARCHAR) || '. Apply ' || titles[i]), chr(10))",
)
PAR = _composition(
    "par", "'par-' || " + _text("names", "-and-"), "'Apply skills in parallel: ' || " + _text("ds", " & ") + " || '. Use when multiple capabilities are needed simultaneously.'", "list_concat(['Multiple skills are needed simultaneously: ' || array_to_string(titles, ', ')], flatten(ws))",
    "list_concat(list_concat(['Apply the following skills in parallel:'], list_transform(range(1, len(names) + 1), lambda i: '  - ' || titles[i] || ': ' || ds[i])), ['Integrate the outputs from all parallel skills:', '  - Identify complementary results across skills', '  - Resolve any conflicts between skill outputs', '  - Synthesize a combined result'])",
    "list_concat(['All parallel skills must receive the same input context'], list_transform(cs, lambda c: coalesce(c[1], '')))",
    "'Apply the following skills in parallel to the same input:' || chr(10) || array_to_string(list_transform(titles, lambda t: '- ' || t), chr(10)) || chr(10) || chr(10) || 'Then integrate the results from all skills.'",
)
COND = _composition(
    "cond", "'cond-' || names[1] || '-then-' || " + _text("names[2:]", "-and-"), "'Conditional skill: if ' || titles[1] || ', then apply ' || " + _text("titles[2:]", " -> ") + " || '. Use when skill application depends on a condition.'", "list_concat(['When ' || titles[1] || ' determines the path'], ws[1])",
    "list_concat(list_concat(['Evaluate the condition:', '1. Check ' || titles[1], '2. If condition is TRUE:'], list_transform(range(1, len(names)), lambda i: '   ' || CAST(i AS VARCHAR) || '. Apply ' || titles[i + 1])), ['3. If condition is FALSE:', '   No action (or apply default behavior)'])",
    "list_concat(['Condition must be evaluable: ' || titles[1], 'Only one branch (then or else) is executed'], cs[1])", "'1. ' || titles[1] || ' evaluates to TRUE' || chr(10) || '2. Apply then-skills: ' || array_to_string(titles[2:], ' -> ')",
)
NL = "chr(10)"
RENDER = f"""{S}, {REG}, o AS (SELECT 'cond-' || names[1] || '-then-' || array_to_string(names[2:], '-and-') AS name, titles, 'Conditional skill: if ' || titles[1] || ', then apply ' || array_to_string(titles[2:], ' -> ') || '. Use when skill application depends on a condition.' AS description,
list_concat(['When ' || titles[1] || ' determines the path'], ws[1]) AS w, list_concat(list_concat(['Evaluate the condition:', '1. Check ' || titles[1], '2. If condition is TRUE:'], list_transform(range(1, len(names)), lambda i: '   ' || CAST(i AS VARCHAR) || '. Apply ' || titles[i + 1])), ['3. If condition is FALSE:', '   No action (or apply default behavior)']) AS p,
list_concat(['Condition must be evaluable: ' || titles[1], 'Only one branch (then or else) is executed'], cs[1]) AS c, list_filter(list_distinct(flatten(rs)), lambda r: NOT list_contains(names, r)) AS unordered, flatten(rs) AS allr, names, array_to_string(titles[2:], ' -> ') AS then_titles FROM w WHERE k = 2),
m AS (SELECT *, (SELECT list(r ORDER BY q) FROM (SELECT r, min(q) AS q FROM (SELECT unnest(allr) AS r, generate_subscripts(allr, 1) AS q) GROUP BY r) WHERE NOT list_contains(names, r)) AS rel, list_aggregate(list_transform(string_split(replace(name, '-', ' '), ' '), lambda x: upper(x[1]) || lower(x[2:])), 'string_agg', ' ') AS title FROM o)
SELECT name, sha256('---' || {NL} || 'name: ' || name || {NL} || 'description: ' || description || {NL} || '---' || {NL} || {NL} || '# ' || title || {NL} || {NL} || '## When to Use' || {NL} || {NL} || array_to_string(list_transform(w, lambda x: '- ' || x || {NL}), '') || {NL}
|| '## Procedure' || {NL} || {NL} || array_to_string(list_transform(range(1, len(p) + 1), lambda i: CAST(i AS VARCHAR) || '. ' || p[i] || {NL}), '') || {NL} || '## Constraints' || {NL} || {NL} || array_to_string(list_transform(c, lambda x: '- ' || x || {NL}), '') || {NL}
|| '### Example 1: Condition is true' || {NL} || {NL} || '**Input:**' || {NL} || 'Input where ' || titles[1] || ' evaluates to TRUE' || {NL} || {NL} || '**Process:**' || {NL} || '1. ' || titles[1] || ' evaluates to TRUE' || {NL} || '2. Apply then-skills: ' || then_titles || {NL} || {NL} || '**Output:**' || {NL} || 'Output from applying ' || then_titles || {NL} || {NL}
|| CASE WHEN len(rel) > 0 THEN '## Related Skills' || {NL} || {NL} || array_to_string(list_transform(rel, lambda x: '- ' || x || {NL}), '') ELSE '' END) AS markdown_sha256 FROM m"""
GRAPH = "g AS (SELECT DISTINCT 'n' || CAST(key AS VARCHAR) AS name, 'n' || CAST(unnest([key - key % 50 + (key % 50 + 7) % 50, key - key % 50 + (key % 50) * 3 % 50]) AS VARCHAR) AS ref FROM skills WHERE step_a NOT LIKE '%promo')"

#: Fields of skills: kind (description, when to use, step, constraint), number within the kind, text.
DOC_FIELDS = """l AS (SELECT doc_id AS skill_uid, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
r AS (SELECT skill_uid, i, l[i + 3] AS t FROM (SELECT skill_uid, l, unnest(range(0, len(l) - 2)) AS i FROM l)),
f AS (SELECT skill_uid, 'd' AS kind, 0 AS i, coalesce(l[1], '') AS t FROM l UNION ALL SELECT skill_uid, 'w', 0, coalesce(l[2], '') FROM l UNION ALL SELECT skill_uid, 's', i - i // 3 + 1, t FROM r WHERE i % 3 <> 2 UNION ALL SELECT skill_uid, 'c', i // 3 + 1, t FROM r WHERE i % 3 = 2)"""
LOCATION = "CASE kind WHEN 'd' THEN 'description' WHEN 'w' THEN 'when_to_use' WHEN 's' THEN 'procedure step ' || CAST(i AS VARCHAR) ELSE 'constraint ' || CAST(i AS VARCHAR) END AS location"
NOT_ASCII = r"[^\x00-\x7F]"


def _values(items: list[str]) -> str:
    return "(VALUES " + ", ".join(f"('{x}')" for x in items) + ") v(p)"


def _found(kind: str, items: list[str], kinds: str, description: str) -> str:
    return f"SELECT skill_uid, '{kind}' AS defect_type, {LOCATION}, {description} AS description FROM f, {_values(items)} WHERE kind IN ({kinds}) AND contains(lower(t), p)"


def _starts(kind: str, words: list[str], kinds: str, description: str) -> str:
    return f"SELECT skill_uid, '{kind}' AS defect_type, {LOCATION}, {description} AS description FROM (SELECT *, lower(regexp_extract(q, '^\\S+')) AS p FROM q) WHERE kind IN ({kinds}) AND p IN ({', '.join(repr(w) for w in words)})"


def _defects_of(fields: str) -> str:
    """CTEs from those of ``fields`` (l: skills; f: their fields) to e: all defects."""
    verbs = "b AS (SELECT * FROM (VALUES " + ", ".join(f"('{v}', '{p}')" for v, p in V.verb_primitives().items()) + ") b(verb, primitive))"
    return f"""{fields}, q AS (SELECT skill_uid, kind, i, trim(unnest(regexp_split_to_array(t, '[.!?]\\s+')), chr(9) || chr(10) || chr(13) || ' ') AS q FROM f), {verbs},
y AS (SELECT skill_uid, i, pos, w FROM (SELECT skill_uid, i, unnest(range(1, len(ws) + 1)) AS pos, unnest(ws) AS w FROM (SELECT skill_uid, i, list_transform(list_filter(regexp_split_to_array(lower(t), '\\s+'), lambda x: x <> ''), lambda x: regexp_replace(x, '^[.,;:!?()\\[\\]"'']+|[.,;:!?()\\[\\]"'']+$', '', 'g')) AS ws FROM f WHERE kind = 's'))),
z AS (SELECT s.skill_uid, s.i, s.t, min_by(b.primitive, y.pos) FILTER (WHERE y.pos <= 5) AS primitive, count(b.verb) AS n FROM (SELECT skill_uid, i, t FROM f WHERE kind = 's') s LEFT JOIN y ON y.skill_uid = s.skill_uid AND y.i = s.i LEFT JOIN b ON b.verb = y.w GROUP BY s.skill_uid, s.i, s.t),
k AS (SELECT skill_uid, 'procedural_sufficiency' AS defect_type, 'procedure step ' || CAST(i AS VARCHAR) AS location, 'Step is not a procedural action: "' || left(t, 80) || '"' AS description FROM z WHERE n = 0
UNION ALL SELECT skill_uid, 'procedural_sufficiency', 'procedure', 'Procedure has no observation step -- actions should begin with observing the input' FROM z GROUP BY skill_uid HAVING coalesce(max(primitive) FILTER (WHERE i = 1), 'observe') <> 'observe' AND count(*) FILTER (WHERE primitive = 'observe') = 0
UNION ALL SELECT skill_uid, 'procedural_sufficiency', 'procedure', 'Procedure is empty -- a skill must have at least 1 procedural action step' FROM l WHERE skill_uid NOT IN (SELECT skill_uid FROM z)),
e AS (SELECT * FROM k UNION ALL SELECT skill_uid, 'passive_voice', {LOCATION}, NULL FROM (SELECT skill_uid, kind, i, unnest(regexp_extract_all(regexp_replace(t, '{NOT_ASCII}', 'x', 'g'), '(?i)\\b(is|was|were|are|been|being|gets|got)\\s+(\\w+ed|(\\w+en))\\b')) AS m FROM f) WHERE lower(m) NOT IN ('is used', 'is called', 'is named', 'is defined')
UNION ALL {_starts('implicit_subject', V.IMPERATIVE_VERBS, "'s'", "'Imperative \"' || left(q, 60) || '...\" has implied subject'")}
UNION ALL {_starts('undefined_language', V.REFERENTS, "'d', 's', 'w', 'c'", "'Undefined referent \"' || p || '\" at sentence start: \"' || left(q, 60) || '...\"'")}
UNION ALL {_found('not_stated_with_specificity', V.VAGUE_QUANTIFIERS, "'d', 's', 'w', 'c'", "'Vague quantifier \"' || p || '\" used without specific count'")}
UNION ALL {_found('vaguely_specified_operation', V.VAGUE_OPERATIONS, "'d', 's', 'c'", "'Vague operation \"' || p || '\" lacks depth or acceptance criteria'")}
UNION ALL {_found('imprecise_external_reference', V.IMPRECISE_REFERENCES, "'d', 's', 'w'", "'Imprecise reference \"' || p || '\" without enough info to locate'")})"""


DEFECTS = "WITH " + _defects_of(DOC_FIELDS)
#: Skills after revision: those of large parts have a new step, all have a new description, as none is valid before.
REVISED = f"""{S}, {_defects_of("""l AS (SELECT *, CAST(regexp_extract(trigger_b, 'size ([0-9]+)', 1) AS INTEGER) > 25 AS large FROM skills),
f AS (SELECT skill_uid, 'd' AS kind, 0 AS i, 'Reads.' AS t FROM l UNION ALL SELECT skill_uid, 'w', 0, '' FROM l UNION ALL SELECT skill_uid, 's', 1, CASE WHEN large THEN 'The analyst reads it' ELSE step_a END FROM l UNION ALL SELECT skill_uid, 's', 2, step_b FROM l WHERE NOT large UNION ALL SELECT skill_uid, 'c', 1, trigger_b FROM l)""")}"""
ROLL_UP = "t AS (SELECT l.skill_uid, count(e.defect_type) AS n FROM l LEFT JOIN e ON e.skill_uid = l.skill_uid GROUP BY l.skill_uid) SELECT count(*) AS skills, count(*) FILTER (WHERE n = 0) AS valid, count(*) FILTER (WHERE n > 0) AS with_defects, CAST(coalesce(sum(n), 0) AS BIGINT) AS total_defects FROM t"

#: Skills in order: each goes to the first kept one that is similar, or is kept.
GREEDY = f"""WITH RECURSIVE skills AS ({S.split('AS (', 1)[1].rsplit(')', 1)[0]}), edges AS ({with_views('edges').split('AS (', 1)[1].rsplit(')', 1)[0]}),
n AS (SELECT ord, skill_uid, merge_name, list_distinct(string_split(merge_name, '-')) AS w, row_number() OVER (ORDER BY ord) AS i FROM skills),
r AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS ord, NULL::BIGINT AS kept, []::STRUCT(o BIGINT, w VARCHAR[])[] AS ks UNION ALL
SELECT i, ord, coalesce(hit, ord), CASE WHEN hit IS NULL THEN list_append(ks, {{'o': ord, 'w': w}}) ELSE ks END FROM (SELECT n.i, n.ord, n.w, r.ks, list_filter(r.ks, lambda k: len(list_intersect(k.w, n.w)) / CAST(greatest(len(k.w), len(n.w)) AS DOUBLE) > 0.6)[1].o AS hit FROM r JOIN n ON n.i = r.i + 1))"""

ORACLES = {
    "v7_defects": f"{DEFECTS} SELECT skill_uid, defect_type, location, description, count(*) AS n FROM e GROUP BY ALL",
    "v9_revise_loop": f"{REVISED}, {ROLL_UP}",
    "v8_defects_by_type": f"{DEFECTS} SELECT defect_type, count(*) AS n FROM e GROUP BY ALL",
    "v8_roll_up": f"{DEFECTS}, {ROLL_UP}",
    "m1_task_skill_match": f"{ETS}, {EDGE}, {MATCH} SELECT * FROM m",
    "m2_one_to_one_plan": f"{ETS}, {EDGE}, {MATCH}, {PLAN} SELECT p.*, a.model, b.mode FROM p, (VALUES ('m-a'), ('m-b')) a(model), (VALUES ('singlecall'), ('stepwise')) b(mode)",
    "m3_cross_task_plan": f"""{with_views('tasks')}, g AS (SELECT task_uid, c AS condition, '' AS skill_name FROM tasks, (VALUES ('baseline'), ('self_generated')) v(c) UNION ALL SELECT task_uid, 'curated', n_name FROM tasks, nation)
SELECT condition, model, repetition, count(*) AS n, count(DISTINCT skill_name) AS n_skills FROM g, (VALUES ('m-a'), ('m-b')) a(model), (VALUES (0), (1)) r(repetition) GROUP BY ALL""",
    "s10_pending_trials": f"{ETS}, {EDGE}, {MATCH}, {PLAN}, t AS (SELECT {KEY} AS trial_key FROM p, (VALUES ('m-a'), ('m-b')) a(model)) SELECT trial_key FROM t WHERE trial_key NOT IN (SELECT trial_key FROM t WHERE left(sha256(trial_key), 1) < '8')",
    "s10_pending_in_log": f"{ETS}, {EDGE}, {MATCH}, {PLAN}, t AS (SELECT {KEY} AS trial_key FROM p, (VALUES ('m-a'), ('m-b')) a(model)) SELECT trial_key FROM t WHERE trial_key NOT IN (SELECT trial_key FROM t WHERE left(sha256(trial_key), 1) < '8')",
    "n7_filter_tasks": f"{with_views('tasks')} SELECT task_uid FROM tasks WHERE domain = 'law' AND difficulty = 'easy'",
    "n8_combine_tasks": f"{with_views('tasks')} SELECT task_uid, CASE WHEN ord % 3 = 0 THEN title || ' (new)' ELSE title END AS title, domain, CAST(CASE WHEN ord % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS source_ord FROM tasks",
    "n10_validation_subset": f"{ETS}, {EDGE} SELECT 'other' AS name, count(*) AS n_tasks FROM x JOIN tasks t ON t.task_uid = x.task_uid WHERE x.ord % 7 <> 0",
    "p13_rename_tasks": f"{ETS}, {EDGE}, {RENAMED} SELECT * FROM r",
    "p13_rename_sources": f"{ETS}, {EDGE}, {RENAMED} SELECT s.skill_uid, coalesce(string_agg(coalesce(r.new_uid, x.task_uid), '~' ORDER BY x.task_uid) FILTER (WHERE x.task_uid IS NOT NULL), '') AS source_task_uids FROM skills s LEFT JOIN x ON x.skill_uid = s.skill_uid LEFT JOIN r ON r.task_uid = x.task_uid GROUP BY s.skill_uid",
    "p12_similar_pairs": f"{S}, n AS (SELECT min(ord) AS ord, w FROM (SELECT ord, list_sort(list_distinct(string_split(merge_name, '-'))) AS w FROM skills) GROUP BY w) SELECT a.ord AS ord_a, b.ord AS ord_b FROM n a JOIN n b ON a.ord < b.ord WHERE len(list_intersect(a.w, b.w)) / CAST(greatest(len(a.w), len(b.w)) AS DOUBLE) > 0.6",
    "p12_merge_skills": f"""{GREEDY},
t AS (SELECT r.kept, e.task_uid FROM r JOIN n ON n.ord = r.ord JOIN edges e ON e.skill_uid = n.skill_uid), g AS (SELECT kept, string_agg(DISTINCT task_uid, '~' ORDER BY task_uid) AS ts FROM t GROUP BY kept)
SELECT n.skill_uid, n.merge_name AS name, coalesce(g.ts, '') AS source_task_uids FROM r JOIN n ON n.ord = r.ord AND r.kept = r.ord LEFT JOIN g ON g.kept = r.ord""",
    "p12_representatives": f"""{GREEDY} SELECT r.ord, r.kept, len(list_intersect(a.w, b.w)) / CAST(greatest(len(a.w), len(b.w)) AS DOUBLE) AS overlap FROM r JOIN n a ON a.ord = r.ord JOIN n b ON b.ord = r.kept""",
    "l1_lineage": f"{ETS}, {EDGE} SELECT coalesce(t.source_document_uid, '') AS source_document_uid, coalesce(t.source_artifact, '') AS source_artifact, '' AS passage_uid, x.task_uid, coalesce(t.title, '') AS task_title, x.skill_uid, x.name AS skill_name FROM x LEFT JOIN tasks t ON t.task_uid = x.task_uid",
    "l2_summary": f"""{ETS}, {EDGE} SELECT (SELECT count(DISTINCT source_document_uid) FROM tasks WHERE source_document_uid <> '') AS documents, (SELECT count(*) FROM tasks) AS tasks, (SELECT count(*) FROM skills) AS skills, (SELECT count(*) FROM x) AS records,
(SELECT count(*) FROM tasks WHERE source_document_uid = '') AS orphaned_tasks, (SELECT count(*) FROM skills WHERE skill_uid NOT IN (SELECT skill_uid FROM edges)) AS orphaned_skills, (SELECT count(*) FROM tasks WHERE task_uid NOT IN (SELECT task_uid FROM x)) AS unlinked_tasks""",
    "l2_unlinked_tasks": f"{ETS}, {EDGE} SELECT task_uid FROM tasks WHERE task_uid NOT IN (SELECT task_uid FROM x)",
    "l2_orphaned_tasks": f"{with_views('tasks')} SELECT task_uid FROM tasks WHERE source_document_uid = ''",
    "l2_orphaned_skills": f"{with_views('edges', 'skills')} SELECT skill_uid FROM skills WHERE name LIKE '%-promo' OR skill_uid NOT IN (SELECT skill_uid FROM edges)",
    "l2_document_tasks": f"{with_views('tasks')} SELECT source_document_uid, max_by(source_artifact, ord) AS source_artifact, count(*) AS n_tasks FROM tasks WHERE source_document_uid <> '' GROUP BY source_document_uid",
    "l3_source_documents": f"{with_views('tasks')}, f AS (SELECT source_document_uid AS document_uid, min_by(source_artifact, ord) AS source_name FROM tasks WHERE source_document_uid <> '' GROUP BY 1) SELECT document_uid, CASE WHEN source_name LIKE 'dataset:%' THEN 'dataset' WHEN source_name LIKE '%.pdf' THEN 'pdf' ELSE 'file' END AS source_type, source_name FROM f",
    "l4_skills_export": f"{with_views('edges', 'skills')} SELECT s.skill_uid, s.name, s.description, 2 AS procedure_steps, CAST(count(e.task_uid) AS INTEGER) AS instance_count FROM skills s LEFT JOIN edges e ON e.skill_uid = s.skill_uid GROUP BY ALL",
    "l4_skill_instances": f"{ETS}, {EDGE} SELECT skill_uid, task_uid FROM x",
    "c1_window_counts": f"{S}, n AS (SELECT collection, count(*) AS n FROM skills GROUP BY 1), k AS (SELECT CAST(k AS INTEGER) AS k_value, CAST(sum(greatest(n - k + 1, 0)) AS BIGINT) AS n FROM n, (VALUES (2), (3)) v(k) GROUP BY k) SELECT k_value, o AS composition_type, n FROM k, (VALUES ('seq'), ('par'), ('cond')) v(o)",
    "c2_compose_seq": SEQ,
    "c3_compose_par": PAR,
    "c4_compose_cond": COND,
    "c5_render_markdown": RENDER,
    "c6_semantic_fusion": f"{S}, {REG} SELECT collection, 'sem-' || array_to_string(names, '-') AS name, 'Semantic fusion of 2 skills' AS description, 'When integrated skill application is needed' AS when_to_use, 'Apply skills with semantic understanding' AS procedure, array_to_string(names, '~') AS source_skills FROM w WHERE k = 2",
    "c7_dependencies": f"WITH RECURSIVE skills AS ({S.split('AS (', 1)[1].rsplit(')', 1)[0]}), {GRAPH}, r AS (SELECT name, ref AS dependency FROM g UNION SELECT r.name, g.ref FROM r JOIN g ON g.name = r.dependency) SELECT * FROM r",
    "c8_invalid_references": f"{S}, {GRAPH} SELECT name, string_agg(ref, '~' ORDER BY ref) AS missing FROM g WHERE ref NOT IN (SELECT name FROM g) GROUP BY name",
    "c9_covering_tasks": f"""{S}, {REG}, h AS (SELECT 'seq-' || array_to_string(names, '-then-') AS composed, unnest(names) AS skill FROM w), q AS (SELECT CAST(ord AS VARCHAR) AS task_uid, unnest(list_filter([name, lead(name) OVER v, lead(name, 2) OVER v, lead(name, 3) OVER v][1:1 + ord % 4], lambda x: x IS NOT NULL)) AS skill FROM reg WINDOW v AS (PARTITION BY collection ORDER BY ord))
SELECT q.task_uid, h.composed FROM q JOIN h ON h.skill = q.skill GROUP BY q.task_uid, h.composed HAVING count(DISTINCT q.skill) = (SELECT count(DISTINCT x.skill) FROM q x WHERE x.task_uid = q.task_uid)""",
}
