"""Semantic fusion of skills by a model call."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathe.functions.text import strip
from lathe.operators.calls import Chat, call_model, offline_client
from lathe.operators.compose import title_case

INSTRUCTION = "Fuse these skills into one composite skill. Return JSON with name, description, when_to_use, procedure, constraints, examples and fusion_rationale."


def fusion_prompt(fusion_type: str = "auto", instruction: str = INSTRUCTION) -> Column:
    """The prompt of a window's members: one section per skill, in order."""
    bullets = lambda a: F.array_join(F.transform(a, lambda x: F.concat(F.lit("- "), x)), "\n")
    each = F.transform("members", lambda s, i: F.concat(F.lit("## Skill "), (i + 1).cast("string"), F.lit(": "), title_case(s["name"]), F.lit("\n\n"), s.description, F.lit("\n\nWhen to use:\n"), bullets(s.when_to_use), F.lit("\n\nProcedure:\n"), bullets(s.procedure), F.lit("\n\nConstraints:\n"), bullets(s.constraints)))
    return F.concat(F.lit(f"{instruction}\nFusion type: {fusion_type}\n\n"), F.array_join(each, "\n\n"))


def fused(replies: DataFrame) -> DataFrame:
    """Composed skills from windows (members, k_value, …) with a reply.

    The reply's JSON is in a ``json`` fence, else from its first ``{`` to its last
    ``}``; without valid JSON a minimal skill stands in.
    """
    m = F.col("members")
    fence = F.regexp_extract("reply", r"(?s)```json\s*(.*?)\s*```", 1)
    body = F.when(fence != "", fence).otherwise(F.regexp_extract("reply", r"(?s)\{.*\}", 0))
    good = F.coalesce(F.startswith(F.schema_of_variant(F.try_parse_json(strip(body))), F.lit("OBJECT")), F.lit(False))
    get = lambda name: F.get_json_object("_body", f"$.{name}")
    items = lambda name: F.coalesce(F.from_json(get(name), "array<string>"), F.array().cast("array<string>"))
    shown = F.coalesce(F.from_json(get("examples"), "array<struct<title:string,input:string,process:string,output:string>>"), F.array().cast("array<struct<title:string,input:string,process:string,output:string>>"))
    filled = F.transform(shown, lambda e: F.struct(F.coalesce(e.title, F.lit("Example")).alias("title"), *[F.coalesce(e[c], F.lit("")).alias(c) for c in ("input", "process", "output")]))
    default = F.concat(F.lit("sem-"), F.array_join(m["name"], "-"))
    none = F.array().cast("array<string>")
    related = F.array_distinct(F.array_except(F.flatten(F.transform(m, lambda s: s.related_skills)), m["name"]))
    rows = replies.withColumn("_good", good).withColumn("_body", F.when(good, body))
    pick = lambda a, b: F.when(F.col("_good"), a).otherwise(b)
    return rows.select(
        "collection", "start", pick(F.coalesce(get("name"), default), default).alias("name"),
        pick(F.coalesce(get("description"), F.lit("")), F.concat(F.lit("Semantic fusion of "), F.size(m).cast("string"), F.lit(" skills"))).alias("description"),
        pick(items("when_to_use"), F.array(F.lit("When integrated skill application is needed"))).alias("when_to_use"), pick(items("procedure"), F.array(F.lit("Apply skills with semantic understanding"))).alias("procedure"),
        pick(items("constraints"), none).alias("constraints"), filled.alias("examples"), pick(related, none).alias("related_skills"), F.lit("sem").alias("composition_type"), m["name"].alias("source_skills"), F.col("k_value").cast("int").alias("k_value"),
    )


def fuse(groups: DataFrame, make_client: Callable[[], Chat] = offline_client, fusion_type: str = "auto", concurrency: int = 8) -> DataFrame:
    """The windows of skills, each fused by one model call."""
    prompts = groups.withColumn("system_prompt", F.lit("")).withColumn("user_prompt", fusion_prompt(fusion_type))
    return fused(call_model(prompts, make_client, concurrency))
