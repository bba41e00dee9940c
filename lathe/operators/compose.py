"""Skill composition (C1-C10) over skills with collection, ord, name, description and the arrays
when_to_use, procedure, constraints, related_skills and examples (title, input, process, output)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathe.operators.numbering import numbered
from lathe.sources.tables import checkpoint

OPERATORS = ("seq", "par", "cond")


def title_case(name: Column) -> Column:
    """Hyphens as blanks, a capital after every non-letter, small letters after letters."""
    chars = F.split(F.replace(name, F.lit("-"), F.lit(" ")), "")
    return F.array_join(F.transform(chars, lambda c, i: F.when((i > 0) & F.get(chars, i - 1).rlike(r"\p{L}"), F.lower(c)).otherwise(F.upper(c))), "")


def windows(skills: DataFrame, k_values: Sequence[int] = (2, 3)) -> DataFrame:
    """Every run of k consecutive skills of a collection, for each k: collection, k_value, start, members (array of structs in order).

    Each skill is sent to the windows that it belongs to, so no window over rows is
    kept open; n - k + 1 windows of n skills.
    """
    order = numbered(skills.select("collection", "ord"), ["collection"], ["ord"], "_i")
    rows = skills.join(order, ["collection", "ord"]).withColumn("k_value", F.explode(F.array(*map(F.lit, k_values))))
    rows = rows.withColumn("start", F.explode(F.sequence(F.greatest(F.lit(1), F.col("_i") - F.col("k_value") + 1), F.col("_i"))))
    member = F.struct("_i", *[c for c in skills.columns if c != "collection"])
    out = rows.groupBy("collection", "k_value", "start").agg(F.sort_array(F.collect_list(member)).alias("members"))
    return out.where(F.size("members") == F.col("k_value"))


def _related(members: Column) -> Column:
    return F.array_distinct(F.array_except(F.flatten(F.transform(members, lambda s: s.related_skills)), members["name"]))


def _titles(members: Column, joiner: str) -> Column:
    return F.array_join(F.transform(members, lambda s: title_case(s["name"])), joiner)


def _composed(df: DataFrame, kind: str, **parts: Column) -> DataFrame:
    m = F.col("members")
    return df.select(
        "collection", "start", parts["name"].alias("name"), parts["description"].alias("description"), parts["when_to_use"].alias("when_to_use"), parts["procedure"].alias("procedure"),
        parts["constraints"].alias("constraints"), parts["examples"].alias("examples"), _related(m).alias("related_skills"), F.lit(kind).alias("composition_type"), m["name"].alias("source_skills"), F.col("k_value").cast("int").alias("k_value"),
    )


def _example(title: Column, input: Column, process: Column, output: Column) -> Column:
    return F.struct(title.alias("title"), input.alias("input"), process.alias("process"), output.alias("output"))


def compose_sequential(groups: DataFrame) -> DataFrame:
    """Skills one after the other; steps of later skills say whose they are."""
    m = F.col("members")
    first = lambda s: F.get(s.examples, F.lit(0))
    flow = F.transform(m, lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), F.when(F.coalesce(first(s).process, F.lit("")) != "", F.concat(title_case(s["name"]), F.lit(": "), F.substring(first(s).process, 1, 100), F.lit("..."))).otherwise(F.concat(F.lit("Apply "), title_case(s["name"])))))
    last = F.element_at(m, -1)
    examples = F.array(_example(
        F.concat(F.lit("Sequential application of "), _titles(m, " -> ")), F.coalesce(first(m[0]).input, F.lit("[Input requiring this skill]")),
        F.concat(F.lit("Apply the following skills in sequence:\n"), F.array_join(flow, "\n")), F.coalesce(first(last).output, F.concat(F.lit("[Output from "), title_case(last["name"]), F.lit("]"))),
    ))
    steps = F.flatten(F.transform(m, lambda s, i: F.transform(s.procedure, lambda p: F.when(i > 0, F.concat(F.lit("Apply "), title_case(s["name"]), F.lit(": "), p)).otherwise(p))))
    return _composed(
        groups, "seq", name=F.concat(F.lit("seq-"), F.array_join(m["name"], "-then-")),
        description=F.concat(F.lit("Apply skills in sequence: "), F.array_join(m["description"], " -> "), F.lit(". Use when multiple capabilities are needed in order.")),
        when_to_use=F.array_distinct(F.flatten(m["when_to_use"])), procedure=steps, constraints=F.flatten(m["constraints"]), examples=examples,
    )


def compose_parallel(groups: DataFrame) -> DataFrame:
    """Skills on the same input; of each one's constraints the first, empty if it has none."""
    m = F.col("members")
    inputs = F.transform(m, lambda s: F.concat(F.lit("- "), title_case(s["name"]), F.when(F.coalesce(F.get(s.examples, F.lit(0)).input, F.lit("")) != "", F.concat(F.lit(": "), F.substring(F.get(s.examples, F.lit(0)).input, 1, 50), F.lit("..."))).otherwise("")))
    examples = F.array(_example(
        F.lit("Parallel skill application"), F.lit("Input that requires analysis from multiple skill perspectives simultaneously"),
        F.concat(F.lit("Apply the following skills in parallel to the same input:\n"), F.array_join(inputs, "\n"), F.lit("\n\nThen integrate the results from all skills.")), F.lit("Combined analysis integrating outputs from all parallel skills"),
    ))
    text = lambda *lines: F.array(*map(F.lit, lines))
    steps = F.concat(
        text("Apply the following skills in parallel:"), F.transform(m, lambda s: F.concat(F.lit("  - "), title_case(s["name"]), F.lit(": "), s.description)),
        text("Integrate the outputs from all parallel skills:", "  - Identify complementary results across skills", "  - Resolve any conflicts between skill outputs", "  - Synthesize a combined result"),
    )
    return _composed(
        groups, "par", name=F.concat(F.lit("par-"), F.array_join(m["name"], "-and-")),
        description=F.concat(F.lit("Apply skills in parallel: "), F.array_join(m["description"], " & "), F.lit(". Use when multiple capabilities are needed simultaneously.")),
        when_to_use=F.concat(F.array(F.concat(F.lit("Multiple skills are needed simultaneously: "), _titles(m, ", "))), F.flatten(m["when_to_use"])), procedure=steps,
        constraints=F.concat(text("All parallel skills must receive the same input context"), F.transform(m, lambda s: F.coalesce(F.get(s.constraints, F.lit(0)), F.lit("")))), examples=examples,
    )


def compose_conditional(groups: DataFrame, n_else: int = 0) -> DataFrame:
    """C4: the first skill is the condition, the next the then-branch, the last ``n_else`` the else-branch."""
    m = F.col("members")
    condition, rest = m[0], F.slice(m, F.lit(2), F.greatest(F.size(m) - 1 - n_else, F.lit(0)))
    other = F.slice(m, F.size(m) - n_else + 1, F.lit(n_else)) if n_else else None
    title = title_case(condition["name"])
    branch = lambda skills: F.transform(skills, lambda s, i: F.concat(F.lit("   "), (i + 1).cast("string"), F.lit(". Apply "), title_case(s["name"])))
    shown = lambda word, kind, skills: _example(F.lit(f"Condition is {word.lower()}"), F.concat(F.lit("Input where "), title, F.lit(f" evaluates to {word}")), F.concat(F.lit("1. "), title, F.lit(f" evaluates to {word}\n2. Apply {kind}-skills: "), _titles(skills, " -> ")), F.concat(F.lit("Output from applying "), _titles(skills, " -> ")))
    name = F.concat(F.lit("cond-"), condition["name"], F.lit("-then-"), F.array_join(rest["name"], "-and-"))
    description = F.concat(F.lit("Conditional skill: if "), title, F.lit(", then apply "), _titles(rest, " -> "))
    examples = [shown("TRUE", "then", rest)]
    otherwise = F.array(F.lit("   No action (or apply default behavior)"))
    if n_else:
        name, otherwise = F.concat(name, F.lit("-else-"), F.array_join(other["name"], "-and-")), branch(other)
        description = F.concat(description, F.lit(", else apply "), _titles(other, " -> "))
        examples.append(shown("FALSE", "else", other))
    steps = F.concat(F.array(F.lit("Evaluate the condition:"), F.concat(F.lit("1. Check "), title), F.lit("2. If condition is TRUE:")), branch(rest), F.array(F.lit("3. If condition is FALSE:")), otherwise)
    return _composed(
        groups, "cond", name=name, description=F.concat(description, F.lit(". Use when skill application depends on a condition.")),
        when_to_use=F.concat(F.array(F.concat(F.lit("When "), title, F.lit(" determines the path"))), condition["when_to_use"]), procedure=steps,
        constraints=F.concat(F.array(F.concat(F.lit("Condition must be evaluable: "), title), F.lit("Only one branch (then or else) is executed")), condition["constraints"]), examples=F.array(*examples),
    )


COMPOSE = {"seq": compose_sequential, "par": compose_parallel, "cond": compose_conditional}


def single(skills: DataFrame, kind: str) -> DataFrame:
    """C2, k = 1: the skill itself under a prefixed name."""
    return skills.withColumn("source_skills", F.array("name")).withColumn("name", F.concat(F.lit(f"{kind}-"), "name")).withColumn("composition_type", F.lit(kind)).withColumn("k_value", F.lit(1))


def compose_all(skills: DataFrame, k_values: Sequence[int] = (2, 3), operators: Sequence[str] = OPERATORS) -> DataFrame:
    """All compositions of the windows of each k by each operator."""
    groups = windows(skills, k_values)
    out = None
    for op in operators:
        part = COMPOSE[op](groups)
        out = part if out is None else out.unionByName(part)
    return out


def render(c: DataFrame) -> Column:
    """A composed skill as Markdown."""
    bullets = lambda a: F.array_join(F.transform(a, lambda x: F.concat(F.lit("- "), x, F.lit("\n"))), "")
    section = lambda name, body, a: F.when(F.size(a) > 0, F.concat(F.lit(f"## {name}\n\n"), body, F.lit("\n"))).otherwise("")
    steps = F.array_join(F.transform("procedure", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x, F.lit("\n"))), "")
    shown = F.array_join(F.transform("examples", lambda e, i: F.concat(F.lit("### Example "), (i + 1).cast("string"), F.lit(": "), e.title, F.lit("\n\n**Input:**\n"), e.input, F.lit("\n\n**Process:**\n"), e.process, F.lit("\n\n**Output:**\n"), e.output, F.lit("\n\n"))), "")
    related = F.when(F.size("related_skills") > 0, F.concat(F.lit("## Related Skills\n\n"), bullets("related_skills"))).otherwise("")
    return F.concat(
        F.lit("---\nname: "), "name", F.lit("\ndescription: "), "description", F.lit("\n---\n\n# "), title_case(F.col("name")), F.lit("\n\n## When to Use\n\n"), bullets("when_to_use"), F.lit("\n## Procedure\n\n"), steps, F.lit("\n"),
        section("Constraints", bullets("constraints"), "constraints"), shown, related,
    )


def with_markdown(composed: DataFrame) -> DataFrame:
    return composed.withColumn("markdown", render(composed))


def dependencies(edges: DataFrame) -> DataFrame:
    """(name, ref) edges -> all (name, dependency) reachable, each once; cycles end at visited nodes.

    Nodes that reach each other reach the same, so one of them stands for all while the
    pairs are found; at the end each pair of classes becomes those of their members.
    """
    links, held = _without_cycles(checkpoint(edges.select("name", F.col("ref").alias("dependency")).distinct()))
    pairs = _closure(links)
    if held is None:
        return pairs
    # a large class is several parts, so that its pairs are not made by one task
    n = F.ceil(F.col("n") / CLASS_PART)
    sizes = held.groupBy("root").agg(F.count("*").alias("n")).select(F.col("root").alias("_root"), n.alias("n"))
    held = checkpoint(held.join(sizes, F.col("root").eqNullSafe(F.col("_root"))).select("node", "root", F.pmod(F.xxhash64("node"), "n").alias("part")))
    parts = held.select("root", "part").distinct()
    for side in ("name", "dependency"):
        of = parts.select(F.col("root").alias("_root"), F.col("part").alias(f"_{side}"))
        pairs = pairs.join(of, F.col(side).eqNullSafe(F.col("_root"))).drop("_root")
    for side in ("name", "dependency"):
        of = held.select("node", F.col("root").alias("_root"), F.col("part").alias("_part"))
        pairs = pairs.join(of, F.col(side).eqNullSafe(F.col("_root")) & (F.col(f"_{side}") == F.col("_part"))).withColumn(side, F.col("node")).drop("node", "_root", "_part", f"_{side}")
    return pairs.select("name", "dependency")


#: Members of a class that one task expands at most, about.
CLASS_PART = 1000


def _closure(links: DataFrame) -> DataFrame:
    """All pairs reachable by distinct links (name, dependency).

    Pairs are held with their distance. A round joins those up to a distance to those of
    just that distance, and so finds all up to twice as far: a shortest path is one of
    the former and then one of the latter. Rounds are the logarithm of the longest
    distance, and a pair is met once for each node on a shortest path at that place.
    """
    reached, reach = links.withColumn("distance", F.lit(1)), 1
    while True:
        far = reached.where(F.col("distance") == reach).select(F.col("name").alias("dependency"), F.col("dependency").alias("_to"))
        step = reached.join(far, "dependency").groupBy("name", F.col("_to").alias("dependency")).agg((F.min("distance") + reach).alias("distance"))
        known = reached.select(F.col("name").alias("_name"), F.col("dependency").alias("_dependency"))
        fresh = checkpoint(step.join(known, F.col("name").eqNullSafe(F.col("_name")) & F.col("dependency").eqNullSafe(F.col("_dependency")), "left_anti"))
        if fresh.isEmpty():
            return reached.select("name", "dependency")
        reached, reach = checkpoint(reached.union(fresh)), 2 * reach


def _without_cycles(links: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Links between classes of nodes that reach each other, and (node, root) of all nodes; None if each is a class of its own.

    A round merges nodes that are at most four links apart in both directions, and so
    shortens the cycles that are left. Rounds end when few nodes are merged: what is left
    of cycles is met by the closure. Nodes that no link enters, or none leaves, are on no
    cycle and are left out of the search.
    """
    members = None
    while True:
        inner = links.where("name != dependency")
        inner = inner.join(inner.select("name").distinct().withColumnRenamed("name", "dependency"), "dependency", "left_semi")
        inner = inner.join(links.where("name != dependency").select(F.col("dependency").alias("name")).distinct(), "name", "left_semi")
        two = checkpoint(_walks(inner).distinct())
        lower, one_way = F.least("name", "dependency").alias("root"), F.col("name") < F.col("dependency")
        both = _walks(two).where("name != dependency").groupBy(F.greatest("name", "dependency").alias("node"), lower).agg(F.min(one_way).alias("_some"), F.max(one_way).alias("_all"))
        moved = checkpoint(both.where("_some != _all").groupBy("node").agg(F.min("root").alias("root")))
        n = moved.count()
        if n == 0:
            return links, members
        moved = checkpoint(_renamed(moved, "root", moved))
        if members is None:
            members = links.select(F.col("name").alias("node")).union(links.select("dependency")).distinct().select("node", F.col("node").alias("root"))
        members = checkpoint(_renamed(members, "root", moved))
        links = checkpoint(_renamed(_renamed(links, "name", moved), "dependency", moved).distinct())
        if 10 * n < links.count():
            return links, members


def _walks(pairs: DataFrame) -> DataFrame:
    """Pairs, and those of two that follow each other; some several times."""
    then = pairs.select(F.col("name").alias("dependency"), F.col("dependency").alias("_to"))
    return pairs.select("name", "dependency").union(pairs.join(then, "dependency").select("name", "_to"))


def _renamed(df: DataFrame, column: str, moved: DataFrame) -> DataFrame:
    """``df`` with the roots of moved nodes in a column."""
    to = moved.select(F.col("node").alias(column), F.col("root").alias("_new"))
    return df.join(to, column, "left").withColumn(column, F.coalesce("_new", column)).select(*df.columns)


def invalid_references(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Per skill, its related names that are no skill, in order."""
    bad = edges.join(names.select(F.col("name").alias("ref")), "ref", "left_anti")
    return bad.groupBy("name").agg(F.array_sort(F.collect_set("ref")).alias("missing"))


def covering(composed: DataFrame, required: Sequence[str]) -> DataFrame:
    """Composed skills whose sources hold all required skills."""
    return composed.where(F.size(F.array_except(F.array(*map(F.lit, required)), "source_skills")) == 0)


def covering_tasks(sources: DataFrame, required: DataFrame) -> DataFrame:
    """C9 for many tasks: sources (composed, skill), required (task_uid, skill) -> (task_uid, composed) whose sources hold all that a task requires.

    A task looks up only the one of its skills that is in the fewest compositions; the
    others are tested on the composition's set of skills. A skill that is in most
    compositions is so looked up by those tasks alone that require nothing rarer.
    """
    held = sources.distinct()
    listed = held.groupBy("skill").agg(F.count("*").alias("_n"))
    sets = held.groupBy("composed").agg(F.collect_set("skill").alias("_has")).withColumn("skill", F.explode("_has"))
    needs = required.distinct().join(listed, "skill", "left").groupBy("task_uid").agg(F.collect_set("skill").alias("_needs"), F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "skill")).alias("_rarest"))
    asked = needs.where("_rarest.n > 0").select("task_uid", "_needs", "_rarest.skill")
    return asked.join(sets, "skill").where(F.size(F.array_except("_needs", "_has")) == 0).select("task_uid", "composed")


def lookup(names: DataFrame, atomic: DataFrame, composed: DataFrame) -> DataFrame:
    """Content and description of each name: an atomic skill first, then a composed one."""
    pick = lambda df, p: df.select("name", F.col("description").alias(f"_{p}d"), F.col("content").alias(f"_{p}c"), F.lit(True).alias(f"_{p}"))
    out = names.join(pick(atomic, "a"), "name", "left").join(pick(composed, "c"), "name", "left")
    return out.select("name", F.when(F.col("_a"), F.col("_ac")).otherwise(F.col("_cc")).alias("content"), F.when(F.col("_a"), F.col("_ad")).otherwise(F.col("_cd")).alias("description"))
