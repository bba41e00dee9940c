import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, TimestampType

from lathe.operators import compose as C
from lathe.operators import lineage as L
from lathe.operators import matching as M
from lathe.operators import numbering
from lathe.operators import skill_merge as S
from lathe.operators import verify as V
from lathe.operators import replies
from lathe.operators.calls import _tasks, call_model, run_episodes
from lathe.plans import relation_queries
from lathe.sources import tables as T
from lathe.streaming import progress

SKILL = "ord long, skill_uid string, name string, source_task_uids array<string>"


def skills(spark, *rows):
    return spark.createDataFrame([(i, f"u{i}", *r) for i, r in enumerate(rows)], SKILL)


def test_match_prefers_small_then_early(spark):
    s = skills(spark, ("big", ["a", "b", "c"]), ("one", ["a"]), ("two", ["b"]), ("three", ["b"]), ("none", []))
    assert {r.task_uid: r.skill_name for r in M.match_skills(s).collect()} == {"a": "one", "b": "two", "c": "big"}


def test_plans(spark):
    s, t = skills(spark, ("one", ["a"])), spark.createDataFrame([("a", 0), ("b", 1)], "task_uid string, ord long")
    assert M.plan_one_to_one(t, s, ["m1", "m2"], ["singlecall", "guided"]).count() == (2 + 1) * 4
    assert M.plan_cross_task(t, s, ["m"], repetitions=5).count() == 2 * (1 + 1) * 5
    assert M.plan_cross_task(t, s, ["m"], ("baseline", "curated", "self_generated")).count() == 2 * 3


def test_pending_and_keys(spark):
    p = spark.createDataFrame([("t", "m", 0), ("t", "m", 1)], "task string, model string, repetition int")
    p = p.withColumn("trial_key", M.trial_key(F.col("task"), F.lit("prov"), F.col("model"), F.lit("baseline"), F.lit(""), F.lit("http://x")))
    assert p.first().trial_key == "t|prov/m@http://x|baseline|"
    assert [r.repetition for r in M.pending(p, p.where("repetition = 0")).collect()] == [1]


def test_a_growing_log_is_not_shuffled(spark, tmp_path):
    keys = "trial_key string, repetition int"
    plan = spark.createDataFrame([(f"k{i}", r) for i in range(50) for r in range(3)] + [("é", 0)], keys)
    log = M.open_trial_log(spark, "trial_log_test", str(tmp_path / "log"), 8)
    assert M.pending_in_log(plan, log).count() == 151
    for some in (plan.where("repetition = 0"), plan.where("repetition = 1 and trial_key < 'k3'"), plan.where("repetition = 0")):
        M.record_trials(some, log, 8)
    spark.sql("DROP TABLE trial_log_test")  # another session opens the same files
    log = M.open_trial_log(spark, "trial_log_test", str(tmp_path / "log"), 8)
    left = M.pending_in_log(plan, log)
    assert sorted(map(tuple, left.collect())) == sorted(tuple(r) for r in plan.collect() if r.repetition == 2 or r.repetition == 1 and r.trial_key >= "k3")
    lines = left._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].split("\n")
    assert sum("Exchange" in x for x in lines) == 1 and any("trial_log_test" in x and "Bucketed: true" in x for x in lines)
    join, log_scan = (next(i for i, x in enumerate(lines) if word in x) for word in ("SortMergeJoin", "trial_log_test"))
    other = next(i for i, x in enumerate(lines) if "Exchange" in x)
    assert join < other < log_scan and lines[other].index("Exchange") > lines[join].index("SortMergeJoin")  # the one exchange is the plan's


def test_later_sources_override(spark):
    a = spark.createDataFrame([("t", 0, "x"), ("t", 1, "y"), ("u", 2, "z")], "task_uid string, ord long, v string")
    b = spark.createDataFrame([("u", 0, "new", 1)], "task_uid string, ord long, v string, extra int")
    assert {r.task_uid: r.v for r in M.combine_tasks(a, b).collect()} == {"t": "y", "u": "new"}


def test_renames(spark):
    s = skills(spark, ("x", ["b", "a"]), ("y", ["a", "c"]))
    t = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2), ("d", 3)], "task_uid string, ord long")
    assert {r.task_uid: r.new_uid for r in M.rename_tasks(s, t).collect()} == {"a": "x-01", "b": "x-02", "c": "y-01"}
    assert {r.name: r.source_task_uids for r in M.rename_sources(s, t).collect()} == {"x": ["x-02", "x-01"], "y": ["x-01", "y-01"]}


def test_prompts(spark):
    row = spark.range(1).select(
        M.inject_skill(F.lit("base \n"), F.lit("n"), F.lit(" body ")), M.hint_skill(F.lit("u"), F.lit("n"), F.lit("d")),
        M.skill_text(F.lit("d"), F.lit(""), F.array(F.lit("a"), F.lit("b")), F.array(F.lit("c"))),
        M.stepwise_state(F.lit("p"), F.lit("c"), F.array().cast("array<string>")), M.guided_state(F.lit("p"), F.lit("c"), F.lit("s"), F.lit(1), F.lit(2), F.array(F.lit("f"))),
        M.default_prompt(F.lit("coding")),
    ).first()
    assert row[0] == "base\n\n--- SKILL: n ---\nbody\n--- END SKILL ---" and row[1] == "u\n\nSkill hint (n): d"
    assert row[2] == "d\n\n## Procedure\n1. a\n2. b\n\n## Constraints\n- c"
    assert row[3].endswith("Reasoning so far:\n  (no steps yet)\n\nWrite the next reasoning step:") and "Findings so far:\n  1. f\n\nStep 1 of 2: s" in row[4]
    assert row[5].startswith("You are an expert software developer")


def merged(spark, *names):
    s = skills(spark, *[(n, [f"t{i}"]) for i, n in enumerate(names)]).withColumn("extraction_method", F.lit("m"))
    return [(r.name, sorted(r.source_task_uids), r.extraction_method) for r in S.merge_skills(s).orderBy("ord").collect()]


def greedy(names):
    kept = []
    for n in names:
        w = set(n.split("-"))
        if not any(len(w & k) / max(len(w), len(k)) > 0.6 for k in kept):
            kept.append(w)
    return len(kept)


def test_merge(spark):
    assert merged(spark, "a-b-c", "a-b-d", "a-b-c-e") == [("a-b-c", ["t0", "t1", "t2"], "")]
    assert merged(spark, "a-b-c-d-e", "a-b-c-x-y") == [("a-b-c-d-e", ["t0"], "m"), ("a-b-c-x-y", ["t1"], "m")]
    names = ["a-b-c", "b-c-d", "c-d-e", "d-e-f", "e-f-g", "a-b-c-d", "x", "x", "b-c-d-e"]
    assert len(merged(spark, *names)) == greedy(names)


def nearest(names):
    """(kept, overlap) of each name, in order."""
    kept, out = [], []
    for i, n in enumerate(names):
        w = set(n.split("-"))
        hit = next(((k, len(w & x) / max(len(w), len(x))) for k, x in kept if len(w & x) / max(len(w), len(x)) > 0.6), None)
        if hit is None:
            kept.append((i, w))
        out.append(hit or (i, 1.0))
    return out


@pytest.mark.parametrize("candidates", [3, 200, 10**6])
def test_representatives(spark, monkeypatch, candidates):
    monkeypatch.setattr(S, "CANDIDATES", candidates)
    rng = random.Random(candidates)
    n = 40 if candidates == 3 else 160
    names = ["-".join(rng.choices("abcdefgh" * 3 + "xyzuvw", k=rng.choice([1, 2, 3, 4, 5, 6]))) for _ in range(n)]
    got = {r.ord: (r.kept, r.overlap) for r in S.representatives(skills(spark, *[(x, []) for x in names])).collect()}
    assert [got[i] for i in range(n)] == nearest(names)


def test_candidates_of_many_alike_names_stay_linear(spark, monkeypatch):
    made, close = [], S._close

    def counted(earlier, later):
        a, b = (x.select("t", F.col("ord").alias(c)) for x, c in ((earlier, "a"), (later, "b")))
        made.append(a.join(b, "t").count())
        return close(earlier, later)

    monkeypatch.setattr(S, "_close", counted)
    rng = random.Random(4)
    six = ["-".join(rng.sample(["read", "find", "rank", "pick", "sort", "check"], rng.randint(2, 6))) for _ in range(5000)]
    S.representatives(skills(spark, *[(x, []) for x in six])).collect()
    assert sum(made) < 5000 * 6  # word sets, of which there are few
    made.clear()
    monkeypatch.setattr(S, "CANDIDATES", 30_000)
    alike = [f"read-the-long-text-first-{i}" for i in range(3000)]  # all pairs: 4.5 million, three common keys each
    got = S.representatives(skills(spark, *[(x, []) for x in alike])).collect()
    assert {r.kept for r in got} == {0} and sum(made) < 3000 * 30


TASK = "task_uid string, title string, source_document_uid string, source_artifact string, ord long"


def test_lineage(spark):
    s = skills(spark, ("x", ["a", "gone"]), ("y", []))
    t = spark.createDataFrame([("a", "A", "d1", "dataset:z", 0), ("b", "B", "", "", 1), ("c", "C", "d1", "f.pdf", 2)], TASK)
    assert sorted((r.task_uid, r.task_title, r.passage_uid) for r in L.lineage(s, t).collect()) == [("a", "A", ""), ("gone", "", "")]
    assert tuple(L.summary(t, s).first()) == (1, 3, 2, 2, 1, 1, 2)
    assert tuple(L.document_tasks(t).first()) == ("d1", "f.pdf", 2) and tuple(L.source_documents(t).first()) == ("d1", "dataset", "dataset:z")


GOLDEN = [
    ("extract-parallel-claims", "when the analyst has the relevant texts", ["The analyst reads both texts"], ["Never address claims outside the texts"], [("imprecise_external_reference", "when_to_use"), ("vaguely_specified_operation", "constraint 1")]),
    ("identify-factual-contradiction", "after claims have been extracted", ["The analyst compares claims"], [], [("procedural_sufficiency", "procedure"), ("passive_voice", "when_to_use")]),
]


@pytest.mark.parametrize("name, when, procedure, constraints, expected", GOLDEN)
def test_verify(spark, name, when, procedure, constraints, expected):
    df = spark.createDataFrame([(name, "Finds claims", when, procedure, constraints)], "skill_uid string, description string, when_to_use string, procedure array<string>, constraints array<string>")
    r = V.verify(df).first()
    assert [(d.defect_type, d.location) for d in r.defects] == expected and r.defect_count == len(expected) and not r.is_valid


@pytest.mark.parametrize("step, primitive", [("The analyst collects notes", "observe"), ("The analyst produces text", "apply"), ("produce text", "enumerate"), ("nothing here at all really compares", None), ("'Ranks', all", "compare")])
def test_primitives(spark, step, primitive):
    assert spark.createDataFrame([(step,)], "c string").select(V.step_primitive(F.col("c"))).first()[0] == primitive


def test_checks(spark):
    row = spark.createDataFrame([("It is used. It was taken. Check this. document the claim, etc.",)], "c string").select(
        V.passive_phrases(F.col("c")), F.size(V.undefined_referent(F.col("c"), F.lit("x"))), F.size(V.implicit_subject(F.col("c"), F.lit("x"))), F.size(V.vague_operations(F.col("c"), F.lit("x"))), F.size(V.vague_quantifiers(F.col("c"), F.lit("x"))),
    ).first()
    assert tuple(row) == (["was taken"], 2, 1, 1, 1)


def test_empty_procedure(spark):
    df = spark.createDataFrame([("u", "", "", [], [])], "skill_uid string, description string, when_to_use string, procedure array<string>, constraints array<string>")
    assert [d.location for d in V.verify(df).first().defects] == ["procedure"]


def test_revisions_stop(spark):
    df = spark.createDataFrame([("good", "", "", ["The analyst reads it"], []), ("bad", "", "", ["hm"], []), ("hopeless", "", "", ["hm"], [])], "skill_uid string, description string, when_to_use string, procedure array<string>, constraints array<string>")
    fix = lambda bad: bad.withColumn("procedure", F.when(F.col("skill_uid") == "bad", F.array(F.lit("The analyst reads it"))).otherwise(F.col("procedure")))
    assert {r.skill_uid: r.is_valid for r in V.revise_loop(df, fix).collect()} == {"good": True, "bad": True, "hopeless": False}


def test_revisions_are_dealt_over_tasks(spark, monkeypatch):
    shape, busy, checkpoint = "skill_uid string, description string, when_to_use string, procedure array<string>, constraints array<string>", [], T.checkpoint

    def counted(df):
        out = checkpoint(df)
        busy.append(out.select(F.spark_partition_id().alias("p")).distinct().count())
        return out

    monkeypatch.setattr(T, "checkpoint", counted)
    df = spark.createDataFrame([(f"s{i}", "", "", ["hm"], []) for i in range(200)], shape).coalesce(1)
    assert V.revise_loop(df, lambda bad: bad).count() == 200
    assert len(busy) == 3 and min(busy) >= 4


def test_revision_query_reads_parts_alone(spark, tmp_path):
    source = "/root/testdata/sf0.001/part.parquet"
    spark.read.parquet(source).coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    row = relation_queries.QUERIES["v9_revise_loop"](spark, str(tmp_path)).first()
    assert row.skills == spark.read.parquet(source).count() and row.valid + row.with_defects == row.skills


EXAMPLE = "array<struct<title:string,input:string,process:string,output:string>>"


def registry(spark, n=3):
    rows = [("c", i, f"skill-{i}", f"does {i}", ["when", f"w{i}"], [f"step {i}"], [f"rule {i}"] if i else [], ["skill-1", f"r{i}"], []) for i in range(n)]
    return spark.createDataFrame(rows, f"collection string, ord long, name string, description string, when_to_use array<string>, procedure array<string>, constraints array<string>, related_skills array<string>, examples {EXAMPLE}")


def test_composition_counts(spark):
    counts = {(r.k_value, r.composition_type): r.n for r in T.count_operators(C.compose_all(registry(spark))).collect()}
    assert counts == {(k, o): 4 - k for k in (2, 3) for o in C.OPERATORS}


def test_compositions(spark):
    w = C.windows(registry(spark), [3])
    s, p, c = (f(w).first() for f in (C.compose_sequential, C.compose_parallel, C.compose_conditional))
    assert s.name == "seq-skill-0-then-skill-1-then-skill-2" and s.when_to_use == ["when", "w0", "w1", "w2"] and s.procedure == ["step 0", "Apply Skill 1: step 1", "Apply Skill 2: step 2"] and s.related_skills == ["r0", "r1", "r2"]
    assert p.constraints == ["All parallel skills must receive the same input context", "", "rule 1", "rule 2"] and p.when_to_use.count("when") == 3
    assert c.name == "cond-skill-0-then-skill-1-and-skill-2" and c.constraints[-1] == "Only one branch (then or else) is executed" and c.procedure[-1] == "   No action (or apply default behavior)"
    e = C.compose_conditional(w, n_else=1).first()
    assert e.name == "cond-skill-0-then-skill-1-else-skill-2" and e.procedure[-1] == "   1. Apply Skill 2" and len(e.examples) == 2
    md = C.with_markdown(C.compose_conditional(w)).first().markdown
    assert md.startswith("---\nname: cond-skill-0") and "## Constraints\n\n- Condition must be evaluable: Skill 0\n" in md


def test_dependencies_end_on_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "name string, ref string")
    assert sorted(map(tuple, C.dependencies(e).collect())) == [("a", "a"), ("a", "b"), ("a", "c"), ("b", "a"), ("b", "b"), ("b", "c")]
    assert C.invalid_references(e, spark.createDataFrame([("a",), ("b",)], "name string")).first().missing == ["c"]


def closure(edges):
    to, out = {}, set()
    for a, b in edges:
        to.setdefault(a, set()).add(b)
    for a in to:
        todo, seen = list(to[a]), set()
        while todo:
            if (x := todo.pop()) not in seen:
                seen.add(x)
                todo += to.get(x, ())
        out |= {(a, x) for x in seen}
    return out


def test_dependencies_of_graphs(spark):
    rng = random.Random(7)
    for n, m in ((8, 10), (30, 40), (30, 90)):
        edges = [(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(m)]
        assert {tuple(r) for r in C.dependencies(spark.createDataFrame(edges, "name string, ref string")).collect()} == closure(edges)


def test_long_chains_take_few_rounds(spark, monkeypatch):
    rounds, checkpoint = [], C.checkpoint
    monkeypatch.setattr(C, "checkpoint", lambda df: rounds.append(1) or checkpoint(df))
    n = 2000
    edges = spark.range(n).select(F.col("id").cast("string").alias("name"), (F.col("id") + 1).cast("string").alias("ref"))
    assert C.dependencies(edges).count() == n * (n + 1) // 2
    assert len(rounds) / 2 <= 15


def test_pairs_of_cycles_are_made_at_the_end(spark, monkeypatch):
    rng = random.Random(5)
    edges = [(f"n{b}-{i}", f"n{b}-{j}") for b in range(3) for i in range(30) if i % 5 for j in ((i + 7) % 30, i * 3 % 30)] + [(f"n0-{rng.randrange(30)}", f"n1-{rng.randrange(30)}") for _ in range(3)]
    edges += [(None, "n0-1"), ("n2-1", None), ("alone", "alone"), ("alone", "n2-2")]
    rows, checkpoint = [], C.checkpoint
    monkeypatch.setattr(C, "checkpoint", lambda df: (out := checkpoint(df), rows.append(out.count()))[0])
    got = sorted(map(str, map(tuple, C.dependencies(spark.createDataFrame(edges, "name string, ref string")).collect())))
    want = {(a, b) for a, b in closure([e for e in edges if None not in e])}
    want |= {(None, "n0-1"), *((None, b) for a, b in want if a == "n0-1")} | {("n2-1", None), *((a, None) for a, b in want if b == "n2-1")}
    assert got == sorted(map(str, want))
    assert max(rows) < len(want) / 3
    if hasattr(C, "CLASS_PART"):
        monkeypatch.setattr(C, "CLASS_PART", 4)
        assert sorted(map(str, map(tuple, C.dependencies(spark.createDataFrame(edges, "name string, ref string")).collect()))) == got


def test_covering_of_several_skills(spark):
    rng = random.Random(3)
    sets = {f"c{i}": {"common", *rng.sample("abcdefghij", rng.randint(1, 4))} for i in range(60)}
    tasks = {f"t{i}": set(rng.sample(["common", *"abcdefghij", "none"], rng.randint(1, 4))) for i in range(60)} | {"only": {"common"}, "un": {"none", "common"}}
    rows = lambda of: [(k, x) for k, v in of.items() for x in v] * 2
    got = C.covering_tasks(spark.createDataFrame(rows(sets), "composed string, skill string"), spark.createDataFrame(rows(tasks), "task_uid string, skill string")).collect()
    assert sorted(map(tuple, got)) == sorted((t, c) for t, need in tasks.items() for c, has in sets.items() if need <= has)


def test_covering_and_lookup(spark):
    c = C.compose_sequential(C.windows(registry(spark), [2]))
    assert [r.name for r in C.covering(c, ["skill-1", "skill-2"]).collect()] == ["seq-skill-1-then-skill-2"]
    a, b = (spark.createDataFrame([("n", "d" + x, "c" + x), (x, "d", "c")], "name string, description string, content string") for x in "ab")
    names = spark.createDataFrame([("n",), ("b",), ("z",)], "name string")
    assert {r.name: r.content for r in C.lookup(names, a, b).collect()} == {"n": "ca", "b": "c", "z": None}


def test_sources(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/results-a.json").write_text(json.dumps([{"task_uid": "t", "score": 0.5}, {"task_uid": "u", "passed": True}]))
    (tmp_path / "in/results-all-merged.json").write_text(json.dumps([{"task_uid": "no"}]))
    assert {r.task_uid for r in T.merge_results(spark, [str(tmp_path / "in")]).collect()} == {"t", "u"}
    (tmp_path / "l.jsonl").write_text('{"task_uid":"a"}\n\n{"task_uid":"b"}\n')
    assert sorted(r.task_uid for r in T.read_jsonl(spark, str(tmp_path / "l.jsonl"), T.TRACE).collect()) == ["a", "b"]
    tree = tmp_path / "tree/k2/seq"
    tree.mkdir(parents=True)
    (tree / "x.md").write_text("one\ntwo")
    (tmp_path / "tree/y.md").write_text("z")
    r = T.read_skill_tree(spark, str(tmp_path / "tree"), [2], ["seq"]).collect()
    assert [(x.k_value, x.composition_type, x.content) for x in r] == [(2, "seq", "one\ntwo")]
    assert [x.text for x in T.read_documents(spark, str(tmp_path / "tree")).orderBy("source_name").collect()] == ["one\ntwo", "z"]
    assert T.text_column(spark.createDataFrame([(1, "a", "b")], "id int, x string, content string")) == "content"
    with pytest.raises(ValueError):
        T.text_column(spark.range(1))


def test_files_of_composed_skills_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "FILE_SKILLS", 3)
    c = spark.range(20, numPartitions=1).select(F.lit(2).alias("k_value"), F.lit("seq").alias("composition_type"), F.concat(F.lit("# s"), "id", F.lit("\n\n")).alias("markdown"))
    T.write_composed(c, str(tmp_path / "out"))
    files = [f.read_text().count(T.SKILL_BREAK) for f in (tmp_path / "out").rglob("*.txt")]
    assert sum(files) == 20 and max(files) <= 3
    assert sorted(r.content for r in T.read_skill_tree(spark, str(tmp_path / "out")).collect()) == sorted(f"# s{i}\n\n" for i in range(20))


def test_sinks(spark, tmp_path):
    c = C.with_markdown(C.compose_all(registry(spark)))
    assert T.write_composed(c, str(tmp_path / "out"), k_values=[2], operators=["par"]).first().n == 2
    assert (tmp_path / "out/k_value=2/composition_type=par").exists()
    df = spark.createDataFrame([('a "q"\n', 1)], "s string, i int")
    T.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "csv")).first().s == 'a "q"\n'
    T.write_jsonl(df, str(tmp_path / "json"))
    assert T.read_json_array(spark, str(tmp_path / "json"), df.schema).count() == 1


def test_calls(spark):
    df = spark.createDataFrame([("s", "a b\nc"), ("", "boom")], "system_prompt string, user_prompt string")

    def client():
        def chat(messages):
            if messages[-1]["content"] == "boom":
                raise RuntimeError("down")
            return {"message": {"content": "ok"}, "usage": {"prompt_tokens": 3, "completion_tokens": 1}}

        return chat

    rows = {r.user_prompt: (r.reply, r.prompt_tokens, r.error) for r in call_model(df, client, 2).collect()}
    assert rows == {"a b\nc": ("ok", 3, None), "boom": ("", 0, "RuntimeError: down")}


def test_episodes(spark):
    t = spark.createDataFrame([("t", "m", "curated", mode, "s", "p", "c", proc) for mode, proc in (("stepwise", []), ("guided", ["one", "two"]), ("guided", []), ("singlecall", []))], "task_uid string, model string, condition string, mode string, system_prompt string, passage string, challenge string, procedure array<string>")
    assert sorted((r.mode, len(r.replies)) for r in run_episodes(t, concurrency=2).collect()) == [("guided", 1), ("guided", 3), ("singlecall", 1), ("stepwise", 8)]


class Killed(BaseException):
    """What ends a task, and not only a call."""


def logging_client(log, dies_at=None):
    """A client that writes down what it is asked and dies when so much has been; a prompt with ``bad`` fails each time."""

    def client():
        def chat(messages):
            with open(log, "a+") as f:
                f.seek(0)
                if dies_at is not None and sum(1 for _ in f) >= dies_at:
                    raise Killed
                f.write(json.dumps(messages) + "\n")
            if "bad" in messages[-1]["content"]:
                raise RuntimeError("refused")
            return {"message": {"content": "re: " + messages[-1]["content"][-20:]}, "usage": {"prompt_tokens": 1, "completion_tokens": 2}}

        return chat

    return client


def lines_of(log):
    return log.read_text().splitlines()


def test_nothing_is_asked_twice(spark, tmp_path):
    log, store = tmp_path / "log", str(tmp_path / "store")
    df = spark.createDataFrame([("s", f"question {i % 40}") for i in range(60)] + [(None, "bad one")], "system_prompt string, user_prompt string")
    with pytest.raises(Exception, match="Killed"):
        call_model(df, logging_client(log, 15), 3, store)
    half = lines_of(log)
    assert len(half) == len(set(half)) and 15 <= len(half) < 41
    rows = call_model(df, logging_client(log), 2, store).collect()  # other tasks than before
    again = lines_of(log)
    assert len(set(again)) == 41 and len([x for x in again if "bad" not in x]) == 40
    assert len(rows) == 61 and all(r.reply == "re: " + r.user_prompt[-20:] and r.completion_tokens == 2 and r.error is None for r in rows if r.user_prompt != "bad one")
    assert [r.error for r in rows if r.user_prompt == "bad one"] == ["RuntimeError: refused"]
    call_model(df, logging_client(log), 2, store).collect()
    assert [x for x in lines_of(log)[len(again):] if "bad" not in x] == []  # a failed call is made again, no other


def test_cut_off_episodes_go_on(spark, tmp_path):
    log, store = tmp_path / "log", str(tmp_path / "store")
    trials = spark.createDataFrame([(f"t{i}", "m", "curated", "guided", "s", "p", "c", ["one", "two", "three"], k) for i in range(4) for k in range(2)], "task_uid string, model string, condition string, mode string, system_prompt string, passage string, challenge string, procedure array<string>, repetition int")
    with pytest.raises(Exception, match="Killed"):
        run_episodes(trials, logging_client(log, 13), concurrency=2, store=store)
    rows = run_episodes(trials, logging_client(log), concurrency=3, store=store).collect()
    assert len(rows) == 8 and {len(r.replies) for r in rows} == {4} and {r.tokens for r in rows} == {12}
    assert len(lines_of(log)) == 8 * 4  # each turn of each repetition once, over both runs


def test_fast_replies_share_files_and_slow_ones_are_written(tmp_path, monkeypatch):
    def files(name, seconds):
        monkeypatch.setattr(replies, "FLUSH_SECONDS", seconds)
        with replies.Buckets(str(tmp_path / name), 2) as buckets:
            for i in range(50):
                buckets.at("0").ask(str(i), lambda: ("r", 1, 1, None))
        assert len(replies.Replies(str(tmp_path / name), "0").known) == 50
        return len(list((tmp_path / name).rglob("*.parquet")))

    assert files("fast", 60.0) == 1 and files("slow", 0.0) == 25
    assert (_tasks(3, 8), _tasks(50_000, 8), _tasks(10**9, 8)) == (8, 100, 4096)


def record(i, ok, at=None):
    return {"problem_id": f"p{i}", "provider": "x", "model": "m", "condition": "baseline", "skill_name": None, "k_value": 0, "repetition": 0, "pass": ok, "score": 0.5, "tokens": 2}


def summary(df):
    r = df.first()
    return r.n_trials, pytest.approx(r.pass_rate), r.mean_score, r.tokens


def test_progress_table_resumes(spark, tmp_path, monkeypatch):
    log, table, at = tmp_path / "log", str(tmp_path / "table"), str(tmp_path / "ck")
    log.mkdir()
    write = lambda name, *rows: (log / name).write_text("".join(json.dumps(record(*r)) + "\n" for r in rows))
    run = lambda: progress.run_to_table(progress.read_progress(spark, str(log), 1), table, at)
    write("1.jsonl", (1, True), (2, False), (1, True))
    run()
    for n, rows in (("2.jsonl", [(1, True), (3, True)]), ("3.jsonl", [(2, False), (3, True), (4, False)])):
        write(n, *rows)
    calls, known = [], progress.read_table

    def dies(session, path, before=None):
        calls.append(before)
        if len(calls) == 2:  # in the second batch of this run, after the first was committed
            raise RuntimeError("killed")
        return known(session, path, before)

    monkeypatch.setattr(progress, "read_table", dies)
    with pytest.raises(Exception, match="killed"):
        run()
    monkeypatch.undo()
    assert sorted(r.problem_id for r in progress.read_table(spark, table).collect()) == ["p1", "p2", "p3"]
    (tmp_path / "table" / "batch_id=2").mkdir()  # what a batch that died while writing leaves
    (tmp_path / "table" / "batch_id=2" / "part-0.parquet").write_text("cut off")
    assert sorted(progress.committed_batches(spark, table)) == [0, 1]
    run()
    run()  # nothing new
    batch = progress.progress_summary(spark.read.schema(progress.RECORD).json(str(log)).withColumnRenamed("pass", "passed"))
    assert summary(progress.summary_of_trials(progress.read_table(spark, table))) == summary(batch) == (4, 0.5, 0.5, 8)
    assert progress.read_table(spark, str(tmp_path / "none")) is None


def test_progress_with_a_time_column(spark, tmp_path):
    log, table, at = tmp_path / "log", str(tmp_path / "table"), str(tmp_path / "ck")
    log.mkdir()
    for n, rows in enumerate([[(1, 10), (2, 11)], [(1, 12), (3, 13)], [(2, 14), (4, 15)]]):
        (log / f"{n}.jsonl").write_text("".join(json.dumps(record(i, True) | {"at": f"2025-01-01T{hour}:00:00Z"}) + "\n" for i, hour in rows))
        stream = spark.readStream.schema(StructType([*progress.RECORD.fields, StructField("at", TimestampType())])).json(str(log)).withColumnRenamed("pass", "passed")
        progress.run_to_table(stream, table, at, "at", "6 hours")
    rows = progress.read_table(spark, table)
    assert sorted(r.problem_id for r in rows.collect()) == ["p1", "p2", "p3", "p4"]


def test_numbers_within_hot_keys(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), rng.choice([None, *range(40)]), i) for i in range(500)]
    out = numbering.numbered(spark.createDataFrame(rows, "k string, o long, i long").repartition(7), ["k"], ["o", "i"], "n").collect()
    by = {}
    for k, o, i in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        by.setdefault(k, []).append(i)
    assert {(r.k, r.i): r.n for r in out} == {(k, i): n for k, ids in by.items() for n, i in enumerate(ids, 1)} and len(out) == 500
