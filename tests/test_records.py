import json

import pytest
from pyspark.sql import functions as F

from lathe.functions.skill_markdown import parse_markdown, parse_registry_skill, render_skill, render_task
from lathe.operators import records as R
from lathe.operators import scoring as E
from lathe.operators.passages import budget, chunks, dataset_chunks, passages, validate_documents


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "c string").select(column(F.col("c"))).first()[0]


def lengths(spark, size):
    text = "\n\n".join("x" * n for n in (300, 300, 5000, 100))
    return [len(c) for c in one(spark, lambda c: chunks(c, size), text)]


def test_chunks(spark):
    assert lengths(spark, 604) == [602, 5000]
    assert lengths(spark, 603) == [300, 300, 5000]
    assert one(spark, lambda c: chunks(c, 600), "") == []


def test_passages_number_after_the_filter(spark):
    text = "\n\n".join(["y" * 100, "x" * 300, "z" * 300])
    rows = passages(spark.createDataFrame([("a.txt", text)], "source_artifact string, text string"), 350).orderBy("chunk_index").collect()
    assert [(r.chunk_index, r.total_chunks, r.text[0]) for r in rows] == [(0, 2, "x"), (1, 2, "z")]


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_budget(spark, parts):
    rows = spark.createDataFrame([(1, "x" * 10), (2, "  "), (3, "y" * 25), (4, "z" * 5)], "ord long, text string").repartition(parts)
    assert sorted(r.ord for r in budget(rows, 30).collect()) == [1, 3]


def test_dataset_chunks_join_rows(spark):
    rows = spark.createDataFrame([("s", 1, "a" * 150), ("s", 2, "b" * 150 + "\n\n" + "c" * 400), ("s", 3, " "), ("s", 4, "d" * 50)], "source string, ord long, text string")
    out = dataset_chunks(rows, 320).orderBy("chunk_index").collect()
    assert [(r.chunk_index, r.total_chunks, len(r.text)) for r in out] == [(0, 2, 302), (1, 2, 400)]
    assert dataset_chunks(rows, 320, max_chunks=1).count() == 1


def test_document_validation(spark):
    good = ("file", "n", "x" * 200, 0, 1)
    rows = [good, ("web", *good[1:]), ("file", " ", *good[2:]), (*good[:2], "x" * 199 + "  ", 0, 1), (*good[:2], "x" * 100_001, 0, 1), (*good[:3], -1, 1), (*good[:3], 0, 0), (*good[:3], 2, 2), (*good[:2], None, 0, 1)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, source_type string, source_name string, text string, chunk_index int, total_chunks int")
    assert [r.reject_reason for r in validate_documents(df).orderBy("i").collect()] == [None, "source_type", "source_name", "text_short", "text_long", "chunk_index", "total_chunks", "chunk_index", "text_missing"]


def trace(spark, text):
    return one(spark, R.parse_trace, text)


def test_traces(spark):
    r = trace(spark, 'x {"steps":[{"primitive":"OBSERVE","action":"a"},{"primitive":"ponder","action":"b"},"c",{"action":""}],"conclusion":" d "} y')
    assert r.procedural_steps == ["OBSERVE: a", "b", "c"] and r.conclusion == "d"
    assert trace(spark, "one\nAnswer: x\ntwo").conclusion == "x"
    r = trace(spark, "one\ntwo")
    assert (r.procedural_steps, r.conclusion) == (["one"], "two")
    assert trace(spark, '{"steps":[],"conclusion":"z"}').conclusion == '{"steps":[],"conclusion":"z"}'
    assert trace(spark, "<think>t</think>only").thinking == "t"
    assert len(trace(spark, "\n".join(map(str, range(20)))).procedural_steps) == 10


def test_raw_steps(spark):
    assert [tuple(x) for x in one(spark, R.raw_steps, '{"steps":[{"primitive":" Select ","action":" a "},"b"]}')] == [("select", "a")]


@pytest.mark.parametrize("text, step", [
    ("CONCLUDE: a\nb", "CONCLUDE: a\nb"), ("x\n observe: y\nz", "observe: y"), ("short\nmore", "short"), ("l" * 300, ""), ("", ""),
])
def test_steps(spark, text, step):
    assert one(spark, R.parse_step, text) == step


def test_tasks(spark):
    reply = json.dumps([{"title": "T", "challenge": "q", "question": "no", "passage": "p", "query_type": "ranking", "acceptance_criteria": {"correct_conclusion": "A", "must_identify": ["m"]}}, {"question": "q2", "output": "o"}])
    df = spark.createDataFrame([("```json\n" + reply + "\n```",), ('{"title":"single"}',), ("broken",), ("",)], "reply string").selectExpr("reply", "'law' as domain", "'f.txt' as source_artifact", "'claude-a:b' as model")
    rows = R.parse_tasks(df).collect()
    assert [(r.title, r.question, r.input, r.output, r.query_type) for r in rows] == [("T", "q", "p", "A", "RANKING"), ("Untitled task 1", "q2", "", "o", "FREE_FORM"), ("single", "", "", "", "FREE_FORM")]
    assert rows[0].extraction_method == "a-b-task-extraction-v1" and rows[0].acceptance_criteria.must_identify == ["m"]


def test_skills(spark):
    df = spark.createDataFrame([('[{"name":"extract-parallel-claims","source_task_ids":["82ea-9d89-c843-4163"]},{}]', "m")], "reply string, model string")
    rows = R.parse_skills(df).collect()
    assert rows[0].skill_uid == "d7be-47bf-73d7-e2f6" and rows[1].name == "unnamed-skill" and rows[1].procedure == []


def test_canonical_names_keep_empty_strings(spark):
    df = spark.createDataFrame([("", "b", None)], "question string, challenge string, task_id string")
    r = R.canonical(df, R.TASK_ALIASES, {"difficulty": "intermediate", "tags": []}).first()
    assert r.question == "" and r.task_uid is None and r.difficulty == "intermediate" and r.tags == []


def test_schema_errors(spark):
    assert one(spark, lambda c: R.schema_errors(c, "skill"), '{"skill_id":"a","name":1}') == ["skill.name: expected string, got bigint", "skill missing required field 'procedure'"]
    assert one(spark, lambda c: R.schema_errors(c, "trace"), "nope") == ["trace is not a JSON object"]


def test_single_answers(spark):
    df = spark.createDataFrame([("a OR b", "FREE_FORM"), ("a", "FREE_FORM"), (" ", "FREE_FORM"), ("a / b", "YES_NO")], "o string, k string")
    assert [r[0] is not None for r in df.select(R.several_answers(F.col("o"), F.col("k"))).collect()] == [True, False, True, False]


def test_completeness(spark):
    df = spark.createDataFrame([("t", "q", "i", " ", "FREE_FORM")], "task_uid string, question string, input string, output string, query_type string")
    assert df.select(R.incomplete_task()).first()[0] == "output"


def test_messages(spark):
    df = spark.createDataFrame([(1, 0, "system", ""), (1, 1, "system", "s"), (1, 2, "user", "u"), (1, 3, "assistant", "a"), (1, 4, "assistant", "b"), (2, 0, "user", None)], "conv_id long, turn long, role string, text string")
    rows = {r.conv_id: tuple(r)[1:] for r in R.key_messages(df).collect()}
    assert rows == {1: ("s", "u", "b"), 2: ("", "", "")}


def test_prompt_cuts(spark):
    df = spark.createDataFrame([("g", 1, "t", "c" * 600, ["s" * 400], "d" * 400)], "g string, ord long, task_uid string, user_prompt string, procedural_steps array<string>, conclusion string")
    p = R.skill_prompts(df, "g", "Traces:\n{traces}!").first().prompt
    assert p == "Traces:\n### Trace 1 (Task: t)\nChallenge: " + "c" * 500 + "\nProcedural actions taken:\n  1. " + "s" * 300 + "\nConclusion reached: " + "d" * 300 + "\n!"


@pytest.mark.parametrize("kind, expected, reply, passed", [
    ("SINGLE_WORD", "paris", "Paris, of course", False), ("SINGLE_WORD", "paris", "Paris.", True), ("YES_NO", "yes", "Yes.", True), ("YES_NO", "yes", "yes it is", False),
    ("YES_NO_VERIFICATION", "incorrect", "To address the student's claim, it is", False), ("RANKING", "A", "a\nbecause", True), ("FREE_FORM", "x", "x", False),
])
def test_scoring(spark, kind, expected, reply, passed):
    df = spark.createDataFrame([(reply, expected, kind, True)], "reply string, expected string, query_type string, has_criteria boolean")
    assert E.score(df).first().passed is passed


def test_no_criteria_passes(spark):
    df = spark.createDataFrame([("", None, "YES_NO", False)], "reply string, expected string, query_type string, has_criteria boolean")
    assert E.score(df).first().score == 1.0


def test_verdicts(spark):
    v = one(spark, E.judge_verdict, '```\n{"passed": false, "score": 0.9}\n```')
    assert (v.passed, v.score, v.rationale) == (False, 0.9, "")
    v = one(spark, E.judge_verdict, "no json")
    assert (v.passed, v.score, v.rationale) == (False, 0.0, "Failed to parse judge response: no json")


def test_skill_markdown_round_trip(spark):
    df = spark.createDataFrame([("u", "n", 'says "hi"', "when", ["a", "b"], ["c"], ["t1", "t2"])], "u string, n string, d string, w string, p array<string>, c array<string>, t array<string>")
    back = df.select(parse_markdown(render_skill(*map(F.col, "undwpct")), "skill").alias("b")).select("b.*").first()
    assert tuple(back) == ("u", "n", 'says "hi"', "when", ["a", "b"], ["c"], ["t1", "t2"])
    df = spark.createDataFrame([("u", "t", "d", "easy", "p\nq", "c?", "o")], "a string, b string, c string, d string, e string, f string, g string")
    assert tuple(df.select(parse_markdown(render_task(*map(F.col, "abcdefg")), "task").alias("b")).select("b.*").first()) == ("u", "t", "d", "easy", "p\nq", "c?", "o")


def test_registry_skill(spark):
    md = "---\nname: pick\ndescription: Picks. Use when asked.\n---\n\n# Pick\n\n## When to Use\n\n- one\n- two\n\n## Procedure\n\n1. Read\n2. Pick\n\n## Constraints\n\n- never\n\n### Example 1: First\n\n**Input:**\nin\n\n**Process:**\npr\n\n**Output:**\nout\n\n## Related Skills\n\n- other: why\n"
    r = one(spark, parse_registry_skill, md)
    assert (r.name, r.when_to_use, r.procedure, r.constraints, r.related_skills, r.error) == ("pick", ["one", "two"], ["Read", "Pick"], ["never"], ["other"], None)
    assert tuple(r.examples[0]) == ("First", "in", "pr", "out")
    assert one(spark, parse_registry_skill, "text").error == "no front matter"
