import json

import pytest
from pyspark.sql import functions as F

from lathe.operators import compose, fusion
from lathe.operators.proofs import LONG_RULES, RULES, SAME_RULES, is_rule, proof_score, score_proof, score_rule
from lathe.operators.verify import verb_primitives
from tests.test_relations import registry


def client(reply):
    def make():
        return lambda messages: {"message": {"content": reply}, "usage": {}}

    return make


def test_fusion_reads_a_fenced_reply(spark):
    reply = "Sure:\n```json\n" + json.dumps({"name": "sem-x", "procedure": ["a"], "examples": [{"input": "i"}]}) + "\n```"
    r = fusion.fuse(compose.windows(registry(spark), [3]), client(reply), concurrency=1).first()
    assert (r.name, r.description, r.procedure, r.related_skills, r.k_value) == ("sem-x", "", ["a"], ["r0", "r1", "r2"], 3)
    assert tuple(r.examples[0]) == ("Example", "i", "", "")


def test_fusion_falls_back(spark):
    r = fusion.fuse(compose.windows(registry(spark), [2]), client("{broken"), concurrency=1).where("start = 1").first()
    assert (r.name, r.description, r.related_skills, r.examples) == ("sem-skill-0-skill-1", "Semantic fusion of 2 skills", [], [])


@pytest.mark.parametrize("name, valid", [("Modus Ponens", True), ("∧I", None), ("conj intro", True), ("bogus", False), ("line 3", None), ("p0", None), ("rule of conjunction introduction", True), ("assumption reuse", True)])
def test_rule_names(name, valid):
    assert is_rule(name) is valid


def test_proofs(spark):
    good = "1. P [premise]\n2. P⇒Q [premise]\n3. Q [modus ponens, 1, 2]\nTherefore Q"
    r = score_proof(good, "Q")
    assert r["passed"] and r["score"] == 1.0 and r["valid_rules"] == 3
    r = score_proof("1. P∨¬P [excluded middle]\n2. Q [modus ponens, 1]", "( Z )")
    assert not r["passed"] and r["classical"] == 1 and not r["conclusion_reached"] and r["score"] == 0.0
    assert score_proof("1. A [assumption]\ndischarge h1 then use h1", "A")["scope_violations"] == 1
    assert score_proof("", "A")["valid_rules"] == 0
    df = spark.createDataFrame([(good, "Q"), (None, "Q")], "t string, g string").select(proof_score(F.col("t"), F.col("g")).passed)
    assert [r[0] for r in df.collect()] == [True, False]


def test_tables_hold_their_fixed_values():
    assert len(set(RULES)) == 118 and len(LONG_RULES) == 69 and len(set(RULES) | LONG_RULES) == 182 and len(SAME_RULES) == 10
    assert {"mp", "↔i", "¬¬i", "modus tollens", "right-simplification"} <= set(RULES) and {"and introduction", "rule of negation elimination", "assumption reuse"} <= LONG_RULES
    assert len(verb_primitives()) == 183 and verb_primitives()["produce"] == "enumerate" and verb_primitives()["produces"] == "apply" and verb_primitives()["collect"] == "observe"


@pytest.mark.parametrize("name", ["and i", "and-e", "arrow intro", "negation introduction of p", "introduce", "conjunct elim"])
def test_unlisted_spellings_do_not_count(name):
    assert is_rule(name) is False


@pytest.mark.parametrize("target, answer", [("⊥e", "explosion"), ("⊥e", "ex-falso"), ("⊥E", "EFQ"), ("¬i", "refutation"), ("⇒i", "deduction-theorem"), ("⇒e", "mp"), ("mp", "modus ponens"), ("∨e", "i use ∨e here")])
def test_rule_selection_aliases(target, answer):
    assert score_rule(answer, target)["passed"] and not score_rule("bogus", target)["passed"]


@pytest.mark.parametrize("text, target, found", [("p QED", "P", True), ("so ( a → b )", "(a⇒b)", True), ("we have: Q", "q", True), ("we have maybe Q", "q", False), ("thus we say q", "Q", True), ("", "Q", False)])
def test_conclusions(text, target, found):
    assert score_proof(text, target)["conclusion_reached"] is found


def test_rule_selection():
    assert score_rule(" conj-elim ", "∧e")["passed"] and score_rule("use mp here", "mp")["passed"] and not score_rule("or-elim", "∧e")["passed"]
