import random

import pytest
from pyspark.sql import functions as F

from lathe.functions import text as T
from lathe.functions.cleanup import Cleanup, blocks, clean, clean_json, clean_payload, clean_xml, close_letters, join_hyphens, markdown_blocks
from lathe.functions.skills import inferred_sources, skill_k, skill_label, skill_operator
from lathe.operators.compose import title_case
from lathe.operators.passages import dataset_chunks


def one(spark, column, value=""):
    return spark.createDataFrame([(value,)], "c string").select(column(F.col("c"))).first()[0]


@pytest.mark.parametrize("text, expected", [
    ("C o m p r e h e n s i o n", "Comprehension"), ("D e e p  L e a r n", "Deep Learn"), ("a b c", "a b c"), ("a b c d  e f g", "abcd e f g"), ("", ""),
])
def test_lettertracks(text, expected):
    assert close_letters(text) == expected


@pytest.mark.parametrize("text, expected", [
    ("compre-\nhension", "comprehension"), ("some-thing-x", "something-x"), ("ab-cd-ef", "ab-cdef"), ("self-made", "self-made"),
    ("Mac-Book", "Mac-Book"), ("state-of-the-art", "state-ofthe-art"), ("a-bc", "a-bc"),
])
def test_hyphens(text, expected):
    assert join_hyphens(text) == expected


def test_hyphens_with_dictionary():
    assert join_hyphens("some-thing odd-ity", frozenset({"something"})) == "something odd-ity"


@pytest.mark.parametrize("seed, uid", [
    ("document|dataset:wikimedia/wikipedia/20231101.en", "b65b-d987-158e-b213"),
    ("language-skills|First Self-Described Anarchist|0", "82ea-9d89-c843-4163"),
    ("82ea-9d89-c843-4163|extract-parallel-claims", "d7be-47bf-73d7-e2f6"),
    ("82ea-9d89-c843-4163|identify-factual-contradiction", "740d-3be6-71ad-f0dd"),
    ("82ea-9d89-c843-4163|render-contradiction-verdict", "db9a-92fd-1fef-c110"),
])
def test_golden_ids(spark, seed, uid):
    assert one(spark, T.uid, seed) == uid


def test_id_builders(spark):
    row = spark.range(1).select(
        T.document_uid(F.lit("dataset:wikimedia/wikipedia/20231101.en")), T.task_uid(F.lit("language-skills"), F.lit("First Self-Described Anarchist"), F.lit(0)),
        T.skill_uid(F.array(F.lit("82ea-9d89-c843-4163")), F.lit("extract-parallel-claims")),
    ).first()
    assert tuple(row) == ("b65b-d987-158e-b213", "82ea-9d89-c843-4163", "d7be-47bf-73d7-e2f6")


def test_thinking(spark):
    assert one(spark, T.thinking, "a<think> b </think> c") == "b" and one(spark, T.without_thinking, "a<think> b </think> c") == "a c"
    assert one(spark, T.thinking, "  x ") == "" and one(spark, T.without_thinking, "  x ") == "  x "
    assert one(spark, T.without_thinking, "<think>a\nb</think>x<think>c</think>") == "x<think>c</think>"


@pytest.mark.parametrize("name, op, k", [
    ("", "baseline", 0), ("pick-claim", "atomic", 1), ("seq-a-then-b", "seq", 2), ("par-a-and-b-and-c", "par", 3), ("cond-a-then-b-and-c", "cond", 3), ("par-compare-and-contrast-and-b", "par", 3),
])
def test_skill_names(spark, name, op, k):
    assert one(spark, skill_operator, name) == op and one(spark, skill_k, name) == k


def test_labels_and_sources(spark):
    assert one(spark, skill_label, "seq-a-then-b") == "[seq k=2] a-then-b"
    assert one(spark, inferred_sources, "seq-a-then-b-and-c") == ["a", "b-and-c"]
    assert one(spark, inferred_sources, "par-a-and-b") == ["a", "b"]


@pytest.mark.parametrize("text, expected", [("a  \nb\n\n\n\nc \n", "a\nb\n\nc"), (" x ", "x"), ("", "")])
def test_whitespace(spark, text, expected):
    assert one(spark, T.normalize_whitespace, text) == expected


def test_fences(spark):
    assert one(spark, T.strip_fences, "```json\n{}\n```") == "{}"
    assert one(spark, T.strip_fences, "```\na\nb") == "a\nb"
    assert one(spark, T.strip_fences, " x ") == "x"


def test_message_content(spark):
    assert one(spark, T.message_text, '[{"type":"text","text":"a"},{"type":"image"},{"type":"text","text":"b"}]') == "ab"
    assert one(spark, T.message_text, '"plain"') == "plain" and one(spark, T.message_text, "plain") == "plain"
    assert one(spark, lambda c: T.message_text(c, "\n", True), '["x",{"type":"text","text":"b"}]') == "x\nb"


def test_markdown(spark):
    assert one(spark, T.markdown_to_text, "# H\n**b** _i_ [t](u) `c`\n---\n\n\n\nx") == "H\nb i t c\n\nx"
    kinds = [(b["block_type"], b["level"], b["text"]) for b in markdown_blocks("# T\n\npara\nmore\n- a\n  - b\n1. n\n---\n> q\n> r\n```py\nx\n```\n![alt](u)")]
    assert kinds == [
        ("heading", 1, "T"), ("paragraph", None, "para\nmore"), ("list_item", 1, "a"), ("list_item", 2, "b"), ("ordered_list_item", 1, "n"),
        ("horizontal_rule", None, ""), ("blockquote", None, "q\nr"), ("code", None, "x"), ("image", None, "alt"),
    ]
    assert one(spark, lambda c: F.size(blocks(c)), "a\n\nb") == 2


def test_payloads(spark):
    assert clean_json('{"pages":[{"blocks":[{"lines":[{"spans":[{"text":"w o r d"}]}]}]}]}') == '{"pages": [{"blocks": [{"lines": [{"spans": [{"text": "word"}]}]}]}]}'
    assert clean_json('{"a":[{"text":"ab-cd"}]}') == '{"a": [{"text": "abcd"}]}'
    assert clean_xml("<r><span>ab-cd</span><x>ef-gh</x></r>") == "<r><span>abcd</span><x>ef-gh</x></r>"
    row = spark.createDataFrame([("json", "{broken"), ("txt", "ab-cd"), ("xml", None)], "k string, c string").select(clean_payload(F.col("k"), F.col("c"))).collect()
    assert [r[0] for r in row] == ["{broken", "abcd", None]


def test_cleanup_switches(spark):
    assert one(spark, lambda c: clean(c, Cleanup(is_markdown=True)), "a b c d endNow ****x") == "abcd end Now  x"
    assert one(spark, lambda c: clean(c, Cleanup(False, False, False, False, False)), " a b c d ") == " a b c d "


@pytest.mark.parametrize("name, title", [("pick-claim", "Pick Claim"), ("a1b-c", "A1B C"), ("it's-X", "It'S X")])
def test_title_case(spark, name, title):
    assert one(spark, title_case, name) == title == name.replace("-", " ").title()


def folded(docs, size, most=None):
    """P2 by a loop over the paragraphs of each source."""
    out = {}
    for source in {s for s, _, _ in docs}:
        chunks, parts, n = [], [], 0
        for _, _, text in sorted((d for d in docs if d[0] == source), key=lambda d: d[1]):
            for p in filter(None, (x.strip() for x in (text or "").split("\n\n"))):
                if n and n + len(p) + 2 > size:
                    chunks.append("\n\n".join(parts))
                    parts, n = [], 0
                parts.append(p)
                n += len(p) + 2
        chunks = [c for c in [*chunks, "\n\n".join(parts)] if len(c) >= 200][:most]
        out |= {(source, i): (len(chunks), c) for i, c in enumerate(chunks)}
    return out


@pytest.mark.parametrize("size, most", [(300, None), (700, None), (2500, None), (100, None), (700, 3)])
def test_dataset_chunks_over_runs(spark, size, most):
    rng = random.Random(size)
    text = lambda: rng.choice([None, "", *["\n\n".join("x" * rng.choice([0, 1, 5, 40, 150, 250, 900]) for _ in range(rng.randint(0, 9))) for _ in range(8)]])
    docs = [(rng.choice("aaaabc"), i, text()) for i in range(150)] + [("short", 500, "y"), ("long", 501, "z" * 5000)]
    rows = dataset_chunks(spark.createDataFrame(docs, "source string, ord long, text string").repartition(5), size, max_chunks=most).collect()
    assert {(r.source, r.chunk_index): (r.total_chunks, r.text) for r in rows} == folded(docs, size, most)


@pytest.mark.parametrize("kind, payload, cleaned", [
    ("json", '{"pages": [{"blocks": [{"text": "a b c d", "lines": [{"spans": [{"text": "w o r d un-\\nder"}]}]}]}], "text": "w o r d"}', '{"pages": [{"blocks": [{"text": "a b c d", "lines": [{"spans": [{"text": "word under"}]}]}]}], "text": "w o r d"}'),
    ("json", '{"blocks": [{"text": "w o r d"}, {"n": 1}], "text": "w o r d"}', '{"blocks": [{"text": "word"}, {"n": 1}], "text": "w o r d"}'),
    ("json", '[{"a": {"text": "co-operate well-known"}}, {"text": ["w o r d"]}]', '[{"a": {"text": "co-operate well-known"}}, {"text": ["w o r d"]}]'),
    ("json", '{"a": [{"text": "é w o r d"}]}', '{"a": [{"text": "é word"}]}'),
    ("xml", "<d><span>w o r d</span><text>w o r d</text></d>", "<d><span>word</span><text>w o r d</text></d>"), ("xml", "<d>w o r d</d>", "<d>word</d>"),
    ("json", "{w o r d", "{w o r d"), ("xml", "<d>w o r d", "<d>w o r d"), ("txt", "w o r d", "word"), ("md", None, None),
])
def test_payload_shapes(spark, kind, payload, cleaned):
    df = spark.createDataFrame([(kind, payload)], "k string, p string")
    assert df.select(clean_payload(F.col("k"), F.col("p"))).first()[0] == cleaned


def test_texts_of_a_batch_are_taken_in_slices(spark):
    import pyarrow as pa

    from lathe.functions import cleanup

    kinds, texts = zip(*cleanup._slices(pa.array(["txt"] * 600), pa.array([str(i) for i in range(600)])))
    assert max(map(len, texts)) <= 256 and sum(texts, []) == [str(i) for i in range(600)] and len(sum(kinds, [])) == 600
    df = spark.range(600, numPartitions=1).select("id", F.when(F.col("id") % 7 > 0, F.concat("id", F.lit(" ab-\ncd S k i l l"))).alias("t"))
    out = df.select("id", cleanup.close_lettertracks(F.col("t")).alias("a"), clean_payload(F.lit("txt"), F.col("t")).alias("b")).collect()
    assert all((r.a, r.b) == ((f"{r.id} ab-\ncd Skill", f"{r.id} abcd Skill") if r.id % 7 else (None, None)) for r in out) and len(out) == 600


def test_the_whole_cleanup_is_one_pass_through_python(spark):
    df = spark.createDataFrame([("S k i l l s ab-\ncd",), (None,)], "t string").select(clean(F.col("t")).alias("c"))
    assert [r.c for r in df.collect()] == ["Skills abcd", None]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("each(") == 1


def test_payloads_of_all_shapes_share_one_worker(spark, tmp_path):
    from lathe.plans.io_queries import _payloads

    spark.createDataFrame([(1, "ab-\ncd"), (2, None)], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    df = _payloads(spark, str(tmp_path))
    assert df.columns == ["doc_id", *[f"{n}_sha256" for n in ("pages", "blocks", "nested", "xml", "txt")]] and df.count() == 2
    assert df._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1


def test_blocks_of_odd_texts_are_those_that_were_made(spark, tmp_path):
    from lathe.plans.text_queries import QUERIES

    marks = ["", " ", "\t", "\r", "\xa0", "　 ", "- a", "* ", "1. a", "12.", "# h", "##", "```", "> q", "---", "![a](b)", " ", "x"]
    tables = {"odd": [f"{a}\n{b}\n{a}" for a in marks for b in marks] + marks + [None], "single": ["one line", "- two"], "null": [None, None], "none": []}
    for name, texts in tables.items():
        spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").write.parquet(str(tmp_path / name / "documents.parquet"))
        held = [t.split("\n")[1:] for t in texts if t is not None]
        items = sum(line.strip(" \xa0　") != "" for lines in held for line in lines) if held else None
        want = {kind: len(held) for kind in ("heading", "code", "blockquote", "paragraph")} | {"list_item": items}
        assert {r.block_type: r.n for r in QUERIES["t10_markdown_blocks"](spark, str(tmp_path / name)).collect()} == want, name
