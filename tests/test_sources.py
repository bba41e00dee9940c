import json
import re

from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from lathe.sources import tables as T

SCHEMA = StructType([StructField("id", LongType()), StructField("text", StringType()), StructField("score", DoubleType()), StructField("tags", ArrayType(StringType())), StructField("o'k", StringType())])
BAD = {
    b'{"id": 4, "text": "cut of': "no JSON",
    b'{"id": "five", "text": "x", "score": 0.5}': "wrong type: id",
    b'{"id": 6, "text": "x", "score": "high", "tags": "one"}': "wrong type: score, tags",
    b'[{"id": 7}]': "no object",
    b'"8"': "no object",
    b'{"text": "no id"}': "missing: id",
    b'{"id": null, "text": null}': "missing: id, text",
    b'{"id": 9, "text": "\xff\xfe"}': "not UTF-8",
}
GOOD = [b'{"id": 1, "text": "a \\u00e9", "score": 1, "tags": ["x"], "o\'k": "z"}', b'{"id": 2, "text": "", "other": {"b": 1}, "score": null}', b' {"id": 3, "text": "c"} ']


def test_bad_lines_are_kept_with_file_line_and_reason(spark, tmp_path):
    lines, want = [], []
    for n, (line, reason) in enumerate(BAD.items()):
        lines += [GOOD[n % 3], b"", b" \t"] * n + [line]
        want.append((len(lines), reason))
    (tmp_path / "a.jsonl").write_bytes(b"\n".join(lines))
    (tmp_path / "b.jsonl").write_bytes(b"\n".join(GOOD) + b"\n")
    for size in ("128m", "100b"):  # whole files, and many splits of each
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            good, bad = T.check_jsonl(spark, str(tmp_path), SCHEMA, ["id", "text"])
            assert sorted((r.line, r.reason) for r in bad.collect()) == want and {r.file_path.rsplit("/", 1)[1] for r in bad.collect()} == {"a.jsonl"}
            assert good.count() == lines.count(GOOD[0]) + lines.count(GOOD[1]) + lines.count(GOOD[2]) + 3
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    row = good.where("id = 1").first()
    assert (row.text, row.score, row.tags, row["o'k"]) == ("a é", 1.0, ["x"], "z")
    assert T.read_jsonl(spark, str(tmp_path), SCHEMA).count() == good.count() + 2  # nothing is required


def test_bad_elements_and_files_of_arrays(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": 1, "text": "a"}, {"id": "x", "text": "b"}, 3, {"id": 4, "text": "d\né", "tags": ["t"]}], indent=1))
    (tmp_path / "b.json").write_text('[{"id": 5, "text": "cut of')
    (tmp_path / "c.json").write_text('{"id": 6}')
    (tmp_path / "d.json").write_text("[]")
    (tmp_path / "e.json").write_text('"text"')
    (tmp_path / "f.json").write_text('{"id": 7, "text": "f"}\n')
    good, bad = T.check_json_array(spark, str(tmp_path), SCHEMA, ["text"])
    assert sorted((r.id, r.text) for r in good.collect()) == [(1, "a"), (4, "d\né"), (7, "f")]
    assert sorted((r.file_path[-6:], -1 if r.position is None else r.position, r.reason) for r in bad.collect()) == [("a.json", 1, "wrong type: id"), ("a.json", 2, "no object"), ("b.json", -1, "no JSON"), ("c.json", 0, "missing: text"), ("e.json", -1, "no array")]


def test_no_bad_rows(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1}\n')
    good, bad = T.check_jsonl(spark, str(tmp_path), SCHEMA)
    assert good.count() == 1 and bad.count() == 0


def parses(df):
    """How often a plan's expressions parse JSON."""
    return len(re.findall(r"(?i)jsontostructsevaluator|from_json|parse_json|parsejson", df._jdf.queryExecution().optimizedPlan().toString()))


def test_a_line_is_parsed_once(spark, tmp_path):
    (tmp_path / "a.jsonl").write_bytes(b"\n".join([*GOOD, *BAD]))
    good, bad = T.check_jsonl(spark, str(tmp_path), SCHEMA, ["id", "text"])
    assert 1 <= parses(good) <= 2 and parses(bad) <= 4  # a name may stand twice in the text of a call


def test_an_array_is_parsed_once_a_branch(spark, tmp_path):
    (tmp_path / "a.json").write_text(' \n[{"id": 1}, null]')
    (tmp_path / "b.json").write_text('\t{"id": 2} ')
    good, bad = T.check_json_array(spark, str(tmp_path), SCHEMA, ["id"])
    assert sorted(r.id for r in good.collect()) == [1, 2]
    assert sorted((r.file_path[-6:], r.reason) for r in bad.collect()) == [("a.json", "no object")]
    assert 1 <= parses(good) <= 3 and parses(bad) <= 5  # of the text, of an object as an array, of each row; and of the rows not taken


def test_bad_lines_are_never_broadcast(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "x", "text": "cut of\n' * 8000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "40k")  # under the 220 kB of the file, over what Spark takes its bad lines for
    try:
        bad = T.check_jsonl(spark, str(tmp_path), SCHEMA, ["id"])[1]
        rows = bad.select("line", "reason")
        assert "BuildLeft" not in rows._jdf.queryExecution().executedPlan().toString()
        assert [r.line for r in rows.where("reason = 'no JSON'").orderBy("line").collect()] == list(range(1, 8001))
        assert "BuildLeft" not in rows._jdf.queryExecution().executedPlan().toString()
        plain = bad.select("value", "reason")
        assert plain.count() == 8000 and "Join" not in plain._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
