"""Reading and writing tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STRINGS = T.ArrayType(T.StringType())


def _struct(strings: str = "", arrays: str = "", ints: str = "", longs: str = "", doubles: str = "", booleans: str = "") -> T.StructType:
    kinds = ((strings, T.StringType()), (arrays, _STRINGS), (ints, T.IntegerType()), (longs, T.LongType()), (doubles, T.DoubleType()), (booleans, T.BooleanType()))
    return T.StructType([T.StructField(n, t) for names, t in kinds for n in names.split()])


DOCUMENT = _struct("source_type source_name text", ints="chunk_index total_chunks")
PASSAGE = _struct("passage_uid source_document_uid source_artifact text extraction_method", ints="chunk_index total_chunks")
CRITERIA = T.StructType([T.StructField("must_identify", _STRINGS), T.StructField("correct_conclusion", T.StringType())])
TASK = _struct("task_uid title domain source_artifact source_document_uid question input output difficulty query_type extraction_method").add("acceptance_criteria", CRITERIA)
RAW_STEPS = T.ArrayType(_struct("primitive action"))
TRACE = _struct("task_uid model system_prompt user_prompt response conclusion thinking extraction_method", "procedural_steps", longs="tokens prompt_tokens completion_tokens", doubles="elapsed_s").add("raw_steps", RAW_STEPS)
SKILL = _struct("skill_uid name description when_to_use extraction_method", "procedure constraints source_task_uids source_trace_uids")
EPISODE = _struct("task_uid model condition skill_name mode judge_rationale", ints="num_steps", longs="tokens", doubles="score elapsed_s", booleans="passed").add(
    "steps", T.ArrayType(_struct("parsed_action selected_skill", ints="step_index", longs="tokens", doubles="elapsed_s"))
)
RECORD = _struct("problem_id domain model provider condition skill_name composition_type episode_id error", ints="k_value repetition steps", longs="tokens", doubles="score elapsed_s", booleans="pass")

#: Names of a text column, most preferred first.
TEXT_COLUMNS = ("text", "content", "passage", "article", "sentence", "document", "paragraph", "body")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or the checkpoint folder that the application has set.

    Without either a session on one machine gets a temporary folder, and a cluster an error.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder and (sc.master == "local" or sc.master.startswith("local[")):
        folder = tempfile.mkdtemp(prefix="lathe-")
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage by a table in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """Rows of a scan over as many partitions as there are cores, where its files give fewer; else as they are.

    For work row by row on tables of one or a few large files, of which each would be one task.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once a row: Spark would repeat its expression for each use in a filter on it, but filters stay above an outer explode."""
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


def _checked(objects: DataFrame, schema: T.StructType, required: Sequence[str], where: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of JSON texts ``value`` that fit a schema, and the others as (*where, value, reason).

    Reasons, the first that holds: no text (not UTF-8), no JSON, no object, wrong type
    (with the fields), missing (with the required fields that are absent or null).
    """
    raw = T.StructType([*schema.fields, T.StructField("_raw", T.StringType())])
    parsed = _once(objects, "_row", F.from_json("value", raw, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_raw"}))
    names = lambda flags: F.array_join(F.filter(F.array(*flags), lambda x: x.isNotNull()), ", ")
    held = lambda f: F.col("_row").getField(f)
    given, valid = F.col("_row._raw").isNotNull(), F.coalesce(F.is_valid_utf8("value"), F.lit(True))
    fits = valid & ~given
    for f in required:
        fits = fits & held(f).isNotNull()
    fits = F.coalesce(fits, F.lit(False))
    good = parsed.where(fits).select(*[held(f.name).alias(f.name) for f in schema])

    others = _once(parsed.where(~fits), "_given", F.try_parse_json(F.when(given, F.col("value"))))
    found = lambda f: F.try_variant_get("_given", f'$["{f}"]', "variant")
    wrong = [F.when(held(f.name).isNull() & found(f.name).isNotNull() & ~F.is_variant_null(found(f.name)), F.lit(f.name)) for f in schema]
    absent = [F.when(held(f).isNull(), F.lit(f)) for f in required]
    reason = (
        F.when(~valid, "not UTF-8")
        .when(given & F.col("_given").isNull(), "no JSON")
        .when(given & ~F.schema_of_variant("_given").startswith("OBJECT"), "no object")
        .when(given, F.concat(F.lit("wrong type: "), names(wrong)))
        .otherwise(F.concat(F.lit("missing: "), names(absent)))
    )
    return good, others.select(*where, F.make_valid_utf8("value").alias("value"), reason.alias("reason"))


def check_json_array(spark: SparkSession, path: str | list[str], schema: T.StructType, required: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Rows of files that hold one JSON array of objects each, and what is no row: (file_path, position, value, reason).

    ``position`` counts from 0; a single object counts as an array of one; a file that is
    neither is one bad row without a position.
    """
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file_path"), "value")
    files = _once(texts, "_v", F.try_parse_json("value"))
    first = F.substring(F.ltrim("value", F.lit(" \t\r\n")), 1, 1)
    rows = F.when(first == "{", F.try_parse_json(F.concat(F.lit("["), "value", F.lit("]")))).otherwise(F.col("_v"))
    is_array = F.col("_v").isNotNull() & F.coalesce(first.isin("[", "{"), F.lit(False))
    broken = files.where(~is_array).select("file_path", F.lit(None).cast("int").alias("position"), F.make_valid_utf8("value").alias("value"), F.when(F.col("_v").isNull(), "no JSON").otherwise("no array").alias("reason"))
    arrays = files.where(is_array).select("file_path", rows.alias("_v"))
    each = arrays.lateralJoin(spark.tvf.variant_explode(F.col("_v").outer())).select("file_path", F.col("pos").alias("position"), F.to_json("value").alias("value"))
    good, bad = _checked(each, schema, required, ["file_path", "position"])
    return good, bad.unionByName(broken)


def check_jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType, required: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Rows of JSON lines, and the lines that are no row: (file_path, line, value, reason); blank lines are skipped.

    ``line`` counts from 1 in its file, which may be read in many splits: a line's place
    in its split is known from the order of reading, and the lines of earlier splits are
    added. The files are read again to count them, but only if ``line`` is asked for. The
    counts are joined from the left: Spark takes the bad lines for a thirtieth of their size
    and would broadcast them through the driver, which a left join never does.
    """
    block = F.struct(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("start")).alias("block")
    lines = spark.read.text(path).select(block, "value", F.monotonically_increasing_id().alias("id"))
    good, bad = _checked(lines.where(F.trim(F.translate("value", "\t\r\x0b\x0c", "    ")) != ""), schema, required, ["block", "id"])
    blocks = lines.groupBy("block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("block.file_path").orderBy("block.start").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    placed = bad.join(blocks, "block", "left").withColumn("line", F.col("base") + F.col("id") - F.col("first") + 1)
    return good, placed.select("block.file_path", "line", "value", "reason")


def read_json_array(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """The rows of ``check_json_array``."""
    return check_json_array(spark, path, schema)[0]


def read_jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """The rows of ``check_jsonl``."""
    return check_jsonl(spark, path, schema)[0]


def read_documents(spark: SparkSession, path: str, extensions: Sequence[str] = ("txt", "md", "xml"), recursive: bool = True) -> DataFrame:
    """S3: whole text files as (source_name, text), with the path that orders them."""
    files = spark.read.option("recursiveFileLookup", recursive).option("pathGlobFilter", "*.{" + ",".join(extensions) + "}").text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_name").alias("source_name"), F.col("value").alias("text"))


def text_column(df: DataFrame) -> str:
    """The text column by name, else the first string column; decided from the schema alone."""
    strings = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    for name in TEXT_COLUMNS:
        if name in strings:
            return name
    if not strings:
        raise ValueError(f"no text column among {df.columns}")
    return strings[0]


#: Between skills that share a file, and how many do at most: a file is read whole by one task. Reading in splits would not do, as
#: skills end in line feeds and a break may overlap itself at a split's end, where Hadoop's reader can repeat a skill.
SKILL_BREAK, FILE_SKILLS = "\n\f\n", 5000


def read_skill_tree(spark: SparkSession, path: str, k_values: Sequence[int] | None = None, operators: Sequence[str] | None = None) -> DataFrame:
    """Skill Markdown under ``k{n}/{operator}/``, or as ``write_composed`` puts it: k_value, composition_type, file_path, content."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{md,txt}").text(path, wholetext=True)
    at = F.col("_metadata.file_path")
    parts = r"/k(?:_value=)?(\d+)/(?:composition_type=)?([^/]+)/"
    out = files.select(at.alias("file_path"), F.col("value").alias("content"), F.nullif(F.regexp_extract(at, parts, 1), F.lit("")).cast("int").alias("k_value"), F.regexp_extract(at, parts, 2).alias("composition_type"))
    if k_values is not None:
        out = out.where(F.col("k_value").isin(list(k_values)))
    if operators is not None:
        out = out.where(F.col("composition_type").isin(list(operators)))
    each = F.explode(F.filter(F.split("content", SKILL_BREAK), lambda c: F.trim(c) != ""))
    return out.withColumn("content", each)


def merge_results(spark: SparkSession, paths: Sequence[str], schema: T.StructType = EPISODE) -> DataFrame:
    """Many result files as one table, with file_path for ordering; files named merged or filtered are left out."""
    rows = spark.read.schema(schema).option("multiLine", True).json(list(paths)).withColumn("file_path", F.col("_metadata.file_path"))
    return rows.where(~F.regexp_extract("file_path", r"([^/]+)$", 1).rlike("merged|filtered"))


def union_all(*frames: DataFrame) -> DataFrame:
    """Tables of differing columns by name."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines; use Parquet between jobs."""
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, all values quoted, quotes doubled."""
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_composed(composed: DataFrame, path: str, k_values: Sequence[int] | None = None, operators: Sequence[str] | None = None) -> DataFrame:
    """Composed skills as text under ``k_value=…/composition_type=…/``, ``FILE_SKILLS`` a file at most; returns the count of each operator."""
    if k_values is not None:
        composed = composed.where(F.col("k_value").isin(list(k_values)))
    if operators is not None:
        composed = composed.where(F.col("composition_type").isin(list(operators)))
    composed.select("k_value", "composition_type", F.col("markdown").alias("value")).write.mode("overwrite").partitionBy("k_value", "composition_type").option("lineSep", SKILL_BREAK).option("maxRecordsPerFile", FILE_SKILLS).text(path)
    return count_operators(composed)


def count_operators(composed: DataFrame) -> DataFrame:
    return composed.groupBy("k_value", "composition_type").agg(F.count("*").alias("n"))
