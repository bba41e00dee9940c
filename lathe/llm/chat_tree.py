r"""Chat formatting as a prefix tree.

Conversations that share initial turns share the nodes of a tree: a node is a
chained hash of the rendered turns so far, owned by the smallest conversation
that passes it. A conversation's own nodes are therefore a suffix of its turns,
and in depth-first order, an owner's continuation before later branches, each
suffix is one contiguous *segment*. The packed stream holds every shared turn
once; a segment carries its offset in the stream, its first position id and the
intervals of its ancestors that its characters attend to.

The template is ``<|im_start|>role\n text <|im_end|>\n`` (without the blanks).
Inside texts every ``<|`` gets a backslash after ``<``, one more than it had, so
no text can close or open a turn; the reader takes it out again.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lathe.llm.common import NO_ID, checkpoint, salted_join

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
_TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)
SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def _escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn in the template, and where its text starts and ends."""
    head = f"{OPEN}{_escape_role(role)}\n"
    body = escape(text)
    return head + body + CLOSE, len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    return [(_unescape_role(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def _turns(conversations: DataFrame) -> DataFrame:
    """_id, and t: turn, role, a hash of role and text, and text; ordered by the struct."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    digest = F.unhex(F.substring(F.sha2(F.concat_ws("\n", blank("role"), blank("text")), 256), 1, 32))
    t = F.struct(F.col("turn").cast("bigint").alias("turn"), blank("role").alias("role"), digest.alias("digest"), blank("text").alias("text"))
    return conversations.select(F.coalesce(F.col("conv_id").cast("bigint"), F.lit(NO_ID)).alias("_id"), t.alias("t"))


def _grouped(rows: DataFrame, *fields: str) -> DataFrame:
    """One row per conversation: _id and an array of each field, in order of turn, role and hash."""
    t = F.struct(*[F.col(f"t.{f}").alias(f) for f in fields])
    return rows.select("_id", t.alias("t")).groupBy("_id").agg(F.sort_array(F.collect_list("t")).alias("_t")).select("_id", *[F.col("_t")[f].alias(f) for f in fields])


def _nodes(turns: DataFrame) -> DataFrame:
    """_id, ends (characters up to each turn's end) and nodes (chained hashes of the turns so far): no text is shuffled for them."""

    def sizes(arrays: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for roles, texts in arrays:
            yield pa.array([len(render(r, x)[0]) for r, x in zip(roles.to_pylist(), texts.to_pylist())], pa.int64())

    def link(arrays: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for digests, sizes in arrays:
            out = []
            for chain, chars in zip(digests.to_pylist(), sizes.to_pylist()):
                at, nodes = b"", []
                for d in chain:
                    at = hashlib.blake2b(at + d, digest_size=16).digest()
                    nodes.append(at)
                out.append({"ends": list(accumulate(chars)), "nodes": nodes})
            yield pa.array(out, pa.struct([("ends", pa.list_(pa.int64())), ("nodes", pa.list_(pa.binary()))]))

    sized = turns.withColumn("chars", F.arrow_udf(sizes, "bigint")("t.role", "t.text"))
    sized = sized.select("_id", F.struct("t.turn", "t.role", "t.digest", "chars").alias("t"))
    rows = _grouped(sized, "turn", "role", "digest", "chars")
    return rows.select("_id", F.arrow_udf(link, "struct<ends:array<bigint>,nodes:array<binary>>")("digest", "chars").alias("c")).select("_id", "c.*")


RENDERED = pa.struct([("text", pa.string()), ("loss", pa.list_(SPAN))])


def draw(arrays: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Formatted text and loss spans of whole conversations."""
    for roles, texts in arrays:
        out = []
        for rs, xs in zip(roles.to_pylist(), texts.to_pylist()):
            parts, loss, at = [], [], 0
            for role, text in zip(rs, xs):
                part, a, b = render(role, text)
                if role == "assistant":
                    loss.append({"start": at + a, "end": at + b})
                at += len(part)
                parts.append(part)
            out.append({"text": "".join(parts), "loss": loss})
        yield pa.array(out, RENDERED)


def pack(conversations: DataFrame) -> DataFrame:
    """One segment per conversation of the depth-first packed stream.

    Columns: conv_id; tree_id (smallest conversation of the tree); start and
    length of the segment in the stream (in characters, which are the tokens
    here; length 0 if another conversation holds all its turns); position, the
    position id of its first character; attend, the ancestors' intervals of the
    stream, in order, to which the segment attends besides its own past; shared,
    how many of its first characters other segments attend to; text; and loss, the intervals of the segment's text that hold assistant texts.

    Turns are ordered by turn (null first), then role and a hash; a null role or
    text is empty; a null conv_id is one conversation, sorted last; repeated
    rows are repeated turns; other columns are not read; an empty table gives no
    rows. A conversation is held as one row, a tree never is: hot nodes are
    aggregated map-side and joined in salted parts, and the stream is ordered by
    range partitions.
    """
    turns = _turns(conversations)
    convs = checkpoint(_nodes(turns))
    path = convs.select("_id", F.posexplode("nodes").alias("k", "node"))
    owners = path.groupBy("node").agg(F.min("_id").alias("owner"), F.count("*").alias("n")).where("n > 1").drop("n")
    shared = salted_join(path, owners, ["node"], F.col("_id"))
    # turns of an owner on the way are consecutive: its run ends at its last one
    runs = shared.groupBy("_id", "owner").agg(F.max("k").alias("last"), F.min("k").alias("first"))
    chains = runs.where("owner <> _id").groupBy("_id").agg(F.sort_array(F.collect_list(F.struct("first", "last", "owner"))).alias("chain"))
    end = lambda k: F.get("ends", k)
    none = F.array().cast("array<struct<first:int,last:int,owner:bigint>>")
    placed = convs.select("_id", "ends").join(chains, "_id", "left").withColumn("chain", F.coalesce("chain", none))
    up = F.when(F.size("chain") > 0, F.try_element_at("chain", F.lit(-1)).last + 1).otherwise(0)  # own turns begin here
    placed = placed.withColumn("up", up).withColumn("position", F.when(F.col("up") > 0, end(F.col("up") - 1)).otherwise(F.lit(0)).cast("bigint"))
    placed = placed.withColumn("length", F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0)) - F.col("position"))
    # depth-first: the owner's way down first, then branches from the deepest up, each by its owner
    steps = F.flatten(F.transform("chain", lambda s: F.array((-s.first).cast("bigint"), s.owner)))
    own = F.array((-F.col("up")).cast("bigint"), F.col("_id"))
    placed = placed.withColumn("order", F.concat(steps, own)).withColumn("tree", F.element_at("order", 2))
    pieces = F.transform("chain", lambda s: F.struct(s.owner.alias("owner"), (end(s.last) - F.when(s.first > 0, end(s.first - 1)).otherwise(0)).alias("chars")))
    placed = checkpoint(placed.select("_id", "tree", "position", "length", "order", pieces.alias("pieces")))

    parts = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = checkpoint(placed.where("length > 0").select("_id", "order", "length").repartitionByRange(parts, "order").withColumn("part", F.spark_partition_id()))
    totals = ranged.groupBy("part").agg(F.sum("length").alias("chars")).orderBy("part").collect()  # one row per partition
    base = [(r.part, at - r.chars) for r, at in zip(totals, accumulate(r.chars for r in totals))]
    base = F.broadcast(ranged.sparkSession.createDataFrame(base, "part int, base bigint"))
    running = F.sum("length").over(Window.partitionBy("part").orderBy("order").rowsBetween(Window.unboundedPreceding, -1))
    starts = checkpoint(ranged.withColumn("before", running).join(base, "part").select("_id", (F.coalesce("before", F.lit(0)) + F.col("base")).cast("bigint").alias("start")))

    wanted = placed.select("_id", F.posexplode("pieces").alias("i", "p")).select("_id", "i", F.col("p.owner").alias("owner"), F.col("p.chars").alias("chars"))
    found = salted_join(wanted, starts.withColumnRenamed("_id", "owner"), ["owner"], F.col("_id"))
    span = F.struct("start", (F.col("start") + F.col("chars")).alias("end"))
    reach = wanted.groupBy(F.col("owner").alias("_id")).agg(F.max("chars").alias("shared"))
    attend = found.groupBy("_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", span.alias("s")))), lambda x: x.s).alias("attend"))
    small = placed.select("_id", "tree", "position", "length").join(starts, "_id", "left").join(attend, "_id", "left").join(reach, "_id", "left")
    # joined while grouped by conversation, and drawn after: a Python step hides the partitioning
    whole = small.join(_grouped(turns, "turn", "role", "digest", "text").withColumnsRenamed({"role": "_roles", "text": "_texts"}).select("_id", "_roles", "_texts"), "_id")
    drawn = F.arrow_udf(draw, "struct<text:string,loss:array<struct<start:bigint,end:bigint>>>")("_roles", "_texts")
    segments = whole.withColumn("c", drawn).select("_id", "tree", "position", "length", "start", "attend", "shared", "c.*")
    own_loss = F.transform(F.filter("loss", lambda s: s.start >= F.col("position")), lambda s: F.struct((s.start - F.col("position")).alias("start"), (s.end - F.col("position")).alias("end")))
    value = lambda c: F.nullif(F.col(c), F.lit(NO_ID))
    return segments.select(
        value("_id").alias("conv_id"), value("tree").alias("tree_id"), "start", "length", "position", F.coalesce("shared", F.lit(0)).alias("shared"),
        F.coalesce("attend", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("attend"),
        F.substr("text", (F.col("position") + 1).cast("int")).alias("text"), own_loss.alias("loss"),
    )


def position_ids() -> Column:
    """Position ids of a segment's characters, in order."""
    return F.when(F.col("length") > 0, F.sequence("position", F.col("position") + F.col("length") - 1)).otherwise(F.array().cast("array<bigint>"))


def read_back(segments: DataFrame) -> DataFrame:
    """conv_id, formatted and loss (spans of ``formatted``) of every conversation, put together from packed segments alone.

    An attended interval starts where its ancestor's segment starts, so pieces are
    found by an equi-join on offsets.
    """
    keyed = segments.withColumn("_id", F.coalesce("conv_id", F.lit(NO_ID)))
    wanted = keyed.select("_id", F.posexplode("attend").alias("i", "s")).select("_id", "i", F.col("s.start").alias("start"), (F.col("s.end") - F.col("s.start")).alias("chars"))
    sources = keyed.where("shared > 0").select("start", F.substr("text", F.lit(1), F.col("shared").cast("int")).alias("text"), "loss")
    pieces = salted_join(wanted, sources, ["start"], F.col("_id"))
    piece = F.struct("i", "chars", F.substr("text", F.lit(1), F.col("chars").cast("int")).alias("text"), F.filter("loss", lambda s: s.end <= F.col("chars")).alias("loss"))
    before = pieces.groupBy("_id").agg(F.sort_array(F.collect_list(piece)).alias("before"))
    columns = ["_id", "conv_id", "position", "text", "loss"]
    alone = keyed.where(F.size("attend") == 0).select("conv_id", F.col("text").alias("formatted"), "loss")
    whole = keyed.where(F.size("attend") > 0).select(*columns).join(before, "_id")

    def shift(spans, by):
        return F.transform(spans, lambda s: F.struct((s.start + by).alias("start"), (s.end + by).alias("end")))

    spans = "array<struct<start:bigint,end:bigint>>"
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(spans).alias("loss"))
    folded = F.aggregate(F.coalesce("before", F.array().cast("array<struct<i:int,chars:bigint,text:string,loss:" + spans + ">>")), start, lambda acc, p: F.struct((acc.at + p.chars).alias("at"), F.concat(acc.loss, shift(p.loss, acc.at)).alias("loss")))
    text = F.concat(F.coalesce(F.array_join(F.col("before.text"), ""), F.lit("")), "text")
    return whole.select("conv_id", text.alias("formatted"), F.concat(folded.loss, shift(F.col("loss"), F.col("position"))).alias("loss")).union(alone)


def digests(formatted: DataFrame) -> DataFrame:
    """Counts and hashes of what a reader gets from formatted conversations and their loss masks."""

    def read(batches):
        for batch in batches:
            rows = []
            for conv, text, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss"))):
                turns = parse(text)
                learnt = "".join(unescape(text[s["start"] : s["end"]]) for s in loss)
                rows.append({
                    "conv_id": conv, "n_turns": len(turns), "turns_sha256": hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
                    "loss_chars": len(learnt), "loss_sha256": hashlib.sha256(learnt.encode()).hexdigest(), "formatted_chars": len(text),
                })
            yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    return formatted.mapInArrow(read, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
