"""Repair of conversation structure by rank-convergence parallel Viterbi.

The cheapest edits of a conversation's rows are a shortest path through four states
(nothing yet, after a system, user, assistant turn), found by the costs to go, which
are computed backwards as vectors of four numbers. Only their differences matter for
the path, and only ``len(VECTORS)`` vectors exist up to a constant.

A conversation is cut into chunks of ``CHUNK`` rows that tasks solve on their own. What
comes after a chunk is unknown, so it starts from every speculative vector; a chunk has
*converged* if all of them give the same vector, up to a constant, at its first row.
Fix-up passes rerun the others from what the chunks behind them give, twice as far in
each pass, until every one has converged or seen the conversation's end. So a
conversation of any length needs few passes, and as many as the logarithm of its
chunks if it never converges. The stitched vectors then steer the tracing, which goes
forwards: each chunk is traced from each state, and the same passes settle in which
state it begins.

Edits are K (keep), R (change the role to user or assistant), D (delete) and I (insert
an empty user or assistant turn). The state that a path is in fixes the role that R and
I give; of paths of equal cost that of the least letters is traced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lathe.llm.common import NO_ID, checkpoint, salted_join, saved

#: Rows and characters of text of a chunk at most; a longer text is a chunk of its own.
CHUNK, CHUNK_CHARS = 128, 4 << 20
RETYPE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: What a text is blank without, and how a whole one ends.
SPACES, STOPS = " \t\n\x0b\x0c\r", ".!?"

NONE, SYSTEM, USER, ASSISTANT = range(4)
#: State after a kept turn of initial s, u, a (others can't be kept), and after a user or assistant turn put where the state allows one.
KEPT = {(NONE, 0): SYSTEM, (NONE, 1): USER, (SYSTEM, 1): USER, (USER, 2): ASSISTANT, (ASSISTANT, 1): USER}
GROWN = {NONE: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
NEVER = 1 << 30
#: A row's code: 0 must go, else 1 + 2 * (place of its initial among these, 3 for others) + whether it is truncated.
INITIALS = "sua"
MUST_GO, CODES = 0, 9


def closed(v: list[int]) -> tuple[int, ...]:
    """Costs to go, with turns inserted first where that is cheaper."""
    user, assistant = min(v[USER], INSERT + v[ASSISTANT]), min(v[ASSISTANT], INSERT + v[USER])
    return (min(v[NONE], INSERT + user), min(v[SYSTEM], INSERT + user), user, assistant)


def edges(v: tuple[int, ...], code: int, state: int) -> list[tuple[str, int, int]]:
    """(edit, cost to go, state after) of the edits that take a row, in the order of their letters; ``v``: costs to go after it."""
    out = [("D", DELETE + v[state], state)]
    if code != MUST_GO:
        initial, truncated = divmod(code - 1, 2)
        if (state, initial) in KEPT:
            out.append(("K", TRUNCATED * truncated + v[KEPT[state, initial]], KEPT[state, initial]))
        out.append(("R", RETYPE + TRUNCATED * truncated + v[GROWN[state]], GROWN[state]))
    return out


def before(v: tuple[int, ...], code: int) -> tuple[int, ...]:
    """Costs to go before a row."""
    return closed([min(cost for _, cost, _ in edges(v, code, state)) for state in range(4)])


def _vectors() -> list[tuple[int, ...]]:
    """All cost vectors up to a constant, that at a conversation's end first."""
    out = [closed([0, NEVER, NEVER, 0])]
    for v in out:
        for code in range(CODES):
            w = before(v, code)
            w = tuple(x - min(w) for x in w)
            if w not in out:
                out.append(w)
    return out


VECTORS = _vectors()
END = 0
#: For each code, the number of the vector before a row for that after it, as a table of bytes.
_NEXT = [bytes(VECTORS.index(tuple(x - min(w) for x in w)) for v in VECTORS for w in [before(v, code)]).ljust(256, b"\0") for code in range(CODES)]


def _edit(v: tuple[int, ...], code: int, state: int) -> tuple[str, int]:
    """The least letters on a cheapest path over one row, and the state after."""
    now, letters = before(v, code), ""
    while True:
        found = {letter: to for letter, cost, to in edges(v, code, state) if cost == now[state]}
        if INSERT + now[GROWN[state]] == now[state]:
            found["I"] = GROWN[state]
        letter = min(found)
        letters, state = letters + letter, found[letter]
        if letter != "I":
            return letters, state


_EDITS = [[[_edit(v, code, state) for state in range(4)] for code in range(CODES)] for v in VECTORS]
#: Turns inserted at a conversation's end.
_TAIL = {NONE: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}


def speculate(codes: bytes) -> list[int]:
    """The vector before a chunk for each vector after it."""
    v = bytes(range(len(VECTORS)))
    for code in reversed(codes):
        v = v.translate(_NEXT[code])
    return list(v)


def backward(codes: bytes, end: int) -> list[int]:
    """The vector after each row of a chunk."""
    out = []
    for code in reversed(codes):
        out.append(end)
        end = _NEXT[code][end]
    return out[::-1]


def trace(codes: bytes, after: list[int], state: int, tail: bool) -> tuple[list[str], int]:
    """Letters for each row (inserted turns before it), one more for the conversation's end, and the state after."""
    letters = []
    for code, v in zip(codes, after):
        edit, state = _EDITS[v][code][state]
        letters.append(edit)
    return [*letters, _TAIL[state] if tail else ""], state


def apply(letters: list[str], state: int, roles: list[str], texts: list[str]) -> tuple[list[tuple[str, str]], int]:
    """The repaired turns of a chunk and what its edits cost (without that of truncated texts)."""
    out, cost = [], 0
    for edits, role, text in zip(letters, [*roles, ""], [*texts, ""]):
        for letter in edits:
            if letter == "D":
                cost += DELETE
                continue
            if letter == "K":
                state = KEPT[state, INITIALS.index(role[0])]
                out.append((role, text))
                continue
            state = GROWN[state]
            cost += INSERT if letter == "I" else RETYPE
            out.append((ROLE[state], "" if letter == "I" else text))
    return out, cost


_ROWS = "c bigint, part int, k int, turns array<bigint>, roles array<string>, texts array<string>, keys array<binary>, flags binary"


def _chunks(rows: DataFrame, size: int) -> DataFrame:
    """Rows in order by conversation, turn, role and text, in chunks: of a task's ``part`` and numbered ``k`` within part and conversation."""
    order = ["c", "turn", "role", "text", "_row"]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(n, *order).sortWithinPartitions(*order).drop("_row")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, conv, k, held, chars, done = TaskContext.get().partitionId(), None, 0, [], 0, []

        def chunk():
            turns, roles, texts = map(list, zip(*held))
            keys = [xxhash.xxh3_128_digest(f"{len(r)} {r}{t}".encode()) for r, t in zip(roles, texts)]
            flags = bytearray()
            for role, text in zip(roles, texts):
                whole = text.rstrip(SPACES)
                flags.append((INITIALS.find(role[0]) if role and role[0] in INITIALS else 3) + 4 * (not whole) + 8 * (whole[-1:] not in STOPS))
            return conv, part, k, turns, roles, texts, keys, bytes(flags)

        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.binary()), pa.binary()]
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)], [x.split()[0] for x in _ROWS.split(", ")])
        waiting = 0
        for batch in batches:
            for c, turn, role, text in zip(*(batch.column(x).to_pylist() for x in ("c", "turn", "role", "text"))):
                if held and (c != conv or len(held) == size or chars + len(text) > CHUNK_CHARS):
                    done.append(chunk())
                    waiting, k, held, chars = waiting + chars, k + 1, [], 0
                    if len(done) >= 500 or waiting > CHUNK_CHARS:
                        yield batch_of(done)
                        done, waiting = [], 0
                if c != conv:
                    conv, k = c, 0
                held.append((turn, role, text))
                chars += len(text)
        if held:
            done.append(chunk())
        if done:
            yield batch_of(done)

    return saved(ranged.mapInArrow(cut, _ROWS), "conversation-chunks")


def _numbered(chunks: DataFrame) -> DataFrame:
    """``chunks`` and their number within the conversation, and how many it has; counts of parts are added up, of which a conversation has few rows."""
    parts = chunks.groupBy("c", "part").agg((F.max("k") + 1).alias("m"))
    w = Window.partitionBy("c")
    earlier = w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("c", "part", F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("base"), F.sum("m").over(w).alias("chunks"))
    return chunks.join(parts, ["c", "part"]).withColumn("chunk", F.col("base") + F.col("k")).drop("base")


def _duplicates(chunks: DataFrame) -> DataFrame:
    """c, part, k and the places of rows whose role and text an earlier row of the conversation has."""
    at = F.struct("part", "k", "i").alias("at")
    rows = chunks.select("c", "part", "k", F.posexplode("keys").alias("i", "h")).select("c", "h", at)
    first = rows.groupBy("c", "h").agg(F.min("at").alias("first"), F.max("at").alias("last")).where("first <> last").drop("last")
    again = salted_join(rows, first, ["c", "h"], F.xxhash64("at"), 4).where("at <> first")
    return again.groupBy("c", "at.part", "at.k").agg(F.collect_list("at.i").alias("repeats"))


_SUMMARY = "codes binary, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first_turn bigint, last_turn bigint, turns bigint, first_initial int, last_initial int"


def _summary(flags: pa.Array, repeats: pa.Array, turns: pa.Array) -> pa.Array:
    rows = []
    for flag, again, turn in zip(flags.to_pylist(), repeats.to_pylist(), turns.to_pylist()):
        again, codes, counts = set(again or ()), bytearray(), [0, 0, 0]
        for i, f in enumerate(flag):
            fault = 0 if f & 4 else 1 if i in again else 2 if f & 8 else None
            if fault is not None:
                counts[fault] += 1
            codes.append(MUST_GO if fault in (0, 1) else 1 + 2 * (f & 3) + (fault == 2))
        initials = [f & 3 for f in flag]
        illegal = sum(not legal(x, y) for x, y in zip(initials, initials[1:]))
        known = [t for t in turn if t is not None]
        rows.append((bytes(codes), *counts, illegal, known[0] if known else None, known[-1] if known else None, len(set(known)), initials[0], initials[-1]))
    names = [x.split()[0] for x in _SUMMARY.split(", ")]
    kinds = [pa.binary(), *[pa.int64()] * 7, *[pa.int32()] * 2]
    return pa.StructArray.from_arrays([pa.array([r[n] for r in rows], kind) for n, kind in enumerate(kinds)], names)


def legal(x: int, y: int) -> bool:
    """Whether initials may follow each other: su, ua, au."""
    return (x, y) in ((0, 1), (1, 2), (2, 1))


def _settled(maps: DataFrame, step: int) -> DataFrame:
    """c, chunk, value: what each chunk gives, from ``map``, what it gives for each value of the chunk ``step`` behind it.

    Maps whose values are all equal are settled; the others are composed with those
    1, 2, 4, … chunks further, until all are. Those of chunks at the end must be so.
    """
    maps = checkpoint(maps.select("c", "chunk", "map", (F.array_max("map") > F.array_min("map")).alias("open")))
    reach = step
    while maps.where("open").limit(1).count():
        behind = maps.select("c", (F.col("chunk") - reach).alias("chunk"), F.col("map").alias("then"))
        composed = maps.where("open").drop("open").join(behind, ["c", "chunk"]).select("c", "chunk", F.transform("then", lambda x: F.get("map", x.cast("int"))).alias("map"))
        composed = composed.withColumn("open", F.array_max("map") > F.array_min("map"))
        maps = checkpoint(maps.where("not open").unionByName(composed))
        reach *= 2
    return maps.select("c", "chunk", F.get("map", F.lit(0)).cast("int").alias("value"))


def _speculated(codes: pa.Array) -> pa.Array:
    return pa.array([speculate(x) for x in codes.to_pylist()], pa.list_(pa.int8()))


def _traced(codes: pa.Array, end: pa.Array) -> pa.Array:
    out = []
    for x, v in zip(codes.to_pylist(), end.to_pylist()):
        after = backward(x, v)
        out.append([trace(x, after, state, False)[1] for state in range(4)])
    return pa.array(out, pa.list_(pa.int8()))


def _constant(maps: Column, value: Column) -> Column:
    return F.transform(maps, lambda _: value.cast("tinyint"))


def _stitched(chunks: DataFrame) -> DataFrame:
    """c, chunk, end (vector after it), state (before it) of the chunks of conversations that have several, and the last initial and turn of the chunk before."""
    many = checkpoint(chunks.where("chunks > 1").select("c", "chunk", "chunks", "codes", "last_initial", "last_turn", F.arrow_udf(_speculated, "array<tinyint>")("codes").alias("map")))
    last = F.col("chunk") == F.col("chunks") - 1
    maps = many.withColumn("map", F.when(last, _constant(F.col("map"), F.get("map", F.lit(END)))).otherwise(F.col("map")))
    starts = _settled(maps, 1).select("c", (F.col("chunk") - 1).alias("chunk"), F.col("value").alias("end"))
    ended = many.join(starts, ["c", "chunk"], "left").withColumn("end", F.coalesce("end", F.lit(END)))
    traced = ended.select("c", "chunk", "end", F.arrow_udf(_traced, "array<tinyint>")("codes", "end").alias("map"))
    traced = traced.withColumn("map", F.when(F.col("chunk") == 0, _constant(F.col("map"), F.get("map", F.lit(NONE)))).otherwise(F.col("map")))
    traced = checkpoint(traced)
    states = _settled(traced, -1).select("c", (F.col("chunk") + 1).alias("chunk"), F.col("value").alias("state"))
    before = many.select("c", (F.col("chunk") + 1).alias("chunk"), F.col("last_initial").alias("initial_before"), F.col("last_turn").alias("turn_before"))
    out = traced.select("c", "chunk", "end").join(states, ["c", "chunk"], "left").join(before, ["c", "chunk"], "left")
    return out.withColumn("state", F.coalesce("state", F.lit(NONE)))


def _repaired(codes: pa.Array, end: pa.Array, state: pa.Array, tail: pa.Array, roles: pa.Array, texts: pa.Array) -> pa.Array:
    audits, costs, messages = [], [], []
    for x, v, q, at_end, r, t in zip(*(a.to_pylist() for a in (codes, end, state, tail, roles, texts))):
        letters, _ = trace(x, backward(x, v), q, at_end)
        turns, cost = apply(letters, q, r, t)
        audits.append("".join(letters))
        costs.append(cost + TRUNCATED * sum(code and not code % 2 and "D" not in edit for code, edit in zip(x, letters)))
        messages.append([{"role": role, "text": text} for role, text in turns])
    kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    return pa.StructArray.from_arrays([pa.array(audits, pa.string()), pa.array(costs, pa.int64()), pa.array(messages, kind)], ["audit", "cost", "messages"])


def repair(conversations: DataFrame, size: int = CHUNK) -> DataFrame:
    """The repaired turns of every conversation, a row for each chunk of up to ``size`` of its rows.

    conv_id; chunk, chunks (its number from 0, how many the conversation has); rows;
    blank, duplicate, truncated (rows by their first fault), illegal (pairs of
    neighbours, with the one before the chunk, whose roles' initials are not su, ua,
    au); first_turn, last_turn, turns (the numbers' ends, and how many the chunk adds;
    null turns left out); cost and audit of its edits; messages (role, text).

    Rows stand by turn (null first), then role and text; rows of a null conv_id are one
    conversation. A blank text has no character but white space, a duplicate has the
    role and text of an earlier row, a truncated text does not end with ``.!?``. Blank
    and duplicate rows are deleted. What is left must begin with at most one system
    turn and go on with pairs of a user's and an assistant's turn, or be empty. A null
    role or text is one blank. Other columns are not read; an empty table gives no rows.
    """
    rows = conversations.select(
        F.coalesce(F.col("conv_id").cast("bigint"), F.lit(NO_ID)).alias("c"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
    )
    chunks = _chunks(rows, size)
    slim = chunks.select("c", "part", "k", "turns", "flags").join(_duplicates(chunks.select("c", "part", "k", "keys")), ["c", "part", "k"], "left")
    slim = checkpoint(_numbered(slim.withColumn("s", F.arrow_udf(_summary, f"struct<{_SUMMARY.replace(' ', ':').replace(',:', ',')}>")("flags", "repeats", "turns")).select("c", "part", "k", "s.*")))
    slim = slim.join(_stitched(slim), ["c", "chunk"], "left").withColumn("end", F.coalesce("end", F.lit(END))).withColumn("state", F.coalesce("state", F.lit(NONE)))
    pair = lambda x, y: (F.col("initial_before") == x) & (F.col("first_initial") == y)
    joint = F.col("initial_before").isNotNull() & ~(pair(0, 1) | pair(1, 2) | pair(2, 1))
    slim = slim.withColumn("illegal", F.col("illegal") + joint.cast("int")).withColumn("turns", F.col("turns") - F.coalesce((F.col("turn_before") == F.col("first_turn")).cast("int"), F.lit(0)))
    whole = chunks.select("c", "part", "k", "roles", "texts").join(slim.drop("first_initial", "last_initial", "initial_before", "turn_before"), ["c", "part", "k"])
    repaired = F.arrow_udf(_repaired, "struct<audit:string,cost:bigint,messages:array<struct<role:string,text:string>>>")
    whole = whole.withColumn("r", repaired("codes", "end", "state", F.col("chunk") == F.col("chunks") - 1, "roles", "texts"))
    conv_id = F.nullif(F.col("c"), F.lit(NO_ID)).alias("conv_id")
    return whole.select(conv_id, "chunk", "chunks", F.length("codes").cast("bigint").alias("rows"), "blank", "duplicate", "truncated", "illegal", "first_turn", "last_turn", "turns", "r.*")


def summarize(repaired: DataFrame) -> DataFrame:
    """A row for each conversation: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    The digest is of its turns as ``role:text``, joined by line ends. Those of a
    conversation of several chunks are hashed one after the other as they come, sorted.
    """
    told = F.array_join(F.transform("messages", lambda m: F.concat(m.role, F.lit(":"), m.text)), "\n")
    one = F.col("chunks") == 1
    key = F.coalesce("conv_id", F.lit(NO_ID)).alias("c")
    slim = saved(repaired.withColumn("told", told).select(
        key, "chunk", "blank", "duplicate", "truncated", "illegal", "first_turn", "last_turn", "turns", "cost", "audit",
        F.when(one, F.sha2("told", 256)).alias("digest"), F.when(~one, F.col("told")).alias("told"),
    ), "repaired")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, begun, out = None, None, False, []
        for batch in batches:
            for c, text in zip(batch.column("c").to_pylist(), batch.column("told").to_pylist()):
                if c != conv:
                    if conv is not None:
                        out.append((conv, state.hexdigest()))
                    conv, state, begun = c, hashlib.sha256(), False
                if text:
                    state.update(("\n" if begun else "").encode() + text.encode())
                    begun = True
        if conv is not None:
            out.append((conv, state.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string())], ["c", "digest"])

    long = slim.where("told is not null").select("c", "chunk", "told").repartition("c").sortWithinPartitions("c", "chunk").select("c", "told").mapInArrow(hashed, "c bigint, digest string")
    sums = [F.sum(x).alias(x) for x in ("blank", "duplicate", "truncated", "illegal", "cost")]
    gaps = F.coalesce(F.max("last_turn") - F.min("first_turn") + 1 - F.sum("turns"), F.lit(0)).alias("gaps")
    audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "audit"))), lambda x: x.audit), "").alias("audit")
    by = slim.groupBy("c").agg(gaps, *sums, audit, F.max("digest").alias("digest"))
    by = by.join(long.withColumnRenamed("digest", "long_digest"), "c", "left")
    return by.select(F.nullif(F.col("c"), F.lit(NO_ID)).alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("digest", "long_digest").alias("repaired_sha256"))


def summarize_all(conversations: DataFrame, repaired: DataFrame) -> DataFrame:
    """``summarize`` with a row for every conv_id of ``conversations``: zeros, an empty audit and the digest of nothing for those without rows."""
    nothing = hashlib.sha256().hexdigest()
    by = summarize(repaired).withColumn("c", F.coalesce("conv_id", F.lit(NO_ID))).drop("conv_id")
    all_ids = conversations.select("conv_id", F.coalesce("conv_id", F.lit(NO_ID)).alias("c")).distinct()
    numbers = [F.coalesce(x, F.lit(0)).alias(x) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return all_ids.join(by, "c", "left").select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
