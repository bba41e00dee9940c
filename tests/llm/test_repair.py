import hashlib
import random
import re
from functools import cache
from zlib import crc32

from pyspark.sql import functions as F

from lathe.llm import repair as r
from lathe.llm.queries import damaged, op11_repair

CONV = "conv_id long, turn long, role string, text string"
GRAMMAR = re.compile(r"(s?(ua)+)?")
WHITE = " \t\n\x0b\x0c\r"


def cheapest(codes):
    """(cost, audit) by trying all edits from the end, with insertions of up to two turns in a row."""

    @cache
    def best(i, state):
        out = [(0, "")] if i == len(codes) and state in (r.NONE, r.ASSISTANT) else []
        for inserts in range(3):
            q, cost = state, 5 * inserts
            for _ in range(inserts):
                q = r.GROWN[q]
            if i == len(codes):
                out += [(cost, "I" * inserts)] if q in (r.NONE, r.ASSISTANT) else []
                continue
            for letter, to_go, to in r.edges((0, 0, 0, 0), codes[i], q):
                rest = best(i + 1, to)
                out.append((cost + to_go + rest[0], "I" * inserts + letter + rest[1]))
        return min(out)

    return best(0, r.NONE)


def solved(codes, size):
    """The chunked solution in one process: speculation, then the true vectors and states from chunk to chunk."""
    parts = [codes[i : i + size] for i in range(0, len(codes), size)]
    maps, ends, v = [r.speculate(p) for p in parts], [], r.END
    for f in reversed(maps):
        ends.append(v)
        v = f[v]
    state, audit = r.NONE, ""
    for n, (part, end) in enumerate(zip(parts, ends[::-1])):
        letters, state = r.trace(part, r.backward(part, end), state, n == len(parts) - 1)
        audit += "".join(letters)
    return audit


def test_vectors_are_few_and_closed():
    assert len(r.VECTORS) < 128 and r.VECTORS[r.END] == (0, 10, 5, 0)
    assert all(min(v) == 0 for v in r.VECTORS)


def test_least_audit_against_all_edits():
    rng = random.Random(1)
    for n in range(1500):
        kinds = rng.choice([range(9), [1, 3, 5], [4, 6], [0, 4, 6, 8], [7, 8], [3, 5, 5, 3, 2]])
        codes = bytes(rng.choice(kinds) for _ in range(rng.randrange(12)))
        cost, audit = cheapest(codes)
        for size in (1, 3, 100):
            assert (solved(codes, size) if codes else "") == audit, (codes, size)


def test_alternating_and_truncated_chunks_converge_or_not():
    alternating = r.speculate(bytes([3, 5] * 20))
    assert len(set(alternating)) == 1
    assert len(set(r.speculate(bytes([4] * 500)))) > 1  # all truncated: kept open to the end


def brute(rows):
    """Per conversation from damaged rows."""
    rows = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
    seen, codes, counts = set(), [], dict(blank=0, duplicate=0, truncated=0, illegal=0)
    for _, role, text in rows:
        fault = "blank" if not text.strip(WHITE) else "duplicate" if (role, text) in seen else "truncated" if text.rstrip(WHITE)[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        codes.append(0 if fault in ("blank", "duplicate") else 1 + 2 * ("sua".index(role[0]) if role[:1] and role[0] in "sua" else 3) + (fault == "truncated"))
    counts["illegal"] = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    turns = {t for t, _, _ in rows if t is not None}
    counts["gaps"] = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    counts["cost"], audit = cheapest(tuple(codes))
    out, state, i = [], "", 0
    for letter in audit:
        want = "a" if state == "u" else "u"
        if letter == "I":
            out.append(({"u": "user", "a": "assistant"}[want], ""))
        else:
            _, role, text = rows[i]
            i += 1
            if letter == "D":
                continue
            out.append((role if letter == "K" else {"u": "user", "a": "assistant"}[want], text))
        state = out[-1][0][0]
    assert i == len(rows) and GRAMMAR.fullmatch("".join(x[0][0] for x in out))
    return {**counts, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(f"{a}:{b}" for a, b in out).encode()).hexdigest()}


def chats(rng, n):
    rows = []
    for c in range(n):
        turn = 0
        for _ in range(rng.choice([1, 2, 3, 8, 13])):
            turn += rng.choice([0, 1, 1, 1, 1, 3])
            rows.append((c if c else None, rng.choice([turn] * 9 + [None]), rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", None, "unit"]), rng.choice(["Hi.", "Well?", "so", "\n", "", None, "é!  ", "no stop\x0b", f"n{turn}."])))
    return rows


def check(spark, rows, size):
    table = spark.createDataFrame([(*x, "clash", 1) for x in rows], CONV + ", chunk string, c int").repartition(3)
    by = {}
    for c, turn, role, text in rows:
        by.setdefault(c, []).append((turn, " " if role is None else role, " " if text is None else text))
    got = {x.conv_id: x.asDict() for x in r.summarize_all(table.select("conv_id"), r.repair(table, size)).collect()}
    assert set(got) == set(by)
    for c, x in by.items():
        assert {k: v for k, v in got[c].items() if k != "conv_id"} == brute(x), (c, x)


def test_conversations(spark):
    rows = chats(random.Random(6), 120)
    check(spark, rows, 128)


def test_chunks_and_fix_up_passes(spark):
    rng = random.Random(9)
    rows = chats(rng, 12)
    rows += [(100, t, "user", "no stop %d" % t) for t in range(40)]  # never converges
    rows += [(101, t, ["user", "assistant"][t % 2], "Same.") for t in range(40)]  # all but two are duplicates
    rows += [(102, None, "user", "One text.")] * 30
    check(spark, rows, 4)
    check(spark, rows, 1)


def test_a_long_conversation_needs_few_passes(spark):
    n, size = 6000, 8
    rows = spark.range(n).select(F.lit(1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.concat(F.lit("no stop "), F.col("id").cast("string")).alias("text"))
    got = r.summarize(r.repair(rows, size)).collect()
    assert got[0].audit == "D" * n and got[0].cost == 2 * n and got[0].truncated == n


def test_long_texts_and_empty_table(spark):
    rows = spark.createDataFrame([(1, 0, "user", "word. " * 400_000), (1, 1, "assistant", "ok."), (1, 2, "user", "\n" * 100_000)], CONV)
    got = r.repair(rows)
    assert [m.role for x in got.orderBy("chunk").collect() for m in x.messages] == ["user", "assistant"]
    assert r.repair(rows.where("false")).count() == 0 and r.summarize_all(rows.where("false").select("conv_id"), r.repair(rows.where("false"))).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/conversations.parquet").collect()
    by = {x.conv_id: [] for x in rows}
    for x in rows:
        case, role, text = crc32(f"{x.conv_id}:{x.turn}".encode()) % 20, x.role or " ", " " if x.text is None else x.text
        text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
        by[x.conv_id] += [(x.turn, "user" if case == 4 else role, text)] * {0: 0, 3: 2}.get(case, 1)
    got = {x.conv_id: x.asDict() for x in op11_repair(spark, sf).collect()}
    assert set(got) == set(by)
    for c, x in by.items():
        assert {k: v for k, v in got[c].items() if k != "conv_id"} == brute(x)


def test_damage_of_null_rows(spark):
    got = damaged(spark.createDataFrame([(None, None, None, None)] * 2, CONV)).collect()
    case = crc32(b" : ") % 20
    assert len(got) == 2 * {0: 0, 3: 2}.get(case, 1)
