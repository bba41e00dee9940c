import random
from zlib import crc32

import numpy as np
import pytest

from lathe.llm.byte_bpe import ByteBPE
from lathe.llm.packing import OpenWindows, Piece, pack, packed_pieces

PATH = "/opt/tokenizers/byte_bpe_50k.json"


@pytest.fixture(scope="module")
def bpe():
    return ByteBPE(PATH)


def test_ids_equal_the_library(bpe):
    draw = random.Random(3)
    parts = ["a", "The", " ", "  ", "\n", "\t", "'s", "12", ",", "é", "語", " ", "<|endoftext|>", "\r\n", "..", "\x00"]
    texts = ["", " ", "<|endoftext|>"] + ["".join(draw.choice(parts) for _ in range(draw.randrange(12))) for _ in range(3000)]
    assert all(bpe.encode(t).tolist() == bpe.library.encode(t, add_special_tokens=False).ids for t in texts)


def whole(sequences, most=1024):
    """Checks that sequences hold every id once; (padding, tokens, documents)."""
    docs, padding, tokens = {}, 0, 0
    for s in sequences:
        n = len(s.ids)
        assert 0 < n <= most and s.padded_length == (n if n & (n - 1) == 0 else most)
        assert [p.offset for p in s.pieces] == [sum(p.length for p in s.pieces[:i]) for i in range(len(s.pieces))]
        assert sum(p.length for p in s.pieces) == n
        padding, tokens = padding + s.padded_length - n, tokens + n
        for p in s.pieces:
            docs.setdefault(p.doc_id, []).append((p.start, p.length, p.doc_tokens, s.ids[p.offset : p.offset + p.length]))
    return docs, padding, tokens


def test_windows_keep_every_token_and_pad_little():
    draw = random.Random(5)
    for slack, most in ((0, 4), (8, 16)):
        held, done, total = OpenWindows(256, most, slack), [], 0
        for doc in range(2000):
            n = draw.choice([1, 3, 40, 200, 256, 700, draw.randrange(1, 1200)])
            total += n
            done += held.place(Piece(doc, 0, np.arange(n, dtype=np.uint32), n))
            assert len(held.room) <= most and len(held.held) == len(held.room)
        emitted = list(done)
        assert all(256 - sum(len(p.ids) for p in w) <= slack for w in emitted)
        done += held.join()
        assert sum(len(p.ids) for w in done for p in w) == total
        assert all((n := sum(len(p.ids) for p in w)) == 256 or n & (n - 1) == 0 for w in done[len(emitted):])
        spans = {}
        for w in done:
            for p in w:
                assert p.ids.tolist() == list(range(p.start, p.start + len(p.ids)))
                spans.setdefault(p.doc_id, []).append((p.start, len(p.ids), p.doc_tokens))
        for parts in spans.values():
            at = 0
            for start, n, of in sorted(parts):
                assert start == at
                at += n
            assert at == of


def test_best_fit_and_fullest():
    held = OpenWindows(10, 2, 1)
    piece = lambda doc, n: Piece(doc, 0, np.zeros(n, np.uint32), n)
    ids = lambda windows: [[(p.doc_id, p.start, len(p.ids)) for p in w] for w in windows]
    assert held.place(piece(1, 4)) == [] and held.place(piece(2, 7)) == []
    assert held.place(piece(3, 2)) == []  # to the window of 7, which has less room
    assert ids(held.place(piece(4, 8))) == [[(2, 0, 7), (3, 0, 2)]]  # none fits: the fullest goes, one short
    assert ids(held.place(piece(5, 7))) == [[(4, 0, 8), (5, 0, 2)]]  # two short: filled up
    assert ids(held.place(piece(6, 5))) == [[(5, 2, 5), (6, 0, 5)]]


def test_documents(spark, bpe):
    texts = ["", None, "one two", "one two", "long words " * 3000, "x\n" * 700] + [f"text {i} " + "word " * (i * 7 % 400) for i in range(300)]
    rows = [(None if i == 3 else i, t, 5, "c") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, ids int, pieces string").repartition(3)
    for merged in (4096, 2):  # two windows' tokens a merging task
        got, padding, tokens = whole(pack(docs, PATH, most=4, merged=merged).collect())
        want = {row[0]: [*bpe.encode(row[1] or "").tolist(), 0] for row in rows}
        assert tokens == sum(map(len, want.values())) and padding <= 0.01 * tokens
        for doc, parts in got.items():
            assert [x for part in sorted(parts) for x in part[3]] == want[doc] and {p[2] for p in parts} == {len(want[doc])}
        assert set(got) == set(want)


def test_digests_ties_and_empty(spark, bpe):
    docs = spark.createDataFrame([(7, "same"), (7, "same"), (None, None)], "doc_id bigint, text string")
    rows = packed_pieces(pack(docs, PATH)).collect()
    ids = np.append(bpe.encode("same"), 0).astype("<u4")
    assert sorted((r.doc_id is None, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == [(False, 0, len(ids), crc32(ids.tobytes()), len(ids))] * 2 + [(True, 0, 1, crc32(bytes(4)), 1)]
    assert pack(docs.where("false"), PATH).count() == 0 and packed_pieces(pack(docs.where("false"), PATH)).count() == 0


def test_query_over_all_documents(spark, bpe):
    from lathe.llm.queries import op12_packing

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    want = {d.doc_id: np.append(bpe.encode(d.text or ""), 0).astype("<u4") for d in docs}
    seen, ends, used = {d: 0 for d in want}, {}, {}
    for r in op12_packing(spark, "/root/testdata/sf0.001").orderBy("doc_id", "start").collect():
        ids = want[r.doc_id]
        assert r.start == seen[r.doc_id] and r.doc_tokens == len(ids)
        seen[r.doc_id] += r.length
        assert r.ids_crc32 == crc32(ids[r.start : r.start + r.length].tobytes())
        ends.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert seen == {d: len(ids) for d, ids in want.items()}
    for sequence, parts in ends.items():
        used[sequence] = 0
        for offset, n in sorted(parts):
            assert offset == used[sequence]
            used[sequence] += n
    padding = sum(1024 - n for n in used.values() if n & (n - 1))
    assert max(used.values()) <= 1024 and padding < 0.01 * sum(used.values())
