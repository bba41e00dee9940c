import random
import re
from collections import Counter

import numpy as np

from lathe.llm import collocations
from lathe.llm.collocations import NORMAL, Grams, chunks, mine

ODD = [None, "", " .,\n", "one", "A-B\tc  d", "x" * 5000, "x" * 5000, "\x00 \x0b é", "tick " * 20_000, "\n" * 5000]


def clauses(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for x in re.split(r"[.,;:!?\x0A-\x0D]", low) if (w := re.findall(r"[^\x20\x09]+", x))]


def brute(docs, least, top):
    n, f = Counter(), Counter()
    for lang, text in docs:
        for w in clauses(text):
            n[lang or "und"] += len(w)
            for k in range(1, 5):
                f.update((lang or "und", tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    f = {x: a for x, a in f.items() if a >= least}
    rows = []
    for (lang, p), a in f.items():
        if len(p) < 2:
            continue
        score, k = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
        longer = [b for (other, q), b in f.items() if other == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
        if not any(100 * b >= 80 * a for b in longer):
            rows.append((lang, -score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    out, seen = [], Counter()
    for lang, score, a, p, l, r in sorted(rows):  # noqa: E741
        seen[lang] += 1
        if seen[lang] <= top:
            out.append((lang, seen[lang], p.decode(), -a, l, r, n[lang], -score))
    return out


def prose(rng, n):
    words = ["new", "york", "city", "Of", "the", "naïve", "a", "x1"]
    return "".join(rng.choice([*words, "new york city hall", "as well as"]) + rng.choice([" ", " ", " ", "\t", ", ", ".\n", ":", "\r\n"]) for _ in range(n))


def test_chunks_hold_every_ngram_once():
    rng = random.Random(2)
    texts = [prose(rng, rng.choice([0, 1, 2, 3, 4, 200])) for _ in range(40)] + ["", "\n.", "a b c d"]
    for trigger in (1, 3, 1000):
        text, last, data, ends = chunks([t.encode().translate(NORMAL) for t in texts], trigger)
        parts = [bytes(data[i:j]) for i, j in zip(ends, ends[1:])]
        grams = Grams("en", parts, np.array(last), np.ones(len(parts), np.int64))
        for n in (2, 3, 4):
            at = np.flatnonzero(grams.starts(n))
            got = Counter(grams.phrases(at, n).to_pylist())
            one, count = grams.counted(at, n)
            assert dict(zip(grams.phrases(one, n).to_pylist(), count.tolist())) == dict(got)
            assert got == Counter(" ".join(w[i : i + n]) for t in texts for w in clauses(t) for i in range(len(w) - n + 1))
        assert grams.weight.sum() == sum(len(w) for t in texts for w in clauses(t))


def test_parts_of_long_texts_hold_every_ngram_once():
    rng = random.Random(5)
    for n in range(60):
        text = prose(rng, rng.choice([5, 60, 400])).encode().translate(NORMAL) if n % 3 else b" ".join([b"a b c dd e"] * 40)
        for block in (1, 7, 50):
            parts = list(collocations._split(text, block))
            assert [more for _, more in parts] == [True] * (len(parts) - 1) + [False]
            _, last, data, ends = chunks([p for p, _ in parts], 3, [m for _, m in parts])
            found = [bytes(data[i:j]) for i, j in zip(ends, ends[1:])]
            grams = Grams("en", found, np.array(last), np.ones(len(found), np.int64))
            for k in (2, 4):
                got = Counter(grams.phrases(np.flatnonzero(grams.starts(k)), k).to_pylist())
                assert got == Counter(" ".join(w[i : i + k]) for w in clauses(text.decode()) for i in range(len(w) - k + 1)), (text, block)


def test_equal_passages_are_cut_alike():
    rng = random.Random(8)
    passage = " ".join(rng.choice("abcdefghijklmnop") for _ in range(400))
    text, last, data, ends = chunks([b"one two " + passage.encode(), b"other start of it " + passage.encode() + b" and end"], 8)
    parts = [bytes(data[i:j]) for i, j in zip(ends, ends[1:])]
    first, second = ({p for p, t in zip(parts, text) if t == k} for k in (0, 1))
    assert len(first & second) >= len(first) - 2 > 10


def test_against_brute_force(spark):
    rng = random.Random(4)
    docs = [(rng.choice(["en", "de", None, "und"]), prose(rng, rng.randrange(60))) for _ in range(300)]
    docs += [("en", docs[0][1])] * 40 + [(None, t) for t in ODD]
    table = spark.createDataFrame([(*d, 1, "clash", 2) for d in docs], "lang string, text string, n long, phrase string, last int").repartition(5)
    for top, trigger, bits, block in ((50, 4, 10, 3000), (2000, 32, 27, 1 << 20)):  # a bitmap so small that it lets most through
        got = [tuple(r) for r in mine(table, top=top, trigger=trigger, bits=bits, block=block).orderBy("lang", "rank").collect()]
        assert got == brute(docs, collocations.LEAST, top)


def test_large_counts_are_exact(spark):
    big = 3 * 10**15
    counts = spark.createDataFrame([("en", "a", 1, big), ("en", "b", 1, big + 1), ("en", "c", 1, big), ("en", "a b", 2, big - 1), ("en", "b c", 2, 10**15), ("en", "a b c", 3, 8 * 10**14)], "lang string, phrase string, size int, n long")
    got = {r.phrase: (r.a, r.l, r.r, r.score) for r in collocations.score_phrases(counts).collect()}
    assert got["a b"] == (big - 1, big, big + 1, 2_000_000 * (big - 1) // (2 * big + 1))
    assert set(got) == {"a b", "a b c"}  # 80 % of "b c" lies in the longer one


def test_empty_and_none_frequent(spark):
    table = spark.createDataFrame([("en", "a b c")], "lang string, text string")
    assert mine(table).count() == 0 and mine(table.where("false")).count() == 0
