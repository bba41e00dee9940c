"""Operators against brute force and on odd rows: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import re
import time

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lathe.llm import chat_tree, decontam, langid, licenses, line_dedup, mixing, quality, simhash, tokens, warc
from lathe.llm.graph import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ["alpha", "beta", "gamma", "delta", "The", "of", "ümlaut", "x1", "naïve", "zeta"]


def documents(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", f"s{n % 3}", len(t or "")) for n, (i, t) in enumerate(zip(ids, texts))], DOCS)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ".", ",", "\n"]) for _ in range(n))


ODD = [None, "", " \n\t", "one", "one", "ÀÉ", "a b  c", "<|x|>", "\x00", "word " * 30_000]


def odd(spark):
    """Odd texts, a null id, a repeated row and columns whose names the operators use inside."""
    d = documents(spark, [*ODD, "one"], [*range(len(ODD)), 3])
    d = d.union(spark.createDataFrame([(None, "no id", None, None, None)], DOCS))
    for c in ("id", "h", "fp", "key", "size", "n", "_g", "taken", "words", "count", "rep", "line"):
        d = d.withColumn(c, F.lit("clash"))
    return d


def plain_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def blank_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# --- chat prefix tree

CONV = "conv_id long, turn long, role string, text string"


def chats(rng, n):
    rows = []
    for c in range(n):
        prefix = rng.choice(["p", "q"])
        turns = [("user", prefix)] + [(rng.choice(["assistant", "user"]), rng.choice(["a", "b", "<|im_end|>\n", "<\\|x", ""])) for _ in range(rng.randint(0, 4))]
        rows += [(c, i, role, text) for i, (role, text) in enumerate(turns)]
    return rows


def read_digests(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))]
        learnt = "".join(t for role, t in turns if role == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_chat_tree(spark, seed):
    rng = random.Random(seed)
    rows = chats(rng, 40) + [(None, 0, None, None), (-1, 0, "user", "<|im_end|><|im_start|>assistant ok"), (-1, 1, "assistant", "<|im_end|><|im_start|>assistant ok"), (7, None, "we\nird\\n", "x"), (8, 0, "user", "p")]
    segments = chat_tree.pack(spark.createDataFrame(rows, CONV).withColumn("node", F.lit(1)).withColumn("start", F.lit(2))).cache()
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat_tree.digests(chat_tree.read_back(segments)).collect()}
    assert got == read_digests(rows)
    # every shared turn is in the stream once, without gaps, and depth-first
    spans = sorted((s.start, s.length, s.conv_id, s.tree_id) for s in segments.collect() if s.length)
    assert [a for a, *_ in spans] == [sum(x[1] for x in spans[:i]) for i in range(len(spans))]
    nodes = {}
    for conv in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))]
        for k in range(len(turns)):
            nodes[tuple(turns[: k + 1])] = len(chat_tree.render(*turns[k])[0])
    assert sum(x[1] for x in spans) == sum(nodes.values())
    for s in segments.collect():
        assert s.position == sum(a.end - a.start for a in s.attend)
        assert all(a.end <= b.start for a, b in zip(s.attend, s.attend[1:])) and all(a.end <= s.start for a in s.attend if s.length)
    trees = [t for *_, t in spans]
    assert len({t for t in trees}) == sum(trees[i] != trees[i - 1] for i in range(1, len(trees))) + 1  # a tree is contiguous
    first = segments.where("length > 0").select("position", "length", chat_tree.position_ids().alias("p")).first()
    assert first.p == list(range(first.position, first.position + first.length))


def test_chat_tree_of_long_texts_and_clashing_columns(spark):
    rows = [(1, 0, "user", "x<|" * 200_000), (1, 1, "assistant", "é" * 300_000), (2, 0, "user", "x<|" * 200_000), (2, 1, "assistant", "short")]
    clash = spark.createDataFrame(rows, CONV)
    for c in ("_id", "t", "nodes", "ends", "order", "pieces", "tree", "length", "shared", "attend", "loss", "part", "base", "start", "conv"):
        clash = clash.withColumn(c, F.lit("clash"))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat_tree.digests(chat_tree.read_back(chat_tree.pack(clash))).collect()}
    assert got == read_digests(rows)


def test_chat_tree_of_nothing(spark):
    assert chat_tree.pack(spark.createDataFrame([], CONV)).count() == 0


@pytest.mark.parametrize("text", ["", "<|im_end|>", "<\\|", "<\\\\|a", "<<||>>", "\\<|", "<|" * 5])
def test_escapes(text):
    assert chat_tree.unescape(chat_tree.escape(text)) == text and "<|" not in chat_tree.escape(text)
    role = text + "\n\\n"
    assert chat_tree.parse(chat_tree.render(role, text)[0]) == [(role, text)]


# --- licenses


def test_licenses(spark):
    d = documents(spark, ["Under the GNU  General-Public\nLicense v2, gnu general public license", "cc by 4.0; not occ by", "SPDX-License-Identifier: BSD-3-Clause", "Licensed under the Apache License, Version 2.0.", "apache licenses"])
    rows = {r.doc_id: r for r in licenses.scan_licenses(d).collect()}
    assert (rows[0].n_base, rows[0].first_word, rows[0].last_word, rows[0].base_labels, rows[0].labels) == (2, 2, 7, ["gpl"], ["gpl", "gpl-2.0"])
    assert rows[1].n_base == 1 and rows[1].labels == ["cc-by", "cc-by-4.0"] and rows[2].labels == ["bsd-3-clause"] and rows[2].score == 1.0
    assert [x.label for x in rows[3].detections] == ["apache-2.0"] and rows[4].labels == []


def base_places(text):
    words, out = plain_words(text), []
    for phrase in licenses.BASE:
        p = phrase.split()
        out += [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    return out


def test_license_places_by_brute_force(spark):
    rng = random.Random(3)
    parts = [w for p in licenses.BASE for w in p.split()] + ["by", "é", "cc", "x"]
    texts = [rng.choice(["-", " "]).join(rng.choice(parts) + rng.choice(["", "!", "\n", "É"]) for _ in range(80)).upper() for _ in range(40)]
    for r in licenses.scan_licenses(documents(spark, texts)).collect():
        at = base_places(texts[r.doc_id])
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(plain_words(texts[r.doc_id])), len(at), min(at, default=None), max(at, default=None))


SNIPPETS = [
    "Licensed under the GNU General Public License, version 3 or later", "mit license", "GPLv3", "gplv2+", "under the terms of the MIT License", "LGPL-2.1-only", "GPL 2", "Apache License 2.0",
    "released under the CC BY-SA 4.0", "https://creativecommons.org/licenses/by-sa/4.0/", "SPDX-License-Identifier: (Apache-2.0 OR MIT) AND GPL-2.0-only WITH Classpath-exception-2.0\n", "neither the name of the foo\n org\n nor the names of its contributors may be used to endorse or promote products",
    "GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version", "é", "all rights reserved", "x", "gnu", "license", "BSD 3-Clause License", "two-clause BSD license",
]


def test_detections_against_all_rules():
    """Every rule over the whole text, and suppression by comparing all pairs."""
    s, rng = licenses.Scanner(), random.Random(4)
    assert len({r.pattern.pattern for r in s.rules}) > 300
    for _ in range(60):
        low = "".join(rng.choice(SNIPPETS) + rng.choice([" ", ". ", "\n * ", "-"]) for _ in range(rng.randint(1, 25))).lower().encode()
        kept = []
        for _, d in sorted(s.hits(low, s.rules)):
            if not any(k.start <= d.start and d.end <= k.end for k in kept):
                kept.append(d)
        assert s.detect(low) == kept and kept


def sample(form):
    """A short text that matches a form: first alternatives, without what is optional."""
    while True:
        new = re.sub(r"\(\?:[^()]*\)\?", "", form)
        new = re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)", r"\1", new)
        if new == form:
            break
        form = new
    form = re.sub(r"\.\{1,\d+\}\?", "x", form)
    form = re.sub(r"\\d\{4\}", "1999", form)
    form = re.sub(r"\[(.)[^\]]*\]", r"\1", form)
    return re.sub(r"\w\?| \?", "", form).replace("\\", "")


@pytest.mark.parametrize("kind", ["NAMES", "TEXTS", "ADDRESSES"])
def test_every_rule_passes_its_gate(kind):
    s = licenses.Scanner()
    for label, form in getattr(licenses, kind):
        low = f"see {sample(form)} here".encode()
        assert any(d.label.startswith(label) for _, d in s.hits(low, s.gated(low))), (label, form, low)


@pytest.mark.parametrize("text, labels", [
    ("neither the name of the foo\n org\n nor the names of its contributors may be used to endorse or promote products", ["bsd-3-clause"]),
    ("// SPDX-License-Identifier: Apache-2.0 OR MIT", ["apache-2.0", "mit"]),
    ("SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0 */", ["classpath-exception-2.0", "gpl-2.0-or-later"]),
    ("spdx-license-identifier: GPL-2.0+ and more", ["gpl-2.0-or-later"]), ("SPDX-License-Identifier: ISC see MIT\n", ["isc"]),
    ("GPL-2.0-only", ["gpl-2.0-only"]), ("GPL v2 or any later version", ["gpl-2.0-or-later"]), ("lgpl 2.1", ["lgpl-2.1"]), ("agplv3+", ["agpl-3.0-or-later"]),
    ("apache  2.0\n# license", ["apache-2.0"]), ("submit license; emit licenses", []), ("gpl 20", []),
])
def test_labels(text, labels):
    assert licenses.Scanner().scan(text.encode())["labels"] == labels


# --- token counts


def greedy(word, pieces):
    text, i, n = "▁" + word, 0, 0
    while i < len(text):
        j = next((j for j in range(len(text), i, -1) if text[i:j] in pieces), None)
        if j is None:
            return 1, 1
        i, n = j, n + 1
    return n, 0


def test_cache_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_BYTES", 2000)
    m = tokens.LongestMatch(["▁", "a", "b", "ab"])
    words = [b"ab" * k for k in range(1, 300)]
    assert [m[w] for w in words for _ in range(2)] == [1 + k for k in range(1, 300) for _ in range(2)]
    assert m.bytes <= 2000 and sum(len(w) + tokens.ENTRY_BYTES for w in m) == m.bytes


def test_token_counts(spark):
    rng = random.Random(0)
    pieces = {"▁", *"abcé"} | {"".join(rng.choice("▁abcé" if k == 0 else "abcé") for k in range(rng.randint(1, 5))) for _ in range(60)}
    texts = [" ".join("".join(rng.choice("abcéX" if rng.random() < 0.1 else "abcé") for _ in range(rng.randint(1, 12))) for _ in range(40)) for _ in range(20)]
    for r in tokens.count_tokens(documents(spark, texts), sorted(pieces)).collect():
        each = [greedy(w, pieces) for w in blank_words(texts[r.doc_id])]
        assert (r.n_words, r.n_tokens, r.n_unknown) == (len(each), sum(n for n, _ in each), sum(u for _, u in each))


# --- line dedup


def naive_patience(a, b, alo=0, blo=0):
    """Aligned places by plain recursion: the longest chain of keys unique in both (else of equal occurrences), then between them."""
    def chain(pairs):
        best = []
        for i, j in pairs:
            best.append(max((c for c in reversed(best) if c[-1][1] < j), key=len, default=[]) + [(i, j)])
        return max(reversed(best), key=len, default=[])

    unique = [(i, b.index(x)) for i, x in enumerate(a) if a.count(x) == b.count(x) == 1]
    equal = [(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x == y and a[:i].count(x) == b[:j].count(y)]
    anchors, out = chain(unique) or chain(equal), []
    for (i0, j0), (i1, j1) in zip([(-1, -1), *anchors], [*anchors, (len(a), len(b))]) if anchors else []:
        out += naive_patience(a[i0 + 1 : i1], b[j0 + 1 : j1], alo + i0 + 1, blo + j0 + 1)
    return sorted(out + [(alo + i, blo + j) for i, j in anchors])


def test_patience():
    assert line_dedup.patience([1, 2, 3], [1, 2, 3]) == [(0, 0), (1, 1), (2, 2)]
    assert line_dedup.patience([1, 9, 2, 3, 4], [2, 3, 7, 1, 4]) == [(2, 0), (3, 1), (4, 4)]
    assert line_dedup.patience([1, 1, 2], [2, 1, 1, 1]) == [(2, 0)]  # what stands once goes first
    assert line_dedup.patience([1, 1], [1, 1, 1]) == [(0, 0), (1, 1)]
    rng = random.Random(1)
    for n in range(600):
        a, b = ([rng.randint(0, 12) for _ in range(rng.randint(0, 12))] for _ in range(2))
        pairs = line_dedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
        assert pairs == naive_patience(a, b)
        if len(a) == len({*a}) and len(b) == len({*b}):  # a longest common subsequence
            best = np.zeros((len(a) + 1, len(b) + 1), int)
            for i, x in enumerate(a):
                for j, y in enumerate(b):
                    best[i + 1, j + 1] = best[i, j] + 1 if x == y else max(best[i, j + 1], best[i + 1, j])
            assert len(pairs) == best[-1, -1]
        if a == b:
            assert len(pairs) == len(a)


def aligned_brute(texts):
    """Lines in a block aligned with any earlier document: every pair of documents, whole."""
    keyed = [line_dedup.runs(*line_dedup.line_hashes((t or "").encode())) for t in texts]
    out = {}
    for d, later in enumerate(keyed):
        gone = set()
        for earlier in keyed[:d]:
            both = sorted(earlier.keys() & later.keys())
            a, b = (sorted((x[k][i], x[k][i + 1], n) for n, k in enumerate(both) for i in range(0, len(x[k]), 2)) for x in (earlier, later))
            for _, j in line_dedup.patience([x[2] for x in a], [x[2] for x in b]):
                gone |= set(range(b[j][0], b[j][1] + 1))
        if gone:
            out[d] = sorted(gone)
    return out


def shared_lines(texts, d):
    """Lines of a document in a shortest block that an earlier one has."""
    later, *earlier = (line_dedup.runs(*line_dedup.line_hashes((t or "").encode())) for t in [texts[d], *texts[:d]])
    return {n for key, at in later.items() if any(key in x for x in earlier) for i in range(0, len(at), 2) for n in range(at[i], at[i + 1] + 1)}


def gone_lines(spark, texts):
    rows = line_dedup.delete_repeated_blocks(documents(spark, texts)).collect()
    assert all(r.text == (None if texts[r.doc_id] is None else "\n".join(x for n, x in enumerate(texts[r.doc_id].split("\n")) if n not in set(r._lathe_gone or []))) for r in rows)
    return {r.doc_id: r._lathe_gone for r in rows if r._lathe_gone}


@pytest.mark.parametrize("rare", [2, line_dedup.RARE, 10**6])
def test_repeated_blocks(spark, monkeypatch, rare):
    monkeypatch.setattr(line_dedup, "RARE", rare)
    rng = random.Random(3)
    lines = [*(" ".join(prose(rng, 14).split()[: rng.choice([1, 2, 4, 6, 9, 12])]) for _ in range(25)), "", ""]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randint(1, 9))) for _ in range(120)]
    texts += ["\n".join(x for t in rng.sample(texts, 3) for x in t.split("\n")) for _ in range(30)] + [texts[0], "", None]
    own = [" ".join(f"o{rng.randint(0, 999)}" for _ in range(4)) for _ in range(200)]  # with blocks that few hold
    texts += ["\n".join(own[k : k + 12] * rng.choice([1, 1, 2]) + own[k - 8 : k - 2]) for k in (rng.randint(10, 180) for _ in range(30))]
    got, want = gone_lines(spark, texts), aligned_brute(texts)
    if rare > 10:
        assert got == want
    else:  # keys of many holders are aligned with their earliest one
        found, all_of = (sum(map(len, x.values())) for x in (got, want))
        assert all(set(x) <= shared_lines(texts, d) for d, x in got.items())
        assert found >= 0.9 * all_of


def test_blocks_that_moved_and_crossed(spark):
    p, q = ([f"{name} line {k} of seven words in all" for k in range(n)] for name, n in (("first", 6), ("second", 3)))
    own = ["its own words here", "and other ones there"]
    assert gone_lines(spark, ["\n".join([*p, own[0]]), "\n".join([own[1], *p])]) == {1: list(range(1, 7))}  # moved: aligned
    crossed = ["\n".join([*p, own[0], *q]), "\n".join([*q, own[1], *p])]
    assert gone_lines(spark, crossed) == {1: list(range(4, 10))}  # the shorter one stays
    assert gone_lines(spark, ["\n".join(q), *crossed])[2] == [0, 1, 2, *range(4, 10)]  # but for another pair
    twice = gone_lines(spark, ["\n".join(p), "\n".join([*p, own[0], *p])])
    assert len(twice[1]) == 6  # one of two copies


def test_a_pair_that_is_no_first_holder_is_aligned(spark):
    two = ["six words stand in this line", "and six words in this one"]
    apart = [f"{two[0]}\nsomething of its own", f"{two[1]}\nsomething else of its own"]
    both = ["\n".join(["begins alone", *two]), "\n".join([*two, "ends alone"])]
    assert gone_lines(spark, both) == {1: [0, 1]} and gone_lines(spark, apart + both) == {3: [0, 1]}


def test_repeated_blocks_beyond_the_earliest_holders_of_lines(spark):
    verse = [f"verse {k} of five words" for k in range(12)]
    single = [f"{x}\nsomething else {k} alone" for k, x in enumerate(verse)]  # each line is held singly before
    assert gone_lines(spark, [*single, "\n".join(verse), "own line\n" + "\n".join(verse)]) == {13: list(range(1, 13))}
    halves = ["\n".join(verse[6:] + verse[:6]), "\n".join(verse), "\n".join(verse)]  # the earliest holder has them in another order
    assert gone_lines(spark, halves)[2] == list(range(12))


def test_repeated_blocks_of_frequent_lines(spark):
    line, short = "one line of ten words that many other documents hold", [f"short line {k}" for k in range(5)]
    texts = [f"own words of document {k}\n{line}\nand an end {k}" for k in range(line_dedup.RARE + 20)]
    assert len(line.split()) == line_dedup.BLOCK_WORDS
    assert gone_lines(spark, texts) == {k: [1] for k in range(1, len(texts))}  # whatever the number of holders
    n = line_dedup.RARE + 5
    texts = [f"{x}\nelse {k} {i}" for k, x in enumerate(short) for i in range(n)] + ["\n".join(short)] * 2  # frequent, with different earliest holders
    assert gone_lines(spark, texts) == {len(texts) - 1: list(range(5))}


def test_blank_lines_and_repeats_in_linear_time(spark):
    line = "one line of ten words that many other documents hold"
    blank = "\n" * 100_000
    assert gone_lines(spark, [f"{line}{blank}a{blank}end", f"b\n{line}{blank}c"]) == {1: [1]}
    assert len(gone_lines(spark, [f"{line}{blank}{line}", f"{line}\n{line}{blank}"])[1]) == 2
    many = "\n".join([line] * 3000)  # each place with each would be nine million
    assert len(gone_lines(spark, [many, "own\n" + many])[1]) == 3000
    assert line_dedup.runs(*line_dedup.line_hashes((blank + line + blank).encode())).__len__() == 1


# --- simhash


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = blank_words(low)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def brute_components(values):
    x = np.array(values, np.uint64)
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= 3
    comp = np.arange(len(x))
    while True:
        new = np.array([comp[near[i]].min() for i in range(len(x))])
        if (new == comp).all():
            return comp
        comp = new


def test_fingerprints_and_components(spark):
    rng = random.Random(4)
    texts = [prose(rng, rng.randint(0, 60)) for _ in range(60)]
    texts += [t + " end" for t in texts[:20]] + texts[:5] + ["", None, "x y"]
    rows = sorted(simhash.near_duplicates(documents(spark, texts)).collect())
    values = [brute_fingerprint(t) for t in texts]
    assert [int(r.fingerprint, 16) for r in rows] == values
    assert [r.component_id for r in rows] == brute_components(values).tolist()


@pytest.mark.parametrize("seed", [0, 1])
def test_links_at_every_distance(spark, seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**64, 40, dtype=np.uint64)
    flips = [int(b) ^ sum(1 << int(k) for k in rng.choice(64, d, replace=False)) for b in base for d in (1, 2, 3, 4, 5)]
    chain = [0]
    for k in range(0, 30, 3):
        chain.append(chain[-1] ^ 7 << k)
    values = sorted({*base.tolist(), *flips, *chain})
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    roots = {r.node: r.root for r in connected_components(simhash.link(fps)).collect()}
    order = sorted(range(len(values)), key=lambda i: signed[i])
    comp = brute_components([values[i] for i in order])
    assert [roots.get(signed[i], signed[i]) for i in order] == [signed[order[c]] for c in comp]


@pytest.mark.parametrize("n, parts, chunk", [(0, 8, 2048), (230_000, 87, 2048), (10**8, 37_400, 2133), (10**10, 280_500, 16_000)])
def test_blocks_stay_bounded(n, parts, chunk):
    got_parts, got_chunk = simhash.block_sizes(n, 8)
    assert abs(got_parts - parts) <= 0.01 * parts + 1 and abs(got_chunk - chunk) <= 0.01 * chunk


def test_components_of_graphs(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(60)] + [(5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each_group_stays(spark):
    d = documents(spark, ["a b c d", "a b c d", "other text that is long", None, ""], [5, 2, 9, 4, None]).union(documents(spark, ["a b c d"], [2])).withColumn("rep", F.lit(1))
    assert sorted(r.doc_id for r in simhash.keep_one(d).collect()) == [2, 4, 9]


# --- language id

SYLLABLES = {"xx": ["ka", "to", "mi", "ru"], "yy": ["schw", "ung", "eit", "pfe"], "zz": ["ção", "õe", "ly", "qu"]}


def spoken(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_language_id(spark):
    rng = random.Random(5)
    rows = [(i, spoken(rng, lang := rng.choice(list(SYLLABLES)), rng.randint(5, 80)), lang, "s", 0) for i in range(400)]
    rows += [(1000, None, "xx", "s", 0), (1001, "123 ... !", "xx", "s", 0), (1002, "", None, "s", 0), (None, "ka to mi ru ka to", "xx", "s", 0)]
    d = spark.createDataFrame(rows, DOCS)
    out = langid.identify(d, langid.fit(d, 60)).withColumn("held", langid.held_out()).select("doc_id", "lang", "held", "language.*").collect()
    held = [r for r in out if r.held and r.doc_id < 1000]
    import zlib

    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out if r.doc_id is not None)
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.95
    assert {r.doc_id: r.lang_pred for r in out if r.doc_id in (1000, 1001, 1002)} == {1000: "und", 1001: "und", 1002: "und"}
    assert all(0 <= r.score <= 1 for r in out) and next(r for r in out if r.doc_id is None).lang_pred == "xx"


def test_training_sample_is_bounded(spark):
    rng = random.Random(5)
    d = spark.createDataFrame([(i, spoken(rng, "xx", 60), f"l{i % 40}", "s", 0) for i in range(2000)], DOCS)
    full, few = (langid.training_sample(d, 600, n).groupBy("lang").count().collect() for n in (10**6, 200))
    assert len(full) == 40 and sum(r["count"] for r in full) > 3000 and 30 <= len(few) <= 40 and sum(r["count"] for r in few) < 1000
    with pytest.raises(ValueError):
        langid.training_sample(d, 600, 39)


def test_language_id_without_labels(spark):
    d = documents(spark, ["abc"]).withColumn("lang", F.lit(None).cast("string"))
    assert langid.identify(d).select("language.lang_pred").first()[0] == "und"


def test_convolution_against_loops():
    rng = np.random.default_rng(0)
    conv = [rng.normal(size=(w, langid.CLASSES, langid.FILTERS)) for w in langid.WIDTHS]
    x = rng.integers(0, langid.CLASSES, (3, langid.WINDOW)).astype(np.uint8)
    tops, places = langid.respond(conv, x)
    assert np.allclose(langid.pooled(conv, x), tops)
    for i in range(3):
        for k, w in enumerate(langid.WIDTHS):
            for f in range(langid.FILTERS):
                r = [sum(conv[k][j, x[i, t + j], f] for j in range(w)) for t in range(langid.WINDOW - w + 1)]
                assert np.isclose(max(r), tops[i, k * langid.FILTERS + f]) and int(np.argmax(r)) == places[i, k * langid.FILTERS + f]


def test_windows_cover_the_text():
    text = ("abC ünd " * 100).encode()
    w = langid.windows(text)
    assert w.ravel()[: len(text) - 1].tobytes() == text[:-1] and not w.ravel()[len(text) - 1 :].any()


# --- WARC


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a.example.com/x?q=1#f", "same"), (4, "https://b.example.com:8080/", "same"), (2, "http://a.example.com/x?q=1", "same"), (3, None, None), (6, "http://é.org/ a\tb", ""), (None, "u", "null id"), (9, "http://c.org/", "a\r\n\r\nb\x00é" * 2000), (10, "http://c.org/", "a\r\n\r\nb\x00é" * 2000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit(0)).withColumn("sha", F.lit(0))
    import base64

    got = {r.page_id: tuple(r)[1:] for r in warc.archive_and_read(pages).collect()}
    for page, _, html in rows:
        raw = (html or "").encode()
        same = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        top = max(same, default=None)
        expected = (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if page == top else "revisit", None if page == top else top)
        assert got[page] == expected
    assert all(r.record_type == "response" for r in warc.archive_and_read(pages, min_bytes=10**6).collect())
    assert warc.archive_and_read(pages.limit(0)).count() == 0


def test_archives_are_valid(spark, tmp_path):
    import gzip

    rows = [(i, f"http://h{i % 5}.example.com/é{i}", f"<p>{i % 7} é" * (1 + i % 5)) for i in range(150)] + [(200, None, None), (201, "u", "x" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    archive = str(tmp_path / "a")
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "left-by-a-failed-attempt.warc.gz").write_bytes(b"half a rec")
    warc.write_archives(pages, archive, file_bytes=2000)
    files = sorted((tmp_path / "a").glob("*.warc.gz"))
    assert len(files) > 3 and not (tmp_path / "a" / "left-by-a-failed-attempt.warc.gz").exists()
    seen = {}
    for f in files:
        rest, kinds = gzip.decompress(f.read_bytes()), []
        while rest:
            head, _, body = rest.partition(b"\r\n\r\n")
            headers = warc.parse_headers(head + b"\r\n\r\n")
            n = int(headers["Content-Length"])
            assert rest.startswith(b"WARC/1.1\r\n") and body[n : n + 4] == b"\r\n\r\n"
            kinds.append(headers["WARC-Type"])
            if kinds[-1] != "warcinfo":
                seen[headers["WARC-Record-ID"]] = headers
            rest = body[n + 4 :]
        assert kinds[0] == "warcinfo" and kinds.count("warcinfo") == 1
    assert len(seen) == len(rows)
    revisits = [h for h in seen.values() if h["WARC-Type"] == "revisit"]
    assert revisits and all(seen[h["WARC-Refers-To"]]["WARC-Payload-Digest"] == h["WARC-Payload-Digest"] and seen[h["WARC-Refers-To"]]["WARC-Type"] == "response" for h in revisits)
    assert not any(x.startswith("X-") for h in seen.values() for x in h)


def test_index_lookups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "LINES", 5)
    monkeypatch.setattr(warc, "SEGMENT", 3)
    monkeypatch.setattr(warc, "BATCH_BYTES", 20)
    rows = [(i, f"http://h{i % 7}.example.com/p{i % 11}", f"<p>{i}") for i in range(120)]
    pages = spark.createDataFrame(rows + rows[:1] * 17, "page_id long, url string, html string")  # captures of one key span blocks and directories
    archive, index = str(tmp_path / "a"), str(tmp_path / "i")
    warc.write_archives(pages, archive)
    warc.build_index(spark, archive, index)
    wanted = pages.where("page_id % 3 = 0").select(warc.page_key().alias("key")).union(spark.createDataFrame([("com,nowhere)/\t1",), (None,), ("\t",), ("zz)/\t3",)], "key string"))
    places = warc.lookup(spark, wanted, index)
    rows = places.collect()
    assert len(rows) == 40 + 17 and len({tuple(r) for r in rows}) == 57
    got = warc.fetch(spark, places).collect()
    assert sorted(r.key for r in got) == sorted(r.key for r in rows)
    assert all(r.payload.decode() == "<p>" + r.key.rsplit("\t")[-1] for r in got if r.record_type == "response")
    plan = places._jdf.queryExecution().toString() + warc.fetch(spark, places)._jdf.queryExecution().toString()
    assert "CoGroups" not in plan and "content#" not in plan  # ranges only


def test_archives_of_others(spark, tmp_path):
    (tmp_path / "a").mkdir()
    head = ["WARC-Type: response", "WARC-Record-ID: <urn:uuid:0>", "WARC-Target-URI: http://x.org/p", "WARC-Payload-Digest: sha1:D"]
    (tmp_path / "a" / "x.warc.gz").write_bytes(warc.info_record("x") + warc._packed(["WARC-Type: request", "WARC-Record-ID: <urn:uuid:1>"], b"") + warc._packed(head, b"HTTP/1.1 200 OK\r\n\r\nbody"))
    warc.build_index(spark, str(tmp_path / "a"), str(tmp_path / "i"))
    got = warc.fetch(spark, warc.lookup(spark, spark.createDataFrame([("org,x)/p\t",)], "key string"), str(tmp_path / "i"))).collect()
    assert [(r.key, bytes(r.payload), r.refers_to) for r in got] == [("org,x)/p\t", b"body", None)]
    assert warc._page_of(warc.record_id(-5, "u", "D")) == "-5" and warc._page_of(f"<{warc.record_id(None, None, 'D')}>") == ""


def test_members_of_a_stream():
    import gzip
    import io

    parts = [b"WARC/1.1\r\nA: b\r\n\r\n" + bytes(n) for n in (0, 5, 3 * warc.CHUNK, 7)]
    packed = [gzip.compress(p) for p in parts]
    found = list(warc.members(io.BytesIO(b"".join(packed))))
    assert [(a, n) for a, n, _ in found] == [(sum(map(len, packed[:i])), len(packed[i])) for i in range(4)] and all(h.startswith(b"WARC") for *_, h in found)
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(b"".join(packed)[:-5])))


@pytest.mark.parametrize("url, key", [("http://www.A.com:80/x?y#z", "com,a,www:80)/x?y"), ("a.b", "b,a)/"), (None, ")/"), ("https://u:p@h.org/é", "org,h)/%C3%A9")])
def test_surt(url, key):
    assert warc.surt(url) == key


# --- mixing


def test_mixing(spark):
    rng = random.Random(6)
    rows = [(i, "w " * rng.randint(0, 50), "en", rng.choice(["a", "b", "B", None, "c"]), 0) for i in range(600)] + [(1, None, "en", "tiny", 0), (1, "one two", "en", "tiny", 0), (1, "one two", "en", "tiny", 0), (None, "x", "en", "empty", 0)]
    d = spark.createDataFrame(rows, DOCS).withColumn("size", F.lit(1)).withColumn("target", F.lit(1))
    out = mixing.mix(d).collect()
    size = {}
    for r in rows:
        size[r[3]] = size.get(r[3], 0) + len(blank_words(r[1]))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight, target, free = {s: 1 + i % 3 for i, s in enumerate(order)}, {}, set(order)
    while True:
        left = sum(size.values()) - sum(target[s] for s in order if s not in free)
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * size[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3 * size[s]
            free.discard(s)
    taken = {}
    for r in out:
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source]) and r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert len(out) == len(rows) and all(abs(taken[s] - target[s]) <= 2 for s in order if size[s] > 50)
    key = lambda r: (r.doc_id if r.doc_id is not None else -1, r._draw, r.taken)
    assert sorted(out, key=key) == sorted(mixing.mix(d.repartition(7)).collect(), key=key)
    assert mixing.mix(d.limit(0)).count() == 0


def test_knapsack_is_exact():
    rng = np.random.default_rng(0)
    for _ in range(100):
        sizes = np.unique(rng.integers(1, 60, 6))
        counts = rng.integers(0, 4, len(sizes))
        budget = int(rng.integers(0, 200))
        sums = {0}
        for s, c in zip(sizes.tolist(), counts.tolist()):
            sums = {x + k * s for x in sums for k in range(c + 1)}
        take = mixing._knapsack(sizes, counts, budget)
        assert (take <= counts).all() and int(take @ sizes) == max(x for x in sums if x <= budget)


@pytest.mark.parametrize("sizes, counts, budget, best", [([25_000, 26_000], [1, 1], 30_000, 26_000), ([21_000, 24_000, 30_000], [1, 1, 1], 47_000, 45_000), ([5, 3], [2, 4], 12, 12), ([0, 7], [3, 2], 6, 0), ([0], [3], 5, 0)])
def test_budgets(sizes, counts, budget, best):
    assert int(mixing.fit_budget(np.array(sizes), np.array(counts), budget) @ sizes) == best


def test_budgets_with_long_documents_are_exact():
    rng = np.random.default_rng(2)
    for n in range(200):
        sizes = np.unique(rng.integers(1, [60, 90_000][n % 2], 5))
        counts = rng.integers(0, 3, len(sizes))
        dp_words = [20_000, 10][n % 2]
        budget = int(rng.integers(0, 2 * max(dp_words, sizes.max()) + 1))
        sums = {0}
        for s, c in zip(sizes.tolist(), counts.tolist()):
            sums = {x + k * s for x in sums for k in range(c + 1)}
        take = mixing.fit_budget(sizes, counts, budget, dp_words)
        assert (take <= counts).all() and int(take @ sizes) == max(x for x in sums if x <= budget)
    for _ in range(20):  # beyond what the programme covers
        sizes = np.unique(rng.integers(1, 40_000, 300))
        counts = rng.integers(1, 9, len(sizes))
        budget = int(rng.integers(100_000, int(sizes @ counts)))
        take = mixing.fit_budget(sizes, counts, budget)
        assert (take <= counts).all() and int(take @ sizes) == budget


def test_any_budget_of_few_long_lengths_is_exact():
    assert int(mixing.fit_budget(np.array([26753, 35502, 37446]), np.array([1, 2, 1]), 98_980) @ [26753, 35502, 37446]) == 97_757
    rng = np.random.default_rng(5)
    for n in range(120):
        sizes = np.unique(rng.integers(5_000, 60_000, rng.integers(1, 8)))
        counts = rng.integers(1, [3, 40][n % 2], len(sizes))
        budget = int(rng.integers(0, int(sizes @ counts) + 1))
        reached = 1  # a bit for each sum
        for s, c in zip(sizes.tolist(), counts.tolist()):
            k = 1
            while c:
                k = min(k, c)
                reached |= reached << s * k
                c, k = c - k, 2 * k
        reached &= (1 << (budget + 1)) - 1
        take = mixing.fit_budget(sizes, counts, budget)
        assert (take >= 0).all() and (take <= counts).all() and int(take @ sizes) == reached.bit_length() - 1


def test_budgets_beyond_the_work_lack_less_than_a_document():
    rng = np.random.default_rng(6)
    for _ in range(60):
        sizes = np.unique(rng.integers(5_000, 60_000, 5))
        counts = rng.integers(1, 50, len(sizes))
        budget = int(rng.integers(0, int(sizes @ counts)))
        take = mixing.fit_budget(sizes, counts, budget, work=1)
        assert (take <= counts).all() and 0 <= budget - int(take @ sizes) < min(sizes[take < counts])


def test_one_very_long_document_is_quickly_fitted():
    sizes = np.concatenate((np.arange(1, 2101), [3_000_000]))
    counts = np.full(len(sizes), 5)
    began = time.process_time()
    take = mixing.fit_budget(sizes, counts, 20_000_000)
    assert int(take @ sizes) == 20_000_000 and time.process_time() - began < 2


def test_targets_of_many_sources(spark):
    rng = random.Random(1)
    sizes = {s: rng.choice([0, 1, 5, 1000, 10**6]) for s in [*{f"{rng.random()}é"[2:] for _ in range(300)}, "", "\U0001f600", "\uffff", None]}
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    free, target = set(order), {}
    while True:
        left, weight = sum(sizes.values()) - sum(target.values()), sum(1 + order.index(s) % 3 for s in free)
        share = {s: left * (1 + order.index(s) % 3) / weight for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        target |= {s: 3 * sizes[s] for s in over} if over else share
        free -= over
        if not over:
            break
    assert got == pytest.approx(target)


# --- decontamination


def hits(text, items, window=10):
    words, covered, found = plain_words(text), set(), set()
    for item, t in items:
        w = plain_words(t)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            p = w[i : i + window]
            for j in range(len(words) - len(p) + 1):
                if words[j : j + len(p)] == p:
                    covered |= set(range(j, j + len(p)))
                    found |= {item} if item is not None else set()
    return len(words), len(covered), sorted(found)


@pytest.mark.parametrize("block", [10**6, 30])
def test_decontamination(spark, block):
    rng = random.Random(8)
    items = [(i, prose(rng, rng.choice([1, 2, 4, 10, 12, 30]))) for i in range(12)] + [(3, "alpha beta"), (None, "x1 x1 zeta"), (50, None), (51, "!!")]
    texts = [prose(rng, rng.randint(0, 40)) + rng.choice(["", " ", "-"]) + (rng.choice(items)[1] or "").upper() + " " + prose(rng, 10) for _ in range(60)] + [None, ""]
    bench = spark.createDataFrame(items, "item_id long, text string")
    n, blocks = decontam.pattern_blocks(bench, 10, block)
    assert all(0 < len(b) < block for b in blocks) if n == 1 else n > 3 and sum(map(len, blocks)) > 90
    found = decontam.find_contamination(documents(spark, texts).withColumn("contamination", F.lit("clash")), bench, max_patterns=block)
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == (n == 1)  # no plan holds two matchers
    out = found.collect()
    assert len(out) == len(texts)
    for r in out:
        c = r.contamination
        assert (c.n_words, c.n_hit, c.item_ids) == hits(texts[r.doc_id], items)
        assert sum(s.last - s.first + 1 for s in c.spans) == c.n_hit
    kept = {r.doc_id for r in decontam.drop_contaminated(documents(spark, texts), bench).collect()}
    assert kept == {r.doc_id for r in out if not r.contamination.n_hit}


def test_decontamination_without_benchmark(spark):
    d = documents(spark, ["a b"])
    assert decontam.drop_contaminated(d, spark.createDataFrame([], "item_id long, text string")).count() == 1


# --- quality


def brute_counts(text):
    text = text or ""
    w = blank_words(text)
    seen, dups = set(), 0
    for line in text.split("\n"):
        if blank_words(line):
            dups += line in seen
            seen.add(line)
    grams = {}
    for i in range(len(w) - 7):
        grams.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {j for at in grams.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(covered)


def test_quality(spark):
    rng = random.Random(7)
    texts = [prose(rng, rng.randint(0, 90)) for _ in range(300)]
    texts += [t + " " + t for t in texts[:10]] + ["a\na\n \n\na #|<"] + ["|" + " ".join(["#$%&"] * 60) for _ in range(3)] + [None]
    rows = {r.doc_id: r for r in quality.judge(documents(spark, texts).withColumn("source", F.lit("s"))).collect()}
    for i, t in enumerate(texts):
        r, b = rows[i], brute_counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == b
        assert r.base_failed == (b[0] < 20 or 100 * b[4] > 30 * b[0])
    passed = [rows[i] for i in range(300) if not rows[i].base_failed]
    assert np.mean([r.kept for r in passed]) > 0.98 and not any(rows[len(texts) - k].kept for k in (2, 3, 4)) and not any(r.kept for r in rows.values() if r.base_failed)


def test_every_group_has_an_estimate(spark):
    rng = random.Random(7)
    rows = quality.judge(documents(spark, [prose(rng, 50) for _ in range(9)])).collect()
    assert all(r.kept and r.distance is not None for r in rows if not r.base_failed)
    assert quality.judge(documents(spark, [])).count() == 0


def mcd_brute(x, rng, starts=400):
    """Least determinant, over many random starts, of the covariance of the nearest 75 % to a fixed point of concentration steps; and its mean and covariance."""
    h, best = int(np.ceil(0.75 * len(x))), (np.inf, None, None)
    for _ in range(starts):
        near = rng.choice(len(x), quality.P + 1, replace=False)
        last = np.inf
        while True:
            mean, cov = x[near].mean(axis=0), np.cov(x[near].T, bias=True) + np.diag(quality.TOLERANCE)
            logdet = np.linalg.slogdet(cov)[1]
            if len(near) == h and logdet >= last - 1e-12:
                break
            if len(near) == h and logdet < best[0]:
                best = logdet, mean, cov - np.diag(quality.TOLERANCE)
            last = logdet if len(near) == h else np.inf
            d = x - mean
            near = np.argsort(np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d), kind="stable")[:h]
    return best


def test_determinants_against_many_starts(spark):
    rng = np.random.default_rng(3)
    groups = {"round": rng.normal(0, 200, (80, 6)), "long": rng.normal(0, 1, (120, 6)) @ rng.normal(0, 200, (6, 6)), "mixed": np.concatenate([rng.normal(0, 150, (100, 6)), rng.normal(900, 60, (30, 6))])}
    rows = [(g, *map(int, r)) for g, x in groups.items() for r in np.round(x)]
    fit = spark.createDataFrame(rows, "_g string, " + ", ".join(f"{x} long" for x in quality.X))
    found = {r._g: r for r in quality.estimate(fit).collect()}
    for g, x in groups.items():
        assert found[g].logdet <= mcd_brute(np.round(x), rng)[0] + 0.1  # the last bin counts in part
    assert np.linalg.norm(np.array(found["mixed"].mu)) < 150  # not drawn to the cluster
    again = {r._g: r for r in quality.estimate(fit.repartition(7)).collect()}
    assert again == found  # to the last bit


def test_verdicts_of_one_group_by_brute_force(spark):
    """With one group the wider estimates are its own, so the verdict follows from the counts and the best of many starts."""
    rng = random.Random(11)
    texts = ["\n".join(" ".join(f"w{rng.randint(0, 9999)}" + rng.choice(["", "", "", "", "#"]) for _ in range(rng.randint(6, 12))) for _ in range(rng.randint(3, 15))) for _ in range(120)]
    lines = [f"x{k} y{k}" for k in range(40)]
    texts += [" ".join("#w$" for _ in range(60)), "\n".join(lines + lines[::-1]), " ".join(f"{rng.random()}" * 3 for _ in range(60)), " ".join(f"w{k}" for k in range(30_000))]
    d = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)
    counts = [brute_counts(t) for t in texts]
    n_lines = [sum(bool(blank_words(x)) for x in t.split("\n")) for t in texts]
    passed = [c[0] >= 20 and 100 * c[4] <= 30 * c[0] for c in counts]
    x = np.round(256 * np.array([[np.log1p(n), np.log(max(chars / n, 1)), np.arcsinh(10 * symbols / n), np.sqrt(dups / k), np.sqrt(rep / n), np.log(max(n / k, 1))] for (n, chars, symbols, dups, rep), k in zip(counts, n_lines)]))
    _, mean, cov = mcd_brute(x[passed], np.random.default_rng(0))
    away = x - mean
    distance = np.einsum("ij,jk,ik->i", away, np.linalg.inv(cov * quality.CONSISTENCY + np.diag(quality.TOLERANCE)), away)
    rows = {r.doc_id: r for r in quality.judge(d).collect()}
    sure = [i for i in range(len(texts)) if abs(np.log(distance[i] / quality.CUT)) > 0.2]
    assert len(sure) > 110 and all(rows[i].kept == (passed[i] and distance[i] <= quality.CUT) for i in sure)
    assert sum(passed) - sum(r.kept for r in rows.values()) >= 3
    assert np.median([abs(np.log(rows[i].distance / distance[i])) for i in range(120)]) < 0.2


def test_blending_and_cut():
    assert quality.CUT == pytest.approx(53.3445, abs=1e-3) and quality.CONSISTENCY == pytest.approx(1.3616, abs=1e-3)
    assert quality.chi2_quantile(0.001, 6) == pytest.approx(22.4577, abs=1e-3)


def test_quality_rejects_outliers_in_large_and_small_groups(spark):
    rng = random.Random(8)

    def text():
        return "\n".join(" ".join(f"w{rng.randint(0, 9999)}" for _ in range(10)) for _ in range(rng.randint(6, 12)))

    symbols = " ".join(f"w{rng.randint(0, 9999)}" + "#" * (k % 10 == 0) for k in range(90))
    odd_words = " ".join(f"{rng.random()}" * 3 for _ in range(60))
    double = [f"x{k} y{k}" for k in range(40)]
    bad = [symbols, odd_words, "\n".join(double + double[::-1])]  # the last one: half of the lines again, no 8-word window twice
    assert not any(100 * b[4] > 30 * b[0] or b[0] < 20 for b in map(brute_counts, bad))
    good = [text() for _ in range(400)]
    rows = [(t, "en", "large") for t in good + bad] + [(t, "en", "small") for t in [text() for _ in range(20)] + bad] + [(t, "fr", "small") for t in [text() for _ in range(20)] + bad]
    out = sorted(quality.judge(spark.createDataFrame([(i, *r, len(r[0])) for i, r in enumerate(rows)], DOCS)).collect())
    is_bad = [r[0] in bad for r in rows]
    assert all(r.distance is not None for r in out)
    assert not any(r.kept for r, b in zip(out, is_bad) if b) and np.mean([r.kept for r, b in zip(out, is_bad) if not b]) > 0.99


# --- odd rows for every document operator


def test_odd_rows(spark):
    d = odd(spark).cache()
    n = d.count()
    assert licenses.scan_licenses(d).count() == tokens.count_tokens(d, ["▁", "o", "n", "e"]).count() == quality.judge(d).count() == n
    named = langid.identify(d.withColumn("language", F.lit("clash")))
    assert named.columns == [*d.columns, "language"] and dict(named.dtypes)["language"].startswith("struct")
    assert langid.identify(d).count() == mixing.mix(d).count() == simhash.near_duplicates(d).count() == n
    out = line_dedup.delete_repeated_blocks(d)
    assert out.columns[:-1] == d.columns and out.count() == n
    assert langid.keep_identified(d).columns == d.columns and simhash.keep_one(d).columns == d.columns
    assert decontam.drop_contaminated(d, spark.createDataFrame([(1, "one")], "item_id long, text string")).columns == d.columns
    empty = d.limit(0)
    for f in (licenses.scan_licenses, mixing.mix, simhash.near_duplicates, line_dedup.delete_repeated_blocks, langid.identify, quality.judge, simhash.keep_one):
        assert f(empty).count() == 0
