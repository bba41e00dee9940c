"""Collocations by prefix-free parsing.

A document's words are parsed into overlapping chunks: one starts wherever the hash
of the next ``OVERLAP`` words is a *trigger*, and ends with the last word of the next
trigger, so equal passages are cut at equal places and a chunk shares ``OVERLAP``
words with the next one. Spark counts how often each distinct chunk occurs; n-grams
are then counted in the distinct chunks only, weighted by these frequencies. An
n-gram of up to ``LONGEST`` = ``OVERLAP`` + 1 words lies whole in the chunk in which it
starts; those that start in the shared words at a chunk's end are left to the next one.

N-grams are counted in three passes over the dictionary of chunks: words, and pairs
by hash; pairs and triples by their words; quadruples by their words. A pass counts
only n-grams whose parts of one word less may be frequent, which a bitmap of
``BITMAP_BITS`` bits tells; it has the same size whatever the input, and what it lets
through by chance is counted exactly and dropped.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathe.llm.common import as_bytes, salted_join, saved
from lathe.operators.numbering import numbered

#: Words that a chunk shares with the next, and those of the longest phrase.
OVERLAP, LONGEST = 3, 4
#: One place in so many starts a chunk.
TRIGGER = 32
#: A phrase that occurs as often is a candidate.
LEAST = 30
#: A candidate goes if a longer one has it and this percentage of its occurrences.
COVERED = 80
#: Bits of a bitmap of frequent n-grams: 16 MB.
BITMAP_BITS = 27
#: Bytes of text that a task looks at together; a longer text is split between words, and its parts overlap as chunks do.
BLOCK = 2 << 20

#: Maps A-Z to a-z, ends of clauses and lines to a line end, a tab to a blank.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else 10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))
_TURN = np.uint64(0x9E3779B97F4A7C15)
#: Odd multipliers of the words of an n-gram.
_ODD = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]
_BYTE = np.array([0 if b in (10, 32) else xxhash.xxh64_intdigest(bytes([b])) for b in range(256)], np.uint64)
_PLACE = np.array([xxhash.xxh64_intdigest(b"place %d" % i) | 1 for i in range(64)], np.uint64)


class Words:
    """Words of a block of normal texts: where they start and end, their text's number, and whether they begin a clause."""

    def __init__(self, texts: list[bytes]):
        joined = b"\n".join(texts) + b"\n"
        self.data = np.frombuffer(joined, np.uint8)
        letter = (self.data != 10) & (self.data != 32)
        edge = np.flatnonzero(np.diff(letter, prepend=False))
        self.start, self.end = edge[::2], edge[1::2]
        firsts = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))[:-1]
        self.text = np.searchsorted(firsts, self.start, "right") - 1
        lines = np.cumsum(self.data == 10, dtype=np.int32)[self.start]
        self.begins = np.diff(lines, prepend=-1) != 0
        self.letter = letter

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word; used for triggers only."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        place = np.arange(self.start[0], len(self.data)) - np.repeat(self.start, np.diff(self.start, append=len(self.data)))
        return np.add.reduceat(_BYTE[self.data[self.start[0] :]] * _PLACE[np.minimum(place, 63)], self.start - self.start[0])


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _ODD[0]
    return h ^ (h >> np.uint64(29))


def chunks(texts: list[bytes], trigger: int = TRIGGER, more: Sequence[bool] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of the text, whether it is the text's last, and the bytes (with offsets) of every chunk of normal texts.

    In a chunk one blank stands between words and one line end between clauses. Texts
    with ``more`` to come end with words that the rest begins with, and have no last chunk.
    """
    words = Words(texts)
    n = len(words.start)
    h = words.hashes()
    starts = np.diff(words.text, prepend=-1) != 0
    if n >= OVERLAP:
        window = mixed(h[:-2] * _ODD[0] + h[1:-1] * _ODD[1] + h[2:] * _ODD[2])
        starts[: n - 2] |= (words.text[:-2] == words.text[2:]) & (window % np.uint64(trigger) == 0)
    first = np.flatnonzero(starts)
    text = words.text[first]
    last = np.append(text[1:] != text[:-1], True)[: len(first)]
    until = np.where(last, np.append(first[1:], n)[: len(first)] - 1, np.append(first[1:], n)[: len(first)] + OVERLAP - 1)
    data = words.data.copy()
    data[words.end] = np.where(np.append(words.begins[1:], True), 10, 32)[:n] if n else 0
    keep = words.letter.copy()
    keep[words.end] = True
    data = data[keep]  # each word and one byte
    at = np.concatenate(([0], np.cumsum(words.end - words.start + 1)))
    size = at[until + 1] - 1 - at[first]
    ends = np.concatenate(([0], np.cumsum(size)))
    if more is not None:
        last = last & ~np.array(more, bool)[text]
    return text, last, data[np.arange(ends[-1]) + np.repeat(at[first] - ends[:-1], size)], ends


def _split(text: bytes, block: int) -> Iterator[tuple[bytes, bool]]:
    """A normal text in parts of about ``block`` bytes, and whether more follows: that begins with the part's last ``OVERLAP`` words, as a chunk does."""
    while len(text) > block:
        at = min((x for x in (text.find(b" ", block), text.find(b"\n", block)) if x >= 0), default=-1)
        if at < 0:
            break
        part, tail = text[:at], at
        for _ in range(OVERLAP):
            tail = len(part[:tail].rstrip(b" \n"))
            tail = max(part.rfind(b" ", 0, tail), part.rfind(b"\n", 0, tail)) + 1
        if not tail:  # of a few words only
            break
        yield part, True
        text = text[tail:]
    yield text, False


def _dictionary(docs: DataFrame, trigger: int, block: int) -> DataFrame:
    """lang, chunk, last, freq of every distinct chunk."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = batch.column("lang")
            parts, held = [], 0
            for row, text in enumerate(as_bytes(batch.column("text"))):
                for part, more in _split((text or b"").translate(NORMAL), block):
                    parts.append((row, part, more))
                    held += len(part)
                    if held >= block:
                        yield found(lang, *zip(*parts))
                        parts, held = [], 0
            if parts:
                yield found(lang, *zip(*parts))

    def found(lang: pa.Array, rows: Sequence[int], texts: Sequence[bytes], more: Sequence[bool]) -> pa.RecordBatch:
        text, last, data, ends = chunks(list(texts), trigger, more)
        chunk = pa.Array.from_buffers(pa.string(), len(text), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
        return pa.RecordBatch.from_arrays([lang.take(pa.array(np.array(rows)[text])), chunk, pa.array(last)], ["lang", "chunk", "last"])

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    every = rows.mapInArrow(parse, "lang string, chunk string, last boolean")
    return saved(every.groupBy("lang", "chunk", "last").agg(F.count("*").alias("freq")), "chunks")


def _blocks(batches: Iterable[pa.RecordBatch], block: int = BLOCK) -> Iterator[tuple[str, list[bytes], np.ndarray, np.ndarray]]:
    """Chunks of one language each, with ``last`` and ``freq``; chunks of several blocks are held at once at most."""
    held: dict[str, tuple[list, list, list]] = {}
    sizes: dict[str, int] = {}

    def flush(lang: str):
        texts, last, freq = held.pop(lang)
        sizes.pop(lang)
        return lang, texts, np.array(last, bool), np.array(freq, np.int64)

    for batch in batches:
        for lang, chunk, last, freq in zip(batch.column("lang").to_pylist(), as_bytes(batch.column("chunk")), batch.column("last").to_pylist(), batch.column("freq").to_pylist()):
            into = held.setdefault(lang, ([], [], []))
            for x, to in zip((chunk, last, freq), into):
                to.append(x)
            sizes[lang] = sizes.get(lang, 0) + len(chunk)
            if sizes[lang] >= block:
                yield flush(lang)
        while sum(sizes.values()) > 8 * block:
            yield flush(max(sizes, key=sizes.get))
    for lang in list(held):
        yield flush(lang)


def summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the place of one of each, and the sum of its weights."""
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    first = np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return sorted_keys[first], order[first], np.add.reduceat(weights[order], first) if len(keys) else weights


class Grams:
    """N-grams of one language's chunks, by the numbers of their words in the block's own dictionary."""

    def __init__(self, lang: str, texts: list[bytes], last: np.ndarray, freq: np.ndarray):
        words = Words(texts)
        n = len(words.start)
        ends = np.concatenate(([0], np.cumsum(words.end - words.start)))
        strings = pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(words.data[words.letter])]).dictionary_encode()
        self.word, self.id = strings.dictionary, strings.indices.to_numpy().astype(np.int64)
        self.size = max(len(self.word), 1)
        seed = xxhash.xxh32_intdigest(lang.encode())
        self.hash = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in as_bytes(self.word)), np.uint64, len(self.word))
        self.clause = np.cumsum(words.begins)
        counts = np.bincount(words.text, minlength=len(texts))
        place = np.arange(n) - np.repeat(np.cumsum(counts) - counts, counts)
        own = np.where(last, counts, counts - OVERLAP)
        self.weight = np.where(place < own[words.text], freq[words.text], 0)

    def starts(self, n: int) -> np.ndarray:
        """Whether an n-gram starts at each place but the last n - 1, and is this chunk's to count."""
        m = max(len(self.id) - n + 1, 0)
        return (self.clause[:m] == self.clause[n - 1 :][:m]) & (self.weight[:m] > 0)

    def hashed(self, at: np.ndarray, n: int) -> np.ndarray:
        """Hashes of the n-grams (2 or 3 words) at the given places."""
        total = self.hash[self.id[at]] * _ODD[0]
        for k in range(1, n):
            total = total + self.hash[self.id[at + k]] * _ODD[k] + _TURN
        return mixed(total)

    def phrases(self, at: np.ndarray, n: int) -> pa.Array:
        return pc.binary_join_element_wise(*[self.word.take(pa.array(self.id[at + k])) for k in range(n)], " ") if n > 1 else self.word.take(pa.array(self.id[at]))

    def counted(self, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """One place and the weighted count of each distinct n-gram (2 to 4 words) that starts at ``at``."""
        keys = self.id[at] * self.size + self.id[at + 1]
        if n > 2:
            keys = np.unique(keys, return_inverse=True)[1]
            rest = self.id[at + 2] if n == 3 else self.id[at + 2] * self.size + self.id[at + 3]
            keys = keys * (rest.max() + 1 if len(rest) and n == 3 else 1)
            if n == 4:
                rest = np.unique(rest, return_inverse=True)[1]
                keys = keys * (len(rest) + 1)
            keys = keys + rest
        _, one, count = summed(keys, self.weight[at])
        return at[one], count


def _set(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = (hashes & np.uint64(8 * len(bits) - 1)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _bitmap(rows: DataFrame, bits: int) -> np.ndarray:
    """The bitmap of a column ``h``: put together in the driver, of the same size for any number of rows."""
    bit = F.col("h").bitwiseAND(F.lit((1 << bits) - 1)) + 1
    parts = rows.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    out = np.zeros(max(1 << (bits - 3), 4096), np.uint8)
    for part, found in parts.collect():  # 4 KB each, of one place
        out[4096 * (part - 1) : 4096 * part] = np.frombuffer(found, np.uint8)
    return out[: 1 << (bits - 3)]


COUNTS = "lang string, phrase string, size int, h bigint, n bigint"


def _rows(lang: str | None, phrase: pa.Array | None, size: int, h: np.ndarray | None, n: np.ndarray) -> pa.RecordBatch:
    m = len(n)
    columns = [pa.array([lang] * m, pa.string()) if lang is None else pa.DictionaryArray.from_arrays(pa.array(np.zeros(m, np.int32)), pa.array([lang])).cast(pa.string())]
    columns += [phrase if phrase is not None else pa.nulls(m, pa.string()), pa.array(np.full(m, size, np.int32)), pa.array(h.view(np.int64)) if h is not None else pa.nulls(m, pa.int64()), pa.array(n.astype(np.int64))]
    return pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "size", "h", "n"])


def _summed(dictionary: DataFrame, count, least: int, name: str) -> DataFrame:
    """Counts of at least ``least`` of what ``count`` finds in each block; rows of size 0 are kept in any case."""
    rows = dictionary.mapInArrow(lambda batches: (out for block in _blocks(batches) for out in count(Grams(*block), block[0]) if out.num_rows), COUNTS)
    total = rows.groupBy("lang", "phrase", "size", "h").agg(F.sum("n").alias("n"))
    return saved(total.where((F.col("n") >= least) | (F.col("size") == 0)), name)


def count_phrases(docs: DataFrame, least: int = LEAST, trigger: int = TRIGGER, bits: int = BITMAP_BITS, block: int = BLOCK) -> DataFrame:
    """lang, phrase, size, n of every phrase of 1 to ``LONGEST`` words that occurs at least ``least`` times, and the number of all words of each lang (size 0)."""
    dictionary = _dictionary(docs, trigger, block)
    shared = docs.sparkSession.sparkContext.broadcast

    def words_and_pairs(g: Grams, lang: str):
        ids, one, n = summed(g.id, g.weight)
        yield _rows(lang, None, 0, None, np.array([g.weight.sum()]))
        yield _rows(lang, g.word.take(pa.array(ids[n > 0])), 1, None, n[n > 0])
        at, n = g.counted(np.flatnonzero(g.starts(2)), 2)
        yield _rows(None, None, 2, g.hashed(at, 2), n)

    first = _summed(dictionary, words_and_pairs, least, "words")
    pair_bits = shared(_bitmap(first.where("size = 2"), bits))

    def pairs_and_triples(g: Grams, lang: str):
        frequent = np.append(_set(pair_bits.value, g.hashed(np.arange(max(len(g.id) - 1, 0)), 2)), False)
        for n, ok in ((2, frequent), (3, frequent & np.append(frequent[1:], False))):
            begin = g.starts(n)
            at, count = g.counted(np.flatnonzero(begin & ok[: len(begin)]), n)
            yield _rows(lang, g.phrases(at, n), n, g.hashed(at, n), count)

    second = _summed(dictionary, pairs_and_triples, least, "triples")
    triple_bits = shared(_bitmap(second.where("size = 3"), bits))

    def quadruples(g: Grams, lang: str):
        frequent = np.append(_set(triple_bits.value, g.hashed(np.arange(max(len(g.id) - 2, 0)), 3)), [False, False])
        begin = g.starts(4)
        at, count = g.counted(np.flatnonzero(begin & (frequent[:-1] & frequent[1:])[: len(begin)]), 4)
        yield _rows(lang, g.phrases(at, 4), 4, None, count)

    third = _summed(dictionary, quadruples, least, "quadruples")
    counted = first.where("size < 2").unionByName(second).unionByName(third)
    return counted.select("lang", "phrase", "size", "n")


def score_phrases(counts: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, score of every phrase of two words or more that no longer one covers."""
    of = counts.where("size > 0").select("lang", "phrase", "size", "n")
    longer = of.where("size > 1").withColumnRenamed("n", "a")
    words, joined = F.split("phrase", " "), lambda x: F.array_join(x, " ")
    cuts = longer.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", joined(F.slice(words, F.lit(1), F.col("k"))).alias("left"), joined(F.slice(words, F.col("k") + 1, F.col("size"))).alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = salted_join(cuts, of.select("lang", F.col("phrase").alias(side), F.col("n").alias(name)), ["lang", side], F.xxhash64("phrase"), 4)
    score = F.expr("(2000000 * cast(a as decimal(20))) div (cast(l as decimal(20)) + cast(r as decimal(20)))")
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    inside = longer.where("size > 2").select("lang", "a", words.alias("w"), F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("m"))
    inside = inside.select("lang", "a", "w", "m", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("m") + 1)).alias("i"))
    inside = inside.groupBy("lang", joined(F.slice("w", F.col("i"), F.col("m"))).alias("phrase")).agg(F.max("a").alias("top"))
    covered = F.expr(f"100 * cast(top as decimal(20)) >= {COVERED} * cast(a as decimal(20))")
    kept = best.join(inside, ["lang", "phrase"], "left").where(F.col("top").isNull() | ~covered)
    return kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def mine(docs: DataFrame, top: int = 2000, least: int = LEAST, trigger: int = TRIGGER, bits: int = BITMAP_BITS, block: int = BLOCK) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the ``top`` best phrases of each language.

    Texts are lower-cased (A-Z), and clauses end at ``.,;:!?`` and line ends; words
    stand between blanks and tabs. a, l, r count a phrase and the two parts of its
    weakest cut, n all words of the language; the score is floor(2000000 a / (l + r)),
    the smallest of all cuts. Null and empty texts have no words; a null lang is
    ``und``, as is a lang of that name. Repeated rows count as often as they stand.
    Ties in score go by a, then by phrase in byte order. Only lang and text are read;
    an empty table gives an empty result. ``trigger``, ``bits`` and ``block`` do not
    change results.
    """
    counts = count_phrases(docs, least, trigger, bits, block)
    scored = score_phrases(counts).select("*", (-F.col("score")).alias("_score"), (-F.col("a")).alias("_a"))
    best = numbered(scored, ["lang"], ["_score", "_a", "phrase"], "rank").where(F.col("rank") <= top)
    total = counts.where("size = 0").select("lang", "n")
    return best.join(total, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
