"""Word-piece token counts by a linear longest-match automaton.

The vocabulary's trie gets a failure link and a popped-token count per node
(Song et al., "Fast WordPiece Tokenization", 2021): when no child matches, the
node's count is added and matching goes on at the linked node, so each
character is read once and no piece is built. Counts of words seen before come
from a cache of bounded size.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathe.llm.common import as_bytes

#: First character of pieces that begin a word.
START = "▁"
#: A word without a segmentation counts one token; this marks it in a word's count.
UNKNOWN = 1 << 40
#: Bytes that the cache of words may take: their own and about 150 more each.
CACHE_BYTES, ENTRY_BYTES = 64 << 20, 150


class LongestMatch(dict):
    """word (UTF-8) -> number of greedy longest-match pieces, or 1 + UNKNOWN."""

    def __init__(self, pieces: Iterable[str]):
        super().__init__()
        self.bytes = 0
        self.children: list[dict[str, int]] = [{}]
        final = {0: False}
        for piece in pieces:
            node = 0
            for c in piece:
                nxt = self.children[node].get(c)
                if nxt is None:
                    nxt = self.children[node][c] = len(self.children)
                    self.children.append({})
                node = nxt
            final[node] = True
        self.link = [-1] * len(self.children)
        self.pops = [0] * len(self.children)
        queue = deque([0])
        while queue:
            u = queue.popleft()
            for c, v in self.children[u].items():
                queue.append(v)
                if final.get(v):
                    self.link[v], self.pops[v] = 0, 1
                    continue
                z, n = self.link[u], self.pops[u]
                while z >= 0 and c not in self.children[z]:
                    n += self.pops[z]
                    z = self.link[z]
                if z >= 0:
                    self.link[v], self.pops[v] = self.children[z][c], n

    def count(self, word: str) -> int:
        children, link, pops = self.children, self.link, self.pops
        u, n = 0, 0
        for c in START + word:
            while (v := children[u].get(c)) is None:
                if link[u] < 0:
                    return 1 + UNKNOWN
                n += pops[u]
                u = link[u]
            u = v
        while u:
            if link[u] < 0:
                return 1 + UNKNOWN
            n += pops[u]
            u = link[u]
        return n

    def __missing__(self, word: bytes) -> int:
        n = self.count(word.decode("utf-8"))
        size = len(word) + ENTRY_BYTES
        if self.bytes + size > CACHE_BYTES:
            self.clear()
            self.bytes = 0
        if size <= CACHE_BYTES:
            self[word] = n
            self.bytes += size
        return n


def load_pieces(model_file: str) -> list[str]:
    """The ordinary pieces of a sentencepiece model; its controls and byte pieces are left out."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]


def count_tokens(docs: DataFrame, pieces: list[str]) -> DataFrame:
    """doc_id, n_words, n_tokens and n_unknown (words without a segmentation, one token each) of every row.

    Words are blank-split; the first piece of a word starts with ``▁``. Null and
    empty texts count 0. Repeated rows each get a row; other columns are not read.
    ``pieces`` is one tokenizer's vocabulary, which is broadcast (tens of
    thousands of short strings).
    """
    shared = docs.sparkSession.sparkContext.broadcast(list(pieces))

    @F.arrow_udf("struct<n_words:bigint,n_tokens:bigint,n_unknown:bigint>")
    def count(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = LongestMatch(shared.value)
        for array in arrays:
            words_of, totals = [], []
            for text in as_bytes(array):
                words = (text or b"").split()
                words_of.append(len(words))
                totals.append(sum(map(automaton.__getitem__, words)))
            tokens, unknown = [t % UNKNOWN for t in totals], [t // UNKNOWN for t in totals]
            yield pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (words_of, tokens, unknown)], ["n_words", "n_tokens", "n_unknown"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), count(text).alias("c")).select("doc_id", "c.*")
