"""Byte-level BPE ids of whole texts, equal to those of the ``tokenizers`` library.

The vocabulary file, a ``tokenizers`` JSON of a byte-level BPE, is a parameter. Its
merges are run by ``tiktoken``, which takes a quarter of the time; texts that spell
out a special token are left to the library.
"""

from __future__ import annotations

import json

import numpy as np

#: The pre-tokenizer's pattern, a fixed value of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in a vocabulary: itself if it prints, else the next one from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


class ByteBPE:
    def __init__(self, path: str):
        import tiktoken
        import tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, byte_of = spec["model"]["vocab"], byte_characters()
        before = spec["pre_tokenizer"]
        if spec["normalizer"] or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"]:
            raise ValueError(f"{path}: a byte-level BPE without normalizer or prefix is expected")
        self.special = [t["content"] for t in spec["added_tokens"]]
        made = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in spec["model"]["merges"]]
        if [vocab[m] for m in made] != list(range(256, 256 + len(made))):
            raise ValueError(f"{path}: ids in the order of the merges are expected")
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if token not in self.special}
        self.merges = tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.library = tokenizers.Tokenizer.from_file(path)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text, without special tokens but those that it spells out."""
        if any(s in text for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.asarray(self.merges.encode_to_numpy(text), np.uint32)


_LOADED: dict[str, ByteBPE] = {}


def loaded(path: str) -> ByteBPE:
    """The tokenizer at a path, once for each worker process."""
    if path not in _LOADED:
        _LOADED[path] = ByteBPE(path)
    return _LOADED[path]
