"""Byte-level BPE ids of whole texts.

The vocabulary file is a parameter (ranks file of a public tokenizer).
"""

from __future__ import annotations

import base64

import numpy as np

from qalake.llm.words import worker_cache


def default_ranks() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """ids(text) equals the tokenizer's ids without special tokens; strings of
    special tokens in a text are ordinary text."""

    def __init__(self, ranks_path: str, pattern: str | None = None):
        import public_tokenizers
        import tiktoken
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._bpe = tiktoken.Encoding("ranks", pat_str=pattern or public_tokenizers.PATTERN,
                                      mergeable_ranks=ranks, special_tokens={})
        size = max(ranks.values()) + 2
        self.n_bytes = np.zeros(size, np.int64)
        self.ends_sentence = np.zeros(size, bool)  # holds a sentence end, if white space follows
        self.starts_space = np.zeros(size, bool)
        self.ends_line = np.zeros(size, bool)
        for token, i in ranks.items():
            self.n_bytes[i] = len(token)
            self.ends_sentence[i] = token[-1:] in (b".", b"!", b"?")
            self.starts_space[i] = token[:1].isspace()
            self.ends_line[i] = token.endswith(b"\n")

    def ids(self, text: str | None) -> np.ndarray:
        """uint32 ids; null and empty text have none."""
        return np.array(self._bpe.encode_ordinary(text), "<u4") if text else np.empty(0, "<u4")


def encoder(ranks_path: str | None) -> Encoder:
    path = ranks_path or default_ranks()
    return worker_cache(("encoder", path), lambda: Encoder(path))
