"""Byte-level BPE ids.

Texts of Latin letters without special tokens go to the faster library with the same vocabulary. In other texts only
the chunks that need it go to the library that defines the ids: the pre-tokeniser never joins a visible character
with the space after it, and what follows a space doesn't depend on what came before, so a text may be cut before
every space that follows a visible character and the chunks encoded on their own.
"""

from __future__ import annotations

import base64
import functools
import itertools
import os
import re

import numpy as np

_CUT = re.compile(r"(?<=\S)(?= )")
_PLAIN = re.compile("(?:[\x01-;=-ɏ]|<(?!\\|))*\\Z")


class ByteBpe:
    """Ids of texts, each as an array of unsigned 32-bit integers."""

    def __init__(self, json_path: str, ranks_path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(json_path)
        self.fast = None
        if ranks_path:
            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _full(self, text: str) -> np.ndarray:
        return np.array(self.full.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text; none for an empty one."""
        if self.fast is None or not text:
            return self._full(text)
        if _PLAIN.match(text):
            return self.fast.encode_to_numpy(text)
        runs = itertools.groupby(_CUT.split(text), lambda x: _PLAIN.match(x) is not None)
        return np.concatenate([self.fast.encode_to_numpy("".join(x)) if plain else self._full("".join(x)) for plain, x in runs])


@functools.lru_cache(maxsize=2)
def byte_bpe(json_path: str, ranks_path: str | None = None) -> ByteBpe:
    """The worker's one encoder of these files."""
    return ByteBpe(json_path, ranks_path)
