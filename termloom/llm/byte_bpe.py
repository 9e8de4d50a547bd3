"""Ids of a byte-level BPE vocabulary, equal to those of the `tokenizers` library.

`tokenizers` reads the vocabulary file and is what ids are defined by. Over whole
texts it takes about 700 CPU seconds a GB, so ordinary text goes through the same
merges in `tiktoken`, four times faster. Two things differ there and are handled
apart: the strings of special tokens, which `tokenizers` turns into their ids
wherever they stand, and very long runs of white space, which overflow the stack of
`tiktoken`'s pattern and are encoded by `tokenizers`.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property

import numpy as np

#: White space runs of so many characters and more are encoded apart.
LONG_RUN = 50_000
_RUN = re.compile(rf"\s{{{LONG_RUN},}}")


@dataclass(frozen=True)
class Vocabulary:
    """A vocabulary as files of both libraries, the pattern that divides texts, and the
    strings of its special tokens. Nothing is read before a task encodes with it."""

    json_path: str
    ranks_path: str
    pattern: str
    special: tuple[tuple[str, int], ...]

    @classmethod
    def read(cls, json_path: str, ranks_path: str, pattern: str) -> Vocabulary:
        from tokenizers import Tokenizer

        added = Tokenizer.from_file(json_path).get_added_tokens_decoder()
        special = tuple(sorted((token.content, number) for number, token in added.items()))
        return cls(json_path, ranks_path, pattern, special)

    def encoder(self) -> Encoder:
        return Encoder(self)


class Encoder:
    """Encodes whole texts, without any post-processing, in one task."""

    def __init__(self, vocabulary: Vocabulary):
        import base64

        import tiktoken

        with open(vocabulary.ranks_path, "rb") as lines:
            ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
        self.vocabulary = vocabulary
        self.fast = tiktoken.Encoding(
            "ranks", pat_str=vocabulary.pattern, mergeable_ranks=ranks, special_tokens={}
        )
        self.special = dict(vocabulary.special)
        # Longest first, as one special string may begin another.
        strings = sorted(self.special, key=len, reverse=True)
        self.divider = re.compile(f"({'|'.join(map(re.escape, strings))})") if strings else None

    @cached_property
    def exact(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.vocabulary.json_path)

    def encode(self, text: str) -> np.ndarray:
        """The ids of `text` as 32-bit numbers; none for the empty text."""
        if not any(string in text for string in self.special):
            return self._plain(text)
        parts = self.divider.split(text)
        # Every other part is a special string.
        ids = [
            np.array([self.special[part]], "<u4") if i % 2 else self._plain(part)
            for i, part in enumerate(parts)
        ]
        return np.concatenate(ids)

    def _plain(self, text: str) -> np.ndarray:
        if len(text) < LONG_RUN or not _RUN.search(text):
            return self.fast.encode_to_numpy(text).astype("<u4", copy=False)
        ids, at = [], 0
        for run in _RUN.finditer(text):
            # The last blank before other text belongs to that text, or stands alone.
            end = run.end() if run.end() == len(text) else run.end() - 1
            ids.append(self.fast.encode_to_numpy(text[at : run.start()]))
            blanks = self.exact.encode(text[run.start() : end], add_special_tokens=False)
            ids.append(np.array(blanks.ids, "<u4"))
            at = end
        ids.append(self.fast.encode_to_numpy(text[at:]))
        return np.concatenate(ids).astype("<u4", copy=False)
