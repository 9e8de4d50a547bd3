"""Token counts under a unigram model of pieces, by dynamic programming over a trie.

The best segmentation of a pre-token into pieces maximises the sum of the
pieces' scores. Its forward scores at a position depend on the characters up to
there only, so pre-tokens that share a prefix share them: distinct pre-tokens go
into a trie, every node is scored once, and the node where a pre-token ends
holds its token count.

A pre-token is a run of characters other than space, tab and line breaks, with
the word mark before it. A character that no piece covers falls back to one
token for each of its UTF-8 bytes.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.batches import text_slices, texts_of

# Fixed values.
WORD_MARK = "▁"
SPACES = "\t\n\x0b\x0c\r "
#: Added to a rank, so that the scores of the first pieces stay close together.
RANK_SHIFT = 2.7
#: Score of a byte that stands for a part of an unknown character.
BYTE_SCORE = -20.0
#: A trie of more nodes is dropped and begun anew, and so are the counts of more words.
#: Bounds memory, changes no count.
MAX_NODES = 400_000
MAX_WORDS = 500_000
#: Pre-tokens of more characters share no prefix worth keeping and go into no trie.
LONG_WORD = 200


def piece_scores(model_path: str) -> dict[str, float]:
    """Scores of a piece vocabulary file: Zipf's law over the order of its pieces.

    Control and byte pieces are left out.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    usable = [
        model.id_to_piece(i)
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
    ]
    # The file lists merged pieces by rank, then single characters.
    return {piece: -math.log(rank + RANK_SHIFT) for rank, piece in enumerate(usable)}


class _Ring:
    """Places of prefixes by their length, where the last `size` of them are held in turn."""

    def __init__(self, size: int):
        self.size = size

    def __getitem__(self, length: int) -> int:
        return length % self.size


class CountingTrie:
    """Pre-tokens as a trie whose nodes hold forward scores and token counts."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        # Pieces from their last character backward; None leads to a piece's score.
        self.endings: dict = {}
        for piece, score in scores.items():
            node = self.endings
            for character in reversed(piece):
                node = node.setdefault(character, {})
            node[None] = score
        self.counts: dict[str, int] = {}
        self.clear()

    def clear(self) -> None:
        # By node: children, and the best score and its token count up to there.
        self.children: list[dict[str, int]] = [{}]
        self.forward: list[float] = [0.0]
        self.tokens: list[int] = [0]

    def insert(self, word: str) -> int:
        """Token count of `word`; only nodes not in the trie yet are scored.

        Of segmentations with equal scores the one with fewer tokens counts.
        """
        if len(self.children) > MAX_NODES:
            self.clear()
        children, forward, tokens = self.children, self.forward, self.tokens
        path, node = [0], 0
        for end, character in enumerate(word, 1):
            following = children[node].get(character)
            if following is None:
                following = len(children)
                children[node][character] = following
                children.append({})
                score, count = self._best(word, end, forward, tokens, path)
                forward.append(score)
                tokens.append(count)
            node = following
            path.append(node)
        return tokens[node]

    def _best(
        self, word: str, end: int, forward: Sequence[float], tokens: Sequence[int], path: Sequence[int]
    ) -> tuple[float, int]:
        """Best (score, tokens) of word[:end]; `path` has the places of its prefixes' own."""
        # The last character alone: as a piece, or else as its bytes.
        last, before = word[end - 1], path[end - 1]
        node = self.endings.get(last)
        alone = None if node is None else node.get(None)
        if alone is None:
            n_bytes = len(last.encode())
            score, count = forward[before] + n_bytes * BYTE_SCORE, tokens[before] + n_bytes
        else:
            score, count = forward[before] + alone, tokens[before] + 1
        # Back from there for as long as a piece may end like this.
        start = end - 1
        while start and node is not None:
            start -= 1
            node = node.get(word[start])
            if node is not None and (piece := node.get(None)) is not None:
                before = path[start]
                whole = forward[before] + piece
                if whole > score or whole == score and tokens[before] + 1 < count:
                    score, count = whole, tokens[before] + 1
        return score, count

    def count_long(self, word: str) -> int:
        """Token count of a long `word`; holds the scores of its last prefixes only."""
        size = self.longest + 1
        forward, tokens = [0.0] * size, [0] * size
        places = _Ring(size)
        for end in range(1, len(word) + 1):
            best = self._best(word, end, forward, tokens, places)
            forward[end % size], tokens[end % size] = best
        return tokens[len(word) % size]

    def count_all(self, words: set[str]) -> dict[str, int]:
        """Token counts of distinct `words`; new ones are inserted in order."""
        if len(self.counts) > MAX_WORDS:
            self.counts.clear()
        known = self.counts
        found = {word: known[word] for word in words if word in known}
        for word in sorted(word for word in words if word not in found):
            if len(word) > LONG_WORD:
                found[word] = self.count_long(word)
            else:
                found[word] = known[word] = self.insert(word)
        return found


def count_tokens(documents: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_pretokens, n_tokens, n_chars) of every row of `documents`.

    Whole texts; a null or blank text has 0 of each pre-token and token, a
    repeated row is counted again, an empty table has an empty result, and
    other columns are not read. No shuffle: a task counts the distinct
    pre-tokens of its own documents, and keeps its trie and counts for the ones
    that follow. A very long pre-token is scored without a trie.
    """
    names = ["doc_id", "n_pretokens", "n_tokens", "n_chars"]

    def count(batches):
        trie = CountingTrie(piece_scores(model_path))
        spaces = str.maketrans(dict.fromkeys(SPACES, " "))
        for batch in batches:
            for part in text_slices(batch, "text"):
                texts = texts_of(part, "text")
                found = [Counter(text.translate(spaces).split(" ")) for text in texts]
                for words in found:
                    words.pop("", None)
                of = trie.count_all({WORD_MARK + word for words in found for word in words})
                columns = [
                    [words.total() for words in found],
                    [sum(n * of[WORD_MARK + w] for w, n in words.items()) for words in found],
                    [len(text) for text in texts],
                ]
                arrays = [pa.array(column, pa.int64()) for column in columns]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *arrays], names)

    schema = ", ".join(f"{name} bigint" for name in names)
    return documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(count, schema)
