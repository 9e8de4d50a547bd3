"""The weightings in plain Python, for small fixtures only."""

import math
from collections import Counter

import regex

WORD = r"[\p{L}\p{Nd}\p{Mn}_]"
ALLOWED = regex.compile(r"[^\t\n\x0B\f\r 0-9\-.:]+")


def _is_word(c):
    return regex.fullmatch(WORD, c) is not None


def tokens(text):
    """From the first to the last word boundary of every run of allowed characters."""
    found = []
    for run in ALLOWED.finditer(text):
        edges = [
            i
            for i in range(run.start(), run.end() + 1)
            if (i > 0 and _is_word(text[i - 1])) != (i < len(text) and _is_word(text[i]))
        ]
        if len(edges) > 1:
            found.append(text[edges[0] : edges[-1]].lower())
    return found


class Model:
    def __init__(self, texts):
        self.tf = {doc: Counter(tokens(text)) for doc, text in texts.items()}
        self.df = Counter(term for counts in self.tf.values() for term in counts)
        self.n = len(texts)
        self.idf = {term: math.log(self.n / df) for term, df in self.df.items()}

    def scores(self):
        return {
            (doc, term): tf * self.idf[term]
            for doc, counts in self.tf.items()
            for term, tf in counts.items()
        }

    def dense(self):
        return {
            (doc, term): self.tf[doc][term] * self.idf[term]
            for doc in self.tf
            for term in self.idf
        }


def rank(scores, k, whole=False):
    """(doc, term, rank) of the first k terms per document."""
    value = lambda s: math.floor(round(s, 6)) if whole else round(s, 6)
    ranked = []
    for doc in {d for d, _ in scores}:
        mine = [(term, value(s)) for (d, term), s in scores.items() if d == doc]
        mine.sort(key=lambda pair: (-pair[1], pair[0].encode()))
        ranked += [(doc, term, i) for i, (term, _) in enumerate(mine[:k], 1)]
    return sorted(ranked)
