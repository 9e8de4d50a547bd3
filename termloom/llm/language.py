"""Language identification by spans: scripts, word scores, and a Viterbi path.

The script of a word narrows the languages it may belong to. Its score for each
of them comes from its character trigrams, learned from labelled documents. The
best path through the words of a text, where every change of language costs a
penalty, labels spans of one language each.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm.batches import text_slices, texts_of

#: About so many labelled documents of each language are learned from, chosen by hash.
SAMPLE_PER_LANGUAGE = 3_000
#: Trigrams are counted by this many classes of their hash: the size of the model per
#: language, whatever was learned from. No trigram and no language is left out.
GRAM_CLASSES = 1 << 15
#: Cost of a change of language, and the most that one word speaks against one.
SWITCH_PENALTY = 6.0
WORD_LIMIT = 8.0
SMOOTHING = 0.5
#: A language uses a script if this share of its letters is of it.
SCRIPT_SHARE = 0.01
#: So few texts are walked one by one, if there are no more languages than that.
FEW_TEXTS = 12
FEW_LANGUAGES = 32
WALK_WORDS = 20_000
#: Words whose scores a task keeps.
MAX_WORDS = 400_000
#: A filter rejects texts of which no language has this share.
MIN_SCORE = 0.5
UNDETERMINED = "und"

# First and last code points of scripts.
SCRIPTS = (
    ("latin", (0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)),
    ("greek", (0x370, 0x3FF), (0x1F00, 0x1FFF)),
    ("cyrillic", (0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)),
    ("armenian", (0x530, 0x58F)),
    ("hebrew", (0x590, 0x5FF)),
    ("arabic", (0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)),
    ("devanagari", (0x900, 0x97F)),
    ("bengali", (0x980, 0x9FF)),
    ("tamil", (0xB80, 0xBFF)),
    ("telugu", (0xC00, 0xC7F)),
    ("thai", (0xE00, 0xE7F)),
    ("georgian", (0x10A0, 0x10FF), (0x1C90, 0x1CBF)),
    ("hangul", (0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)),
    ("kana", (0x3040, 0x30FF), (0x31F0, 0x31FF)),
    ("han", (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)),
)
WORD = re.compile(r"[^\W\d_]+")
WORD_SQL = r"\p{L}+"


@dataclass(frozen=True)
class LanguageModel:
    """Languages, the scripts each uses, and log rates of trigram classes by language."""

    languages: tuple[str, ...]
    scripts: dict[str, tuple[bool, ...]]
    weights: np.ndarray


def script_of(word: str) -> str:
    """The script of a word's first letter; empty if it is none of the list."""
    point = ord(word[0])
    for name, *ranges in SCRIPTS:
        if any(low <= point <= high for low, high in ranges):
            return name
    return ""


def held_out(doc_id: Column) -> Column:
    """Whether a document is held out from learning, by the CRC of its id as text."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _script_column(letter: Column) -> Column:
    point = F.ascii(letter)
    found = F.lit("")
    for name, *ranges in reversed(SCRIPTS):
        inside = F.lit(False)
        for low, high in ranges:
            inside |= point.between(low, high)
        found = F.when(inside, name).otherwise(found)
    return found


def train(documents: DataFrame, sample_per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageModel:
    """A model of the labelled rows of `documents` (doc_id, text, lang) not held out.

    Labels are counted over all of them, and every label is a language; texts
    are read of about `sample_per_language` rows of each, chosen by a hash of
    the id. Trigrams are counted by Spark; a count for each class and language
    reaches the driver. Repeated rows count again. Without labelled rows the
    model knows no language.
    """
    labelled = documents.where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))
    ).select("doc_id", "text", "lang")
    by_language = labelled.groupBy("lang").count()
    # One row for each language.
    counts = by_language.collect()
    languages = tuple(sorted(row["lang"] for row in counts))
    if not languages:
        return LanguageModel((), {}, np.zeros((GRAM_CLASSES, 0), np.float32))
    share = {row["lang"]: min(1.0, sample_per_language / row["count"]) for row in counts}
    places = documents.sparkSession.createDataFrame(
        [(lang, share[lang], number) for number, lang in enumerate(languages)],
        "lang string, share double, language int",
    )
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000
    words = (
        labelled.join(F.broadcast(places), "lang")
        .where(chance < F.col("share"))
        .select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(WORD_SQL), F.lit(0))).alias("word"))
        .groupBy("lang", "word")
        .count()
    )
    framed = F.concat(F.lit("^"), "word", F.lit("$"))
    grams = F.transform(
        F.sequence(F.lit(1), F.length("word")), lambda i: F.substr(framed, i, F.lit(3))
    )
    class_of = F.pmod(F.crc32(F.col("gram").cast("binary")), F.lit(GRAM_CLASSES)).cast("int")
    by_class = (
        words.select("lang", "count", F.explode(grams).alias("gram"))
        .groupBy("lang", class_of.alias("class"))
        .agg(F.sum("count").alias("n"))
        .join(F.broadcast(places), "lang")
        .select("class", "language", "n")
        .toArrow()
    )
    numbers = np.zeros((GRAM_CLASSES, len(languages)))
    numbers[by_class["class"].to_numpy(), by_class["language"].to_numpy()] = by_class["n"].to_numpy()
    met = numbers.any(axis=1, keepdims=True)
    numbers += SMOOTHING
    weights = np.log(numbers / (numbers * met).sum(axis=0))
    # A class that was not met says nothing for or against a language.
    weights = (weights - weights.max(axis=1, keepdims=True)) * met

    letters = (
        words.select("lang", "count", _script_column(F.substr("word", F.lit(1), F.lit(1))).alias("script"))
        .groupBy("lang", "script")
        .agg(F.sum("count").alias("n"))
        .collect()
    )
    of_language = {lang: sum(r["n"] for r in letters if r["lang"] == lang) for lang in languages}
    used = {(r["lang"], r["script"]) for r in letters if r["n"] >= SCRIPT_SHARE * of_language[r["lang"]]}
    scripts = {
        script: tuple((lang, script) in used for lang in languages) for script in {s for _, s in used}
    }
    return LanguageModel(languages, scripts, weights.astype(np.float32))


class WordScores:
    """Scores of distinct words for each language, as rows of a growing table."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.ids: dict[str, int] = {}
        self.classes: dict[str, int] = {}
        self.table = np.zeros((0, len(model.languages)), np.float32)
        self.new: list[str] = []

    def number(self, words: list[str]) -> np.ndarray:
        """Row numbers of `words`; new ones are scored by the next call of `scores`."""
        ids = self.ids
        for word in words:
            if word not in ids:
                ids[word] = len(ids)
                self.new.append(word)
        return np.fromiter(map(ids.__getitem__, words), np.int32, len(words))

    def scores(self) -> np.ndarray:
        if self.new:
            self.table = np.concatenate([self.table, self._score(self.new)])
            self.new = []
        return self.table

    def _score(self, words: list[str]) -> np.ndarray:
        model, classes = self.model, self.classes
        numbers, starts = [], []
        for word in words:
            starts.append(len(numbers))
            framed = f"^{word}$"
            for i in range(len(word)):
                gram = framed[i : i + 3]
                number = classes.get(gram)
                if number is None:
                    number = classes[gram] = zlib.crc32(gram.encode()) % GRAM_CLASSES
                numbers.append(number)
        table = np.add.reduceat(model.weights[numbers], starts, axis=0)
        masks = {
            script: np.where(allowed, 0, -np.inf) for script, allowed in model.scripts.items()
        }
        scripts = [script_of(word) for word in words]
        for script, mask in masks.items():
            table[[s == script for s in scripts]] += mask.astype(np.float32)
        table -= table.max(axis=1, keepdims=True)
        return np.maximum(table, -WORD_LIMIT)

    def trim(self) -> None:
        """Forget all words once there are many. Bounds memory, changes no score."""
        if len(self.ids) + len(self.classes) > MAX_WORDS:
            self.__init__(self.model)


def best_paths(
    scores: np.ndarray, words: np.ndarray, lengths: np.ndarray, penalty: float = SWITCH_PENALTY
) -> np.ndarray:
    """The language number of every word on the best path of its text.

    `words` holds the texts one after the other, `lengths` words each. All texts
    are walked at the same time, longest first, so those still going on are the
    first ones. The few longest go on one by one. Of equal values the first
    language counts.
    """
    order = np.argsort(-lengths, kind="stable")
    sorted_lengths = lengths[order]
    offsets = (np.cumsum(lengths) - lengths)[order]
    n_languages = scores.shape[1]
    # Texts longer than t, for every t.
    active = len(lengths) - np.searchsorted(sorted_lengths[::-1], np.arange(sorted_lengths[0]), "right")
    value = np.zeros((len(lengths), n_languages), np.float64)
    came_from = np.zeros((len(words), n_languages), np.min_scalar_type(n_languages))
    own = np.arange(n_languages, dtype=came_from.dtype)
    together = len(active)
    if n_languages <= FEW_LANGUAGES:
        together = int(np.searchsorted(-active, -FEW_TEXTS, side="left"))
    for t, n in enumerate(active[:together]):
        at, v = offsets[:n] + t, value[:n]
        best = v.argmax(axis=1)
        changed = np.take_along_axis(v, best[:, None], axis=1) - penalty
        change = changed > v
        came_from[at] = np.where(change, best[:, None], own)
        value[:n] = np.where(change, changed, v) + scores[words[at]]
    alone = range(active[together] if together < len(active) else 0)
    rest = [slice(offsets[i] + together, offsets[i] + sorted_lengths[i]) for i in alone]
    for i, part in zip(alone, rest):
        value[i], came_from[part] = _walk(value[i], scores, words[part], penalty, came_from.dtype)
    labels = np.zeros(len(words), came_from.dtype)
    current = value.argmax(axis=1)
    for i, part in zip(alone, rest):
        labels[part], current[i] = _walk_back(came_from[part], int(current[i]))
    for t in range(together - 1, -1, -1):
        n = active[t]
        at = offsets[:n] + t
        labels[at] = current[:n]
        current[:n] = came_from[at, current[:n]]
    return labels


def _walk(value: np.ndarray, scores: np.ndarray, words: np.ndarray, penalty: float, kind) -> tuple:
    """Values after the `words` of one text, from those before, and where each came from."""
    v, parts = value.tolist(), []
    languages = range(len(v))
    for start in range(0, len(words), WALK_WORDS):
        came = []
        for row in scores[words[start : start + WALK_WORDS]].tolist():
            best = max(v)
            changed, origin = best - penalty, v.index(best)
            came.append([origin if changed > v[i] else i for i in languages])
            v = [(changed if changed > x else x) + s for x, s in zip(v, row)]
        parts.append(np.array(came, kind).reshape(-1, len(v)))
    return v, np.concatenate(parts)


def _walk_back(came_from: np.ndarray, current: int) -> tuple[np.ndarray, int]:
    """Labels of a text's words that end in `current`, and the label before them."""
    labels = np.empty(len(came_from), came_from.dtype)
    for end in range(len(came_from), 0, -WALK_WORDS):
        start = max(0, end - WALK_WORDS)
        found = []
        for row in reversed(came_from[start:end].tolist()):
            found.append(current)
            current = row[current]
        labels[start:end] = found[::-1]
    return labels, current


@dataclass(frozen=True)
class Labelled:
    """Prediction of one text; spans are (language number, first word, words)."""

    language: str
    score: float
    spans: list[tuple[int, int, int]]


def label_texts(texts: list[str], known: WordScores) -> Iterator[Labelled]:
    """Label `texts` with the languages of a model that knows at least one."""
    numbered, letters = [], []
    for text in texts:
        words = WORD.findall(text.lower())
        if not any(character.isalpha() for word in words for character in word):
            words = []
        numbered.append(known.number(words))
        letters.append(np.fromiter(map(len, words), np.int32, len(words)))
    lengths = np.array([len(words) for words in numbered])
    scores, languages = known.scores(), known.model.languages
    labels = np.zeros(0, int)
    if lengths.sum():
        labels = best_paths(scores, np.concatenate(numbered), lengths)
    end = 0
    for size, weight in zip(lengths.tolist(), letters):
        start, end = end, end + size
        if not size:
            yield Labelled(UNDETERMINED, 0.0, [])
            continue
        path = labels[start:end]
        share = np.bincount(path, weight, len(languages))
        winner = int(share.argmax())
        cuts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), size]
        spans = [(int(path[a]), a, b - a) for a, b in zip(cuts, cuts[1:])]
        yield Labelled(languages[winner], float(share[winner] / share.sum()), spans)
    known.trim()


def _labelled_slices(
    batches: Iterator[pa.RecordBatch], model: LanguageModel
) -> Iterator[tuple[pa.RecordBatch, list[Labelled]]]:
    known = WordScores(model)
    slice_bytes = min(8 << 20, (64 << 20) // max(1, len(model.languages)))
    for batch in batches:
        for part in text_slices(batch, "text", slice_bytes):
            texts = texts_of(part, "text")
            if model.languages:
                yield part, list(label_texts(texts, known))
            else:
                yield part, [Labelled(UNDETERMINED, 0.0, [])] * len(texts)


def identify(documents: DataFrame, model: LanguageModel, spans: bool = True) -> DataFrame:
    """(doc_id, lang_pred, score, spans) of every row of `documents` (doc_id, text).

    `lang_pred` is the language of most letters and `score` its share of them;
    `und` with score 0 if a text is null or has no letter. Of languages with
    equal shares the first by name counts. `spans` are (lang, first_word,
    n_words) over words of letters. Only the text decides; repeated rows are
    predicted alike, an empty table has an empty result.
    """
    kind = "array<struct<lang:string,first_word:bigint,n_words:bigint>>"
    names = ["doc_id", "lang_pred", "score"] + ["spans"] * spans
    arrow = pa.list_(
        pa.struct([("lang", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64())])
    )

    def label(batches):
        for part, found in _labelled_slices(batches, model):
            columns = [
                part.column("doc_id"),
                pa.array([x.language for x in found], pa.string()),
                pa.array([x.score for x in found], pa.float64()),
            ]
            if spans:
                named = [
                    [{"lang": model.languages[i], "first_word": a, "n_words": n} for i, a, n in x.spans]
                    for x in found
                ]
                columns.append(pa.array(named, arrow))
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id bigint, lang_pred string, score double" + f", spans {kind}" * spans
    return documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(label, schema)


def keep_identified(
    documents: DataFrame, model: LanguageModel, min_score: float = MIN_SCORE
) -> DataFrame:
    """The rows of `documents` of which one language has the share `min_score`, all columns.

    A model that knows no language keeps no row.
    """

    def keep(batches):
        for part, found in _labelled_slices(batches, model):
            mask = [x.language != UNDETERMINED and x.score >= min_score for x in found]
            yield pc.filter(part, pa.array(mask, pa.bool_()))

    return documents.mapInArrow(keep, documents.schema)
