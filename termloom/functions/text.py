"""Text columns to arrays of lines, tokens and raw words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values. They decide which strings count as words.
#
# A token is a run free of ASCII whitespace, ASCII digits, '-', '.' and ':',
# reaching from its first to its last word boundary. The class spells out its
# members, since the same class written with \s and \d matches about two times
# slower on JDK 17. The boundary is spelled out because \b differs by JDK.
TOKEN_CHARACTER = r"[^\t\n\x0B\f\r 0-9\-.:]"
WORD_CHARACTER = r"[\p{L}\p{Nd}\p{Mn}_]"
WORD_START = f"(?<!{WORD_CHARACTER})(?={WORD_CHARACTER})"
WORD_END = f"(?<={WORD_CHARACTER})(?!{WORD_CHARACTER})"
# Either end is any boundary, the likelier kind first. The leading look-ahead only
# rejects hopeless positions early.
TOKEN_PATTERN = (
    f"(?={TOKEN_CHARACTER})(?:{WORD_START}|{WORD_END}){TOKEN_CHARACTER}+(?:{WORD_END}|{WORD_START})"
)
LINE_BREAK = r"\r\n?|\n"
BLANKS = r"\t\n\x0B\f\r "
WHITESPACE = f"[{BLANKS}]+"
RAW_WORD_DROPPED = '.:;()",?!<>/'
RAW_WORD_MIN_LENGTH = 4
RAW_WORD_MAX_LENGTH = 32


def tokens(text: Column | str) -> Column:
    """All tokens of a text in order, lower-cased, duplicates kept.

    Explode this expression itself. Naming the array in a `select` first and
    exploding the name makes Spark infer a non-empty filter from it, which
    runs the pattern over every text three times.
    """
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0)), F.lower)


def raw_words(
    text: Column | str,
    min_length: int = RAW_WORD_MIN_LENGTH,
    max_length: int | None = RAW_WORD_MAX_LENGTH,
) -> Column:
    """Words between blanks, punctuation removed, of 4 to 32 characters unless told otherwise."""
    # Twice as fast as `translate`, which looks up each character.
    plain = F.regexp_replace(text, f"[{RAW_WORD_DROPPED}]+", "")
    return F.filter(
        F.transform(F.split(plain, WHITESPACE), F.lower),
        lambda word: F.length(word) >= min_length
        if max_length is None
        else F.length(word).between(min_length, max_length),
    )


def lines(text: Column | str) -> Column:
    """The lines of a text; a final line break opens no further line."""
    parts = F.split(text, LINE_BREAK)
    count = F.size(parts)
    return F.slice(parts, F.lit(1), F.when(F.get(parts, count - 1) == "", count - 1).otherwise(count))


def line_count(text: Column) -> Column:
    """The number of `lines`, without making them."""
    closed = (text == "") | text.endswith("\n") | text.endswith("\r")
    return F.regexp_count(text, F.lit(LINE_BREAK)) + F.when(closed, 0).otherwise(1)


def without_extension(name: Column | str) -> Column:
    """A file name without its last extension."""
    return F.regexp_replace(name, r"\.[^./]*$", "")
