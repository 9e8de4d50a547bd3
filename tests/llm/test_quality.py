import re
from llm_fixtures import texts  # noqa: F401

from termloom.llm import quality

PROSE = " ".join(f"the w{i} of l{i}" for i in range(20))
CASES = [
    (1, PROSE),
    (2, None),
    (3, ""),
    (4, " \n\t "),
    (5, "a b c a b c " * 30),
    (6, "x y z x y z\nx y z\n\nx y z"),
    (7, PROSE + " #$%" * 40),
    (8, "one two"),
    (None, PROSE),
    (1, PROSE),
    (9, "ab\x0bcd\x0cef\rgh é\u00a0ü |x|\n" * 3),
    (10, "word " * 100_000),
]


def slow_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = {w: windows.count(w) for w in set(windows)}
    covered = {i + j for i, w in enumerate(windows) if counts[w] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text or "")),
        len(lines) - len(set(lines)),
        len(covered),
    )


def test_measures_and_verdicts(texts):
    short = [case for case in CASES if case[0] != 10]
    found = sorted(quality.judge(texts(CASES)).collect(), key=str)
    got = sorted(
        (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        for r in found
        if r["doc_id"] != 10
    )
    assert got == sorted(slow_measures(text) for _, text in short)
    kept = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in found}
    assert kept[1] == kept[None] == (False, True)
    assert kept[2] == kept[3] == kept[4] == kept[5] == kept[8] == kept[10] == (True, False)
    assert kept[7] == (False, False)
    long = next(r for r in found if r["doc_id"] == 10)
    assert long["n_repeat_words"] == long["n_words"] == 100_000


def test_the_filter_keeps_whole_rows(texts):
    table = texts(CASES)
    kept = quality.keep_good(table)
    assert kept.columns == table.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "1", "None"]
    assert quality.keep_good(texts([])).count() == 0
    plan = quality.judge(table)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
