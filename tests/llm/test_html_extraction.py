import random
import re
import time

import pytest

from termloom.llm import html_extraction
from termloom.llm.html_extraction import extract, main_text

TEXT = "Some words of the story, with commas, and length enough to count for a paragraph."


@pytest.mark.parametrize(
    "page, expected",
    [
        ("", ""),
        ("plain words", "plain words"),
        (
            f"<body><nav><a href=/>Home</a></nav><div class='ad'>Buy this, now, all.</div><article>"
            f"<h1>A &amp; B</h1><p><b>{TEXT}<br>x<p>a<i>b</i>\n c</article><footer>&copy; Me</footer>",
            f"A & B {TEXT} x ab c",
        ),
        (
            f"<div id=top><ul><li><a>One</a></li><li><a>Two</a></li></ul></div><div class=content><p>{TEXT}</p>"
            f"<p>{TEXT}</p><div class='comments'><p>{TEXT} no</p></div></div><div class=sidebar><p>{TEXT}</p></div>",
            f"{TEXT} {TEXT}",
        ),
        (f"<main><script>if (a<b) x('</p>')</script><style>p{{}}</style><p>{TEXT}<!-- <p>no</p> --></main>", TEXT),
        (f"<article><p>{TEXT}</p><form><input><p>Sign up, please</p></form><p>short</p>", f"{TEXT} short"),
        (f'<article><p title="a>b">{TEXT}</p><p>1 < 2 &lt;b&gt;</p><table><tr><td>x<td>y</table></article>',
         f"{TEXT} 1 < 2 <b> x y"),
    ],
)
def test_main_text(page, expected):
    assert main_text(page) == expected


def test_pages(spark):
    page = f"<article><p>{TEXT}</p></article>"
    rows = [(1, "u", page, "t"), (1, "u", page, "t"), (2, None, None, "t"), (None, "v", "<nav>x</nav>", "t")]
    rows.append((3, "u", "<article>" + f"<p>{TEXT}</p>" * 20_000, "t"))
    table = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    found = sorted((str(r["page_id"]), r["n_chars"], r["text"][:4]) for r in extract(table).collect())
    n = len(TEXT)
    assert found == [("1", n, "Some"), ("1", n, "Some"), ("2", 0, ""), ("3", (n + 1) * 20_000 - 1, "Some"), ("None", 0, "")]
    assert extract(table.limit(0)).collect() == []


def slow_tree(page):
    """(name, text or children) by a list of open elements, searched through for every tag."""
    open_, top = [("#root", [])], html_extraction
    position = 0
    while position < len(page):
        match = top.TOKEN.search(page, position)
        text = page[position : match.start() if match else len(page)]
        if text:
            open_[-1][1].append(text)
        if not match:
            break
        position = match.end()
        if match[2] is None:
            continue
        name = match[2].lower()
        if match[1]:
            for i in range(len(open_) - 1, 0, -1):
                if open_[i][0] == name:
                    del open_[i:]
                    break
                if open_[i][0] in ("td", "th") and name not in top.BLOCK:
                    break
            continue
        if name in top.P_CLOSERS:
            for i in range(len(open_) - 1, 0, -1):
                if open_[i][0] == "p":
                    del open_[i:]
                    break
                if open_[i][0] in top.BLOCK:
                    break
        if name in top.ITEM_CLOSES:
            last = None
            for i in range(len(open_) - 1, 0, -1):
                if open_[i][0] in top.ITEM_BOUNDARY[name]:
                    break
                if open_[i][0] in top.ITEM_CLOSES[name]:
                    last = i
            if last:
                del open_[last:]
        element = (name, [])
        open_[-1][1].append(element)
        slash = match[3].rstrip().endswith("/")
        if name in top.RAW_TEXT:
            found = re.search(rf"(?i)</{name}(?=[\s/>])[^>]*>?", page[position:])
            position = position + found.end() if found else len(page)
        elif name not in top.VOID and (not slash or name in top.BLOCK | top.DROPPED):
            open_.append(element)
    return open_[0]


def tree_of(element):
    return (element.name, [c if isinstance(c, str) else tree_of(c) for c in element.children])


def test_trees_equal_those_of_a_plain_parser():
    rng = random.Random(6)
    names = ["p", "div", "b", "li", "ul", "table", "tr", "td", "th", "dt", "dd", "dl", "a", "article", "br", "script", "h2", "option", "x"]
    for _ in range(400):
        page = ""
        for _ in range(rng.randint(0, 40)):
            name = rng.choice(names)
            page += rng.choice([f"<{name}>", f"<{name}>", f"</{name}>", f"<{name} />", "text ", "<!-- c -->", "< "])
        assert tree_of(html_extraction.parse(page)) == slow_tree(page), page


@pytest.mark.parametrize("page", ["<b></x>", "<b><p></p></x>", "<li>", "<div></p>", "<td><b></tr>", "<i>"])
def test_broken_markup_takes_linear_time(page):
    started = time.process_time()
    main_text(page * 50_000)
    assert time.process_time() - started < 10
