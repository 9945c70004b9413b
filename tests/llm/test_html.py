import random
import re
import time

import pytest

from graphloom.llm import html

P = "This is a paragraph of an article, with commas, and more than enough words to count as text."


def page(body):
    return f"<html><head><title>A &amp; B</title><script>var x = '<p>no</p>';</script></head><body>{body}</body></html>"


def test_article_without_its_surroundings():
    links = "".join(f"<li><a href='/{i}'>Some link, number {i}</a></li>" for i in range(30))
    title, text, score, n = html.extract(page(f"<nav><ul>{links}</ul></nav><div id='content'><h1>Head</h1><p>{P}<p>{P} <b>Bold</b>, yes.</div><div class='sidebar'><p>{P[:40]}</p></div><footer><p>Footer text, with commas, and words.</p></footer>"))
    assert title == "A & B" and score > 0 and n == 3
    assert text == f"Head\n{P}\n{P} Bold, yes."


def test_siblings_are_kept():
    text = html.extract(page(f"<div><p>{P}</p><p>{P}</p></div><div><p>{P}</p></div><div>short</div>"))[1]
    assert text.count(P) == 3 and "short" not in text


def test_links_count_against_a_container():
    linked = "".join(f"<p><a href='#'>{P}</a></p>" for _ in range(6))
    assert html.extract(page(f"<div>{linked}</div><div><p>{P}</p><p>{P}</p></div>"))[1].startswith(P)


@pytest.mark.parametrize("raw", [None, "", "   ", "<p>", "<script>x", "<!-- a", "<html><body></body></html>"])
def test_pages_without_text(raw):
    assert html.extract(raw)[1:] == ("", 0.0, 0)


def test_broken_markup():
    assert html.extract("plain text only")[1] == "plain text only"
    assert P in html.extract(f"<div><p>{P}<p>{P}</b></i></span><td>x")[1]
    assert "a < b" in html.extract(f"<div><p>{P} a < b</p></div>")[1]


def test_depth_and_length():
    began = time.time()
    deep = "<div>" * 20_000 + f"<p>{P}</p>"
    assert html.extract(deep)[1] == P
    assert html.extract(f"<div>{f'<p>{P}</p>' * 20_000}</div>")[3] == 20_000
    for bad in ("<" * 100_000, "<a " * 50_000, "<!--" * 50_000, "<script>" * 20_000, "<p class='" * 20_000):
        html.extract(bad)
    assert time.time() - began < 60


def test_tables(spark):
    pages = spark.createDataFrame([(1, "u", page(f"<p>{P}</p>")), (1, "u", page(f"<p>{P}</p>")), (None, None, None), (2, "v", "")], "page_id long, url string, html string").selectExpr("*", "1 AS title", "2 AS text")
    got = sorted(((str(r["page_id"]), r["text"]) for r in html.extract_pages(pages).collect()))
    assert got == [("1", P), ("1", P), ("2", ""), ("None", "")]
    assert html.extract_pages(pages.limit(0)).count() == 0


@pytest.mark.parametrize("head", ["<head><title>t</title>", "<head><meta charset=utf-8><title>t", "<title>t", "<head><title>t</title><link rel=x><style>p {}</style>"])
@pytest.mark.parametrize("body", ["<body>", "<BODY class=x>", "", "<div>", "<span>s</span>"])
def test_a_head_that_is_left_open(head, body):
    title, text, score, _ = html.extract(f"<html>{head}{body}<p>{P}</p><p>{P}")
    assert title.startswith("t") and text.count(P) == 2 and score > 0


def test_text_ends_a_head():
    assert html.extract(f"<head><title>t</title>{P}")[:2] == ("t", P)
    assert html.extract(f"<head><title>t</title><b>{P}</b>")[:2] == ("t", P)
    assert html.extract(f"<head><title>a <b>x</b></title></head><body><p>{P}</p>")[1] == P


def test_paragraphs_in_divs_and_between_blank_lines():
    teaser = "<div class=top><p>Read this teaser, it is thirty-nine ch.</p></div>"
    assert html.extract(page(teaser + "<div>" + "<br><br>".join([P] * 10) + "</div>"))[1:4:2] == ("\n".join([P] * 10), 10)
    assert html.extract(page(teaser + "<div>" + f"<div>{P}<br></div>" * 10 + "</div>"))[1] == "\n".join([P] * 10)
    assert html.extract(page(teaser + "<section>" + f"{P}<h2>Head</h2>" * 5 + "</section>"))[1].count(P) == 5
    assert html.extract("<div>one<br>two<br/></div>")[1] == "one\ntwo"


def grow(r, depth):
    """A random tree of (tag, children), children being texts or trees."""
    text = lambda: " ".join(r.choice(["word", "longer,", "clause,", "and", "more."]) for _ in range(r.randint(1, 30)))
    if depth == 0 or r.random() < 0.3:
        return (r.choice(["p", "p", "div"]), [("a", [text()]) if r.random() < 0.15 else text() for _ in range(1)])
    return (r.choice(["div", "article", "section"]), [grow(r, depth - 1) for _ in range(r.randint(1, 4))])


def markup(x):
    return x if isinstance(x, str) else f"<{x[0]}>{''.join(map(markup, x[1]))}</{x[0]}>"


def naive(body):
    """Best score and text by the definition, on trees of grow()."""
    bonus = {"article": 8.0, "section": 3.0, "div": 3.0}
    nodes = []

    def walk(x, path):
        me = len(nodes)
        nodes.append((x[0], path))
        inner = [(c, True) if isinstance(c, str) and x[0] == "a" else (c, False) if isinstance(c, str) else None for c in x[1]]
        texts = [t for t in inner if t]
        leaves = [(me, c) for c in x[1] if isinstance(c, str)]
        for c in x[1]:
            if not isinstance(c, str):
                below, more = walk(c, [*path, me])
                texts += below
                leaves += more
        info[me] = texts
        return texts, leaves

    info = {}
    _, leaves = walk(body, [])
    size = {i: sum(len(t) for t, _ in x) for i, x in info.items()}
    links = {i: sum(len(t) for t, a in x if a) for i, x in info.items()}
    score = {}
    blocks = {p for i, (tag, path) in enumerate(nodes) if tag != "a" for p in path[-1:]}
    paragraph = {i for i, (tag, _) in enumerate(nodes) if tag == "p" or tag == "div" and i not in blocks}
    for i in sorted(paragraph):
        if size[i] >= 25:
            points = (1 + sum(t.count(",") for t, _ in info[i]) + min(size[i] / 100, 3)) * (1 - links[i] / size[i])
            for k, up in enumerate(reversed(nodes[i][1][-2:])):
                score[up] = score.get(up, bonus.get(nodes[up][0], 0.0)) + points / (1 + k)
    final = {i: s * (1 - links[i] / size[i]) for i, s in score.items()}
    if not final:
        return 0.0, "\n".join(t for _, t in leaves)
    best = max(final, key=lambda i: (final[i], -i))
    chosen = {best}
    for i, (tag, path) in enumerate(nodes):
        if i != best and path and nodes[best][1] and path[-1] == nodes[best][1][-1]:
            if final.get(i, -1e9) >= max(5.0, 0.2 * final[best]) or i in paragraph and size[i] > 80 and links[i] / size[i] < 0.25:
                chosen.add(i)
    return round(final[best], 6), "\n".join(t for i, t in leaves if chosen & {i, *nodes[i][1]})


def test_against_a_naive_version():
    r = random.Random(3)
    for _ in range(400):
        tree = ("body", [grow(r, r.randint(1, 4)) for _ in range(r.randint(1, 4))])
        _, text, score, _ = html.extract(f"<html><head><title>t</title></head>{markup(tree)}</html>")
        want = naive(tree)
        assert score == pytest.approx(want[0], abs=1e-5) and text == re.sub(r" +", " ", want[1])
