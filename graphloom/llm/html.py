"""Operator 9, HTML extraction by tree scoring.

A page is tokenised into tags and text and built into a tree (unclosed heads, paragraphs and list items end where HTML says;
scripts, styles and comments are skipped). Each paragraph gives its parent, and half as much its grandparent, a point,
a point per comma, and up to three for length, all less its own link density. An element such as div that holds one run
of text is a paragraph; where it holds several, parted by blocks or blank lines (two br), each is one within it. A
container's score is discounted by its link density; the best container is kept, with the siblings that score at least a
fifth of it or are long, link-poor paragraphs. A br ends a line.

Results, case by case: a null or empty page, or one without text, gives an empty text with score 0; null ids and urls
are carried; ties go to the container that begins first; repeated rows are extracted each for itself; nesting may be of
any depth; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OPEN = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][\w:-]*))")
_STOP = re.compile(r"[>\"']")
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in "script style noscript template svg iframe textarea select".split()}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_HEAD = frozenset("head title meta link base basefont bgsound noframes".split())  # and what is skipped anyway
_PARAGRAPH = frozenset("p pre td blockquote".split())
_LEAF = frozenset("center dd div".split())  # paragraphs too, if they hold nothing but one run of text
_RUNS = frozenset("#root article body center dd div html main section".split())  # whose other runs of text count as paragraphs within them
_CONTAINER = frozenset("article aside body blockquote center dd div dl fieldset figure footer form header html li main nav ol section table tbody td tr ul".split())
_UNLIKELY = re.compile(r"(?i)\b(?:ad|ads|advert\w*|banner|breadcrumb\w*|combx|comment\w*|cookie\w*|disqus|footer|menu|nav\w*|pager|popup|promo\w*|related|share|sidebar|social|sponsor\w*|subscribe)\b")
_LIKELY = re.compile(r"(?i)\b(?:article|body|content|entry|main|post|story|text)\b")
_ATTR = re.compile(r"""(?i)\b(?:class|id)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
_TAG_BONUS = {"article": 8.0, "main": 8.0, "section": 3.0, "div": 3.0, "pre": 3.0, "td": 3.0, "blockquote": 3.0, "form": -3.0, "ol": -3.0, "ul": -3.0, "dl": -3.0, "nav": -15.0, "footer": -15.0, "aside": -10.0, "header": -5.0}
_SPACES = re.compile(r"\s+")


def tokens(html: str) -> Iterator[tuple[bool, str | None, str, int, int]]:
    """(end tag, name, attributes, start, end) of each tag, and with name None of comments, declarations and elements whose content isn't read.

    One pass: a tag ends at the first > outside quotes. Where quotes run to the end of the page they are not believed any
    more, neither there nor later; where no > is left, what remains is text.
    """
    at, quoted = 0, True
    while True:
        m = _OPEN.search(html, at)
        if m is None:
            return
        start, i = m.start(), m.end()
        if m[1]:
            end = html.find("-->", i)
            at = len(html) if end < 0 else end + 3
            yield False, None, "", start, at
            continue
        end = -1
        while quoted and not m[2]:
            stop = _STOP.search(html, i)
            if stop is None:
                break
            if stop[0] == ">":
                end = stop.start()
                break
            i = html.find(stop[0], stop.end()) + 1
            if not i:
                break
        if end < 0:
            quoted = quoted and bool(m[2])
            end = html.find(">", m.end())
        if end < 0:
            return
        at = end + 1
        if m[2]:
            yield False, None, "", start, at
            continue
        name = m[4].lower()
        if name in _RAW and not m[3]:
            close = _RAW[name].search(html, at)
            at = close.end() if close else len(html)
            yield False, None, "", start, at
        else:
            yield bool(m[3]), name, html[m.end() : end], start, at


def extract(html: str | None) -> tuple[str, str, float, int]:
    """Title, text, score and number of paragraphs of a page."""
    if not html:
        return "", "", 0.0, 0
    tag, parent, attrs, texts = ["#root"], [-1], [""], []  # texts: (node, text) in order; text None is a line break
    stack = [0]
    opened: dict[str, int] = {}  # open elements by name: an end tag without one is skipped
    title, pos = "", 0

    def add(raw: str) -> None:
        t = _SPACES.sub(" ", unescape(raw) if "&" in raw else raw)
        if tag[stack[-1]] == "head" and t.strip():
            leave(len(stack) - 1)
        if t and t != " ":
            texts.append((stack[-1], t))
        elif t and texts and texts[-1][1] is not None:
            texts.append((stack[-1], " "))

    def leave(i: int) -> None:
        for k in stack[i:]:
            opened[tag[k]] -= 1
        del stack[i:]

    def close(names: frozenset[str] | set[str], fence: frozenset[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if tag[stack[i]] in names:
                leave(i)
                return
            if tag[stack[i]] in fence:
                return

    for slash, name, attributes, start, end in tokens(html):
        if start > pos:
            add(html[pos:start])
        pos = end
        if name is None:
            continue
        if name == "br":
            texts.append((stack[-1], None))
            continue
        if slash:
            if not opened.get(name):
                continue
            for i in range(len(stack) - 1, 0, -1):
                if tag[stack[i]] == name:
                    leave(i)
                    break
                if tag[stack[i]] in ("td", "table", "body") and name not in _BLOCK:
                    break
            continue
        if name not in _HEAD and (opened.get("head") or opened.get("title")) and (name in _BLOCK or not opened.get("title")):
            leave(next(i for i, k in enumerate(stack) if tag[k] in ("head", "title")))
        if name in _BLOCK:
            close({"p"}, _BLOCK - {"p"})
            if name == "li":
                close({"li"}, frozenset(("ul", "ol")))
            elif name in ("td", "th"):
                close({"td", "th"}, frozenset(("tr", "table")))
            elif name == "tr":
                close({"tr"}, frozenset(("table",)))
            elif name in ("dd", "dt"):
                close({"dd", "dt"}, frozenset(("dl",)))
        tag.append(name)
        parent.append(stack[-1])
        attrs.append(attributes)
        if name not in _VOID and not attributes.endswith("/"):
            stack.append(len(tag) - 1)
            opened[name] = opened.get(name, 0) + 1
    if pos < len(html):
        add(html[pos:])

    n = len(tag)
    length, commas, linked, pieces = [0] * n, [0] * n, [0] * n, [[] for _ in range(n)]
    inside_title = [False] * n
    in_link = [False] * n
    for i in range(1, n):
        inside_title[i] = tag[i] in ("title", "head") or inside_title[parent[i]]
        in_link[i] = tag[i] == "a" or in_link[parent[i]]
    order = []
    block = [0] * n  # the nearest block element
    parts = [False] * n  # has block elements below it, or a blank line
    for i in range(1, n):
        block[i] = i if tag[i] in _BLOCK else block[parent[i]]
        if tag[i] in _BLOCK:
            parts[block[parent[i]]] = True
    runs: list[list[int]] = []  # block element, length, commas, length in links
    breaks, last = 0, None
    for node, t in texts:
        if inside_title[node]:
            title += t or "" if tag[node] == "title" else ""
            continue
        if t is None:
            breaks += 1
            order.append((node, t))
            continue
        size = len(t.strip())
        if size:
            if breaks > 1 and block[node] == last:
                parts[last] = True
            if breaks > 1 or block[node] != last:
                runs.append([block[node], 0, 0, 0])
            breaks, last = 0, block[node]
            for k, x in enumerate((size, t.count(","), size * in_link[node]), 1):
                runs[-1][k] += x
        length[node] += size
        commas[node] += t.count(",")
        if in_link[node]:
            linked[node] += size
        order.append((node, t))
    for i in range(n - 1, 0, -1):
        p = parent[i]
        length[p] += length[i]
        commas[p] += commas[i]
        linked[p] += linked[i]
    if not length[0]:
        return title.strip(), "", 0.0, 0
    score: dict[int, float] = {}
    holder = [-1] * n  # the nearest container above
    for i in range(1, n):
        holder[i] = parent[i] if parent[i] <= 0 or tag[parent[i]] in _CONTAINER else holder[parent[i]]

    def give(i: int, points: float) -> None:
        if i not in score:
            score[i] = _TAG_BONUS.get(tag[i], 0.0)
            known = " ".join(a or b or c for a, b, c in _ATTR.findall(attrs[i]))
            if known:
                score[i] += 8.0 * bool(_LIKELY.search(known)) - 15.0 * bool(_UNLIKELY.search(known))
        score[i] += points

    def credit(up: int, size: int, marks: int, links: int) -> None:
        points = (1.0 + marks + min(size / 100.0, 3.0)) * (1.0 - links / size)
        if up >= 0:
            give(up, points)
            if up > 0:
                give(parent[up], points / 2.0)

    unlikely = lambda i: any(_UNLIKELY.search(a or b or c) for a, b, c in _ATTR.findall(attrs[i]))
    leaf = [tag[i] in _LEAF and not parts[i] for i in range(n)]
    for i in range(1, n):
        if length[i] >= 25 and (tag[i] in _PARAGRAPH and not (tag[i] == "td" and commas[i] == 0 and length[i] < 80) or leaf[i] and not unlikely(i)):
            credit(holder[i], length[i], commas[i], linked[i])
    for i, size, marks, links in runs:
        if tag[i] in _RUNS and not leaf[i] and size >= 25:
            credit(i, size, marks, links)
    density = lambda i: linked[i] / length[i] if length[i] else 1.0
    final = {i: s * (1.0 - density(i)) for i, s in score.items()}
    if final:
        best = max(final, key=lambda i: (final[i], -i))
        top = final[best]
    else:
        best, top = next((i for i in range(n) if tag[i] == "body"), 0), 0.0
    chosen = {best}
    if best > 0:
        for i in range(1, n):
            if parent[i] == parent[best] and i != best:
                if final.get(i, -1e9) >= max(5.0, 0.2 * top) or (tag[i] == "p" or leaf[i] and not unlikely(i)) and length[i] > 80 and density(i) < 0.25:
                    chosen.add(i)
    keep = [False] * n
    dropped = {i for i in range(1, n) if tag[i] in ("nav", "footer", "aside", "form", "button") or final.get(i, 0.0) < 0}
    for i in range(n):
        keep[i] = i in chosen or (parent[i] >= 0 and keep[parent[i]] and i not in dropped)
    lines, last = [], None
    for node, t in order:
        if keep[node]:
            if block[node] != last or t is None:
                lines.append([])
                last = block[node]
            lines[-1].append(t or "")
    shown = [x for x in (_SPACES.sub(" ", "".join(p)).strip() for p in lines) if x]
    return title.strip(), "\n".join(shown), round(top, 6), len(shown)


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, title, text, score, n_blocks) for every page."""
    id_type = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                title, text, score, n = zip(*map(extract, batch.column("html").to_pylist()))
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(title), pa.array(text), pa.array(score, pa.float64()), pa.array(n, pa.int32())], names=["page_id", "url", "title", "text", "score", "n_blocks"])

    return pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, f"page_id {id_type}, url string, title string, text string, score double, n_blocks int")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
