"""Line blocks decide: ablations on the tables' pages, pages of other layouts with known text, and malformed pages in linear time."""

import random
import time

import pyarrow.parquet as pq
import pytest

from riskloom.llm import html_extract

DATA = "/root/testdata/sf0.001"
WORDS = "river stone light garden winter market bridge letter morning harbour silver window valley engine forest bread paper music doctor island".split()


def sentence(rng, least=6, most=18):
    return " ".join(rng.choice(WORDS) for _ in range(rng.randint(least, most))).capitalize() + "."


def body(rng, paragraphs):
    return [" ".join(sentence(rng) for _ in range(rng.randint(2, 6))) for _ in range(paragraphs)]


def links(rng, n, tag="li"):
    return "".join(f"<{tag}><a href='/{k}'>{' '.join(rng.choice(WORDS) for _ in range(rng.randint(1, 5)))}</a></{tag}>" for k in range(n))


def page(rng, kind):
    """(html, its text) in one of five layouts, none of which has an article element or names that mark its text."""
    text = body(rng, rng.randint(4, 9))
    head, told = sentence(rng, 3, 6), "".join(f"<p>{t}</p>" for t in text)
    foot = f"<div>&copy; 2024 {rng.choice(WORDS)}</div><div>{links(rng, 4, 'span')}</div>"
    if kind == 0:  # boxes without names
        return f"<body><div>{links(rng, 8)}</div><div><h1>{head}</h1>{told}</div><div>{links(rng, 9)}</div>{foot}</body>", [head, *text]
    if kind == 1:  # a table as layout
        rows = "".join(f"<tr><td>{t}</td></tr>" for t in text)
        return f"<body><table><tr><td>{links(rng, 7, 'div')}</td></tr>{rows}<tr><td>{links(rng, 6, 'div')}</td></tr></table>{foot}</body>", text
    if kind == 2:  # line breaks only
        return f"<body>{links(rng, 6, 'p')}<br>{'<br><br>'.join(text)}<br>{links(rng, 6, 'p')}{foot}</body>", text
    if kind == 3:  # names that say what is beside the text
        menu, talk = f"<div id='top-menu'>{links(rng, 6)}</div>", "".join(f"<div class='comment-body'>{sentence(rng)}</div>" for _ in range(5))
        return f"<body>{menu}<div class='story'><h2>{head}</h2>{told}</div><div class='comments'>{talk}</div>{foot}</body>", [head, *text]
    lists = "".join(f"<ul>{''.join(f'<li>{sentence(rng)}</li>' for _ in range(4))}</ul>" for _ in range(1))  # with a list in the text
    return f"<body><ul>{links(rng, 10)}</ul><section><h1>{head}</h1>{told}{lists}</section><ul>{links(rng, 12)}</ul>{foot}</body>", [head, *text, *[x.split("</li>")[0] for x in lists.split("<li>")[1:]]]


def test_fifty_pages_of_other_layouts():
    rng = random.Random(11)
    found = wanted = right = 0
    for k in range(50):
        html, text = page(rng, k % 5)
        got, want = html_extract.main_text(html).split(), " ".join(text).split()
        same = sum(min(got.count(w), want.count(w)) for w in set(want))
        assert same >= 0.8 * len(want), (k, html_extract.main_text(html))
        found, wanted, right = found + len(got), wanted + len(want), right + same
    assert right >= 0.97 * wanted and right >= 0.97 * found, (right / wanted, right / found)


def test_windows_and_weights_matter(monkeypatch):
    pages = pq.read_table(f"{DATA}/pages.parquet", columns=["html"]).column(0).to_pylist()
    texts = [html_extract.main_text(p) for p in pages]
    with monkeypatch.context() as m:
        m.setattr(html_extract, "stretches", lambda sizes: [(0, len(sizes))])
        assert sum(html_extract.main_text(p) != t for p, t in zip(pages, texts, strict=True)) > 0.8 * len(pages)
    with monkeypatch.context() as m:
        m.setattr(html_extract, "weighted_sizes", lambda lines: [float(len(x.text)) for x in lines])
        assert sum(html_extract.main_text(p) != t for p, t in zip(pages, texts, strict=True)) > 0.5 * len(pages)


@pytest.mark.parametrize("pattern", ['<p x">y"', "<p '\">", "<a b='c\">d", '<p "', "<i x=\"y'>z\" ", "<b \"'\"'>"])
def test_unbalanced_quotes_take_linear_time(pattern):
    began = time.perf_counter()
    html_extract.main_text(pattern * (1_000_000 // len(pattern)))
    assert time.perf_counter() - began < 15


def test_quotes_close_as_the_tag_says():
    assert html_extract.main_text("<p title='a > b'>kept</p>") == "kept"
    assert html_extract.main_text("<p title='a > b>kept</p>") == "b>kept"
    assert html_extract.main_text("<div><p x=\"1>one</p><p y=\"2\">two</p></div>") == html_extract.main_text("<div><p x='1>one</p><p y='2'>two</p></div>")
