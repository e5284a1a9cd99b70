"""Main text of pages with sections, several articles, equal ratios and very deep nesting."""

from __future__ import annotations

import random
import time

import pytest

from siftline.llm import html_text as H
from siftline.llm.html_text import main_text

NAV, FOOT = '<nav><a href="/">Home</a> <a href="/x">News</a></nav>', "<footer><p>Imprint and more words here for all</p></footer>"


def page(rng, tag):
    words = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta"]) for _ in range(n))
    parts = [[f"{words(rng.randrange(5, 60))}." for _ in range(rng.randrange(1, 6))] for _ in range(rng.randrange(2, 6))]
    body = "".join(f"<{tag}>" + "".join(f"<p>{p}</p>" for p in own) + f"</{tag}>" for own in parts)
    return body, " ".join(p for own in parts for p in own)


@pytest.mark.parametrize("tag", ["section", "div", "article"])
def test_all_sections_and_articles_are_whole(tag):
    rng = random.Random(5)
    for _ in range(200):
        body, want = page(rng, tag)
        assert main_text(f"<html><body>{NAV}<div id='c'>{body}</div>{FOOT}</body></html>") == want
        assert main_text(f"<html><body>{NAV}{body}{FOOT}</body></html>") == want


def test_equal_ratios_lose_nothing():
    for n in (1, 2, 3, 4, 8, 10, 20, 50, 100):
        assert main_text("<div><p>x y z</p>" * n) == " ".join(["x y z"] * n)
        assert main_text("<div><p>some words of text</p></div>" * n) == " ".join(["some words of text"] * n)


def test_deep_pages_take_time_in_proportion():
    for form in ("<div>{}", "<div><p>{}", "<span><b>{}</section>", "<section><div>{}</section>"):
        start = time.time()
        text = main_text(form.format("x") * 20_000)
        assert text.replace(" ", "") == "x" * 20_000 and time.time() - start < 8


def test_ratios_decide_where_names_say_nothing(monkeypatch):
    """Anonymous elements without links: short bare lines around long ones are no content, unless all ratios are made equal."""
    rng = random.Random(3)
    words = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(n))
    body = [words(60) for _ in range(8)]
    html = "<div>" + "".join(f"<div><i>{x}</i><i>{x}</i><i>{x}</i></div>" for x in ("Home", "News", "Sport", "About", "More", "Next")) + "</div><div>" + "".join(f"<div>{b}</div>" for b in body) + "</div>"
    assert main_text(html).endswith(" ".join(body)) and "NewsNewsNews" not in main_text(html)  # smoothing takes the line next to the text along
    monkeypatch.setattr(H.Line, "ratio", property(lambda self: 1.0))
    assert "NewsNewsNews" in main_text(html)


def test_articles_keep_their_borders():
    html = f"<body><main><article><h1>T</h1><p>first text here</p></article><article><p>second one</p></article><p>not in any</p><article class='comment'><p>reader</p></article></main>{FOOT}</body>"
    assert main_text(html) == "T first text here second one"
