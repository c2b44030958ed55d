"""Hostile pages in linear time, templates against a brute count, and columns with clashing names."""

import collections
import time

import numpy as np
import pytest

from keelstone.llm import html_extract
from keelstone.llm.html_extract import _candidates, main_text, parse_html

MB = 1_000_000
HOSTILE = {
    "unclosed tags": "<a " * (MB // 3),
    "unclosed attributes": '<a x="' * (MB // 6),
    "unclosed attributes before an end": '<a x="' * (MB // 6) + ">",
    "odd quotes": "<a '>" * (MB // 5) + '<b x="',
    "quoted ends": '<a " "><a "' * (MB // 11) + "'",
    "unclosed end tags": "</a " * (MB // 4),
    "unmatched end tags": "<b>" * (MB // 20) + "</i>" * (MB // 20) + "<span>" * (MB // 20) + "</em>" * (MB // 20),
    "items below open spans": "<ul>" + "<b>" * (MB // 10) + "<li></li>" * (MB // 20),
    "rules below open spans": "<p><tr>" + "<b>" * (MB // 10) + "<hr>" * (MB // 10),
    "nested adverts": '<div class="ad">' * (MB // 16) + "<article>x",
    "nested headers": "<article>" + "<header><h1>" * (MB // 12) + "x",
    "nested headings": "<article><header>" + "<h1>" * (MB // 4) + "x",
    "signs": "<" * MB,
    "comments": "<!-" * (MB // 3),
    "open script": "<script>" * (MB // 8),
}


@pytest.mark.parametrize("kind", HOSTILE)
def test_hostile_pages_take_linear_time(kind):
    began = time.process_time()
    root = parse_html(HOSTILE[kind])
    parsed = time.process_time() - began
    main_text(root, {1})
    assert parsed < 2 and time.process_time() - began < 8


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("<p title='a > b'>x</p>", "x"),
        ("<p>a</p><a x=\"1>b<p>c</p>", "a\n\nb\n\nc"),  # a quote that is not closed
        ("<p>1 <2 and <b", "1 <2 and <b"),
        ("a <!-- b -- c", "a"),
        ("x <a y <!-- z", "x <a y"),
        ("<article><header><nav><h2>Menu</h2></nav><h1>Title <h2>sub</h2></h1></header><p>t</p></article>", "Title\n\nsub\n\nt"),
        ("<script>var a = '</p>'; </script x>y", "y"),
    ],
)
def test_odd_pages(source, text):
    assert main_text(parse_html(source)) == text


def pages(spark, rows):
    schema = "page_id long, url string, html string, page string, host string, key string, own string, any string, text string"
    return spark.createDataFrame([(i, u, h, *["mine"] * 6) for i, (u, h) in enumerate(rows)], schema)


def site(rng, host, n):
    bits = [f"<div><p>part {j} of the site</p></div>" for j in range(12)]
    out = []
    for i in range(n):
        around = [bits[j] for j in range(12) if rng.random() < 0.4]
        cut = int(rng.integers(len(around) + 1))
        story = f"<div><p>story {int(rng.integers(n // 2))} of {host} with more words than all parts of this site have together</p><p>{'long ' * 80}</p></div>"
        out.append((f"http://{host}/{i}", "<html><body>" + "".join(around[:cut]) + story + "".join(around[cut:]) + "</body></html>"))
    return out


def brute_text(rows, least):
    """Subtrees of each host, counted over pages with different main parts in plain Python."""
    seen = collections.defaultdict(set)
    for url, source in rows:
        found, main = _candidates(parse_html(source))
        for x in found:
            seen[url.split("/")[2], x.hash].add(main)
    texts = []
    for url, source in rows:
        root = parse_html(source)
        own = {x.hash for x in _candidates(root)[0] if len(seen[url.split("/")[2], x.hash]) >= least}
        texts.append(main_text(root, own))
    return texts


@pytest.mark.parametrize("bound", [1_000_000, 0])  # broadcast, and joined to the pages
def test_templates_against_a_brute_count_and_clashing_names(spark, bound):
    rng = np.random.default_rng(8)
    rows = site(rng, "a.com", 30) + site(rng, "b.com", 14) + site(rng, "c.com", 3)
    df = pages(spark, rows)
    out = html_extract.extract_pages(df, broadcast_subtrees=bound)
    assert out.columns == [c for c in df.columns if c not in ("html", "text")] + ["text"]
    got = {r["page_id"]: r for r in out.collect()}
    want = brute_text(rows, html_extract.MIN_PAGES)
    assert [got[i]["text"] for i in range(len(rows))] == want
    assert any("part" in t for t in want) and any("part" not in t for t in want)
    assert all(r[c] == "mine" for r in got.values() for c in ("page", "host", "key", "own", "any"))
    assert html_extract.extract_pages(df.limit(0), broadcast_subtrees=bound).count() == 0
