"""Pages that leave out the end tag of their head."""

import pytest

from keelstone.llm.html_extract import main_text, parse_html


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("<html><head><title>T</title><body><nav>Menu</nav><article><p>Whole</p></article>", "Whole"),
        ("<head><meta charset=utf-8><link rel=icon><article>No body tag</article>", "No body tag"),
        ("<head><title>T</title>Only <b>text</b>", "Only text"),
        ("<head><script>1</script>\n<title>T</title><p>One<p>Two", "One\n\nTwo"),
        ("<head><title>T</title> <style>p {}</style></head><body><p>Closed</p>", "Closed"),
    ],
)
def test_an_open_head_ends_where_the_body_starts(source, text):
    assert main_text(parse_html(source)) == text
