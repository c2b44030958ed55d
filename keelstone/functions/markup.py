"""Text of html by an event parser (F18), as an Arrow-batched function."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements whose content is no text of the page.
SKIPPED = ("script", "style", "nav", "header", "footer")
_BREAKS = {"p": "\n\n", "li": "\n- "} | {f"h{i}": "\n\n## " for i in range(1, 7)}


class _Events(HTMLParser):
    """Collects text outside skipped elements, with breaks before paragraphs, items and headings."""

    def __init__(self):
        super().__init__()
        self.out: list[str] = []
        self.skipped = self.verbatim = 0

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.skipped += 1
        elif tag == "pre":
            self.verbatim = 1
        else:
            self.out.append(_BREAKS.get(tag, ""))

    def handle_endtag(self, tag):
        if tag in SKIPPED and self.skipped:
            self.skipped -= 1
        elif tag == "pre":
            self.verbatim = 0

    def handle_data(self, data):
        if not self.skipped:
            self.out.append(data if self.verbatim else re.sub(r"\s+", " ", data).strip())


def event_text(source: str | None) -> str:
    parser = _Events()
    parser.feed(source or "")
    parser.close()
    return "".join(parser.out).strip()


def html_event_text(source: Column) -> Column:
    """the text of each page."""

    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(event_text)

    return run(source)
