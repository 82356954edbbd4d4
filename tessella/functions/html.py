"""Text of HTML elements."""

from __future__ import annotations

import html
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The entities that the plain form knows.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def element_texts(page: Column, element: str = "code", *, breaks: bool = True, entities: list[tuple[str, str]] = ENTITIES) -> Column:
    """Text of each outermost element, in order: breaks become newlines, other tags vanish, entities are resolved.

    Without breaks, these vanish like other tags.
    """
    broken = F.regexp_replace(page, r"(?i)<br\s*/?>", "\n") if breaks else page
    found = F.regexp_extract_all(broken, F.lit(rf"(?is)<{element}(?:\s[^>]*)?>(.*?)</{element}>"), F.lit(1))

    def plain(t: Column) -> Column:
        t = F.regexp_replace(t, r"(?s)<[^>]*>", "")
        for entity, char in entities:
            t = F.replace(t, F.lit(entity), F.lit(char))
        return t

    return F.transform(found, plain)


class _Nodes(HTMLParser):
    """Every node below an element, in document order: text of text nodes, "" for elements."""

    def __init__(self, element: str):
        super().__init__(convert_charrefs=True)
        self.element, self.depth, self.out = element, 0, []

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.handle_data("\n")
        else:
            if self.depth:
                self.out.append("")
            self.depth += tag == self.element

    def handle_endtag(self, tag):
        self.depth -= tag == self.element and self.depth > 0

    def handle_data(self, data):
        if self.depth:
            self.out.append(data)


def node_texts(page: Column, element: str = "code") -> Column:
    """One entry for each node under the elements, as fragment ordinals count them; by a Pandas UDF."""

    @F.pandas_udf("array<string>")
    def run(pages: pd.Series) -> pd.Series:
        def one(text):
            if text is None:
                return None
            nodes = _Nodes(element)
            nodes.feed(text)
            nodes.close()
            return nodes.out

        return pages.map(one)

    return run(page)


def unescape(text: Column) -> Column:
    """All named and numbered character references resolved; by a Pandas UDF."""
    return F.pandas_udf(lambda s: s.map(html.unescape, na_action="ignore"), "string")(text)
