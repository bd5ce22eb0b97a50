"""Column functions on HTML. Regular expressions where they define the result; a tree parser (``visible_text``) where nesting matters."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .links import HOSTS, strip
from .parts import small_parts

PARAGRAPH = r"(?is)<p(?:\s[^>]*)?>(.*?)</p>"
HREF = r'<a href="([^"]*)"'
SRC = r'<img[^>]*?\ssrc="([^"]*)"'
# Which parts of a page are no text, and which element holds its text, first match first.
HIDDEN = ("script", "style", "nav", "footer", "header")
CONTAINERS = (("id", "content"), ("id", "bodyContent"), ("class", "mw-body-content"), ("id", "mw-content-text"))
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, r"<[^>]*>", "")


def unescape(text: Column) -> Column:
    """The named entities of running text; ``&amp;`` last, so that nothing is decoded twice."""
    for name, char in ENTITIES.items():
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def paragraph_text(html: Column) -> Column:
    """Text of the first ``<p>``, untrimmed; null if there is none."""
    return F.when(html.rlike(PARAGRAPH), unescape(strip_tags(F.regexp_extract(html, PARAGRAPH, 1))))


def first_paragraph(html: Column) -> Column:
    """The first paragraph without newlines, trimmed; null without a ``<p>``."""
    return strip(F.regexp_replace(paragraph_text(html), r"[\r\n]", ""))


def first_sentence(html: Column) -> Column:
    """What the first paragraph holds before ``。``, ``？``, ``！`` or a newline; ``N/A`` if that is empty."""
    head = strip(F.split(paragraph_text(html), "[。？！\n]")[0])
    return F.coalesce(F.nullif(head, F.lit("")), F.lit("N/A"))


def drop_tables(html: Column) -> Column:
    return F.regexp_replace(html, r"(?is)<table.*?</table>", "")


def description(html: Column, define: Column | None = None) -> Column:
    """The first paragraph outside tables; ``define`` if it is empty, null without a ``<p>``."""
    text = first_paragraph(drop_tables(html))
    return F.when(text == "", define if define is not None else F.lit("")).otherwise(text)


def html_to_text(html: Column) -> Column:
    """Text without hidden parts, comments and tags, white space folded: the flat form of ``visible_text``."""
    body = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    for tag in HIDDEN:
        body = F.regexp_replace(body, rf"(?is)<{tag}(?:\s[^>]*)?>.*?</{tag}>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(body, r"<[^>]*>", " "), r"[ \t\r\n]+", " "))


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(HREF), F.lit(1))


def image_sources(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(SRC), F.lit(1))


def rewrite_anchors(html: Column, host: str = HOSTS["en"]) -> Column:
    """Anchors with plain text that lead to articles get an absolute href."""
    return F.regexp_replace(html, r'<a href="(/wiki/[^"]*)"([^>]*)>([^<]+)</a>', f'<a href="{host}$1"$2>$3</a>')


def strip_srcset(html: Column) -> Column:
    return F.regexp_replace(html, r'\s+srcset="[^"]*"', "")


def data_uri(image: Column) -> Column:
    return F.concat(F.lit("data:image/jpeg;base64,"), image)


class Page(HTMLParser):
    """Collects the text of the whole page, of its body and of the first element of each container kind."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, list[str]]] = []
        self.seen: dict[str, list[str]] = {"": []}
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            return
        given = {k: v or "" for k, v in attrs}
        # a container is a div; an id is one value, a class several
        of = {"id": [given.get("id", "")], "class": given.get("class", "").split()} if tag == "div" else {}
        places = [f"{k}={v}" for k, v in CONTAINERS if v in of.get(k, [])] + (["body"] if tag == "body" else [])
        places = [p for p in places if p not in self.seen and not self.hidden]
        self.seen.update({p: [] for p in places})
        self.hidden += tag in HIDDEN
        self.open.append((tag, tag in HIDDEN, places))

    def handle_endtag(self, tag: str) -> None:
        if any(t == tag for t, *_ in self.open):
            while self.open:
                name, hides, _ = self.open.pop()
                self.hidden -= hides
                if name == tag:
                    break

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            for place in ["", *(p for *_, ps in self.open for p in ps)]:
                self.seen[place].append(data)

    def text(self) -> str:
        order = [f"{k}={v}" for k, v in CONTAINERS] + ["body", ""]
        parts = next(self.seen[p] for p in order if p in self.seen)
        lines = (line.strip() for line in "\n".join(parts).splitlines())
        return "\n".join(line for line in lines if line)


def page_text(html: str | None) -> str | None:
    if html is None:
        return None
    page = Page()
    page.feed(html)
    page.close()
    return page.text()


@F.arrow_udf(StringType())
def visible_text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The lines of a page's main container (else body, else everything) without hidden parts and comments."""
    for batch in batches:
        for (pages,) in small_parts([batch]):
            yield pa.array([page_text(h) for h in pages.to_pylist()], pa.string())
