"""Column functions on links: normal forms, titles, page kinds, file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How links to encyclopedia pages look.
ARTICLE = "wikipedia.org/wiki/"
HOSTS = {"zh": "https://zh.wikipedia.org", "en": "https://en.wikipedia.org"}
SPECIAL = r"/(Special|Template|Help):"
IMAGE = "/File:"


def strip(text: Column) -> Column:
    """Without white space at both ends, ideographic spaces included."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def percent_decode(text: Column) -> Column:
    """Percent escapes decoded, ``+`` kept; text with a malformed escape stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def after_wiki(link: Column) -> Column:
    return F.regexp_extract(link, r"(?s)^.*?/wiki/(.*)$", 1)


def cut_url(link: Column) -> Column:
    """The link before its first ``#`` or ``?``."""
    return F.regexp_extract(link, r"(?s)^[^#?]*", 0)


def normalize_v1(link: Column) -> Column:
    """The decoded title of an article link, any other link trimmed; null is empty."""
    link = strip(F.coalesce(link, F.lit("")))
    return F.when(link.contains(ARTICLE), percent_decode(after_wiki(link))).otherwise(link)


def normalize_v2(link: Column) -> Column:
    """As ``normalize_v1``, with titles cut before the first ``#`` or ``?``."""
    link = strip(F.coalesce(link, F.lit("")))
    return F.when(link.contains(ARTICLE), percent_decode(cut_url(after_wiki(link)))).otherwise(link)


def title_from_url(link: Column) -> Column:
    """The title of an article link; null and empty links have none."""
    return F.when(F.coalesce(link, F.lit("")) != "", normalize_v2(link))


def clean_link(link: Column) -> Column:
    """List numbers (``3.``, ``3)``), option marks and ``link:`` before a link are dropped, in this order."""
    out = strip(link)
    for prefix in (r"(?U)^\d+[.)]\s*", r"(?U)^选项\d+[：:]\s*", r"(?iU)^link[：:]\s*"):
        out = F.regexp_replace(out, prefix, "")
    return strip(out)


def entity_id(uri: Column) -> Column:
    """What follows the last slash."""
    return F.element_at(F.split(uri, "/"), -1)


def first_url(text: Column) -> Column:
    """The first http(s) address, up to white space; null if there is none."""
    return F.nullif(F.regexp_extract(text, r"(?U)https?://[^\s]+", 0), F.lit(""))


def qid(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"Q\d+", 0), F.lit(""))


def page_language(link: Column) -> Column:
    """zh or en by the link's host; null for any other link."""
    return F.when(link.startswith(HOSTS["zh"] + "/wiki/"), "zh").when(link.startswith(HOSTS["en"] + "/wiki/"), "en")


def is_special_page(link: Column) -> Column:
    return link.rlike(SPECIAL)


def is_image_page(link: Column) -> Column:
    return link.contains(IMAGE)


def article_hrefs(hrefs: Column) -> Column:
    """Of an array of hrefs those that lead to articles."""
    return F.filter(hrefs, lambda h: h.startswith("/wiki/") & ~h.startswith("/wiki/File:"))


def remote_images(sources: Column) -> Column:
    """Of an array of image sources the protocol-relative ones."""
    return F.filter(sources, lambda s: s.startswith("//"))


def absolute_src(src: Column, host: str = HOSTS["en"]) -> Column:
    """``//x`` gets a protocol, ``/x`` a host; others stay."""
    return F.when(src.startswith("//"), F.concat(F.lit("https:"), src)).when(src.startswith("/"), F.concat(F.lit(host), src)).otherwise(src)


def article_url(href: Column, host: str = HOSTS["en"]) -> Column:
    """The address of an article href; the prefix ``/wiki/`` is taken off as a whole."""
    return F.concat(F.lit(f"{host}/wiki/"), F.regexp_replace(href, r"^/wiki/", ""))


def sanitize_filename(name: Column) -> Column:
    """No characters that file systems forbid, no dots or spaces at the ends, at most 200 characters."""
    clean = F.regexp_replace(F.regexp_replace(name, r'[<>:"/\\|?*]', "_"), r"^[. ]+|[. ]+$", "")
    return F.left(clean, F.lit(200))


def filename_from_link(link: Column, query: Column) -> Column:
    """From an article's title, else the query, else the last step of the link's path; ``unknown.txt`` without a link."""
    link, query = F.coalesce(link, F.lit("")), F.coalesce(query, F.lit(""))
    path = F.regexp_replace(F.regexp_extract(link, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1), r"^/+|/+$", "")
    name = F.when(link.contains(ARTICLE), sanitize_filename(percent_decode(cut_url(after_wiki(link))))).when(
        query != "", sanitize_filename(query)).when(path != "", sanitize_filename(entity_id(path)))
    return F.when((link == "") | name.isNull(), "unknown.txt").otherwise(F.concat(name, F.lit(".txt")))
