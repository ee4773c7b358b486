"""Facts of an HTML page by regular expressions that Java and RE2 share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LANG = r'<html[^>]*lang="([^"]*)"'
TITLE = r"<title>([^<]*)</title>"
HREF = r'<a[^>]*href="([^"]*)"'
BLOCKS = r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->"
TAG = r"<[^>]+>"
SPACE = r"\s+"
PATH = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)"


def lang(html: Column) -> Column:
    """The root language, or null."""
    return F.nullif(F.regexp_extract(html, LANG, 1), F.lit(""))


def title(html: Column) -> Column:
    return F.regexp_extract(html, TITLE, 1)


def links(html: Column) -> Column:
    """Targets of all anchors, in order."""
    return F.regexp_extract_all(html, F.lit(HREF), F.lit(1))


def visible_text(html: Column) -> Column:
    """Text outside tags, scripts, styles and comments, with single spaces."""
    bare = F.regexp_replace(F.regexp_replace(html, BLOCKS, " "), TAG, " ")
    return F.trim(F.regexp_replace(bare, SPACE, " "))


def path(url: Column) -> Column:
    return F.regexp_extract(url, PATH, 1)


def message_link(base: str, text: Column) -> Column:
    """A fixed base and a URL-encoded text."""
    return F.concat(F.lit(base), F.url_encode(text))


def message_of(link: Column) -> Column:
    """The text of such a link; raw letters beside percent escapes are taken as they are."""
    return F.url_decode(F.regexp_extract(link, r"[?&]text=([^&#]*)", 1))


def visible(marked: Column, root: str | Column) -> Column:
    """Whether an element shows: unmarked ones always, marked ones in their language; any root but pt shows es."""
    root = F.lit(root) if isinstance(root, str) else root
    return marked.isNull() | (marked == F.when(root == "pt", "pt").otherwise("es"))


def wanted_language(stored: Column, default: str = "es") -> Column:
    """A stored choice, where empty counts as unset."""
    return F.coalesce(F.nullif(stored, F.lit("")), F.lit(default))
