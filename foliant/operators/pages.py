"""Title, description and paragraphs of stored posting pages, by expressions within the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import let, or_else, or_empty, trimmed, unescaped
from foliant.operators.markup import TAGS, UNSEEN

MAX_PARAGRAPHS = 80
PARAGRAPH = r"(?is)<p(?:\s[^>]*)?(?:>|\z)"
#: Where an unclosed paragraph ends.
BLOCK = (
    r"(?is)</?(?:p|div|article|section|header|footer|nav|main|aside|ul|ol|li|dl|table|tr|td|th|h[1-6]|form|pre|"
    r"blockquote|body|html)\b.*$"
)
HEADING = r"(?is)<h1\b[^>]*(?:>|\z)(.*?)(?:</h1\s*>|\z)"
TITLE = r"(?is)<title\b[^>]*(?:>|\z)(.*?)(?:</title\s*>|\z)"
META = r"(?i)<meta[\s/]"
#: An attribute with its value, or the end of the tag.
ATTRIBUTE = r"""[^\s"'>/=]+\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)|>"""
VALUE = r"""(?s)=\s*["']?(.*?)["']?$"""
NAME = r"^[^\s=]+"


def seen(html: Column) -> Column:
    return F.regexp_replace(or_empty(html), UNSEEN, "")


def plain(markup: Column) -> Column:
    return unescaped(F.regexp_replace(markup, TAGS, ""))


def _title(seen: Column) -> Column:
    heading = plain(F.regexp_extract(seen, HEADING, 1))
    return let(heading, lambda h: F.when(h != "", h).otherwise(plain(F.regexp_extract(seen, TITLE, 1))))


def title_of(html: Column) -> Column:
    """The text of the first h1, or else of the title, or else empty. One that isn't closed goes to the end."""
    return let(seen(html), _title)


def _attributes(found: Column) -> Column:
    """Of what ATTRIBUTE finds, the attributes up to the end of the tag."""
    end = F.array_position(found, ">").cast("int")
    return F.when(end > 0, F.slice(found, 1, end - 1)).otherwise(found)


def _value(attributes: Column, name: str) -> Column:
    """The value of the first attribute of that name, in whatever quotes, as it stands; or else null."""
    named = F.filter(attributes, lambda a: F.lower(F.regexp_extract(a, NAME, 0)) == name)
    return F.regexp_extract(F.get(named, 0), VALUE, 1)


def _description(seen: Column) -> Column:
    def of(tags: Column) -> Column:
        def content(key: str, value: str) -> Column:
            chosen = F.filter(tags, lambda t: _value(t, key) == value)
            return or_empty(unescaped(_value(F.get(chosen, 0), "content")))

        return let(content("name", "description"), lambda d: F.when(d != "", d).otherwise(content("property", "og:description")))

    return let(F.transform(F.slice(F.split(seen, META), 2, 2**30), lambda tag: let(F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(0)), _attributes)), of)


def description_of(html: Column) -> Column:
    """The content of the first meta with the name description, or else with the property og:description, or else empty.

    A value ends with the quote that it began with, or at white space where it has none.
    """
    return let(seen(html), _description)


def _paragraphs(seen: Column, n: int) -> Column:
    def texts(parts: Column) -> Column:
        return F.transform(
            F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), lambda p: trimmed(plain(F.regexp_replace(p, BLOCK, "")))
        )

    return F.slice(F.filter(let(F.split(seen, PARAGRAPH), texts), lambda t: t != ""), 1, n)


def paragraph_array(html: Column, n: int = MAX_PARAGRAPHS) -> Column:
    """The text of the first n paragraphs that aren't empty."""
    return _paragraphs(seen(html), n)


def job_text(html: Column) -> Column:
    """Title, description and paragraphs, with an empty line between; empty ones keep theirs."""

    def whole(seen: Column) -> Column:
        head = F.array(or_empty(_title(seen)), or_empty(_description(seen)))
        return F.array_join(F.concat(head, _paragraphs(seen, MAX_PARAGRAPHS)), "\n\n")

    return let(seen(html), whole)


def page_paragraphs(pages: DataFrame, *, key: str = "page_id", html: str = "html", n: int = MAX_PARAGRAPHS) -> DataFrame:
    """key, n (from 1), paragraph."""
    return pages.select(key, F.posexplode(paragraph_array(F.col(html), n)).alias("n", "paragraph")).select(
        key, (F.col("n") + 1).cast("long").alias("n"), "paragraph"
    )
