"""Line breaks, markers and tags in texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.text import replaced, trimmed, unescaped

# What is dropped with its content (to the end, where it isn't closed), and the tags that end a line.
UNSEEN = r"(?is)<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)|<!--.*?(?:-->|\z)"
LINE_ENDS = r"(?i)<br\s*/?>|</(?:p|div|li|ul|ol|tr|table|h[1-6]|article|section|header|footer|nav|main|aside|title)\s*>"
#: A tag begins with a letter or one of three signs; one that isn't closed goes to the end.
TAGS = r"(?s)<[a-zA-Z/!?][^>]*(?:>|\z)"
SPAN = ('<span style="color: red;">', "</span>")


def text_to_markup(text: Column) -> Column:
    return replaced(replaced(text, "\r\n", "\n"), "\n", "<br>")


def collapse_breaks(markup: Column) -> Column:
    """Two or more breaks, with white space after each, are one. No pattern here repeats a group, which Java would do by
    a call within a call for each break."""
    together = F.regexp_replace(markup, r"<br>\s+(?=<br>)", "<br>")
    return F.regexp_replace(together, r"(?<=<br>)<br>\s*", "")


def without_markers(text: Column) -> Column:
    """Two passes: what the first one brings together, the second one may find."""
    return replaced(replaced(text, "}}", ""), "{{", "")


def clean_export(markup: Column) -> Column:
    return without_markers(F.regexp_replace(replaced(markup, "<br>", "\n"), "\n{2,}", "\n"))


def escaped(value: Column) -> Column:
    return replaced(replaced(replaced(value, "&", "&amp;"), "<", "&lt;"), ">", "&gt;")


def marker(value: Column, wrap: str = "none") -> Column:
    """The value as it is inserted; ``span``: in red, as markup."""
    inserted = F.concat(F.lit("}}"), value, F.lit("{{"))
    return inserted if wrap == "none" else F.concat(F.lit(SPAN[0]), escaped(inserted), F.lit(SPAN[1]))


def markup_to_text(markup: Column) -> Column:
    lines = F.regexp_replace(F.regexp_replace(markup, UNSEEN, ""), LINE_ENDS, "\n")
    return trimmed(unescaped(F.regexp_replace(lines, TAGS, "")))
