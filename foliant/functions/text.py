"""Text expressions. Lengths and offsets are in code points."""

from __future__ import annotations

import json
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The characters that a trim removes, as a class for regular expressions of Java and RE2.
TRIMMED = r"[\x09-\x0D\x20\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
TRIM = f"^{TRIMMED}+|{TRIMMED}+$"
#: What a character reference begins with, after its ampersand.
REFERENCE = r"^(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);"
#: Names of characters (those that end with a semicolon), as Python's library knows them.
NAMED = {name[:-1]: value for name, value in html5.items() if name.endswith(";")}
#: What references to the control characters from 0x80 on stand for: characters of an old code page.
OLD_PAGE = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(0x80, 0xA0))
NO_CHARACTER = "\ufffd"
#: A word boundary of ASCII words; Java's own looks at all letters.
BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, TRIM, "")


def or_empty(text: Column) -> Column:
    """Missing text is the empty text."""
    return F.coalesce(text, F.lit(""))


def or_else(text: Column, other: Column) -> Column:
    """``other`` for an empty or missing text."""
    return F.coalesce(F.nullif(text, F.lit("")), other)


def replaced(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it stands in it."""
    return F.transform(F.array(value), body)[0]


def _character(code: Column) -> Column:
    """The character of a number; none of what is no character."""
    old = F.substring(F.lit(OLD_PAGE), (code - 0x7F).cast("int"), F.lit(1))
    spelled = F.decode(F.unhex(F.lpad(F.hex(code), F.lit(8), F.lit("0"))), "UTF-32")
    valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(code.between(0x80, 0x9F), old).when(valid, spelled).otherwise(F.lit(NO_CHARACTER))


def _number(digits: Column, base: int) -> Column:
    """At most seven digits of it matter, without zeros before them; a longer one is too large for a character."""
    short = F.ltrim(digits, F.lit("0"))
    return F.when(F.length(short) > 7, F.lit(0)).otherwise(F.conv(F.concat(F.lit("0"), short), base, 10)).cast("long")


def unescaped(text: Column) -> Column:
    """The text with the characters that references with a semicolon stand for, each read once, in one pass."""
    named = F.from_json(F.lit(json.dumps(NAMED)), "map<string,string>")

    def decoded(part: Column) -> Column:
        name = F.regexp_extract(part, REFERENCE, 1)
        hexadecimal = F.lower(F.left(name, F.lit(2))) == "#x"
        number = F.when(hexadecimal, _number(F.substr(name, F.lit(3)), 16)).otherwise(_number(F.substr(name, F.lit(2)), 10))
        found = F.when(name.startswith("#"), _character(number)).when(name != "", F.try_element_at(named, name))
        return F.coalesce(F.concat(found, F.substr(part, F.length(name) + 2)), F.concat(F.lit("&"), part))

    def joined(parts: Column) -> Column:
        rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), decoded)
        return F.concat(parts[0], F.array_join(rest, ""))

    return let(text, lambda t: F.when(F.contains(t, F.lit("&")), let(F.split(t, "&"), joined)).otherwise(t))


def unused(name: str, df: DataFrame) -> str:
    """A column name that ``df`` doesn't have: the given one, or one made from it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
