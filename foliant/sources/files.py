"""Text files, multi-page files and letters."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from foliant.functions.text import OLD_PAGE, unused
from foliant.sources.letters import LetterFiles

ON_OTHER = ("fallback", "rejected", "ignored")


def load_text(spark: SparkSession, path: str, *, keep: tuple[str, ...] = ()) -> DataFrame:
    """name, text: each file as one text; Spark passes empty files over. ``keep``: columns that the names of folders hold."""
    read = spark.read.text(path, wholetext=True)
    return read.select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"), *keep)


def route_of(name: Column, on_other: str = "fallback") -> Column:
    """text, paged, or what is done with other files: fallback (try as text), rejected or ignored."""
    if on_other not in ON_OTHER:
        raise ValueError(f"on_other is one of {ON_OTHER}")
    lower = F.lower(name)
    is_text = lower.endswith(".txt") | lower.endswith(".md")
    return F.when(is_text, "text").when(lower.endswith(".pdf"), "paged").otherwise(on_other)


def route_files(files: DataFrame, *, name: str = "name", on_other: str = "fallback") -> DataFrame:
    return files.withColumn("route", route_of(F.col(name), on_other))


def _assembled(separator: str, trailing: bool, out: T.StructType):
    """The texts of documents whose items come in order, one document after another; one may go on in the next batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begun, now, page, parts = False, None, None, []

        def row() -> pd.DataFrame:
            return pd.DataFrame({out.names[0]: [now], out.names[1]: ["".join([*parts, separator if trailing else ""])]})

        for batch in batches:
            for key, number, text in batch.itertuples(index=False):
                key, number = (None if x != x else x for x in (key, number))
                if not begun or key != now:
                    if begun:
                        yield row()
                    begun, now, parts = True, key, []
                elif number != page:
                    parts.append(separator)
                else:
                    parts.append(" ")
                page = number
                parts.append(text or "")
        if begun:
            yield row()

    return run


def assemble_pages(
    items: DataFrame, *, key: str = "doc_id", page: str = "page", item: str = "item", text: str = "str",
    separator: str = "\n\n", trailing: bool = True,
) -> DataFrame:
    """key, text: the items of a page joined by a space, the pages in order, each followed by the separator.

    Items are dealt once, by document, and sorted where they are; a task holds one document's text at a time, however
    many pages it has. A null text is an empty item; equal places go by text; a null key is a document.
    """
    rows = items.select(F.col(key).alias("key"), F.col(page).alias("page"), F.col(item).alias("item"), F.col(text).alias("text"))
    out = T.StructType([T.StructField(key, items.schema[key].dataType), T.StructField("text", T.StringType())])
    dealt = rows.repartition("key").sortWithinPartitions("key", "page", "item", "text")
    return dealt.select("key", "page", "text").mapInPandas(_assembled(separator, trailing, out), out)


def first_file(files: DataFrame, *, session: str = "session", order: str = "pos") -> DataFrame:
    """Of several files of a session, the first."""
    rank = unused("rank", files)
    ranked = files.withColumn(rank, F.row_number().over(W.partitionBy(session).orderBy(order)))
    return ranked.where(F.col(rank) == 1).drop(rank)


def approved_version(versions: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """key, version, text: the latest approved version."""
    latest = versions.where("approved").groupBy(key).agg(F.max_by(F.struct("version", "text"), "version").alias("v"))
    return latest.select(key, "v.version", "v.text")


def session_documents(
    versions: DataFrame, asks: DataFrame, *, key: str = "doc_id", at: str = "ts", text: str = "text"
) -> DataFrame:
    """The asks (key, at, ..) with ``saved_at`` and ``text`` of the version that was approved last by then.

    ``versions``: key, at, text, approved (those that aren't are passed over). An as-of join by one exchange: both
    tables are dealt by key and sorted by time, versions before asks of the same time, and each ask takes what came
    last. An ask before any approved version has neither; of versions of one time the larger text counts.
    """
    row, is_ask, saved, mine = (unused(n, asks) for n in ("ask", "is_ask", "saved", "of"))
    time = asks.schema[at].dataType
    kept = F.struct(F.col(at).cast(time).alias("saved_at"), F.col(text).alias("text"))
    left = versions.where("approved").select(
        F.col(key).alias(mine), F.col(at).cast(time).alias("when"), F.lit(False).alias(is_ask), kept.alias(saved)
    )
    right = asks.select(
        F.col(key).alias(mine), F.col(at).alias("when"), F.lit(True).alias(is_ask), F.struct(*asks.columns).alias(row)
    )
    both = left.unionByName(right, allowMissingColumns=True).where(F.col("when").isNotNull() | F.col(is_ask))
    order = W.partitionBy(mine).orderBy("when", is_ask, F.col(f"{saved}.text")).rowsBetween(W.unboundedPreceding, 0)
    last = F.when(F.col("when").isNotNull(), F.last(saved, ignorenulls=True).over(order))
    found = both.withColumn(saved, last).where(is_ask)
    new = [F.col(f"{saved}.saved_at").alias("saved_at"), F.col(f"{saved}.text").alias("text")]
    return found.select(*[F.col(f"{row}.{c}").alias(c) for c in asks.columns if c not in ("saved_at", "text")], *new)


def write_letters(letters: DataFrame, path: str, *, kind: str = "kind", text: str = "letter") -> None:
    """Plain text files in a folder for each kind, and the same rows with their keys as Parquet."""
    letters.select(F.col(kind).alias("kind"), F.col(text).alias("value")).write.partitionBy("kind").mode(
        "overwrite"
    ).text(f"{path}/text")
    letters.write.mode("overwrite").parquet(f"{path}/rows")


def save_letters(
    letters: DataFrame, path: str, *, name: str = "name", kind: str = "kind", text: str = "letter", overwrite: bool = True
) -> None:
    """Each letter as a file of its own, ``part=<task>/kind=<kind>/<name>``, which ``read_letters`` reads back.

    See ``LetterFiles``: files of a job are all there or none is.
    """
    letters.sparkSession.dataSource.register(LetterFiles)
    rows = letters.select(*[F.col(c).cast("string").alias(n) for c, n in ((kind, "kind"), (name, "name"), (text, "text"))])
    rows.write.format(LetterFiles.name()).mode("overwrite" if overwrite else "append").save(path)


def read_letters(spark: SparkSession, path: str) -> DataFrame:
    """kind, name, text of each letter that ``save_letters`` has left; tasks list the files, the driver only their folders."""
    spark.dataSource.register(LetterFiles)
    return spark.read.format(LetterFiles.name()).load(path)


# How files of some kinds begin.
PDF, UTF8_MARK, LITTLE_MARK, BIG_MARK = "25504446", "EFBBBF", "FFFE", "FEFF"
#: Control characters that no text has.
NO_TEXT = r"[\x00-\x08\x0E-\x1A\x1C-\x1F]"


@F.pandas_udf(T.StringType())
def _utf16(contents: pd.Series) -> pd.Series:
    """UTF-16 text, of which the first two bytes say the order; null for what is none."""

    def decoded(content: bytes | None) -> str | None:
        try:
            return None if content is None else bytes(content).decode("utf-16")
        except UnicodeDecodeError:
            return None

    return contents.map(decoded).astype(object)


def decode_files(files: DataFrame, *, content: str = "content") -> DataFrame:
    """The files with mime, charset, route (text, paged or rejected), text, status and error, by what they hold.

    Text is UTF-8 or UTF-16 by its mark, else UTF-8 where that is valid, else the old one-byte code page; what has
    control characters is none. Empty content is an empty text, none an error. Only UTF-16 leaves the JVM.
    """
    data = F.col(content)
    head = F.hex(F.substring(data, 1, 4))
    wide = head.startswith(LITTLE_MARK) | head.startswith(BIG_MARK)
    bare = F.when(head.startswith(UTF8_MARK), F.substring(data, 4, 2**30)).otherwise(data)
    as_utf8 = F.try_validate_utf8(bare.cast("string"))
    old = "".join(chr(c) for c in range(0x80, 0xA0))
    as_old = F.translate(F.decode(F.when(as_utf8.isNull(), data), "ISO-8859-1"), old, OLD_PAGE)
    charset = (
        F.when(head.startswith(PDF), None).when(wide, "UTF-16").when(as_utf8.isNotNull(), "UTF-8").otherwise("windows-1252")
    )
    names = {n: unused(n, files) for n in ("charset_", "text_")}
    rows = files.withColumn(names["charset_"], charset)
    kind = F.col(names["charset_"])
    text = F.when(kind == "UTF-16", _utf16(F.when(kind == "UTF-16", data))).when(kind == "UTF-8", as_utf8).when(kind == "windows-1252", as_old)
    rows = rows.withColumn(names["text_"], text)
    found = F.col(names["text_"])
    good = found.isNotNull() & ~found.rlike(NO_TEXT)
    paged = head.startswith(PDF)
    return rows.withColumns(
        {
            "mime": F.when(paged, "application/pdf").when(good, "text/plain").otherwise("application/octet-stream"),
            "charset": F.when(good, kind),
            "route": F.when(paged, "paged").when(good, "text").otherwise("rejected"),
            "text": F.when(good, found),
            "status": F.when(paged | good, "ok").otherwise("error"),
            "error": F.when(paged | good, F.lit(None).cast("string")).when(found.isNull(), "undecodable").otherwise("no text"),
        }
    ).drop(*names.values())


def load_files(spark: SparkSession, path: str, *, keep: tuple[str, ...] = ()) -> DataFrame:
    """name, size, and what ``decode_files`` finds in each file of the folder; Spark passes empty files over.

    ``keep``: columns that folders' names hold.
    """
    read = spark.read.format("binaryFile").load(path)
    named = read.select(F.col("_metadata.file_name").alias("name"), F.col("length").alias("size"), "content", *keep)
    return decode_files(named).drop("content")
