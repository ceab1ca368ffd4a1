"""Words, their frequencies and the top words of each text.

Texts are dealt once by their key; words are then exploded, counted and ranked where they are, as all rows of a key
are in one place. Only corpus-wide counts shuffle again, after each task has added up its own. A null key is a key;
rows that repeat a key count as one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions.text import or_empty

# The words that don't count as keywords.
STOPWORDS = (
    "a an the and or of to for in on with as by is are be that this we you your our at from will have has it its".split()
)


def token_array(text: Column) -> Column:
    """Lower-case runs of a-z 0-9 # + -, without # + - around them (which may leave the empty word)."""
    runs = F.regexp_extract_all(F.lower(or_empty(text)), F.lit("[a-z0-9#+\\-]+"), F.lit(0))
    return F.transform(runs, lambda w: F.regexp_replace(w, "^[-#+]+|[-#+]+$", ""))


def content_array(text: Column) -> Column:
    """The content words, in order: the pattern matches tokens as they are without # + - around them."""
    words = F.regexp_extract_all(F.lower(or_empty(text)), F.lit("[a-z0-9](?:[a-z0-9#+\\-]*[a-z0-9])?"), F.lit(0))
    return F.filter(words, is_content)


def is_content(word: Column) -> Column:
    return (F.length(word) >= 2) & ~word.isin(STOPWORDS)


def tokenize(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, pos, word: all tokens in order."""
    return docs.select(key, F.posexplode(token_array(F.col(text))).alias("pos", "word")).select(
        key, F.col("pos").cast("long").alias("pos"), "word"
    )


def content_words(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, word: a row for each content word."""
    return docs.select(key, F.explode(content_array(F.col(text))).alias("word"))


def _counted(docs: DataFrame, key: str, text: str, by: tuple[str, ...] = (), dealt: bool = False) -> DataFrame:
    """key, by, word, n, first_pos. ``dealt``: the texts come by key from a step before."""
    texts = docs.select(key, *by, F.col(text).alias("text"))
    words = (texts if dealt else texts.repartition(key)).select(key, *by, F.posexplode(content_array(F.col("text"))).alias("pos", "word"))
    return words.groupBy(key, *by, "word").agg(
        F.count(F.lit(1)).alias("n"), F.min("pos").cast("long").alias("first_pos")
    )


def word_frequencies(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, word, n, first_pos."""
    return _counted(docs, key, text)


def corpus_frequencies(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", by: tuple[str, ...] = ("lang",)
) -> DataFrame:
    """by, word, n, docs: how often and in how many documents a word occurs."""
    counted = _counted(docs, key, text, by)
    return counted.groupBy(*by, "word").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs"))


def top_keywords(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", n: int = 10, dealt: bool = False
) -> DataFrame:
    """key, rank (from 1), word: the n most frequent content words; of equally frequent ones, that seen first."""
    best = W.partitionBy(key).orderBy(F.desc("n"), "first_pos")
    ranked = _counted(docs, key, text, dealt=dealt).withColumn("rank", F.row_number().over(best).cast("long"))
    return ranked.where(F.col("rank") <= n).select(key, "rank", "word")


def top_lists(docs: DataFrame, *, key: str = "doc_id", text: str = "text", n: int = 10, dealt: bool = False) -> DataFrame:
    """key, words: the top words in order of their rank; texts without words have no row."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "word")))
    return top_keywords(docs, key=key, text=text, n=n, dealt=dealt).groupBy(key).agg(ordered["word"].alias("words"))
