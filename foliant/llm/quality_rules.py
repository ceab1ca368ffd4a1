"""Quality rules as a short-circuit cascade.

Each rule is one Boolean expression over a document. A sample tells what share of the documents a rule rejects and
what the rule costs; the rules then stand in one CASE expression, the highest rejection per cost first, so that a
document which an early rule rejects never reaches the costly ones. The order changes the cost alone: a document is
kept if no rule rejects it.

Defined results: a null text is an empty text (no words, rejected by ``few_words``); repeated rows are judged one by
one; an empty table gives an empty result; other columns of the input are ignored (``judge`` keeps them). Only
built-in functions are used.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import cut, let, words_of

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
SAMPLE_TASKS = 4


def word_chars(words: Column) -> Column:
    return F.length(F.array_join(words, "")).cast("long")


def _signs(text: Column) -> Column:
    """The symbols and exclamation marks of a text."""
    return F.regexp_replace(text, r"[^#*$%&|<>!]+", "")


def _without_marks(signs: Column) -> Column:
    return F.length(F.replace(signs, F.lit("!"), F.lit(""))).cast("long")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word in them that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"\S"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def _window_hashes(words: Column) -> Column:
    """A hash for each window of eight words: of its two halves, of their halves, of the words."""

    def pairs(hashes: Column, apart: int) -> Column:
        return let(
            hashes,
            lambda h: F.zip_with(
                F.slice(h, 1, F.size(h) - apart),
                F.slice(h, apart + 1, F.size(h) - apart),
                lambda a, b: F.xxhash64(a, b),
            ),
        )

    return pairs(pairs(pairs(F.transform(words, lambda w: F.xxhash64(w)), 1), 2), 4)


def repeated_words(words: Column) -> Column:
    """Words covered by windows of eight words that occur twice or more in the text.

    Most texts repeat no window, which the number of distinct window hashes shows; only the others sort their windows.
    """

    def covered(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))

        def repeated(s: Column) -> Column:
            def same(j: Column, k: Column) -> Column:
                return F.coalesce(F.get(s, j)["h"] == F.get(s, k)["h"], F.lit(False))

            twice = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: same(j, j - 1) | same(j, j + 1))
            return F.array_sort(F.transform(twice, lambda j: F.get(s, j)["at"]))

        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        return F.aggregate(
            let(ordered, repeated),
            start,
            lambda acc, at: F.struct(
                (at + WINDOW).alias("end"), (acc["n"] + at + WINDOW - F.greatest(at, acc["end"])).alias("n")
            ),
            lambda acc: acc["n"],
        )

    counted = let(
        _window_hashes(words), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0)
    )
    return F.when(F.size(words) >= WINDOW, counted).otherwise(0).cast("long")


@dataclass(frozen=True)
class Facts:
    """What rules ask of a document. Each is an expression, evaluated only where a rule that asks for it is reached."""

    n_words: Column
    word_chars: Column
    n_symbols: Column
    n_marks: Column
    n_dup_lines: Column
    n_lines: Column
    n_repeat_words: Column


def facts_of(text: Column, words: Column) -> Facts:
    signs = _signs(text)
    return Facts(
        n_words=F.size(words).cast("long"),
        word_chars=word_chars(words),
        n_symbols=_without_marks(signs),
        n_marks=let(signs, lambda s: F.length(s) - _without_marks(s)),
        n_dup_lines=duplicate_lines(text),
        n_lines=F.size(F.split(text, "\n")),
        n_repeat_words=repeated_words(words),
    )


@dataclass(frozen=True)
class Rule:
    """``rejects`` says from the facts whether the document is to go."""

    name: str
    rejects: Callable[[Facts], Column]


BASE_RULES = (
    Rule("few_words", lambda x: x.n_words < MIN_WORDS),
    Rule("repeats", lambda x: 100 * x.n_repeat_words > MAX_REPEAT_PERCENT * x.n_words),
)

#: Shares are of the number of words or lines. Prose of the four languages seen stays far below each of them.
EXTRA_RULES = (
    Rule("symbols", lambda x: 100 * x.n_symbols > 20 * x.n_words),
    Rule("shouting", lambda x: 100 * x.n_marks > 50 * x.n_words),
    Rule("word_length", lambda x: x.word_chars > 20 * x.n_words),
    Rule("duplicate_lines", lambda x: 2 * x.n_dup_lines > x.n_lines),
)


@dataclass(frozen=True)
class Estimate:
    name: str
    seconds: float
    rejected: float

    @property
    def gain(self) -> float:
        return self.rejected / self.seconds


def estimate_rules(
    docs: DataFrame,
    rules: Sequence[Rule],
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    sample_rows: int = 1000,
    repeats: int = 8,
) -> list[Estimate]:
    """Cost and rejected share of each rule on a bounded sample of rows. The sample decides only the order of rules.

    The sample are the rows of the smallest hashes, from all over the table: as many as ``sample_rows``, give or take
    the chance of a draw, as a row is taken by its hash alone. A rule is timed over ``repeats`` times the
    sample, twice, less the time of a rule that asks for nothing; what it costs for a row is rounded to a power of four
    microseconds, so that the same table gives the same order.
    """
    share = min(1.0, sample_rows / max(1, docs.count()))
    below = F.xxhash64(F.col(id_col), F.col(text_col)) <= int(share * 2**64) - 2**63 - 1
    sample = cut(_texts(docs.where(below), text_col).repartition(SAMPLE_TASKS))
    many = sample.withColumn("turn", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    n = max(1, repeats * sample.count())

    def timed(rejects: Column) -> tuple[float, float]:
        took = []
        for _ in range(2):
            began = time.perf_counter()
            rejected = many.agg(F.count_if(rejects)).first()[0]
            took.append(time.perf_counter() - began)
        return min(took) / n, rejected / n

    nothing, _ = timed(F.size("words") < 0)
    found = []
    for rule in rules:
        seconds, rejected = timed(rule.rejects(facts_of(F.col("text"), F.col("words"))))
        found.append(Estimate(rule.name, rounded_cost(seconds - nothing), rejected))
    return found


def rounded_cost(seconds: float) -> float:
    """The nearest power of four microseconds, 1 at least."""
    return 4.0 ** round(max(0.0, math.log(max(seconds, 1e-9) * 1e6, 4))) * 1e-6


def order_rules(rules: Sequence[Rule], estimates: Sequence[Estimate]) -> list[Rule]:
    """Highest rejection per cost first; of those that reject nothing in the sample, the cheapest; then by name."""
    by_name = {e.name: e for e in estimates}
    return sorted(rules, key=lambda r: (-by_name[r.name].gain, by_name[r.name].seconds, r.name))


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(text.alias("text"), words_of(text).alias("words"))


def cascade(facts: Facts, rules: Sequence[Rule]) -> Column:
    """The name of the first rule that rejects the document, or null: later rules are then not evaluated."""
    named = F.when(F.lit(False), F.lit(None).cast("string"))
    for rule in rules:
        named = named.when(rule.rejects(facts), F.lit(rule.name))
    return named


def judge(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    rules: Sequence[Rule] = BASE_RULES + EXTRA_RULES,
    sample_rows: int = 1000,
    result_col: str = "rejected_by",
) -> DataFrame:
    """The rows of ``docs`` with ``result_col``: the rule that ended the cascade, null for a document that is kept.

    ``result_col`` is to be a name that ``docs`` doesn't have.
    """
    if result_col in docs.columns:
        raise ValueError(f"there is a column {result_col} already; name another result_col")
    ordered = order_rules(rules, estimate_rules(docs, rules, id_col=id_col, text_col=text_col, sample_rows=sample_rows))
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumn(result_col, let(words_of(text), lambda w: cascade(facts_of(text, w), ordered)))


def measure(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 1000
) -> DataFrame:
    """One row per document with its counts, whether the base rules reject it, and the verdict of all rules.

    The counts are wanted for every document here, so each is evaluated once and the cascade runs over the counts.
    """
    rules = BASE_RULES + EXTRA_RULES
    ordered = order_rules(rules, estimate_rules(docs, rules, id_col=id_col, text_col=text_col, sample_rows=sample_rows))
    text = F.coalesce(F.col(text_col), F.lit(""))

    def counts(words: Column) -> Column:
        facts = vars(facts_of(text, words)) | {"n_symbols": F.lit(0), "n_marks": F.lit(0)}
        return F.struct(*[column.alias(name) for name, column in facts.items()])

    counted = docs.select(
        F.col(id_col).alias("doc_id"),
        let(words_of(text), counts).alias("found"),
        let(_signs(text), lambda s: F.struct(F.length(s).alias("all"), _without_marks(s).alias("symbols"))).alias("signs"),
    ).select("doc_id", "found.*", "signs")
    facts = Facts(
        **{name: F.col(name) for name in vars(facts_of(text, F.array()))}
        | {"n_symbols": F.col("signs.symbols"), "n_marks": F.col("signs.all") - F.col("signs.symbols")}
    )
    return counted.select(
        "doc_id",
        "n_words",
        "word_chars",
        facts.n_symbols.alias("n_symbols"),
        "n_dup_lines",
        "n_repeat_words",
        cascade(facts, BASE_RULES).isNotNull().alias("base_failed"),
        cascade(facts, ordered).isNull().alias("kept"),
    )
