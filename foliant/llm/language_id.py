"""Language identification by cross-parsing.

For each language, a suffix automaton of labelled text recognises exactly the substrings of that text. A text is
parsed from left to right into longest matches (phrases); the language that needs fewest phrases wins. Normalised,
phrases * log2(characters learned) / characters estimates the cross-entropy in bits per character.

Text is lower-cased; letters stay, each run of other characters is one space. It is parsed in segments of SEGMENT
characters, many at once: each step looks up the next state of all segments in the automaton's transition table.

Learned from at most ``sample_docs`` labelled documents of each language (those of the smallest hash of the id, spread
over the corpus) and ``sample_chars`` of their characters, shared evenly among them; of rows that repeat an id and a
language the first text counts. All texts are parsed whole.

Defined results: ``und`` with score 0 for a text that is null or has no letter, or if nothing was learned; otherwise
the score is the second-best entropy over the sum of the two best (0.5: undecided), or 1 if one language is known.
Equal entropies go to the first language by name. Repeated rows are repeated; a null id stays null; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.llm.common import small_batches

SAMPLE_DOCS = 48
#: An automaton has fewer than twice as many states as characters, so that states fit in 16 bits.
SAMPLE_CHARS = 32_000
SEGMENT = 512
BATCH = 8192
DEAD, ROOT = 0, 1


def held_out(id_col: str = "doc_id", mod: int = 5, of: int = 0) -> Column:
    """Whether crc32 of the id, as text, leaves this remainder; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(mod)) == of, F.lit(False))


def plain(text: str) -> str:
    """Lower-case letters, with one space for each run of other characters."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def suffix_automaton(codes: list[int], n_codes: int) -> np.ndarray:
    """Transition table (states x codes) of the substrings of ``codes``; state 1 is the empty string, 0 no match."""
    follow: list[dict[int, int]] = [{}, {}]
    link, length = [0, 0], [0, 0]
    last = ROOT
    for code in codes:
        now = len(follow)
        follow.append({})
        link.append(ROOT)
        length.append(length[last] + 1)
        at = last
        while at and code not in follow[at]:
            follow[at][code] = now
            at = link[at]
        if at:
            to = follow[at][code]
            if length[to] == length[at] + 1:
                link[now] = to
            else:
                copy = len(follow)
                follow.append(dict(follow[to]))
                link.append(link[to])
                length.append(length[at] + 1)
                while at and follow[at].get(code) == to:
                    follow[at][code] = copy
                    at = link[at]
                link[to] = link[now] = copy
        last = now
    table = np.zeros((len(follow), n_codes), np.uint16)
    for state, steps in enumerate(follow):
        for code, to in steps.items():
            table[state, code] = to
    return table


def shared_out(sizes: list[int], total: int) -> list[int]:
    """What each of texts of those sizes may give: equal shares of the total; what short ones leave goes to the others."""
    shares, left = [0] * len(sizes), total
    for done, i in enumerate(sorted(range(len(sizes)), key=sizes.__getitem__)):
        shares[i] = min(sizes[i], left // (len(sizes) - done))
        left -= shares[i]
    return shares


def _learner(sample_chars: int):
    if sample_chars > SAMPLE_CHARS:
        raise ValueError(f"at most {SAMPLE_CHARS} characters, as states are numbers of 16 bits")
    return lambda rows: _learn(rows, sample_chars)


def _learn(rows: pd.DataFrame, sample_chars: int = SAMPLE_CHARS) -> pd.DataFrame:
    """The automaton of one language; code 0 is the space, the others are its letters in order."""
    texts = [x for x in (plain(t) for t in rows.sort_values(["rank", "text"])["text"]) if x]
    shares = shared_out([len(x) + 1 for x in texts], sample_chars)
    text = " ".join([x[:n] for x, n in zip(texts, shares) if n])[:sample_chars]
    letters = "".join(sorted(set(text) - {" "}))
    code = {" ": 0} | {c: i + 1 for i, c in enumerate(letters)}
    table = suffix_automaton([code[c] for c in text], len(code))
    return pd.DataFrame(
        {"lang": [rows["lang"].iloc[0]], "letters": [letters], "n_chars": [len(text)], "states": [table.tobytes()]}
    )


def learn(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample_docs: int = SAMPLE_DOCS,
    sample_chars: int = SAMPLE_CHARS,
) -> DataFrame:
    """lang, letters, n_chars, states: the automaton of each language of the labelled documents ``docs``."""
    known = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    known = known.where("lang is not null and text is not null")
    first = W.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    ids = known.select("id", "lang").distinct()
    chosen = ids.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= sample_docs)
    chosen = F.broadcast(chosen)  # sample_docs rows for each language
    rows = known.join(chosen, ["id", "lang"]).groupBy("lang", "rank").agg(F.min("text").alias("text"))
    return rows.groupBy("lang").applyInPandas(_learner(sample_chars), "lang string, letters string, n_chars long, states binary")


class CrossParser:
    """The automata of all languages over one alphabet."""

    def __init__(self, models: list[dict]):
        self.models = sorted((m for m in models if m["n_chars"]), key=lambda m: m["lang"])
        letters = sorted(set("".join(m["letters"] for m in self.models)))
        self.other = len(letters) + 1  # a letter that no language has seen
        width = self.other + 1
        self.code = np.zeros(0x110000, np.uint16)
        for point in range(0x110000):
            if chr(point).isalpha():
                self.code[point] = self.other
        for i, c in enumerate(letters):
            self.code[ord(c)] = i + 1
        self.tables, self.starts = [], []
        for m in self.models:
            own = np.frombuffer(m["states"], np.uint16).reshape(-1, len(m["letters"]) + 1)
            table = np.zeros((len(own), width), np.uint16)
            table[:, [0] + [self.code[ord(c)] for c in m["letters"]]] = own
            self.tables.append(table.ravel())
            self.starts.append(table[ROOT].copy())
        self.width = width

    def encode(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = self.code[points]
        keep = codes > 0
        keep[1:] |= codes[:-1] > 0
        codes = codes[keep]
        return codes[:-1] if len(codes) and not codes[-1] else codes

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases that each language (row) needs for each text (column)."""
        total = np.zeros((len(self.tables), len(texts)), np.int64)
        held, owners = [], []
        for i, codes in enumerate(texts):
            for at in range(0, len(codes), SEGMENT):
                held.append(codes[at : at + SEGMENT])
                owners.append(i)
            if len(held) >= BATCH or (i + 1 == len(texts) and held):
                self._parse(held, np.array(owners), total)
                held, owners = [], []
        return total

    def _parse(self, segments: list[np.ndarray], owners: np.ndarray, total: np.ndarray) -> None:
        lengths = np.fromiter(map(len, segments), np.int64, len(segments))
        order = np.argsort(-lengths, kind="stable")
        lengths = lengths[order]
        codes = np.zeros((lengths[0], len(segments)), np.uint16)
        for column, i in enumerate(order):
            codes[: len(segments[i]), column] = segments[i]
        active = np.searchsorted(-lengths, -np.arange(lengths[0]), "left")
        for k, (table, start) in enumerate(zip(self.tables, self.starts)):
            state = np.full(len(segments), DEAD, np.int64)  # the first character begins a phrase
            count = np.zeros(len(segments), np.int64)
            for row, n in zip(codes, active):
                step = row[:n]
                to = table[state[:n] * self.width + step]
                miss = to == DEAD
                count[:n] += miss
                state[:n] = np.where(miss, start[step], to)
            np.add.at(total[k], owners[order], count)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        codes = [self.encode(t or "") for t in texts]
        if not self.models:
            return ["und"] * len(texts), [0.0] * len(texts)
        size = np.array([max(1, len(c)) for c in codes])
        learned = np.log2([[m["n_chars"] + 1] for m in self.models])
        bits = self.phrases(codes) * learned / size
        best = np.argmin(bits, axis=0)
        langs, scores = [], []
        for i, c in enumerate(codes):
            if not len(c):
                langs.append("und")
                scores.append(0.0)
                continue
            two = np.sort(bits[:, i])[:2]
            langs.append(self.models[best[i]]["lang"])
            scores.append(float(two[1] / (two[0] + two[1])) if len(two) > 1 else 1.0)
        return langs, scores


def identify(
    docs: DataFrame, models: DataFrame, *, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, lang_pred, score. ``models`` is what ``learn`` returns: one row per language."""
    sent = docs.sparkSession.sparkContext.broadcast([r.asDict() for r in models.collect()])

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        parser = CrossParser(sent.value)
        for texts in batches:
            parts = [parser.predict(list(texts[at : at + 1000])) for at in range(0, len(texts), 1000)]
            yield pd.DataFrame({"lang_pred": [x for p in parts for x in p[0]], "score": [x for p in parts for x in p[1]]})

    found = small_batches(docs).select(F.col(id_col).alias("doc_id"), predict(F.col(text_col)).alias("found"))
    return found.select("doc_id", "found.lang_pred", "found.score")
