"""Alignment of two tokenizers against a plain loop over the tokenizers' own output."""

from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from foliant.llm import alignment
from foliant.llm.queries import BYTE_MODEL, PIECE_MODEL, QUERIES

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
FILES = {"byte_file": BYTE_MODEL, "piece_file": PIECE_MODEL}
ODD = [
    (None, "a null id"),
    (1, None),
    (2, ""),
    (3, " "),
    (4, "same text here"),
    (4, "same text here"),
    (5, "  two  spaces and an end "),
    (6, "a ▁ mark"),
    (7, "é ÿ 漢字 😀 \x00 é   ﬁ"),
    (8, "<|endoftext|> <s> </s> <unk> <0x41>"),
    (9, "\n\n\t tabs\r\nand lines \n"),
    (10, "x" * 3000 + " " * 300 + "漢" * 500),
    (11, "don't we'll 1234567 !!! ...---***"),
]


def tokens_of(texts):
    """Tokens of both sides as (id, bytes), or none where they don't spell a space and the text."""
    a, b = Tokenizer.from_file(BYTE_MODEL), sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    a.encode_special_tokens = True
    byte_of = alignment.byte_of_letter()
    out = []
    for text in texts:
        if not text:
            out.append(([], []))
            continue
        ids = a.encode(" " + text, add_special_tokens=False).ids
        left = [(i, bytes(byte_of[c] for c in a.id_to_token(i))) for i in ids]
        right = []
        for i in b.encode(text):
            name = b.id_to_piece(i)
            right.append((i, bytes([int(name[3:5], 16)]) if b.is_byte(i) else name.replace("▁", " ").encode()))
        whole = (" " + text).encode()
        good = b"".join(x for _, x in left) == whole == b"".join(x for _, x in right)
        out.append((left, right) if good else ([], []))
    return out


def groups_of(left, right):
    """Lists of A and B places; each ends where both sides do."""
    ends = [np.cumsum([len(x) for _, x in side]).tolist() for side in (left, right)]
    both, out, i, j = sorted(set(ends[0]) & set(ends[1])), [], 0, 0
    for end in both:
        a, b = [], []
        while i < len(left) and ends[0][i] <= end:
            a.append(i)
            i += 1
        while j < len(right) and ends[1][j] <= end:
            b.append(j)
            j += 1
        out.append((a, b))
    return out


def plain(rows):
    tokens = tokens_of([t for _, t in rows])
    links, texts = [], []
    for left, right in tokens:
        found = groups_of(left, right)
        links.append(Counter((left[i][0], right[j][0]) for a, b in found for i in a for j in b))
        texts.append(
            ";".join(",".join(str(left[i][0]) for i in a) + "|" + ",".join(str(right[j][0]) for j in b) for a, b in found)
        )
    n = Counter(p for found in links for p in found)
    most = defaultdict(int)
    for (a, _), k in n.items():
        most[a] = max(most[a], k)
    return [
        (
            key,
            len(left),
            len(right),
            len(text.split(";")) if text else 0,
            sum(found.values()),
            sum(m for p, m in found.items() if n[p] == most[p[0]]),
            sum(m * n[p] for p, m in found.items()),
            sha256(text.encode()).hexdigest() if text else "",
        )
        for (key, _), (left, right), found, text in zip(rows, tokens, links, texts)
    ]


def rows_of(df):
    return sorted((tuple(r[c] for c in alignment.DIGEST_COLUMNS) for r in df.collect()), key=repr)


def test_the_query_equals_a_plain_loop(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert rows_of(QUERIES["op11_alignment"](spark, sf_dir)) == sorted(plain(rows), key=repr)


def test_odd_rows_and_small_blocks(spark, monkeypatch):
    clashing = {c: F.lit(c) for c in ("block", "pair", "n", "a", "ids")}
    docs = spark.createDataFrame(ODD, DOCS).repartition(2).withColumns(clashing)
    wanted = sorted(plain(ODD), key=repr)
    assert rows_of(alignment.link_digests(docs, **FILES)) == wanted
    assert rows_of(alignment.link_digests(docs.coalesce(1), **FILES)) == wanted
    assert sum(r[1] == 0 for r in wanted) == 3  # null, empty, and the text with a mark of its own
    assert rows_of(alignment.link_digests(docs.where("doc_id < 0"), **FILES)) == []


def test_alignments(spark):
    docs = spark.createDataFrame(ODD, DOCS).withColumn("a", F.lit("x"))
    found = alignment.alignments(docs, **FILES).collect()
    by_key = defaultdict(list)
    for r in found:
        by_key[r["doc_id"]].append(r)
    for (key, _), (left, right) in zip(ODD, tokens_of([t for _, t in ODD])):
        r = by_key[key][0]
        assert (r["a"], r["b"]) == ([i for i, _ in left], [i for i, _ in right])
        groups = groups_of(left, right)
        assert r["group_a"] == [g for g, (a, _) in enumerate(groups) for _ in a]
        assert r["group_b"] == [g for g, (_, b) in enumerate(groups) for _ in b]
        spans = []
        for side in (left, right):
            ends = np.cumsum([len(x) for _, x in side]).tolist()
            spans.append(list(zip([0, *ends], ends)))
        if len(left) * len(right) < 10_000:
            over = [(i, j) for i, (a, b) in enumerate(spans[0]) for j, (c, d) in enumerate(spans[1]) if a < d and c < b]
            assert [tuple(x) for x in r["overlaps"]] == over


@pytest.mark.parametrize("wide", [0, 4096])
def test_links_of_wide_groups(monkeypatch, wide):
    """Two tokenizers that cut bytes at random, so that groups hold many tokens and ids repeat."""
    monkeypatch.setattr(alignment, "WIDE", wide)
    rng = np.random.default_rng(4)
    sizes = np.array([1, 2, 3, 5, 7])
    a, b = [], []
    for n in (0, 1, 10, 400):
        for side in (a, b):
            ids, left = [], n
            while left:
                ids.append(int(rng.choice(np.flatnonzero(sizes <= left))))
                left -= sizes[ids[-1]]
            side.append(ids)
    found = alignment.align(a, b, sizes, sizes)
    docs, pairs, times = alignment.links(found)
    got = Counter({(d, p >> alignment.ID_BITS, p & ((1 << alignment.ID_BITS) - 1)): t for d, p, t in zip(docs, pairs, times)})
    wanted = Counter()
    for d, (x, y) in enumerate(zip(a, b)):
        for left, right in groups_of([(i, b" " * sizes[i]) for i in x], [(i, b" " * sizes[i]) for i in y]):
            wanted.update((d, x[i], y[j]) for i in left for j in right)
    assert got == wanted


def test_other_vocabularies_are_refused(tmp_path):
    with pytest.raises(ValueError, match="byte-level"):
        alignment.ByteTokens(b'{"model": {"vocab": {}, "merges": []}, "pre_tokenizer": {"type": "Whitespace"}}')
