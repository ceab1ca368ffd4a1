"""The training-data operators against brute force, round trips and held-out accuracy, and on odd inputs."""

import base64
import hashlib
import io
import itertools
import random
import re
import zipfile
from collections import Counter, defaultdict
from pathlib import Path
from types import SimpleNamespace

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from foliant.llm import (
    decontamination,
    html_text,
    language_id,
    near_duplicates,
    personal_data,
    pieces,
    quality_model,
    quality_rules,
    stages,
    substrings,
    warc,
)
from foliant.llm.oracle import ORACLE_SQL
from foliant.llm.queries import PIECE_MODEL, QUERIES

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), DOCS)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.collect()}


#: Nulls, empty and blank texts, ties, repeated rows and a long text without spaces.
ODD = [(None, "a null id"), (1, None), (2, ""), (3, " \n\t "), (4, "same text here"), (4, "same text here"), (5, "same text here"), (6, "x" * 5000), (7, "é ÿ 漢字 😀 \x00")]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_duckdb(spark, sf_dir, name):
    duck = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        duck.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    found, wanted = QUERIES[name](spark, sf_dir), duck.sql(ORACLE_SQL[name])
    columns = sorted(found.columns)
    assert columns == sorted(wanted.columns)
    places = [wanted.columns.index(c) for c in columns]
    rows = Counter(repr([r[c] for c in columns]) for r in found.collect())
    assert rows == Counter(repr([r[i] for i in places]) for r in wanted.fetchall())


# 1 HTML
@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, None),
        ("", ""),
        ("plain  text", "plain text"),
        ("<p>One<p>Two<br>three", "One\n\nTwo\nthree"),
        ("a<b>b</b> c<div>d</div>e", "ab c\nd\ne"),
        ("<ul><li>a<li>b<ol start=3><li>x<li>y</ol></ul>", "- a\n- b\n  3. x\n  4. y"),
        ("<table><tr><th>Name<th>Qty<tr><td>apple<td>3</table>", "Name   Qty\napple  3"),
        ("<table><tr><td colspan=2>total of all<tr><td>a<td>b</table>", "total of all\na  b"),
        ("<head><title>no</title></head><script>var t='</p>'</script><p hidden>no<p>yes", "yes"),
        ('<div style="Display : none">no<p>no</p></div>yes<!-- no -->', "yes"),
        ("<pre>\n a\n   b</pre>", " a\n   b"),
        ("a &lt; b &amp;amp; < c", "a < b &amp; < c"),
        ("<dl><dt>t<dd>d</dl>", "t\n  d"),
        ("</p></div>x<script>never closed", "x"),
        ("<div>" * 3000 + "deep", "deep"),
    ],
)
def test_rendering(page, text):
    assert html_text.render(page) == text


def test_no_visible_word_is_lost(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = {r["page_id"]: r["text"] for r in html_text.visible_text(pages).collect()}
    for row in pages.collect():
        seen = re.sub(r"(?is)<(script|style|head)\b.*?</\1>|<!--.*?-->", "", row["html"])
        words = re.sub(r"<[^>]*>", " ", seen).replace("&amp;", "&").replace("&quot;", '"').replace("&copy;", "©").replace("&middot;", "·").split()
        assert [w for w in found[row["page_id"]].replace("\n- ", "\n").split() if w != "-"] == [w for w in words if w != "-"]


# 2 Languages
def test_automaton_holds_exactly_the_substrings():
    rng = random.Random(1)
    text = [rng.randrange(3) for _ in range(60)]
    table = language_id.suffix_automaton(text, 3)
    inside = {tuple(text[i:j]) for i in range(61) for j in range(i + 1, min(61, i + 7))}
    for _ in range(2000):
        word = tuple(rng.randrange(3) for _ in range(rng.randrange(1, 7)))
        state = language_id.ROOT
        for code in word:
            state = table[state, code]
        assert bool(state) == (word in inside)


def test_phrases_are_longest_matches():
    rng = random.Random(2)
    models = []
    for lang in ("aa", "bb"):
        text = "".join(rng.choice("abc " if lang == "aa" else "bcd ") for _ in range(200)).strip()
        text = language_id.plain(text)
        rows = language_id.pd.DataFrame({"lang": [lang], "text": [text], "rank": [1]})
        models.append(language_id._learn(rows).iloc[0].to_dict() | {"plain": text})
    parser = language_id.CrossParser(models)
    tests = ["".join(rng.choice("abcdé ") for _ in range(rng.randrange(1, 1500))) for _ in range(20)]
    counts = parser.phrases([parser.encode(t) for t in tests])
    for i, text in enumerate(tests):
        text = language_id.plain(text)
        for k, model in enumerate(parser.models):
            n = 0
            for at in range(0, len(text), language_id.SEGMENT):
                part, begin = text[at : at + language_id.SEGMENT], 0
                while begin < len(part):
                    end = begin + 1
                    while end < len(part) and part[begin : end + 1] in model["plain"]:
                        end += 1
                    begin, n = end, n + 1
            assert counts[k, i] == n


def test_languages_of_held_out_documents(spark, sf_dir, documents):
    found = QUERIES["op2_language_id"](spark, sf_dir).join(documents.select("doc_id", "lang"), "doc_id").where("held_out")
    rows = found.collect()
    assert len(rows) > 20 and np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.9
    assert all(0 <= r["score"] <= 1 for r in rows)


# 3 Substrings
def removed_by_brute_force(rows):
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        words = SPACE.findall(text or "")
        covered = set()
        for i in range(len(words) - 19):
            window = tuple(words[i : i + 20])
            if window in seen:
                covered.update(range(i, i + 20))
            seen.add(window)
        out[doc_id] = (len(words), len(covered), " ".join(w for i, w in enumerate(words) if i not in covered))
    return out


@pytest.mark.parametrize("width_bits", [4, 12, 27])
def test_repeats_with_any_width_of_the_sketch(spark, width_bits):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(50)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    rows = []
    for i in range(60):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(0, 120)))
        rows.append((i, text + (" \n" + passage + "\t" if i % 3 == 0 else " ") + text[: rng.randrange(200)]))
    rows += [(100, "a " * 50), (101, "a " * 19), (102, None), (103, ""), (104, rows[3][1])]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    found = by_id(substrings.remove_repeats(docs, width_bits=width_bits))
    assert {k: tuple(v)[1:] for k, v in found.items()} == removed_by_brute_force(rows)


def test_parts_of_any_size_give_the_same(spark, monkeypatch):
    rows = [(i, " ".join(f"w{(i * j) % 7}" for j in range(80))) for i in range(30)]
    monkeypatch.setattr(substrings, "PART", 50)
    monkeypatch.setattr(substrings, "CHUNK", 100)
    found = by_id(substrings.remove_repeats(spark.createDataFrame(rows, DOCS)))
    assert {k: tuple(v)[1:] for k, v in found.items()} == removed_by_brute_force(rows)


def test_repeated_and_unnamed_rows_keep_one_passage(spark):
    one, two, three, four = (" ".join(f"{c}{i}" for i in range(30)) for c in "abcd")
    rows = [(5, one), (5, one), (7, one + " " + two), (7, one + " " + two), (9, two), (5, three), (None, four), (None, four)]
    rows += [(None, four), (None, "short text"), (None, "short text"), (None, three), (None, three)]
    for parts in (1, 3):
        found = substrings.remove_repeats(spark.createDataFrame(rows, DOCS).repartition(parts), width_bits=16).collect()
        got = Counter((r["doc_id"], r["n_words"], r["kept_text"]) for r in found)
        want = Counter([(5, 30, one)] * 2 + [(7, 60, two)] * 2 + [(9, 30, ""), (5, 30, three), (None, 30, four)])
        want += Counter([(None, 30, "")] * 4 + [(None, 2, "short text")] * 2)
        assert got == want


def test_known_repeats_of_a_hot_passage_meet_in_no_bucket():
    passage = " ".join(f"h{i}" for i in range(40))
    batch = substrings.pd.DataFrame({"doc_id": range(500), "text": [f"x{i} {passage} y{i}" for i in range(500)]})
    bits = {(row, 0): b"\xff" * 32 for row in range(substrings.ROWS)}  # all counters at two
    sent = type("Sent", (), {"value": bits})
    rows = substrings.pd.concat(substrings._candidates(sent, 8, 8)(iter([batch])))
    known = rows[rows["hashes"].isna()]
    assert (known["bucket"] < 0).all() and known["sizes"].map(sum).sum() == 499 * 21
    compared = rows[~rows["hashes"].isna()]
    assert (compared["bucket"] >= 0).all() and compared["sizes"].map(sum).sum() == 21 + 500 * 2
    runs = substrings.pd.concat(substrings._later(iter([rows.sort_values("bucket")])))
    got = Counter((r.doc_id, s) for r in runs.itertuples() for s in range(r.first, r.last + 1))
    assert got == Counter((d, s) for d in range(1, 500) for s in range(1, 22))


# 4 Personal data
def base_by_brute_force(text):
    found = [(m.start(), m.end(), 0) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), m.end(), 1) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 12 <= len(d) <= 19 and (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0:
            found.append((m.start(), m.end(), 2))
    found += [(m.start(), m.end(), 3) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(found)


def test_an_address_of_any_number_of_zeros():
    zeros = "0" * 5000
    text = f"{zeros}.1.2.3 and {zeros}1.{zeros}.2.255 but {zeros}256.1.1.1"
    assert [(a, b, kind) for a, b, kind in personal_data.base_spans(text) if kind == 1] == [(0, 5006, 1), (5011, 5011 + 10_008, 1)]


def test_base_spans(texts):
    rng = random.Random(6)
    samples = ["".join(rng.choice("ab1290.@_-+% ()é") for _ in range(60)) for _ in range(3000)]
    samples += ["a@b.c_d@e.f", "a@b@c.d", "x@y", "1.2.3.4.5", "0256.1.1.1", "4111 1111 1111 1111", "+1 (518) 555-0532.", *texts.values()]
    for text in samples:
        assert personal_data.base_spans(text) == base_by_brute_force(text)


def test_contexts_find_unseen_identifiers(spark):
    rng = random.Random(7)
    rows = []
    for i in range(40):
        card = "4111111111111111" if i % 2 else f"user{i}@mail.example.com"
        rows.append((i, f"some words the contact mailbox: {card} and the rest"))
    rows.append((40, "and now the contact mailbox: user99(at)mail and the rest 12345678"))
    rows += [(100 + i, "the rest " + " ".join(f"of{rng.randrange(9)}xyzab" for _ in range(5))) for i in range(40)]
    found = by_id(personal_data.find(spark.createDataFrame(rows, DOCS)))
    text = rows[40][1]
    assert [text[s["start"] : s["stop"]] for s in found[40]["spans"]] == ["user99(at)mail"]
    assert found[40]["base"] == []
    assert all(not found[100 + i]["spans"] for i in range(40))


def test_redaction(spark):
    docs = docs_of(spark, ["mail a@b.com, ip 1.2.3.4.", None, "", "none"]).withColumn("added", F.lit(1))
    found = personal_data.redact(docs)
    assert found.columns == docs.columns
    assert [by_id(found)[i]["text"] for i in range(4)] == ["mail [EMAIL], ip [IP].", None, "", "none"]


# 5 WARC
def test_packages_are_zip_archives():
    members = [("a/b.txt", b"hello"), ("é", b"")]
    for zip64 in (True, False):
        data = warc.zip_package(members, zip64)
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            assert [(n, z.read(n)) for n in z.namelist()] == members and z.testzip() is None
        places = warc.zip_members(lambda at, n, data=data: data[at : at + n], len(data))
        assert {n: data[at : at + size] for n, (at, size) in places.items()} == dict(members)
    other = io.BytesIO()
    with zipfile.ZipFile(other, "w") as z:
        z.writestr("x", b"y" * 100)
        z.comment = b"note PK"
    data = other.getvalue()
    at, size = warc.zip_members(lambda at, n: data[at : at + n], len(data))["x"]
    assert data[at : at + size] == b"y" * 100


PAGES = "page_id long, url string, html string"


def test_pages_come_back(spark, tmp_path):
    rows = [(3, "u\r\nv", "<p>é</p>"), (1, None, "<p>é</p>"), (2, "u", ""), (5, "u", None), (None, "u", "<p>é</p>"), (7, "u", "z" * 5000), (7, "u", "z" * 5000)]
    pages = spark.createDataFrame(rows, PAGES)
    packages = warc.write_packages(pages, folder=f"file://{tmp_path}/w")
    found = warc.read_records(packages).collect()
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found)
    want = Counter()
    for page_id, _, html in rows:
        payload = (html or "").encode()
        ids = [i for i, _, h in rows if (h or "") == (html or "") and i is not None]
        revisit = page_id != min(ids)
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        want[(None if page_id is None else str(page_id), len(payload), digest, "revisit" if revisit else "response", str(min(ids)) if revisit else None)] += 1
    assert got == want
    assert {bytes(r["payload"]) for r in found if r["payload"] is not None} == {b"", "<p>é</p>".encode(), b"z" * 5000}


def test_archives_without_an_index_are_walked(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"<p>{i}</p>") for i in range(20)], PAGES)
    path = warc.write_packages(pages.coalesce(1), folder=f"file://{tmp_path}/w").first()["path"].removeprefix("file://")
    with zipfile.ZipFile(path) as z:
        bare = warc.zip_package([(warc.ARCHIVE, z.read(warc.ARCHIVE))])
    (tmp_path / "bare.wacz").write_bytes(bare)
    found = warc.read_records(spark.createDataFrame([(f"file://{tmp_path}/bare.wacz",)], "path string"))
    assert sorted(int(r["page_id"]) for r in found.collect()) == list(range(20))


def test_small_payloads_are_all_responses(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], PAGES)
    found = warc.read_records(warc.write_packages(pages, folder=f"file://{tmp_path}/w", min_revisit_bytes=3))
    assert {r["page_id"]: r["record_type"] for r in found.collect()} == {"1": "response", "2": "response", "3": "response", "4": "revisit"}


# 6 Near duplicates
def fingerprint_by_brute_force(text):
    words = [w.encode() for w in SPACE.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_by_brute_force(fingerprints):
    label = {d: d for d in fingerprints}
    ids = sorted(fingerprints)
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if label[b] < label[a] and (fingerprints[a] ^ fingerprints[b]).bit_count() <= 2:
                    label[a], changed = label[b], True
    return label


def test_fingerprints_and_components(spark, sf_dir, texts):
    found = by_id(QUERIES["op6_near_duplicates"](spark, sf_dir))
    want = {d: fingerprint_by_brute_force(t) for d, t in texts.items()}
    assert {d: r["fingerprint"] for d, r in found.items()} == {d: f"{f:016x}" for d, f in want.items()}
    assert {d: r["component_id"] for d, r in found.items()} == components_by_brute_force(want)


def test_long_texts_have_the_same_fingerprint():
    rng = random.Random(8)
    text = " ".join(rng.choice(["Ab", "cé", "D"]) for _ in range(1500))
    assert near_duplicates.fingerprint(text.encode()) == fingerprint_by_brute_force(text)


@pytest.mark.parametrize("large_group", [1, 4, 1000])
def test_links_of_large_groups(spark, large_group):
    rng = random.Random(9)
    values = {0, 1, 3, 7, 15, 2**63, 2**64 - 1}
    for base in [rng.getrandbits(64) for _ in range(6)]:
        values |= {base ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) & (2**64 - 1) for _ in range(12)}
    fps = dict(enumerate(sorted(values)))
    nodes = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v, i) for i, v in fps.items()], "fp long, node long")
    found = near_duplicates.components(near_duplicates.links(nodes, large_group=large_group))
    label = {i: i for i in fps} | {r["node"]: r["label"] for r in found.collect()}
    assert label == components_by_brute_force(fps)


def test_chains_reach_their_smallest_node(spark):
    chain = list(range(40))
    random.Random(10).shuffle(chain)
    pairs = spark.createDataFrame(list(zip(chain, chain[1:])), "a long, b long")
    assert {r["label"] for r in near_duplicates.components(pairs).collect()} == {0}
    assert near_duplicates.components(pairs.limit(0)).count() == 0


def similar_by_brute_force(texts):
    def runs(text):
        words = (text or "").lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}

    sets = {d: runs(t) for d, t in texts.items()}
    def similar(a, b):
        small, large = sorted((len(sets[a]), len(sets[b])))
        return small >= 0.8 * large and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])

    links = [(a, b) for a in sets for b in sets if b < a and similar(a, b)]
    label = {d: d for d in texts}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed = changed or label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def test_representatives_of_planted_near_copies(spark):
    rng = random.Random(21)
    vocabulary = [f"w{i}" for i in range(500)]
    rows = []
    for size in (4, 12, 100, 200, 500):
        for _ in range(4):
            base = [rng.choice(vocabulary) for _ in range(size)]
            rows.append(" ".join(base))
            for changes in (1, 1, 2, 3, 5):  # words changed, one after another and from the base
                copy = list(base)
                for _ in range(changes):
                    copy[rng.randrange(size)] = rng.choice(vocabulary)
                rows.append(" ".join(copy))
                base = copy if rng.random() < 0.3 else base
    rng.shuffle(rows)
    want = set(similar_by_brute_force(dict(enumerate(rows))).values())
    found = [r["doc_id"] for r in near_duplicates.representatives(docs_of(spark, rows)).collect()]
    assert sorted(found) == sorted(want)
    assert len(want) < len(set(components_by_brute_force({i: fingerprint_by_brute_force(t) for i, t in enumerate(rows)}).values()))


@pytest.mark.parametrize("large_group", [1, 64])
def test_close_fingerprints_meet(spark, large_group):
    rng = random.Random(23)
    values = [rng.getrandbits(64) for _ in range(8)]
    for base in values[:8]:
        for bits in (0, 1, 3, 5, 5, 9, 20):
            values.append(base ^ sum(1 << b for b in rng.sample(range(64), bits)))
    nodes = spark.createDataFrame([(t, v - (1 << 64) if v >> 63 else v) for t, v in enumerate(values)], "t long, fp long")
    found = {tuple(r) for r in near_duplicates.close_pairs(nodes, large_group=large_group).collect()}
    differ = {(a, b): (values[a] ^ values[b]).bit_count() for b in range(len(values)) for a in range(b)}
    assert all(differ[pair] <= near_duplicates.SIMILAR_RADIUS for pair in found)
    if large_group == 64:  # each text has the smallest of those within the radius that surely agree on blocks, or a smaller one
        for b in range(len(values)):
            near = [a for a in range(b) if differ[a, b] <= near_duplicates.SIMILAR_BLOCKS]
            assert not near or min(a for a, z in found if z == b) <= min(near)


def test_rows_are_told_by_marks(spark):
    ids = [*range(0, 20_000, 100)]
    docs = spark.createDataFrame([(i, "a", f"text {i}") for i in [*range(20_000), 100, 101]], "doc_id long, part string, text string")
    for column in ("doc_id", "text"):
        marked, others = near_duplicates._by_marks(docs, column, docs.where(F.col("doc_id").isin(ids)).select(F.col(column).alias("m")))
        told, rest = marked.collect(), others.collect()
        assert sorted([*told, *rest]) == sorted(docs.collect())
        assert not {r["doc_id"] for r in rest} & set(ids) and len(told) < 6_000
    marked, others = near_duplicates._by_marks(docs, "doc_id", docs.limit(0).select("doc_id"))
    assert marked.count() == 0 and others.count() == 20_002


def test_links_go_through_rounds_once(spark, monkeypatch):
    rng = random.Random(25)
    rows = []
    for _ in range(8):
        words = [f"w{rng.randrange(5000)}" for _ in range(100)]
        rows += [" ".join(words)] + [" ".join([*words[:i], "x", *words[i + 1 :]]) for i in (0, 2, 50, 97)]
    sizes, components = [], near_duplicates.components
    monkeypatch.setattr(near_duplicates, "components", lambda pairs: sizes.append(pairs.count()) or components(pairs))
    found = [r["doc_id"] for r in near_duplicates.representatives(docs_of(spark, rows)).collect()]
    assert sorted(found) == [*range(0, 40, 5)]
    assert sizes[0] and sum(sizes) < 40  # no more than the texts: a link that is known isn't given again


def test_few_texts_agree_on_blocks_by_chance(spark):
    rng = random.Random(26)
    values = [rng.getrandbits(64) - (1 << 63) for _ in range(20_000)]
    nodes = spark.createDataFrame(list(enumerate(values)), "t long, fp long")
    keyed = near_duplicates._blocks(nodes.withColumnRenamed("t", "node"), near_duplicates.block_masks(near_duplicates.SIMILAR_BLOCKS))
    shared = keyed.groupBy("choice", "block").count().where("count > 1").count()
    assert keyed.count() <= 20 * len(values) and shared < 10  # 0.9 pairs are expected at 32 bits


def test_representatives_come_through_fingerprints(spark, monkeypatch):
    rng = random.Random(24)
    rows = []
    for _ in range(6):
        words = [f"w{rng.randrange(5000)}" for _ in range(300)]
        rows += [" ".join(words), " ".join([*words[:150], "x", *words[151:]])]
    met, close_pairs = [], near_duplicates.close_pairs
    monkeypatch.setattr(near_duplicates, "close_pairs", lambda nodes: met.append(close_pairs(nodes)) or met[0])
    # Without what follows the fingerprints, the links are those that fingerprints find.
    monkeypatch.setattr(near_duplicates, "_hub_pairs", lambda listed, labels: met[0].limit(0))
    monkeypatch.setattr(near_duplicates, "_candidates", lambda listed, labels, threshold: met[0].limit(0))
    found = sorted(r["doc_id"] for r in near_duplicates.representatives(docs_of(spark, rows)).collect())
    sets = [near_duplicates.shingles(t.encode()) for t in rows]
    near = [(near_duplicates.majority(sets[i]) ^ near_duplicates.majority(sets[i + 1])).bit_count() for i in range(0, 12, 2)]
    sure = {i for i, bits in zip(range(1, 12, 2), near) if bits <= near_duplicates.SIMILAR_BLOCKS}
    assert len(met) == 1 and len(sure) >= 3 and not sure & set(found) and set(range(0, 12, 2)) <= set(found)


# 7 Rules
def test_the_order_of_rules_changes_no_verdict(spark, documents):
    rules = quality_rules.BASE_RULES + quality_rules.EXTRA_RULES
    text = F.coalesce("text", F.lit(""))
    facts = quality_rules.facts_of(text, quality_rules.words_of("text"))
    one = documents.select("doc_id", quality_rules.cascade(facts, rules).isNull().alias("kept"))
    two = documents.select("doc_id", quality_rules.cascade(facts, rules[::-1]).isNull().alias("kept"))
    verdicts = {tuple(r) for r in one.collect()}
    assert verdicts == {tuple(r) for r in two.collect()}
    assert verdicts == {tuple(r) for r in quality_rules.measure(documents).select("doc_id", "kept").collect()}
    judged = quality_rules.judge(documents)
    assert verdicts == {tuple(r) for r in judged.select("doc_id", F.col("rejected_by").isNull()).collect()}


def test_rules_come_by_rejection_per_cost():
    rules = [quality_rules.Rule(n, None) for n in "abcd"]
    costs = {"a": (1.0, 0.1), "b": (0.1, 0.1), "c": (2.0, 0.0), "d": (1.0, 0.0)}
    estimates = [quality_rules.Estimate(n, *costs[n]) for n in "abcd"]
    assert [r.name for r in quality_rules.order_rules(rules, estimates)] == ["b", "a", "d", "c"]


# 8 Quality model
def test_scores_of_held_out_documents(spark, documents):
    good = documents.where("n_chars > 200").select("doc_id", "text")
    bad = good.select((F.col("doc_id") + 1000).alias("doc_id"), F.regexp_replace("text", " ", "%%% ").alias("text"))
    docs = good.union(bad)
    labels = docs.select("doc_id", (F.col("doc_id") < 1000).cast("int").alias("label")).where("doc_id % 3 <> 1")
    found = by_id(quality_model.quality_scores(docs, labels))
    held = {d: r["score"] for d, r in found.items() if d % 3 == 1}
    assert np.mean([(s >= 0.5) == (d < 1000) for d, s in held.items()]) > 0.95
    assert all(0 <= s <= 1 for s in held.values())


def test_without_labels_all_scores_are_equal(spark):
    docs = docs_of(spark, ["a b", "", None])
    none = spark.createDataFrame([], "doc_id long, label int")
    assert {r["score"] for r in quality_model.quality_scores(docs, none).collect()} == {0.5}


def test_network_learns_and_is_calibrated():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, quality_model.POOLED))
    p = 1 / (1 + np.exp(-2 * x[:, 0] * x[:, 1]))
    y = (rng.random(3000) < p).astype(float)
    net = quality_model.fit(x[:2000], y[:2000], epochs=30)
    assert abs(net.probabilities(x[2000:]).mean() - y[2000:].mean()) < 0.06


# 9 Pieces
def viterbi(unit, table, low):
    best = [(0.0, [])] + [None] * len(unit)
    for stop in range(1, len(unit) + 1):
        for start in range(stop):
            piece = unit[start:stop]
            if piece in table:
                i, score = table[piece]
                ids = [i]
            elif stop == start + 1:
                ids = [3 + b for b in piece.encode()]
                score = (low - pieces.BYTE_PENALTY) * len(ids)
            else:
                continue
            total = best[start][0] + score
            if best[stop] is None or total >= best[stop][0]:
                best[stop] = total, best[start][1] + ids
    return best[-1][1]


@pytest.fixture(scope="module")
def piece_table(spark):
    if not Path(PIECE_MODEL).exists():
        pytest.skip("no vocabulary file")
    known = pieces.read_pieces(spark, PIECE_MODEL)
    table = {r["piece"]: (r["id"], r["score"]) for r in known.where("kind = 'normal'").collect()}
    return known, table, min(s for _, s in table.values())


def test_units_get_their_best_path(spark, piece_table):
    known, table, low = piece_table
    rng = random.Random(11)
    units = {pieces.MARK + "".join(rng.choice("etaoin😀é漢.,") for _ in range(rng.randrange(1, 12))) for _ in range(150)} | {"a", "▁", "\x00"}
    found = pieces.encode_units(spark.createDataFrame([(u,) for u in units], "unit string"), known)
    assert {r["unit"]: r["ids"] for r in found.collect()} == {u: viterbi(u, table, low) for u in units}


def test_texts_come_back(spark, piece_table, texts, monkeypatch):
    known, table, low = piece_table
    monkeypatch.setattr(pieces, "BLOCK_WORDS", 300)
    odd = ["", None, " \n ", "x" * 300, "é漢😀 \x00 a▁b", "same", "same", "e.g. i.e., (a.b) c.d!!"]
    rows = [*odd, *list(texts.values())[:20]]
    found = pieces.decode(pieces.encode(docs_of(spark, rows).repartition(2), known), known)
    got = by_id(found)
    for i, text in enumerate(rows):
        words = SPACE.findall((text or "").replace("▁", " "))
        assert got[i]["text"] == " ".join(words)
        if all(len(w) < pieces.MAX_UNIT for w in words):
            assert got[i]["ids"] == [x for w in words for x in viterbi(pieces.MARK + w, table, low)]


def test_long_words_get_their_best_path(spark, piece_table):
    known, table, low = piece_table
    rng = random.Random(22)
    words = ["internationalization" * 9, "x" * 300, "https://example.org/" + "some/longer/path/" * 12, "漢é😀the" * 40]
    words += ["".join(rng.choice("etaoinshr") for _ in range(n)) for n in (63, 64, 65, 130, 700)]
    words += [base64.b64encode(rng.randbytes(200)).decode()]
    found = by_id(pieces.encode(docs_of(spark, [*words, " and ".join(words)]), known))
    paths = [viterbi(pieces.MARK + w, table, low) for w in words]
    assert [found[i]["ids"] for i in range(len(words))] == paths
    joined = paths[0] + [i for p in paths[1:] for i in viterbi(pieces.MARK + "and", table, low) + p]
    assert found[len(words)]["ids"] == joined


def test_beaten_pieces_are_left_out(piece_table):
    _, table, low = piece_table
    known = pieces.PieceTable(table, max(map(len, table)), 3, low)
    useful = pieces.useful_pieces(known)
    assert len(useful) < len(table) / 2  # most of the edges that the lattice had are on no best path
    rng = random.Random(5)
    few = {p: table[p] for p in useful}
    for u in [*rng.sample(sorted(table), 400), *("".join(rng.sample(sorted(table), 4))[: pieces.MAX_UNIT] for _ in range(200))]:
        assert viterbi(u, few, low) == viterbi(u, table, low)


def test_beaten_pieces_by_brute_force():
    """Random tables, with ties, positive scores, fractions and scores far apart."""
    rng = random.Random(6)
    for turn in range(150):
        scores = [lambda: float(rng.randint(-4, 1)), lambda: rng.uniform(-9, 0), lambda: rng.choice((-0.1, -0.2, -0.3, -1e9))][turn % 3]
        names = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(60)})
        table = {p: (300 + i, scores()) for i, p in enumerate(names)}
        low = min(s for _, s in table.values())
        useful = pieces.useful_pieces(pieces.PieceTable(table, 6, 3, low))
        assert all(p in useful for p in table if len(p) == 1)
        few = {p: table[p] for p in useful}
        for _ in range(20):
            u = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 14)))
            assert viterbi(u, few, low) == viterbi(u, table, low)


def test_pieces_that_end_alike(spark):
    """Pieces of more than TAIL characters with the same end, of which a unit has none, one or several."""
    names = ["a", "b", "ab", "abab", "babab", "ababab", "aababab", "bbbbbbbb"]
    table = {p: (300 + i, float(-len(p) % 3) - 4) for i, p in enumerate(names)}
    rows = [(3 + b, f"<0x{b:02X}>", 0.0, "byte") for b in range(256)] + [(i, p, x, "normal") for p, (i, x) in table.items()]
    known, low = spark.createDataFrame(rows, "id int, piece string, score double, kind string"), min(x for _, x in table.values())
    units = ["".join(x) for n in range(1, 8) for x in itertools.product("ab", repeat=n)] + ["b" * 20, "ab" * 9, "acababab"]
    found = pieces.encode_units(spark.createDataFrame([(u,) for u in units], "unit string"), known)
    assert {r["unit"]: r["ids"] for r in found.collect()} == {u: viterbi(u, table, low) for u in units}


@pytest.mark.parametrize(("words", "n_bytes"), [(1_000_000, 32_000_000), (9, 32_000_000), (1_000_000, 300), (1, 1)])
def test_blocks_end_by_words_and_bytes(spark, piece_table, monkeypatch, words, n_bytes):
    known, table, low = piece_table
    sent = SimpleNamespace(value=pieces.PieceTable(table, max(map(len, table)), 3, low))
    monkeypatch.setattr(pieces, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 2)))
    for name, value in (("BLOCK_WORDS", words), ("BLOCK_BYTES", n_bytes), ("ROW_WORDS", 20)):
        monkeypatch.setattr(pieces, name, value)
    texts = ["", None, " \n\x0b ", "x" * 90, "é漢😀 \x00 a▁b", "same", "same", "e.g. i.e.,\x1c (a.b) c.d!!\x85e", "x-y" * 200, "", "the end is near " * 9]
    ids = [None if i == 4 else str(i) for i in range(len(texts))]
    batches = [pa.record_batch({"id": pa.array(ids[i : i + 4], pa.string()), "text": pa.array(texts[i : i + 4], pa.string())}) for i in (0, 4, 8)]
    rows = pa.Table.from_batches(pieces._pack(8, pieces.cut_pattern(known))(iter(batches)))
    assert pieces.PACKED_TYPE == rows.schema
    lists, blocks = rows.filter(pc.is_valid(rows["bucket"])), rows.filter(pc.is_null(rows["bucket"]))
    none = pa.schema({"unit": pa.string(), "ids": pa.list_(pa.int32())}).empty_table()
    found = [pieces._look_up(sent)(lists.filter(pc.equal(lists["bucket"], b)), none) for b in range(8)]
    found, got = pa.concat_tables(found), []
    for b in sorted(set(blocks["block"].to_pylist())):
        got += pieces._unpack(blocks.filter(pc.equal(blocks["block"], b)), found.filter(pc.equal(found["block"], b))).to_pylist()
    wanted = [(text or "").replace("▁", " ").encode().split() for text in texts]
    assert [r["doc_id"] for r in got] == ids
    assert [r["n_words"] for r in got] == [len(x) for x in wanted]
    assert [r["ids"] for r in got] == [[i for w in x for i in viterbi("▁" + w.decode(), table, low)] for x in wanted]
    n_blocks = len(set(blocks["block"].to_pylist()))
    assert n_blocks == 1 if (words, n_bytes) == (1_000_000, 32_000_000) else n_blocks > 1


# 10 Decontamination
def leaks_by_brute_force(docs, items):
    def words(text):
        return re.findall(r"[^\W_]+", (text or "").lower())

    def shingles(ws, k):
        return [tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)]

    out = {}
    for doc_id, text in docs:
        ws = words(text)
        for item_id, item in items:
            own = words(item)
            if not own or len(ws) < len(own):
                continue
            k = min(5, len(own))
            want = Counter(shingles(own, k))
            for i in range(len(ws) - len(own) + 1):
                have = Counter(shingles(ws[i : i + len(own)], k))
                similarity = (want & have).total() / (want | have).total()
                if similarity >= 0.8 and similarity > out.get((doc_id, item_id), (0,))[0]:
                    out[doc_id, item_id] = similarity, i
    return out


def test_leaks(spark):
    rng = random.Random(12)
    words = [f"word{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(words) for _ in range(n))) for i, n in enumerate([1, 2, 4, 5, 6, 14, 30, 59])]
    items += [(50, items[6][1].upper() + "!"), (51, ""), (52, None), (53, "a a a a a a a a a a a a a a a")]
    docs = []
    for i in range(60):
        own = rng.choice(items[4:8])[1].split()
        for _ in range(rng.randrange(5)):
            change = rng.randrange(3)
            at = rng.randrange(len(own))
            own = own[:at] + ([rng.choice(words)] if change == 0 else []) + own[at + (change != 1) :] if change else own
        filler = [rng.choice(words) for _ in range(rng.randrange(40))]
        docs.append((i, ", ".join(filler + own + filler[:10])))
    docs += [(100, None), (101, ""), (102, "a " * 40), (103, items[0][1])]
    table = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.leaks(spark.createDataFrame(docs, DOCS), table).collect()
    got = {(r["doc_id"], r["item_id"]): (r["similarity"], r["start_word"]) for r in found}
    assert len(got) == len(found)
    assert got == leaks_by_brute_force(docs, items)
    kept = decontamination.without_leaks(spark.createDataFrame(docs, DOCS), table)
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in got}


def test_documents_shorter_than_the_item(spark):
    rng = random.Random(23)
    item = [f"v{rng.randrange(10**6)}" for _ in range(100)]
    ends = {1: item[:95], 2: item[5:], 3: item[:50] + item[51:], 4: item[:80], 5: item[:99], 6: item[:84], 7: item[:83], 8: item[:4], 9: item}
    docs = spark.createDataFrame([(i, " ".join(ws)) for i, ws in ends.items()], DOCS)
    table = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    want = {}
    whole = {tuple(item[i : i + 5]) for i in range(96)}
    for i, ws in ends.items():
        own = {tuple(ws[j : j + 5]) for j in range(len(ws) - 4)}
        similarity = len(own & whole) / len(own | whole)
        if similarity >= 0.8:
            want[i] = (similarity, 0)
    found = decontamination.leaks(docs, table).collect()
    assert {r["doc_id"]: (r["similarity"], r["start_word"]) for r in found} == want
    assert len(found) == len(want) and {1, 2, 3, 5, 9} <= set(want)
    assert {r["doc_id"] for r in decontamination.without_leaks(docs, table).collect()} == set(ends) - set(want)


# Long texts take time in proportion to their length
@pytest.mark.parametrize("unit", ["1", "a@ ", "@", "1.", "+1 ", "(", "1.2.3.4,", "a123456 ", "a@b.c "])
def test_personal_data_of_long_texts(unit):
    text = unit * (10**6 // len(unit))
    spans = personal_data.base_spans(text)
    others = personal_data.other_identifiers(text, spans)
    personal_data._patterns_before(text, [a for a, _, _ in spans] + [a for a, _ in others])
    if unit == "1.2.3.4,":
        assert len(spans) == 125_000


@pytest.mark.parametrize("unit", ["<a ", "<div>", '<a "', "<a", "<ul><li>x", "<!--", "<table><tr><td>x", "<blockquote>q", "<select><option>a", "&", "<p>", "</p>"])
def test_rendering_of_long_pages(unit):
    assert html_text.render(unit * (400_000 // len(unit)) + "<p>end") is not None


def test_patterns_before_places_are_those_of_the_corpus():
    rng = random.Random(31)
    for _ in range(300):
        text = "".join(rng.choice("ab=:é 1(\n") for _ in range(rng.randrange(40)))
        ends = sorted(rng.randrange(len(text) + 1) for _ in range(5))
        for end, got in zip(ends, personal_data._patterns_before(text, ends)):
            one, two, has = personal_data.pattern_hashes(*personal_data.token_hashes([text[:end].encode()]))
            want = [*one[-1:], *(two[-1:] if len(has) and has[-1] else [])]
            assert list(got) == list(np.array(want, np.uint64).view(np.int64))


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<svg><title>no</title><text>yes</text></svg> b", "yes b"),
        ("<math><mi>x</mi><mo>+</mo></math>", "x+"),
        ("<textarea>\n a\n b</textarea>", " a\n b"),
        ('<p style="visibility:hidden">no <b style="visibility: visible">yes</b> no', "yes"),
        ("<select><option>a<option selected>b<option>c</select>", "b"),
        ("<select><option>a<option>b</select>", "a"),
        ("<select multiple><option>a<option>b</select>", "a\nb"),
        ("<table><tr><td>one<ul><li>x<li>y</ul><td>two<p>three</table>", "one  two\n- x  three\n- y"),
        ("<a href=\"x>y\">z</a> c>d", "z c>d"),
        ('<a b="never closed>text <i>it</i>', '<a b="never closed>text it'),
    ],
)
def test_visible_elements(page, text):
    assert html_text.render(page) == text


def test_personal_data_query(spark, sf_dir, texts):
    found = by_id(QUERIES["op4_personal_data"](spark, sf_dir))
    assert set(found) == set(texts)
    for doc_id, text in texts.items():
        base = base_by_brute_force(text or "")
        row, names = found[doc_id], personal_data.KINDS
        assert [row[f"n_{k}"] for k in names] == [sum(s[2] == i for s in base) for i in range(4)]
        ordered = sorted(base, key=lambda s: (s[0], s[2]))
        listed = [f"{names[k]}:{a}:{b}" for a, b, k in ordered]
        assert row["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert set(listed) <= set(row["spans"].split(",")) | {""} or not listed


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "some words " * 30, "x")], "doc_id long, text string, a string")
    names = ("rejected_by", "leak_doc", "leak_hash", "t", "row", "new", "a_doc", "a_hash", "text_hash", "added")
    docs = docs.withColumns({n: F.lit("x") for n in names})
    items = spark.createDataFrame([(1, "another text here")], "item_id long, text string")
    assert decontamination.without_leaks(docs, items).columns == docs.columns
    assert near_duplicates.representatives(docs).collect() == docs.collect()
    assert personal_data.redact(docs).collect() == docs.collect()
    with pytest.raises(ValueError):
        quality_rules.judge(docs)
    assert quality_rules.judge(docs, result_col="why").columns == [*docs.columns, "why"]


def test_components_of_text_nodes(spark):
    pairs = spark.createDataFrame([("b", "c"), ("a", "b"), ("x", "y")], "a string, b string")
    found = {r["node"]: r["label"] for r in near_duplicates.components(pairs).collect()}
    assert found == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}


def test_costly_rules_come_last(spark, documents):
    costly = quality_rules.Rule("costly", lambda x: x.n_repeat_words < 0)
    cheap = quality_rules.Rule("dear_by_name", lambda x: x.n_words < 0)
    for _ in range(2):
        estimates = quality_rules.estimate_rules(documents, [costly, cheap])
        assert [r.name for r in quality_rules.order_rules([costly, cheap], estimates)] == ["dear_by_name", "costly"]


# Odd inputs and the pipeline
def _operators(spark):
    items = spark.createDataFrame([(1, "same text here"), (2, None)], "item_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (4, 1), (4, 0), (None, 1)], "doc_id long, label int")
    known = pieces.read_pieces(spark, PIECE_MODEL)
    return {
        "languages": lambda d: language_id.identify(d, language_id.learn(d.withColumn("lang", F.lit("xx")))),
        "substrings": substrings.remove_repeats,
        "personal data": personal_data.find,
        "redaction": personal_data.redact,
        "near duplicates": near_duplicates.near_duplicates,
        "rules": quality_rules.measure,
        "judge": quality_rules.judge,
        "model": lambda d: quality_model.quality_scores(d, labels),
        "pieces": lambda d: pieces.decode(pieces.encode(d, known), known),
    } | {"leaks": lambda d: decontamination.leaks(d, items)}


@pytest.mark.parametrize("name", ["languages", "substrings", "personal data", "redaction", "near duplicates", "rules", "judge", "model", "pieces", "leaks"])
def test_odd_and_empty_tables(spark, piece_table, name):
    operator = _operators(spark)[name]
    docs = spark.createDataFrame(ODD, DOCS)
    extra = docs.withColumns({c: F.lit("x") for c in ("words", "fp", "id", "n", "block", "hashes", "score", "found")})
    rows = operator(extra).collect()
    if name == "leaks":
        assert {r["doc_id"] for r in rows} == {4, 5}
    else:
        assert Counter(r["doc_id"] for r in rows) == Counter(d for d, _ in ODD)
    assert operator(docs.limit(0)).collect() == []


def test_representatives_of_odd_rows(spark):
    docs = spark.createDataFrame(ODD, DOCS).withColumn("fp", F.lit(1))
    found = near_duplicates.representatives(docs)
    assert found.columns == docs.columns
    # Texts without words are one class, as are the three equal texts.
    assert Counter(r["doc_id"] for r in found.collect()) == Counter([None, 1, 4, 6, 7])


def test_pipeline(spark, sf_dir, documents, piece_table):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "personal_data", "pieces"]
    docs, ids = documents, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == documents.columns
        ids.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    rows = {r["doc_id"]: r["text"] for r in documents.collect()}
    assert ids[0] == {r["doc_id"] for r in quality_rules.measure(documents).where("kept").collect()}
    # The stage links texts at a five-word-shingle similarity of 0.8 or more; op6's three words and two bits are its query's.
    assert ids[1] == set(similar_by_brute_force({d: rows[d] for d in ids[0]}).values())
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    leaked = {d for d, _ in leaks_by_brute_force([(d, rows[d]) for d in ids[1]], items)}
    assert ids[2] == ids[1] - leaked and leaked
    assert ids[3] == ids[2]
    for row in docs.collect():
        assert not base_by_brute_force(row["text"]) and row["n_chars"] == len(row["text"])
    last = corpus_pipeline.run(spark, sf_dir)
    assert {r["doc_id"] for r in last.collect()} == ids[3]
