"""Registered queries of this package as DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from foliant.llm.decontamination import SHINGLE, THRESHOLD
from foliant.llm.quality_rules import MAX_REPEAT_PERCENT, MIN_WORDS
from foliant.llm.quality_rules import WINDOW as RULE_WINDOW
from foliant.llm.substrings import WINDOW

WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

REPEATS = f"""WITH docs AS (SELECT doc_id, {WORDS} AS ws FROM documents),
    places AS (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS pos FROM docs),
    windows AS (SELECT doc_id, pos, array_to_string(ws[pos : pos + {WINDOW - 1}], ' ') AS w FROM places),
    ranked AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) AS n FROM windows),
    covered AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + {WINDOW})) AS pos FROM ranked WHERE n > 1),
    words AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM docs),
    kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY pos) AS text, count(*) AS n
        FROM words ANTI JOIN covered USING (doc_id, pos) GROUP BY 1)
    SELECT d.doc_id, len(d.ws) AS n_words, len(d.ws) - coalesce(k.n, 0) AS n_removed,
        sha256(coalesce(k.text, '')) AS kept_sha256 FROM docs d LEFT JOIN kept k USING (doc_id)"""

#: Twenty bytes as hexadecimal digits to base 32: the ten digits of each five bytes are eight groups of five bits.
BASE32 = """array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(h, i // 8 * 10 + 1, 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS INT)) & 31 AS INT) + 1, 1)), '')"""

RECORDS = f"""WITH given AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
    named AS (SELECT *, {BASE32} AS payload_digest, min(page_id) OVER (PARTITION BY h) AS first FROM given)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
        CASE WHEN page_id <> first THEN first END AS refers_to FROM named"""

RULES = rf"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS ws,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM documents),
    places AS (SELECT doc_id, ws, unnest(range(1, len(ws) - {RULE_WINDOW - 2})) AS pos FROM docs),
    windows AS (SELECT doc_id, pos, array_to_string(ws[pos : pos + {RULE_WINDOW - 1}], ' ') AS w FROM places),
    twice AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, w) AS n FROM windows),
    repeated AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(pos, pos + {RULE_WINDOW})) AS pos
        FROM twice WHERE n > 1) GROUP BY 1),
    facts AS (SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, length(text) - length(replace(text, '!', '')) AS n_marks,
        len(ls) - len(list_distinct(ls)) AS n_dup_lines, len(string_split(text, chr(10))) AS n_lines,
        coalesce(r.n, 0) AS n_repeat_words FROM docs LEFT JOIN repeated r USING (doc_id)),
    judged AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM facts)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
        NOT (base_failed OR 100 * n_symbols > 20 * n_words OR 100 * n_marks > 50 * n_words OR word_chars > 20 * n_words
            OR 2 * n_dup_lines > n_lines) AS kept FROM judged"""


def _plain(column: str) -> str:
    return rf"list_filter(string_split_regex(lower(coalesce({column}, '')), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"


#: Pairs that share enough shingles, all item-sized windows of their documents, and the two multisets of shingles.
LEAKS = f"""WITH items AS (SELECT item_id, ws, len(ws) AS n, least(len(ws), {SHINGLE}) AS k
        FROM (SELECT item_id, {_plain('text')} AS ws FROM benchmark) WHERE len(ws) > 0),
    docs AS (SELECT doc_id, {_plain('text')} AS ws FROM documents),
    item_shingles AS (SELECT item_id, n, k, array_to_string(ws[pos : pos + k - 1], ' ') AS s
        FROM (SELECT *, unnest(range(1, n - k + 2)) AS pos FROM items)),
    item_counts AS (SELECT item_id, s, count(*) AS c FROM item_shingles GROUP BY 1, 2),
    sizes AS (SELECT DISTINCT k FROM items),
    doc_shingles AS (SELECT doc_id, k, pos, array_to_string(ws[pos : pos + k - 1], ' ') AS s
        FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS pos FROM docs, sizes)),
    likely AS (SELECT d.doc_id, i.item_id FROM doc_shingles d JOIN (SELECT DISTINCT item_id, n, k, s FROM item_shingles) i USING (k, s)
        GROUP BY d.doc_id, i.item_id, i.n, i.k HAVING count(DISTINCT pos) >= {2 * THRESHOLD / (1 + THRESHOLD) - 1e-9} * (i.n - i.k + 1)),
    windows AS (SELECT l.doc_id, i.item_id, i.n - i.k + 1 AS m, i.k, unnest(range(1, len(d.ws) - i.n + 2)) AS start
        FROM likely l JOIN items i USING (item_id) JOIN docs d USING (doc_id)),
    window_counts AS (SELECT w.doc_id, w.item_id, w.start, w.m, d.s, count(*) AS c FROM windows w JOIN doc_shingles d
        ON d.doc_id = w.doc_id AND d.k = w.k AND d.pos BETWEEN w.start AND w.start + w.m - 1 GROUP BY ALL),
    shared AS (SELECT w.doc_id, w.item_id, w.start, w.m, CAST(sum(least(w.c, i.c)) AS BIGINT) AS x
        FROM window_counts w JOIN item_counts i USING (item_id, s) GROUP BY ALL)
    SELECT doc_id, item_id, max(x / (2 * m - x)) AS similarity, arg_min(start, (-x / (2 * m - x), start)) - 1 AS start_word
        FROM shared WHERE x / (2 * m - x) >= {THRESHOLD} GROUP BY 1, 2"""



def _rounds(rounds: int = 3) -> str:
    """Assignments a0, a1, ... of the vectors v to the centroids c0, c1, ...: one of each for a round, and a last one."""
    parts = []
    for i in range(rounds + 1):
        parts.append(f"""d{i} AS (SELECT v.n, v.x, c.j, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d
        FROM v, c{i} c), a{i} AS MATERIALIZED (SELECT n, any_value(x) AS x, arg_min(j, (d, j)) AS j, min(d) AS d FROM d{i} GROUP BY n)""")
        if i < rounds:
            parts.append(f"""s{i} AS (SELECT j, i, sum(y)::HUGEINT AS s, count(*) AS m FROM (SELECT j, unnest(x) AS y,
        generate_subscripts(x, 1) AS i FROM a{i}) GROUP BY 1, 2), m{i} AS (SELECT j, list(((s - ((s % m) + m) % m) // m)::BIGINT ORDER BY i) AS x
        FROM s{i} GROUP BY 1), c{i + 1} AS MATERIALIZED (SELECT j, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN m{i} m USING (j))""")
    return ",\n    ".join(parts)


CENTROIDS = f"""WITH kept AS (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = 64
        AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
    v AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda e: floor(64 * e::DOUBLE)::BIGINT) AS x FROM kept),
    c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS j, x FROM (SELECT sha256('1:' || vec_id) AS h, x FROM v ORDER BY h, x LIMIT 16)),
    {_rounds()}
    SELECT vec_id, a3.j::INTEGER AS cluster, a3.d::BIGINT AS distance, (sum(a3.d) OVER (PARTITION BY a3.j))::BIGINT AS cluster_inertia,
        (sum(a3.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c3.x, ',')) AS centroid_sha256
    FROM a3 JOIN v USING (n) JOIN c3 ON a3.j = c3.j"""

ORACLE_SQL = {
    "op13_centroids": CENTROIDS,
    "op3_substring_dedup": REPEATS,
    "op5_warc": RECORDS,
    "op7_quality_rules": RULES,
    "op10_decontamination": LEAKS,
}
