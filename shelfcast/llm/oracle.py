"""DuckDB SQL of the registered training-data queries, over the same tables."""

from __future__ import annotations

from shelfcast.llm.line_dedup import OP8_SQL

OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hx FROM pages),
w AS (SELECT page_id, strlen(body) AS n, hx, max(page_id) OVER (PARTITION BY body) AS winner FROM p),
d AS (SELECT page_id, n, winner,
      array_to_string([array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
          ((('0x' || substr(hx, 1 + 10 * g, 10))::BIGINT >> (5 * k)) & 31)::INT + 1, 1)
          FOR k IN [7, 6, 5, 4, 3, 2, 1, 0]], '') FOR g IN [0, 1, 2, 3]], '') AS payload_digest FROM w)
SELECT page_id, n::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN page_id < winner THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < winner THEN winner END AS refers_to FROM d
"""

_RULES = {
    "assign": r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
    "github": r"gh[pousr]_[A-Za-z0-9]+",
    "jwt": r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+",
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
}
_LEAST = {"assign": 6, "access": 20, "hex": 24, "github": 40, "jwt": 30, "private_key": 1}


def _op6() -> str:
    ctes, union = [], []
    for n, (kind, rx) in enumerate(_RULES.items()):
        ctes.append(f"""m{n} AS (SELECT doc_id, list_transform(regexp_split_to_array(t, '{rx}'), lambda x: len(x)) AS gaps,
            regexp_extract_all(t, '{rx}') AS found, regexp_extract_all(t, '{rx}', {2 if kind == 'assign' else 0}) AS vals FROM t)""")
        union.append(f"""SELECT doc_id, {n} AS o, '{kind}' AS kind,
            list_sum(gaps[1:i]) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: len(x))), 0) AS s, len(found[i]) AS n
            FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM m{n} WHERE len(found) > 0) WHERE len(vals[i]) >= {_LEAST[kind]}""")
    return f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), {', '.join(ctes)},
    u AS ({' UNION ALL '.join(union)}),
    v AS (SELECT doc_id, kind, o, s, kind || ':' || s::BIGINT || ':' || (s + n)::BIGINT AS span FROM u),
    g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS na, count(*) FILTER (kind = 'access') AS nc,
          count(*) FILTER (kind = 'hex') AS nh, string_agg(span, ',' ORDER BY s, o) FILTER (o < 3) AS base,
          string_agg(span, ',' ORDER BY s, o) AS spans FROM v GROUP BY doc_id)
    SELECT t.doc_id, coalesce(na, 0) AS n_assign, coalesce(nc, 0) AS n_access, coalesce(nh, 0) AS n_hex,
           sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN g USING (doc_id)"""


OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS win
       FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
       FROM (SELECT d.*, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, win)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM h)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS k FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""

OP3_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{20}\x{09}-\x{0D}]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 3) - 1], ' ') AS g
      FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 3) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
l AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.y FROM r JOIN l ON l.x = r.b)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, m.component_id FROM d LEFT JOIN n USING (doc_id)
JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) m USING (doc_id)
"""

#: crc32 over the bytes of a text: the reflected polynomial 0xEDB88320, eight steps a byte.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, 1 + strlen({0})), lambda k:
    ('0x' || substr(hex(encode({0})), (2 * k - 1)::INT, 2))::BIGINT)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)),
        lambda c, step: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)))"""

OP11_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+') AS w FROM documents),
r AS (SELECT run, n, {_CRC.format("key")} AS h FROM (SELECT run, count(*) AS n, coalesce(doc_id::VARCHAR, '') || ':' || run AS key
      FROM (SELECT doc_id, unnest(w) AS run FROM d) GROUP BY doc_id, run)),
t AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM r),
v AS (SELECT word, sum(n)::BIGINT AS n FROM t WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
c AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
g AS (SELECT word, n, substr(word, 1, (i - 1)::INT) || '*' || substr(word, (i + 1)::INT) AS k FROM c),
x AS (SELECT DISTINCT word, n, substr(word, 1, (i - 1)::INT) || substr(word, (i + 1)::INT) AS k FROM c),
i AS (SELECT x.word AS a, x.n AS na, v.word AS b, v.n AS nb FROM x JOIN v ON v.word = x.k),
p AS (SELECT a.word AS a, b.word AS b, b.n AS nb FROM g a JOIN g b USING (k) WHERE a.word <> b.word
      UNION ALL SELECT a, b, nb FROM i UNION ALL SELECT b, a, na FROM i),
m AS (SELECT a, count(*) AS n_near, max(nb) AS top, first(b ORDER BY nb DESC, b) AS b FROM p GROUP BY a),
f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 2 * n THEN b END AS form, CASE WHEN top >= 2 * n THEN top END AS form_n
      FROM v LEFT JOIN m ON a = word),
z AS (SELECT word, word AS up, 0 AS step FROM f UNION ALL SELECT z.word, f.form, step + 1 FROM z JOIN f ON f.word = z.up WHERE f.form IS NOT NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN (SELECT word, arg_max(up, step) AS root FROM z GROUP BY word) USING (word)
"""

OP12_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS la, b.vec_id, b.label, list_dot_product(a.q, b.q)::BIGINT AS score
      FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE label = la
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE label <> la AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10
"""

OP13_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x{20}\x{09}-\x{0D}]+') AS w FROM documents),
o AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
f AS (SELECT win, min(doc_id) AS lo FROM o GROUP BY win HAVING min(doc_id) < max(doc_id)),
h AS (SELECT doc_id, list(DISTINCT p) AS gone, FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM o JOIN f USING (win) WHERE doc_id > lo) GROUP BY doc_id),
k AS (SELECT doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN h USING (doc_id))
SELECT doc_id, len(w)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed,
       sha256(array_to_string([w[j] FOR j IN range(1, len(w) + 1) IF NOT list_contains(gone, j)], ' ')) AS kept_sha256,
       len(list_filter(gone, lambda j: NOT list_contains(gone, j - 1)))::BIGINT AS n_spans FROM k
"""

SQL = {
    "op11_spelling": OP11_SQL,
    "op12_hard_negatives": OP12_SQL,
    "op13_substring_dedup": OP13_SQL,
    "op3_jaccard_join": OP3_SQL,
    "op2_decontaminate": OP2_SQL,
    "op4_warc": OP4_SQL,
    "op6_secret_scan": _op6(),
    "op8_line_dedup": OP8_SQL,
}
