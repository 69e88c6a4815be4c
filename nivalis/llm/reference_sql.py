"""Reference SQL of the corpus queries that SQL can express, over the whole tables.

Rows are told apart by their number; words are lists, windows their joined words (no word holds a
space), so nothing here is hashed before it is compared, but for the windows of `op4`, which are
compared by digest."""

from __future__ import annotations

#: Documents with their words `[^\x20\x09-\x0D]+`.
_SPACED = r"""docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents)"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

JACCARD = f"""WITH {_SPACED},
s AS (SELECT DISTINCT r, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM docs WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY 1, 2),
e AS (SELECT a, b, c = x.n AND c = y.n AS same FROM c JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE c * 1.8e0 >= 0.8e0 * (x.n + y.n) - 1e-9),
reach AS (
    WITH RECURSIVE reach(r, o) AS (SELECT r, r FROM docs UNION SELECT e.b, reach.o FROM reach JOIN e ON e.a = reach.r)
    SELECT reach.r, min(d.doc_id) AS class_id FROM reach JOIN docs d ON d.r = reach.o GROUP BY 1)
SELECT d.doc_id, reach.class_id, (SELECT count(*) FROM e WHERE e.a = d.r) AS n_links,
       least(d.doc_id, (SELECT min(o.doc_id) FROM e JOIN docs o ON o.r = e.b WHERE e.a = d.r AND same)) AS text_class
FROM docs d JOIN reach ON reach.r = d.r"""

SUBSTRING = f"""WITH {_SPACED},
k AS (SELECT r, doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS h FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM docs WHERE len(w) >= 50)),
f AS (SELECT h, min(doc_id) AS first FROM k GROUP BY 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 50)) AS i FROM k JOIN f USING (h) WHERE first < doc_id),
words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM docs),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (r, i) GROUP BY 1),
n AS (SELECT r, count(*) AS n FROM gone GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n.n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM docs LEFT JOIN n USING (r) LEFT JOIN kept USING (r)"""

DECONTAMINATE = f"""WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_ALNUM} AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ALNUM} AS w FROM benchmark WHERE item_id IS NOT NULL),
k AS (SELECT item, l, array_to_string(w[i : i + l - 1], ' ') AS g FROM (SELECT item, w, least(10, len(w)) AS l, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT l FROM k),
d AS (SELECT r, l, i, array_to_string(w[i : i + l - 1], ' ') AS g FROM (SELECT r, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM docs, sizes WHERE len(w) >= l)),
hit AS (SELECT r, i, l, item FROM d JOIN (SELECT DISTINCT item, l AS l2, g AS g2 FROM k) ON g = g2 AND l = l2),
words AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + l)) AS p FROM hit) GROUP BY 1),
found AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM hit) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(found.n, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (r) LEFT JOIN found USING (r)"""

_ESCAPED = r"replace(replace({0}, '\', '\\'), '<|', '<\|')"
CHAT = rf"""WITH rows_ AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
t AS (SELECT *, row_number() OVER o AS k, count(*) OVER (PARTITION BY conv_id) AS n,
      sum(length('<|im_start|>') + length(replace({_ESCAPED.format('role')}, chr(10), '\n')) + 1 + length({_ESCAPED.format('text')}) + length('<|im_end|>') + 1) OVER o AS so_far
      FROM rows_ WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(so_far) FILTER (role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars
FROM t GROUP BY 1"""

#: The crc32 of a number's digits, bit by bit: a byte, then eight shifts (256) for each digit.
_CRC = """xor(4294967295::UBIGINT, list_reduce(
    list_prepend(4294967295::UBIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c)::UBIGINT, 256, 256, 256, 256, 256, 256, 256, 256]))),
    lambda a, b: CASE WHEN b < 256 THEN xor(a, b) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END))"""

LANGUAGE = f"""WITH docs AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce({_CRC} % 4 = 2, false) AS held_out,
    replace('_' || regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}]+', '_', 'g') || '_', '__', '_') AS t, text IS NOT NULL AS has FROM documents),
ch AS (SELECT r, string_split(t, '') AS ch FROM docs WHERE t <> '_'),
z AS (SELECT r, z[1] AS a, z[1] || z[2] AS b, z[1] || z[2] || z[3] AS c FROM (SELECT r, unnest(list_zip(ch, ch[2:], ch[3:])) AS z FROM ch)),
g AS (SELECT r, g, count(*) AS c FROM (SELECT r, unnest([a, b, c]) AS g FROM z) WHERE g IS NOT NULL AND g <> '_' GROUP BY 1, 2),
profile AS (SELECT lang, g, k FROM (SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY sum(c) DESC, g) - 1 AS k FROM g JOIN docs USING (r) WHERE NOT held_out AND lang IS NOT NULL AND has GROUP BY lang, g) WHERE k < 300),
own AS (SELECT * FROM (SELECT r, g, row_number() OVER (PARTITION BY r ORDER BY c DESC, g) - 1 AS k FROM g) WHERE k < 300),
apart AS (SELECT o.r, l.lang, sum(coalesce(abs(p.k - o.k), 300)) AS apart, count(*) AS n FROM own o CROSS JOIN (SELECT DISTINCT lang FROM profile) l LEFT JOIN profile p ON p.lang = l.lang AND p.g = o.g GROUP BY 1, 2),
best AS (SELECT r, arg_min(lang, (apart, lang)) AS lang, min(apart) AS apart, max(n) AS n FROM apart GROUP BY 1)
SELECT doc_id, held_out, coalesce(best.lang, 'und') AS lang_pred, coalesce(1e0 - CAST(apart AS DOUBLE) / CAST(300 * n AS DOUBLE), 0e0) AS score FROM docs LEFT JOIN best USING (r)"""

RANKED = f"""WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_ALNUM} AS w FROM documents),
sizes AS (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n FROM docs WHERE len(w) > 0),
whole AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM sizes),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM docs) GROUP BY 1, 2),
df AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS weight FROM tf, whole GROUP BY term, n_docs),
asked AS (SELECT q, any_value(item_id) AS item_id, term, count(*) AS times FROM (SELECT q, item_id, unnest(w) AS term FROM (SELECT row_number() OVER () AS q, item_id, {_ALNUM} AS w FROM benchmark)) GROUP BY q, term),
m AS (SELECT r, doc_id, 75 + (25 * n * n_docs) // n_terms AS m FROM sizes, whole),
scored AS (SELECT q, any_value(item_id) AS item_id, any_value(doc_id) AS doc_id, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
    FROM asked JOIN tf USING (term) JOIN df USING (term) JOIN m USING (r) GROUP BY q, r)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 20"""

VECTORS = """WITH v AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT *, sqrt(list_inner_product(e, e)) AS norm FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
l AS (SELECT a.r AS a, b.r AS b FROM u a JOIN u b ON a.r <> b.r AND len(a.e) = len(b.e) WHERE a.norm > 0 AND b.norm > 0 AND list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.9e0),
reach AS (
    WITH RECURSIVE reach(r, o) AS (SELECT r, r FROM v UNION SELECT l.b, reach.o FROM reach JOIN l ON l.a = reach.r)
    SELECT reach.r, min(o.vec_id) AS component_id FROM reach JOIN v o ON o.r = reach.o GROUP BY 1)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.r) AS n_links, component_id, coalesce(v.vec_id = component_id, false) AS kept FROM v JOIN reach USING (r)"""

ORACLES = {
    "op3_jaccard_join": JACCARD,
    "op4_substring_dedup": SUBSTRING,
    "op8_chat_format": CHAT,
    "op9_language_id": LANGUAGE,
    "op10_decontaminate": DECONTAMINATE,
    "op11_ranked_search": RANKED,
    "op12_vector_links": VECTORS,
}
