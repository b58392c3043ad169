"""DuckDB SQL of the queries that SQL can express: exact definitions, written from the contracts."""

from __future__ import annotations

SQL: dict[str, str] = {}

# A word: a run without space, tab, line feed, vertical tab, form feed or carriage return.
_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
_ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL["op1_near_dedup"] = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(text=_ASCII_LOWER)} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
             ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
x AS (SELECT doc_id, unnest(s) AS g FROM s),
pairs AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT u, v FROM pairs JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * k >= 80 * (a.n + b.n - k)),
both_ways AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
reach AS (SELECT u AS node, u AS other FROM both_ways UNION SELECT r.node, b.v FROM reach r JOIN both_ways b ON r.other = b.u),
root AS (SELECT node, min(other) AS root FROM reach GROUP BY node)
SELECT n.doc_id, n.n AS n_shingles, coalesce(root.root, n.doc_id) AS component_id, coalesce(root.root, n.doc_id) = n.doc_id AS kept
FROM n LEFT JOIN root ON root.node = n.doc_id"""

SQL["op4_suffix_dedup"] = """WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
p AS (SELECT doc_id, b, unnest(range(octet_length(b) - 199)) AS i FROM b WHERE octet_length(b) >= 200),
h AS (SELECT doc_id, i, md5(b[i + 1:i + 200]) AS h FROM p),
r AS (SELECT h FROM h GROUP BY h HAVING count(*) > 1),
hit AS (SELECT doc_id, i FROM h WHERE h IN (SELECT h FROM r)),
step AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER w + 200 THEN 0 ELSE 1 END AS fresh FROM hit WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
run AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM step),
span AS (SELECT doc_id, k, min(i) AS a, max(i) + 200 AS z FROM run GROUP BY doc_id, k),
gap AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS kept_from FROM span),
agg AS (SELECT g.doc_id, count(*) AS n_spans, sum(z - a) AS n_removed, max(z) AS last,
               list(b.b[kept_from + 1:a] ORDER BY a) AS parts
        FROM gap g JOIN b ON b.doc_id = g.doc_id GROUP BY g.doc_id)
SELECT b.doc_id, CAST(octet_length(b.b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(CASE WHEN agg.doc_id IS NULL THEN b.b
                   ELSE list_reduce(list_append(parts, b.b[last + 1:octet_length(b.b)]), lambda x, y: x || y) END) AS kept_sha256
FROM b LEFT JOIN agg ON agg.doc_id = b.doc_id"""

_BASE32 = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
_DIGIT = "substr(" + _BASE32 + ", CAST((CAST('0x' || substr(d, 5 * g + 1, 5) AS BIGINT) >> {shift}) & 31 AS INTEGER) + 1, 1)"

SQL["op6_warc"] = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS d FROM pages),
q AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS n, d, max(page_id) OVER (PARTITION BY d) AS top FROM p)
SELECT page_id, n AS payload_bytes,
       array_to_string(list_transform(range(8), lambda g: {" || ".join(_DIGIT.format(shift=s) for s in (15, 10, 5, 0))}), '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM q"""

SQL["op9_substring_dedup"] = f"""WITH d AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM p),
first AS (SELECT h, min(doc_id) AS first FROM h GROUP BY h),
hit AS (SELECT h.doc_id, h.i FROM h JOIN first USING (h) WHERE first.first < h.doc_id),
gone AS (SELECT doc_id, list(DISTINCT j) AS gone FROM (SELECT doc_id, unnest(range(i, i + 50)) AS j FROM hit) GROUP BY doc_id),
k AS (SELECT d.doc_id, len(d.w) AS n, CASE WHEN gone.doc_id IS NULL THEN d.w
             ELSE (SELECT list(e.x ORDER BY e.j) FROM (SELECT unnest(d.w) AS x, unnest(range(1, len(d.w) + 1)) AS j) e
                   WHERE NOT list_contains(gone.gone, e.j)) END AS kept
      FROM d LEFT JOIN gone ON gone.doc_id = d.doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(n - coalesce(len(kept), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM k"""

SQL["op12_phrases"] = rf"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_ASCII_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece
           FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
x AS (SELECT lang, w, unnest(range(1, 6)) AS k FROM w),
y AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM x WHERE len(w) >= k),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS a FROM y GROUP BY ALL HAVING count(*) >= 100),
cand AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k >= 2),
part AS (SELECT lang, unnest([array_to_string(w[1:k - 1], ' '), array_to_string(w[2:k], ' ')]) AS phrase, a FROM cand WHERE k > 2),
kept AS (SELECT c.* FROM cand c WHERE NOT EXISTS (SELECT 1 FROM part WHERE part.lang = c.lang AND part.phrase = c.phrase AND 100 * part.a >= 100 * c.a)),
cut AS (SELECT *, unnest(range(1, k)) AS j FROM kept),
scored AS (SELECT cut.lang, cut.phrase, cut.a, l.a AS l, r.a AS r, n, j,
                  CAST((CAST(1000 AS HUGEINT) * cut.a * n) // (CAST(l.a AS HUGEINT) * r.a) AS BIGINT) AS score
           FROM cut JOIN total ON total.lang = cut.lang
           JOIN f l ON l.lang = cut.lang AND l.phrase = array_to_string(w[1:j], ' ')
           JOIN f r ON r.lang = cut.lang AND r.phrase = array_to_string(w[j + 1:cut.k], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best QUALIFY rank <= 2000"""

_TERMS = rf"regexp_extract_all({_ASCII_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

SQL["op13_ranked_search"] = rf"""WITH d AS (SELECT doc_id, unnest({_TERMS}) AS t FROM documents),
n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
total AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM n),
tf AS (SELECT doc_id, t, count(*) AS tf FROM d GROUP BY doc_id, t),
w AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY t),
m AS (SELECT doc_id, 100 - 25 + ((25 * n * n_docs) // n_terms) AS m FROM n, total),
q AS (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark),
qt AS (SELECT item_id, t, count(*) AS c FROM q GROUP BY item_id, t),
s AS (SELECT item_id, doc_id, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
      FROM qt JOIN w USING (t) JOIN tf USING (t) JOIN m USING (doc_id) GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 20"""
