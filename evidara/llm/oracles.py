"""DuckDB SQL with the rows of those queries that SQL can express."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ITEM_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_BLANK_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"

OP2 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_BLANK_WORDS.format(_LOWER)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS s
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
sets AS (SELECT doc_id, md5(string_agg(s, '|' ORDER BY s)) AS h FROM s GROUP BY doc_id),
class AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS r FROM sets),
rs AS (SELECT s.doc_id, s.s FROM s JOIN class ON s.doc_id = class.doc_id AND class.r = class.doc_id),
pair AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS shared FROM rs a JOIN rs b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT u, v FROM pair JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * shared >= 75 * (a.n + b.n - shared)
         UNION ALL SELECT r, doc_id FROM class WHERE r <> doc_id),
arc AS (SELECT u, v FROM link UNION SELECT v, u FROM link),
reach AS (SELECT u AS doc_id, v AS r FROM arc UNION SELECT reach.doc_id, arc.v FROM reach JOIN arc ON arc.u = reach.r),
least_ AS (SELECT doc_id, min(r) AS r FROM reach GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(l.r, w.doc_id)) AS component_id,
       w.doc_id = least(w.doc_id, coalesce(l.r, w.doc_id)) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN least_ l ON l.doc_id = w.doc_id
"""

OP8 = rf"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ITEM_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
g AS (SELECT DISTINCT item, least(len(w), 13) AS n, w[i:i + least(len(w), 13) - 1] AS g
      FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents),
x AS (SELECT doc_id, n, i, w[i:i + n - 1] AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
      FROM d CROSS JOIN (SELECT DISTINCT n FROM g) WHERE len(w) >= n)),
h AS (SELECT x.doc_id, x.i, x.n, g.item FROM x JOIN g ON x.n = g.n AND x.g = g.g),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
       sha256(coalesce(t.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""

OP9 = rf"""
WITH d AS (SELECT doc_id, {_BLANK_WORDS.format("coalesce(text, '')")} AS w FROM documents),
x AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
m AS (SELECT h, min(doc_id) AS first FROM x GROUP BY h),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM x JOIN m USING (h) WHERE m.first < doc_id),
k AS (SELECT e.doc_id, string_agg(e.w, ' ' ORDER BY e.p) AS t FROM (SELECT doc_id, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS p FROM d) e
      ANTI JOIN r ON r.doc_id = e.doc_id AND r.p = e.p GROUP BY e.doc_id),
c AS (SELECT doc_id, count(*) AS n FROM r GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(c.n, 0) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id
"""

_SAID = "replace(replace({0}, '<|im_start|>', '<|im_start |>'), '<|im_end|>', '<|im_end |>')"

OP6 = f"""
WITH t AS (SELECT conv_id, turn, CASE WHEN trim(coalesce(role, '')) = '' THEN 'unknown' ELSE role END AS author, coalesce(text, '') AS body FROM conversations),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(author || '|' || body), author, body) - 1 AS pos FROM t),
p AS (SELECT DISTINCT conv_id, author AS speaker FROM t WHERE author <> 'system'),
r AS (SELECT o.conv_id, speaker, pos, pos // 256 AS part, author = speaker AS own,
             '<|im_start|>' || CASE WHEN author = 'system' THEN 'system' WHEN author = speaker THEN 'assistant'
                                    ELSE 'user name=' || translate({_SAID.format("author")}, chr(13) || chr(10), '  ') END || chr(10) AS head,
             {_SAID.format("body")} || '<|im_end|>' || chr(10) AS tail
      FROM o JOIN p ON o.conv_id IS NOT DISTINCT FROM p.conv_id),
rr AS (SELECT * FROM r UNION ALL SELECT r.conv_id, r.speaker, r.pos, p.part, false, r.head, r.tail FROM r
       JOIN (SELECT DISTINCT conv_id, speaker, part FROM r WHERE part > 0) p ON p.conv_id IS NOT DISTINCT FROM r.conv_id AND p.speaker = r.speaker
       WHERE r.part = 0 AND starts_with(r.head, '<|im_start|>system')),
h AS (SELECT *, sum(length(head) + length(tail)) OVER (PARTITION BY conv_id, speaker, part ORDER BY pos) AS stop FROM rr)
SELECT conv_id, speaker, part, count(*) AS n_turns, string_agg(head || tail, '' ORDER BY pos) AS text,
       coalesce(string_agg(CAST(stop - length(tail) AS VARCHAR) || '-' || CAST(stop AS VARCHAR), ',' ORDER BY pos) FILTER (own), '') AS masks,
       coalesce(sum(length(tail)) FILTER (own), 0) AS n_trained
FROM h GROUP BY conv_id, speaker, part
"""

#: CRC-32 has no function there: its table of 256 remainders, and a fold over the bytes of Latin-1 letters.
_CRC_TABLE = """bits AS (SELECT n, 0 AS k, n::UBIGINT AS c FROM range(256) t(n)
         UNION ALL SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384::UBIGINT, c >> 1) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY n) AS tab FROM bits WHERE k = 8)"""
_CRC = """xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, flatten(list_transform(string_split({0}, ''),
           lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)::UBIGINT] ELSE [(192 + ord(x) // 64)::UBIGINT, (128 + ord(x) % 64)::UBIGINT] END))),
           lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255)::INT + 1])))"""

OP12 = rf"""
WITH RECURSIVE {_CRC_TABLE},
r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]{{6,}}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w
      FROM documents),
u AS (SELECT doc_id, w, count(*) AS n FROM r GROUP BY ALL),
h AS (SELECT w, n, {_CRC.format("coalesce(doc_id::VARCHAR, '') || ':' || w")} AS h FROM u, crc),
v AS (SELECT CASE WHEN h % 199 = 0 THEN w[:(h % length(w))::INT] || w[(h % length(w))::INT + 2:] ELSE w END AS word, sum(n)::BIGINT AS n FROM h
      GROUP BY 1 HAVING sum(n) >= 5 AND length(word) >= 6),
p AS (SELECT word, n, i, word[:i - 1] || word[i + 1:] AS less FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM v)),
near AS (SELECT a.word, b.word AS other, b.n AS m FROM p a JOIN p b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
         UNION SELECT a.word, b.word, b.n FROM p a JOIN v b ON a.less = b.word UNION SELECT b.word, a.word, a.n FROM p a JOIN v b ON a.less = b.word),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-m, encode(other))) AS form, max(m) AS form_n FROM near GROUP BY word),
f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * n THEN form END AS form, CASE WHEN form_n >= 5 * n THEN form_n END AS form_n
      FROM v LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root, 0 AS k FROM f UNION ALL SELECT chain.word, f.form, k + 1 FROM chain JOIN f ON f.word = chain.root WHERE f.form IS NOT NULL),
last AS (SELECT word, arg_max(root, k) AS root FROM chain GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM f JOIN last USING (word)
"""

_TURN = "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"
_ENDS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

#: Forward over the rows, with the cheapest edits of least letters for each state; before a row come up to three insertions.
OP13 = f"""
WITH RECURSIVE {_CRC_TABLE},
c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC.format(_TURN)} % 20 AS k FROM conversations, crc),
d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
      FROM c, range(2) r(copy) WHERE k <> 0 AND (copy = 0 OR k = 3)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, right(rtrim(text, {_ENDS}), 1) AS e FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS prior FROM o),
f AS (SELECT *, CASE WHEN e = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN e NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM p),
follows(q, x, then_) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
added(q, x, then_) AS (VALUES (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
more(q, n, lines, then_) AS (SELECT q, 0, []::VARCHAR[], q FROM range(4) r(q)
      UNION ALL SELECT m.q, n + 1, list_append(lines, CASE x WHEN 'u' THEN 'user:' ELSE 'assistant:' END), a.then_ FROM more m JOIN added a ON a.q = m.then_ WHERE n < 3),
edits AS (SELECT conv_id, i, q.q, 'D' AS letter, 2 AS cost, q.q AS then_, []::VARCHAR[] AS line FROM f, range(4) q(q)
      UNION ALL SELECT conv_id, i, q, 'K', CASE fault WHEN '' THEN 0 ELSE 5 END, then_, [role || ':' || text] FROM f JOIN follows ON x = role[1] WHERE fault IN ('', 'truncated')
      UNION ALL SELECT conv_id, i, q, 'R', CASE fault WHEN '' THEN 1 ELSE 6 END, then_, [CASE x WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text] FROM f, added
                WHERE fault IN ('', 'truncated')),
best AS (SELECT conv_id, 0::BIGINT AS i, 0::BIGINT AS q, 0::BIGINT AS cost, '' AS audit, []::VARCHAR[] AS lines FROM (SELECT DISTINCT conv_id FROM conversations)
      UNION ALL SELECT conv_id, i, q, cost, audit, lines FROM (
        SELECT *, row_number() OVER (PARTITION BY conv_id, q ORDER BY cost, audit) AS place FROM (
          SELECT b.conv_id, e.i, e.then_ AS q, b.cost + 5 * m.n + e.cost AS cost, b.audit || repeat('I', m.n) || e.letter AS audit, b.lines || m.lines || e.line AS lines
          FROM best b JOIN more m ON m.q = b.q JOIN edits e ON e.conv_id IS NOT DISTINCT FROM b.conv_id AND e.i = b.i + 1 AND e.q = m.then_)) WHERE place = 1),
ends AS (SELECT b.conv_id, b.cost + 5 * n AS cost, audit || repeat('I', n) AS audit, b.lines || m.lines AS lines FROM best b JOIN more m ON m.q = b.q
      WHERE then_ IN (0, 3) AND b.i = (SELECT count(*) FROM f WHERE f.conv_id IS NOT DISTINCT FROM b.conv_id)),
least AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) AS place FROM ends),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
      count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (prior || role[1] NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT l.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       cost, audit, sha256(array_to_string(lines, chr(10))) AS repaired_sha256
FROM least l LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM l.conv_id WHERE place = 1
"""

ORACLES = {"op6_chat_perspectives": OP6, "op2_minhash_near_dedup": OP2, "op8_benchmark_decontamination": OP8, "op9_substring_dedup": OP9, "op12_spelling_variants": OP12, "op13_conversation_repair": OP13}
