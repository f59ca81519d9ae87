"""DuckDB SQL of the corpus queries that SQL can express."""

SQL: dict[str, str] = {}

SQL["op10_decontaminate"] = r"""
WITH item AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0)
), doc AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents
), place AS (
  SELECT doc_id, w, n, i
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)
), occ AS (
  SELECT p.doc_id, p.i, p.n, win.item_id
  FROM place p JOIN win ON win.n = p.n AND win.win = array_to_string(p.w[p.i : p.i + p.n - 1], ' ')
), hit AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM occ) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM occ) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

SQL["op1_ngram_jaccard"] = r"""
WITH RECURSIVE doc AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents
), shingle AS (
  SELECT DISTINCT r, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 3], ' ') END AS s
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM doc WHERE len(w) > 0)
), size AS (
  SELECT r, count(*) AS n FROM shingle GROUP BY r
), alike AS (
  SELECT a.r AS x, b.r AS y, count(*) AS o FROM shingle a JOIN shingle b ON a.s = b.s AND a.r < b.r GROUP BY 1, 2
), link AS (
  SELECT x, y FROM alike JOIN size m ON m.r = x JOIN size n ON n.r = y WHERE 100 * o >= 85 * (m.n + n.n - o)
), edge AS (
  SELECT x, y FROM link UNION ALL SELECT y, x FROM link
), reach(r, y) AS (
  SELECT DISTINCT x, x FROM edge UNION SELECT reach.r, edge.y FROM reach JOIN edge ON edge.x = reach.y
)
SELECT d.doc_id, coalesce(any_value(size.n), 0)::BIGINT AS n_shingles, coalesce(min(t.doc_id), d.doc_id) AS component_id
FROM doc d LEFT JOIN size USING (r) LEFT JOIN reach ON reach.r = d.r LEFT JOIN doc t ON t.r = reach.y GROUP BY d.r, d.doc_id
"""

SQL["op12_quality_rules"] = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), word AS (
  SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM doc
), place AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS win
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM word WHERE len(w) > 2)
), again AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c FROM place) WHERE c > 1
), covered AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY r
), counted AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines)::BIGINT AS n_lines,
         coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
         len(regexp_extract_all(t, '[A-Z]')) AS n_upper, len(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]')) AS n_letters, len(regexp_extract_all(t, '!')) AS n_bangs
  FROM word LEFT JOIN covered USING (r)
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 5 * n_symbols > n_words OR 2 * n_upper > n_letters OR 10 * n_bangs > 3 * n_words OR 2 * n_dup_lines > n_lines
            OR word_chars > 12 * n_words OR 2 * word_chars < 5 * n_words) AS kept
FROM judged
"""

#: The table of the crc32, and the crc32 of a text of code points below 0x800, as DuckDB expressions.
CRC_TABLE = """
crc AS (
  SELECT list(list_reduce([b::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS t
  FROM range(256) r(b)
)"""


def crc32(text: str) -> str:
    """The expression for a text column, where ``t`` of the table ``crc`` is in scope."""
    points = f"list_transform(string_split({text}, ''), lambda z: unicode(z)::BIGINT)"
    octets = f"flatten(list_transform({points}, lambda p: CASE WHEN p < 128 THEN [p] ELSE [192 | (p >> 6), 128 | (p & 63)] END))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)"


SQL["op13_spelling_variants"] = f"""
WITH RECURSIVE {CRC_TABLE}, run AS (
  SELECT doc_id, run, count(*) AS c
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
  WHERE length(run) >= 5 GROUP BY ALL
), hashed AS (
  SELECT run, c, {crc32("doc_id::VARCHAR || ':' || run")} AS h FROM run, crc
), word AS (
  SELECT word, sum(c)::BIGINT AS n
  FROM (SELECT c, CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 5 GROUP BY 1 HAVING sum(c) >= 3
), less AS (
  SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS k FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM word)
), near AS (
  SELECT a.word, b.word AS o FROM less a JOIN less b ON a.k = b.k AND a.i = b.i AND a.word <> b.word
  UNION SELECT k, word FROM less WHERE k IN (SELECT word FROM word)
  UNION SELECT word, k FROM less WHERE k IN (SELECT word FROM word)
), best AS (
  SELECT near.word, count(*) AS n_near, arg_min({{'w': o, 'n': m.n}}, (-m.n, o)) AS top FROM near JOIN word m ON m.word = o GROUP BY 1
), rated AS (
  SELECT word.word, word.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN top.n >= 2 * word.n THEN top.w END AS form, CASE WHEN top.n >= 2 * word.n THEN top.n END AS form_n
  FROM word LEFT JOIN best USING (word)
), walk AS (
  SELECT word, word AS root, form AS next FROM rated
  UNION ALL SELECT walk.word, walk.next, rated.form FROM walk JOIN rated ON rated.word = walk.next
)
SELECT rated.word, form, root, n, n_near, form_n FROM rated JOIN walk ON walk.word = rated.word AND walk.next IS NULL
"""

#: Ways to each state (0 none, 1 s, 2 u, 3 a): s, cost g, audit a, repaired turns r.  Inserts a turn behind each, and keeps the best way to each state.
_INSERTED = "list_transform(ways, lambda w: {'s': CASE WHEN w.s = 2 THEN 3 ELSE 2 END, 'g': w.g + 5, 'a': w.a || 'I', 'r': list_append(w.r, CASE WHEN w.s = 2 THEN 'assistant:' ELSE 'user:' END)})"
_BEST = "list_filter(list_transform([0, 1, 2, 3], lambda s: list_min(list_filter({}, lambda w: w.s = s))), lambda w: w IS NOT NULL)"
_WIDER = _BEST.format(f"list_concat(ways, {_INSERTED})")
_TAKEN = """list_concat(
  list_transform(ways, lambda w: {'s': w.s, 'g': w.g + 2, 'a': w.a || 'D', 'r': w.r}),
  list_transform(list_filter(ways, lambda w: fault NOT IN ('blank', 'duplicate') AND (initial = 's' AND w.s = 0 OR initial = 'u' AND w.s <> 2 OR initial = 'a' AND w.s = 2)),
    lambda w: {'s': CASE initial WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, 'g': w.g + charge, 'a': w.a || 'K', 'r': list_append(w.r, role || ':' || text)}),
  list_transform(list_filter(ways, lambda w: fault NOT IN ('blank', 'duplicate')),
    lambda w: {'s': CASE WHEN w.s = 2 THEN 3 ELSE 2 END, 'g': w.g + 1 + charge, 'a': w.a || 'R', 'r': list_append(w.r, CASE WHEN w.s = 2 THEN 'assistant:' ELSE 'user:' END || text)}))"""

SQL["op11_conversation_repair"] = rf"""
WITH RECURSIVE {CRC_TABLE}, conv AS (
  SELECT conv_id, row_number() OVER () AS c FROM (SELECT DISTINCT conv_id FROM conversations)
), broken AS (
  SELECT c, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS k
  FROM conversations JOIN conv USING (conv_id), crc
), kept AS (
  SELECT c, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM broken WHERE k <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text, copy) AS i, substr(role, 1, 1) AS initial,
         regexp_extract(text, '[^\x20\x09-\x0D]([\x20\x09-\x0D]*)$', 0)[1] AS last
  FROM kept
), faulty AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'duplicate'
                 WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         lag(initial) OVER (PARTITION BY c ORDER BY i) || initial AS pair
  FROM placed
), charged AS (
  SELECT *, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS charge FROM faulty
), counted AS (
  SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
  FROM charged GROUP BY c
), walk AS (
  SELECT c, 0::BIGINT AS i, [{{'s': 0, 'g': 0, 'a': '', 'r': []::VARCHAR[]}}] AS ways FROM conv
  UNION ALL
  SELECT c, i, {_BEST.format(_TAKEN)} AS ways
  FROM (SELECT * REPLACE ({_WIDER} AS ways) FROM (SELECT walk.c, r.i, r.role, r.text, r.initial, r.fault, r.charge, {_WIDER} AS ways FROM walk JOIN charged r ON r.c = walk.c AND r.i = walk.i + 1))
), ended AS (
  SELECT walk.c, ways FROM walk LEFT JOIN counted USING (c) WHERE walk.i = coalesce(n, 0)
), wider AS (
  SELECT c, {_WIDER} AS ways FROM (SELECT c, {_WIDER} AS ways FROM ended)
), best AS (
  SELECT c, list_min(list_transform(list_filter(ways, lambda w: w.s IN (0, 3)), lambda w: {{'g': w.g, 'a': w.a, 'r': w.r}})) AS b FROM wider
)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, b.g::BIGINT AS cost, b.a AS audit, sha256(array_to_string(b.r, chr(10))) AS repaired_sha256
FROM conv JOIN best USING (c) LEFT JOIN counted USING (c)
"""
