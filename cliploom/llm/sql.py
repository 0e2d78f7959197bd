"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

MIXING = r"""
WITH sized AS (
  SELECT doc_id, source,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    length(coalesce(text, '')) - length(translate(coalesce(text, ''), '#*$%&|<>', '')) AS symbols
  FROM documents),
keyed AS (
  SELECT doc_id, source, size,
    -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '/mix'), 1, 13))::BIGINT + 0.5::DOUBLE)
      / 4503599627370496::DOUBLE)
    / CASE WHEN size > 0 THEN size / (size + symbols)::DOUBLE ELSE 1.0::DOUBLE END AS key
  FROM sized),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, 2 * sum(size)::BIGINT AS cap,
    [5, 2, 1][1 + ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3)::INT] AS w
  FROM keyed GROUP BY source),
ranked AS (
  SELECT *, (sum(source_size) OVER ())::BIGINT AS total,
    coalesce(sum(cap) OVER before, 0)::BIGINT AS cap_before,
    (sum(w) OVER () - coalesce(sum(w) OVER before, 0))::BIGINT AS w_left
  FROM sources
  WINDOW before AS (ORDER BY cap::DOUBLE / w, source ASC NULLS LAST
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
marked AS (
  SELECT *, (total * 3 - cap_before * 2) * w > cap * 2 * w_left AS cut,
    (total * 3 - cap_before * 2)::DOUBLE / 2 / w_left AS level FROM ranked),
targets AS (
  SELECT source, source_size, CASE WHEN cut THEN cap::DOUBLE
    ELSE w * (SELECT arg_max(level, w_left) FROM marked WHERE NOT cut) END AS target
  FROM marked),
spread AS (
  SELECT k.*, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS epochs,
    coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM keyed k JOIN targets t ON k.source IS NOT DISTINCT FROM t.source),
chosen AS (
  SELECT *, epochs + CASE WHEN source_size > 0
    AND before + size / 2.0::DOUBLE <= target - epochs * source_size THEN 1 ELSE 0 END AS copies
  FROM spread)
SELECT doc_id, source, size, source_size, target, copies, size * copies AS taken FROM chosen
"""

CHAT = r"""
WITH said AS (
  SELECT conv_id::BIGINT AS conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text))
    AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text)
    FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(10 + length(role) + length(text)
    + length(role) - length(translate(role, '\<[|', ''))
    + length(text) - length(translate(text, '\<[|', '')))::BIGINT AS formatted_chars
FROM said GROUP BY conv_id
"""

SHARDING = r"""
WITH RECURSIVE shards AS (
  SELECT i, 'shard-' || lpad(i::VARCHAR, 2, '0') AS shard FROM range(64) r(i)),
steps AS (
  SELECT list(('0x' || substr(md5(shard || '/offset'), 1, 15))::BIGINT % 8191 ORDER BY i) AS starts,
    list(('0x' || substr(md5(shard || '/skip'), 1, 15))::BIGINT % 8190 + 1 ORDER BY i) AS skips
  FROM shards),
turns AS (
  SELECT 0 AS turn, -1::BIGINT AS slot, list_transform(range(8191), lambda x: true) AS free
  UNION ALL
  SELECT turn + 1, pick, list_transform(free, lambda f, k: f AND k <> pick + 1)
  FROM (
    SELECT turn, free, list_filter(
      list_transform(range(8191), lambda j: (starts[turn % 64 + 1] + j * skips[turn % 64 + 1]) % 8191),
      lambda s: free[s + 1])[1] AS pick
    FROM turns, steps WHERE turn < 8191)),
filled AS (SELECT slot, (turn - 1) % 64 AS i FROM turns WHERE turn > 0)
SELECT doc_id, f.slot::INT AS slot, shard
FROM (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % 8191 AS slot
  FROM documents) d
JOIN filled f ON f.slot = d.slot JOIN shards USING (i)
"""

WARC = r"""
WITH hashed AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes,
    sha1(coalesce(html, '')) AS hex FROM pages),
coded AS (
  SELECT *, list_aggregate(list_transform(range(32), lambda i:
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
        ((('0x' || substr(hex, (i // 4 * 5 + 1)::INT, 5))::BIGINT >> (15 - i % 4 * 5)) & 31)::INT + 1]),
    'string_agg', '') AS payload_digest,
    max(page_id) OVER (PARTITION BY hex) AS kept
  FROM hashed)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM kept THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM kept THEN kept END AS refers_to
FROM coded
"""

DECONTAMINATION = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row_id, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
items AS (
  SELECT item_id, words, least(len(words), 10) AS size FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM benchmark) WHERE len(words) > 0),
wanted AS (
  SELECT DISTINCT item_id, size, unnest(list_transform(range(1, len(words) - size + 2),
    lambda i: array_to_string(words[i:i + size - 1], ' '))) AS phrase
  FROM items),
windows AS (
  SELECT row_id, size, unnest(range(1, len(words) - size + 2)) AS begun,
    unnest(list_transform(range(1, len(words) - size + 2),
      lambda i: array_to_string(words[i:i + size - 1], ' '))) AS phrase
  FROM docs, (SELECT DISTINCT size FROM items) WHERE len(words) >= size),
hits AS (SELECT row_id, item_id, begun, size FROM windows JOIN wanted USING (size, phrase)),
covered AS (
  SELECT row_id, count(DISTINCT position) AS n_hit
  FROM (SELECT row_id, unnest(range(begun, begun + size)) AS position FROM hits) GROUP BY row_id),
named AS (
  SELECT row_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT row_id, item_id::VARCHAR AS item_id FROM hits) GROUP BY row_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (row_id) LEFT JOIN named USING (row_id)
"""

SPELLING = r"""
WITH RECURSIVE runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS doc, unnest(regexp_extract_all(translate(
    coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[a-z\x{C0}-\x{FF}]+')) AS run
  FROM documents),
counted AS (
  SELECT doc, run, count(*) AS k FROM runs WHERE length(run) >= 7 GROUP BY doc, run),
coded AS (
  -- CRC-32 bit by bit: a byte is taken in at its first bit
  SELECT run, k, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
      flatten(list_transform(string_split(doc || ':' || run, ''), lambda c:
        CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT]
        ELSE [192::BIGINT + (ord(c) >> 6), 128::BIGINT + (ord(c) & 63)] END)),
      lambda b: [b, 0, 0, 0, 0, 0, 0, 0]))),
    lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295) AS h
  FROM counted),
words AS (
  SELECT word, sum(k)::BIGINT AS n FROM (
    SELECT k, CASE WHEN h % 31 = 0 THEN run[:(h % length(run))::INT] || run[(h % length(run) + 2)::INT:]
      ELSE run END AS word FROM coded)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
shorter AS (
  SELECT word, n, i, word[:i - 1] || word[i + 1:] AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS other_n
  FROM shorter a JOIN shorter b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT DISTINCT s.word, s.n, w.word, w.n FROM shorter s JOIN words w ON s.rest = w.word
  UNION SELECT DISTINCT w.word, w.n, s.word, s.n FROM shorter s JOIN words w ON s.rest = w.word),
near AS (
  SELECT word, count(*) AS n_near,
    arg_min(other, {'n': -other_n, 'word': other}) FILTER (other_n >= 10 * n) AS form,
    max(other_n) FILTER (other_n >= 10 * n) AS form_n
  FROM pairs GROUP BY word),
chains AS (
  SELECT word, word AS root, 0 AS step FROM words
  UNION ALL
  SELECT c.word, n.form, step + 1 FROM chains c JOIN near n ON n.word = c.root WHERE n.form IS NOT NULL)
SELECT w.word, form, root, n, coalesce(n_near, 0)::BIGINT AS n_near, form_n
FROM words w LEFT JOIN near USING (word)
JOIN (SELECT word, arg_max(root, step) AS root FROM chains GROUP BY word) USING (word)
"""

RANKING = r"""
WITH words AS (
  SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(translate(
    coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
sized AS (
  SELECT row_id, doc_id, terms, len(terms)::BIGINT AS n, count(*) FILTER (len(terms) > 0) OVER () AS docs,
    (sum(len(terms)) OVER ())::BIGINT AS total FROM words),
counted AS (
  SELECT row_id, doc_id, 75 + (25 * n * docs) // total AS m, docs, term, count(*) AS tf
  FROM (SELECT row_id, doc_id, n, docs, total, unnest(terms) AS term FROM sized)
  GROUP BY ALL),
weighed AS (
  SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM counted GROUP BY term),
parts AS (
  SELECT row_id, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * m)) AS part
  FROM counted JOIN weighed USING (term)),
items AS (
  SELECT row_number() OVER () AS item, item_id, regexp_extract_all(translate(
    coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM benchmark),
asked AS (
  SELECT item, item_id, term, count(*) AS times
  FROM (SELECT item, item_id, unnest(terms) AS term FROM items) GROUP BY ALL),
scored AS (
  SELECT item, item_id, row_id, doc_id, sum(times * part)::BIGINT AS score
  FROM asked JOIN parts USING (term) GROUP BY ALL HAVING sum(times * part) > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank
  FROM scored) WHERE rank <= 20
"""

CHECKS = {"op13_ranking": RANKING, "op12_spelling": SPELLING, "op4_decontamination": DECONTAMINATION, "op5_mixing": MIXING, "op8_chat_formatting": CHAT, "op9_sharding": SHARDING,
          "op10_warc": WARC}
