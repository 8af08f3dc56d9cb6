"""DuckDB SQL of the queries that SQL can express on whole tables.

op1, op6 and op10 are tested against brute force instead (their SQL would compare every window or pair of the corpus);
op3, op5 and op8 have no SQL form.
"""

from __future__ import annotations

SQL: dict[str, str] = {}


def _escaped(text: str) -> str:
    """The escaping of the chat template in SQL: "\\" first, then the first character of each control string."""
    out = f"replace({text}, '\\', '\\0')"
    for string in ("<</SYS>>", "<<SYS>>", "<|role:", "<|end|>", "</s>", "<s>"):
        out = f"replace({out}, '{string}', '\\1{string[1:]}')"
    for string in ("[/INST]", "[INST]"):
        out = f"replace({out}, '{string}', '\\2{string[1:]}')"
    return f"replace({out}, '|>', '\\3>')"


SQL["op2_chat_format"] = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), u AS (
  SELECT *, length({_escaped('text')}) + CASE role WHEN 'system' THEN 17 WHEN 'user' THEN 15 WHEN 'assistant' THEN 9
    ELSE 16 + length({_escaped('role')}) END AS chars,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars,
  bool_and(CASE role WHEN 'system' THEN before IS NULL WHEN 'user' THEN before IS NULL OR before <> 'user'
    WHEN 'assistant' THEN coalesce(before = 'user', false) ELSE false END)
    AND arg_max(role, (turn, role, text)) = 'assistant' AS valid
FROM u GROUP BY conv_id
"""

_WORDS = r"[^\x20\x09-\x0D]+"
_LINE = r"trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'))"

SQL["op4_quality_rules"] = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS ws
  FROM documents
), runs AS (
  SELECT doc_id, unnest(list_transform(range(0, len(ws) - 7), lambda i: {{'i': i, 'w': array_to_string(ws[i + 1:i + 8], ' ')}})) AS r
  FROM d WHERE len(ws) >= 8
), again AS (
  SELECT doc_id, r.i AS i FROM runs QUALIFY count(*) OVER (PARTITION BY doc_id, r.w) > 1
), repeated AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM again) GROUP BY doc_id
), raw AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM d
), dup AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM raw WHERE regexp_matches(line, '{_WORDS}') GROUP BY doc_id
), lines AS (
  SELECT doc_id, source, {_LINE} AS line FROM raw WHERE regexp_matches(line, '{_WORDS}')
), frequent AS (
  SELECT source, line FROM lines GROUP BY source, line
  HAVING count(DISTINCT doc_id) > 5
), gone AS (
  SELECT doc_id, sum(len(string_split(line, ' ')))::BIGINT AS n FROM lines JOIN frequent USING (source, line) GROUP BY doc_id
), counts AS (
  SELECT d.doc_id, len(ws)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
    coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(repeated.n, 0)::BIGINT AS n_repeat_words,
    coalesce(gone.n, 0)::BIGINT AS n_line_words
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN repeated USING (doc_id) LEFT JOIN gone USING (doc_id)
)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * (n_words - n_line_words) >= 30 * n_words AS kept
FROM counts
"""

SQL["op7_url_filter"] = r"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM pages
), rules(rule, h, pre, what) AS (
  VALUES ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
    ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'),
    ('net/fr/', 'net', '/fr/', 'block')
), best AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(what, length(rule)) AS what
  FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre) GROUP BY page_id
), seen AS (
  -- the document of a page is the number that the second part of its path is
  SELECT host, count(*) AS n, sum(quality) AS good
  FROM p JOIN labels ON doc_id = TRY_CAST(regexp_extract(path, '^/[^/]+/([0-9]{1,18})(\.[A-Za-z]+)?/?$', 1) AS BIGINT)
  WHERE quality IN (0, 1) GROUP BY host
), units AS (
  SELECT host, array_to_string(list_slice(string_split(host, '.'), -1 - long, -1), '.') AS suffix,
    array_to_string(list_slice(string_split(host, '.'), -2 - long, -1), '.') AS domain,
    coalesce(n, 0) AS n, coalesce(good, 0) AS good
  FROM (SELECT DISTINCT host, CAST(array_to_string(list_slice(string_split(host, '.'), -2, -1), '.')
          IN ('co.uk', 'org.uk', 'ac.uk', 'com.au', 'co.jp', 'com.br') AS INTEGER) AS long FROM p) LEFT JOIN seen USING (host)
), overall AS (
  SELECT (sum(good) + 1)::DOUBLE / (sum(n) + 2) AS prior FROM units
), s0 AS (
  SELECT suffix, sum(n) AS n, sum(good) AS good, any_value(prior) AS prior FROM units, overall GROUP BY suffix
), ks AS (
  SELECT CASE WHEN v <= w OR s <= w OR s IS NULL THEN 1000 ELSE least(1000, greatest(2, (v - w) / (s - w) - 1)) END AS k
  FROM (SELECT sum(n * pow(good / n - prior, 2)) AS s, sum(prior * (1 - prior)) AS w, sum(n * prior * (1 - prior)) AS v FROM s0 WHERE n > 0)
), s1 AS (
  SELECT suffix, (k * prior + good) / (k + n) AS prior FROM s0, ks
), d0 AS (
  SELECT domain, suffix, sum(n) AS n, sum(good) AS good, any_value(s1.prior) AS prior FROM units JOIN s1 USING (suffix) GROUP BY domain, suffix
), kd AS (
  SELECT CASE WHEN v <= w OR s <= w OR s IS NULL THEN 1000 ELSE least(1000, greatest(2, (v - w) / (s - w) - 1)) END AS k
  FROM (SELECT sum(n * pow(good / n - prior, 2)) AS s, sum(prior * (1 - prior)) AS w, sum(n * prior * (1 - prior)) AS v FROM d0 WHERE n > 0)
), d1 AS (
  SELECT domain, (k * prior + good) / (k + n) AS prior FROM d0, kd
), h0 AS (
  SELECT host, n, good, d1.prior FROM units JOIN d1 USING (domain)
), kh AS (
  SELECT CASE WHEN v <= w OR s <= w OR s IS NULL THEN 1000 ELSE least(1000, greatest(2, (v - w) / (s - w) - 1)) END AS k
  FROM (SELECT sum(n * pow(good / n - prior, 2)) AS s, sum(prior * (1 - prior)) AS w, sum(n * prior * (1 - prior)) AS v FROM h0 WHERE n > 0)
), h1 AS (
  SELECT host, (k * prior + good) / (k + n) AS mean, k + n AS total FROM h0, kh
), h2 AS (
  SELECT host, mean, mean + 1.645 * sqrt(mean * (1 - mean) / (total + 1)) AS upper FROM h1
)
SELECT p.page_id, p.host, p.path, best.rule,
  coalesce(best.what, CASE WHEN h2.upper < 0.5 THEN 'block' ELSE 'allow' END) AS verdict,
  round(h2.mean, 6) AS reputation, round(h2.upper, 6) AS upper
FROM p JOIN h2 USING (host) LEFT JOIN best USING (page_id)
"""

_ITEM_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL["op9_decontamination"] = rf"""
WITH b AS (
  SELECT item_id::VARCHAR AS item, {_ITEM_WORDS} AS ws FROM benchmark
), bl AS (
  SELECT item, ws, least(len(ws), 13) AS n FROM b WHERE len(ws) > 0
), bw AS (
  SELECT DISTINCT n, item, unnest(list_transform(range(0, len(ws) - n + 1), lambda i: array_to_string(ws[i + 1:i + n], ' '))) AS w FROM bl
), lens AS (
  SELECT DISTINCT n FROM bw
), d AS (
  SELECT doc_id, {_ITEM_WORDS} AS ws FROM documents
), dw AS (
  SELECT doc_id, n, unnest(list_transform(range(0, len(ws) - n + 1), lambda i: {{'i': i, 'w': array_to_string(ws[i + 1:i + n], ' ')}})) AS r
  FROM d, lens WHERE len(ws) >= n
), hits AS (
  SELECT DISTINCT doc_id, dw.n, r.i AS i, item FROM dw JOIN bw ON bw.n = dw.n AND bw.w = dw.r.w
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY doc_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""

SQL["op12_phrases"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces
), grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase
  FROM w, (VALUES (1), (2), (3)) t(k) WHERE len(ws) >= k
), f AS (
  SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL
), totals AS (
  SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
), cand AS (
  SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND a >= 10
), longer AS (
  SELECT lang, unnest([ws[1] || ' ' || ws[2], ws[2] || ' ' || ws[3]]) AS phrase, a FROM cand WHERE k = 3
), inside AS (
  SELECT lang, phrase, max(a) AS top FROM longer GROUP BY ALL
), left_over AS (
  SELECT c.* FROM cand c LEFT JOIN inside i USING (lang, phrase) WHERE c.k = 3 OR i.top IS NULL OR 100 * i.top < 50 * c.a
), cuts AS (
  SELECT lang, phrase, a, cut, array_to_string(ws[1:cut], ' ') AS head, array_to_string(ws[cut + 1:k], ' ') AS tail
  FROM left_over, (VALUES (1), (2)) t(cut) WHERE cut < k
), scored AS (
  SELECT c.lang, c.phrase, c.a, c.cut, x.a AS l, y.a AS r,
    (1000000::HUGEINT * c.a * c.a // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.head AND x.k = c.cut
    JOIN f y ON y.lang = c.lang AND y.phrase = c.tail AND y.k = len(string_split(c.phrase, ' ')) - c.cut
), worst AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM worst
) JOIN totals USING (lang) WHERE rank <= 2000
"""

SQL["op13_hard_negatives"] = """
WITH e AS (
  SELECT row_number() OVER () AS k, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
), pairs AS (
  SELECT a.k AS anchor, a.vec_id AS anchor_id, b.k, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON a.k <> b.k WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT anchor, anchor_id, k AS positive, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, k) <= 5
), negatives AS (
  SELECT p.anchor_id, positive_id, positive_score, n.vec_id AS negative_id, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor, positive ORDER BY n.score DESC, n.vec_id, n.k) AS rank
  FROM positives p JOIN pairs n ON n.anchor = p.anchor AND NOT n.same
    AND 50 * positive_score <= 100 * n.score AND 100 * n.score <= 95 * positive_score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 3
"""
