"""DuckDB SQL for the queries that SQL can express."""

SQL: dict[str, str] = {}

SQL["op1_decontaminate"] = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, len(g) AS n, array_to_string(g, ' ') AS g FROM (
    SELECT item_id, unnest(list_transform(range(1, greatest(len(w) - 13, 0) + 2), lambda i: list_slice(w, i, i + 12))) AS g
    FROM bw WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM win
), grams AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM dw, sizes WHERE len(w) >= n
), hits AS (
  SELECT g.doc_id, g.i, g.n, win.item_id
  FROM (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM grams) g JOIN win ON win.g = g.g AND win.n = g.n
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS s
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hits) GROUP BY doc_id
), bt AS (SELECT DISTINCT item_id, unnest(w) AS t FROM bw
), dp AS (SELECT doc_id, unnest(w) AS t, unnest(range(len(w))) AS p FROM dw
), pairs AS (
  SELECT doc_id, item_id, m FROM (SELECT DISTINCT doc_id, t FROM dp) JOIN bt USING (t) JOIN (SELECT item_id, count(*) AS m FROM bt GROUP BY item_id) USING (item_id)
  GROUP BY doc_id, item_id, m HAVING count(*) = m
), pos AS (
  SELECT doc_id, item_id, m, p, lead(p) OVER (PARTITION BY doc_id, item_id, t ORDER BY p) AS following FROM pairs JOIN bt USING (item_id) JOIN dp USING (doc_id, t)
), span AS (
  SELECT b.doc_id, b.item_id, b.p AS hi, CASE WHEN count(*) = any_value(b.m) THEN min(a.p) END AS lo FROM pos b
  JOIN pos a ON a.doc_id = b.doc_id AND a.item_id = b.item_id AND a.p <= b.p AND a.p > b.p - 64 AND coalesce(a.following > b.p, true) GROUP BY b.doc_id, b.item_id, b.p
), near AS (
  SELECT doc_id, count(*) AS n_near FROM (SELECT *, lag(lo) OVER (PARTITION BY doc_id, item_id ORDER BY hi) AS before FROM span)
  WHERE lo IS NOT NULL AND (before IS NULL OR lo > before) GROUP BY doc_id
)
SELECT dw.doc_id, coalesce(n_near, 0) AS n_near, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id) LEFT JOIN near USING (doc_id)
"""

SQL["op2_secrets"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), m AS (
  SELECT r, 'assign' AS kind, 0 AS rank, 6 AS least, string_split_regex(t, '(?i)(?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+') AS gaps,
    regexp_extract_all(t, '(?i)(?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 0) AS ms,
    regexp_extract_all(t, '(?i)(?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1) AS gs FROM d
  UNION ALL
  SELECT r, 'access', 1, 20, string_split_regex(t, 'AKIA[A-Z0-9]{16,}'), regexp_extract_all(t, 'AKIA[A-Z0-9]{16,}'), regexp_extract_all(t, 'AKIA[A-Z0-9]{16,}') FROM d
  UNION ALL
  SELECT r, 'hex', 2, 24, string_split_regex(t, '[0-9a-f]{24,}'), regexp_extract_all(t, '[0-9a-f]{24,}'), regexp_extract_all(t, '[0-9a-f]{24,}') FROM d
  UNION ALL
  SELECT r, kind, rank, 1, string_split_regex(t, p), regexp_extract_all(t, p), regexp_extract_all(t, p) FROM d, (VALUES
    ('pem', 3, '-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----'),
    ('jwt', 4, 'eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}'),
    ('vendor', 5, '(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{35,}|sk_live_[0-9a-zA-Z]{24,})'),
    ('url', 6, '(?:https?|ftps?|ssh|git|mysql|postgres(?:ql)?|mongodb|redis|amqps?)://[^\x00-\x20/:@]+:[^\x00-\x20/@]+@')) k(kind, rank, p)
), x AS (
  SELECT r, kind, rank, least, unnest(range(1, len(ms) + 1)) AS i, gaps, ms, gs FROM m WHERE len(ms) > 0
), y AS (
  SELECT r, kind, rank, length(gs[i]) >= least AS ok, length(ms[i]) AS size,
    sum(length(gaps[i]) + length(ms[i])) OVER (PARTITION BY r, kind ORDER BY i) AS e FROM x
), z AS (
  SELECT r, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS k, count(*) FILTER (kind = 'hex') AS h,
    string_agg(kind || ':' || CAST(e - size AS VARCHAR) || ':' || CAST(e AS VARCHAR), ',' ORDER BY e - size, rank) AS s,
    string_agg(kind || ':' || CAST(e - size AS VARCHAR) || ':' || CAST(e AS VARCHAR), ',' ORDER BY e - size, rank) FILTER (rank < 3) AS base
  FROM y WHERE ok GROUP BY r
)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(h, 0) AS n_hex,
  coalesce(s, '') AS spans, sha256(coalesce(base, '')) AS base_sha256
FROM d LEFT JOIN z USING (r)
"""

SQL["op4_topk"] = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _canonical_sql(c: str) -> str:
    from loomfield.llm.licenses import COPYRIGHT_LINE, LIST_MARK, MARKS, SPELLINGS, WHOLE_WORDS

    out = f"translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ{MARKS}', 'abcdefghijklmnopqrstuvwxyz{' ' * len(MARKS)}')"
    out = f"regexp_replace(regexp_replace({out}, '{COPYRIGHT_LINE}', '', 'g'), '{LIST_MARK}', '', 'g')"
    out = rf"regexp_replace({out}, '[\x00-\x09\x0b-\x2f\x3a-\x60\x7b-\x7f]+', ' ', 'g')"
    for other, ours in SPELLINGS:
        if " " not in other.strip():
            out = f"replace({out}, '{other}', '{ours}')"
    for other, ours in WHOLE_WORDS:
        out = rf"regexp_replace({out}, '\b{other}\b', '{ours}', 'g')"
    return out


def _two_words(c: str) -> str:
    from loomfield.llm.licenses import SPELLINGS

    for other, ours in SPELLINGS:
        if " " in other.strip():
            c = f"replace({c}, '{other}', '{ours}')"
    return c


def _licenses_sql() -> str:
    from loomfield.llm.licenses import KNOWN, KNOWN_DIGESTS, OPENING

    texts = ", ".join(f"({_quoted(k)}, {_quoted(t)})" for k, t in KNOWN)
    digests = ", ".join(f"({_quoted(k)}, {_quoted(d)})" for k, d in KNOWN_DIGESTS)
    whole = _two_words(rf"trim(regexp_replace(regexp_replace(l, '{OPENING}', '', 'g'), '[ \n]+', ' ', 'g'))")
    line = _two_words("trim(regexp_replace({}, '[ \\n]+', ' ', 'g'))")
    return rf"""
WITH kf AS (SELECT license, {_canonical_sql("t")} AS l FROM (VALUES {texts}) k(license, t)
), kw AS (
  SELECT digest, string_agg(DISTINCT license, ',' ORDER BY license) AS license FROM (
    SELECT license, sha256({whole}) AS digest FROM kf WHERE {whole} <> '' UNION ALL SELECT * FROM (VALUES {digests}) k(license, digest)) GROUP BY 1
), kl AS (
  SELECT x, string_agg(DISTINCT license, ',' ORDER BY license) AS license
  FROM (SELECT license, {line.format('l')} AS x FROM kf) WHERE x <> '' GROUP BY 1
), d AS (SELECT row_number() OVER () AS r, doc_id, {_canonical_sql("text")} AS l FROM documents
), li AS (
  SELECT r, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS s
  FROM (SELECT r, {line.format('l')} AS x FROM (SELECT r, unnest(string_split(l, chr(10))) AS l FROM d)) JOIN kl USING (x) GROUP BY r
), w AS (SELECT r, doc_id, sha256({whole}) AS digest FROM d)
SELECT w.doc_id, w.digest, kw.license, coalesce(li.s, '') AS line_licenses, coalesce(li.n, 0) AS n_lines
FROM w LEFT JOIN kw USING (digest) LEFT JOIN li USING (r)
"""


SQL["op3_licenses"] = _licenses_sql()

SQL["op6_preferences"] = r"""
WITH t AS (
  SELECT DISTINCT conv_id, turn,
    regexp_replace(regexp_replace(coalesce(role, 'unknown'), '[\r\n]+', ' ', 'g'), '<\|im_(start|end)\|>', '<|im_\1 |>', 'g') AS role,
    regexp_replace(coalesce(text, ''), '<\|im_(start|end)\|>', '<|im_\1 |>', 'g') AS text FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, text) AS l FROM t GROUP BY conv_id
), s AS (
  SELECT * FROM (SELECT conv_id, l, list_filter(range(1, len(l) + 1), lambda i: l[i].role = 'assistant') AS spots FROM c) WHERE len(spots) > 0
), b AS (
  SELECT s.conv_id AS pair_id, s.l[1:s.spots[-1]] AS a,
    list_concat(s.l[1:s.spots[s.conv_id % len(s.spots) + 1] - 1], [{'role': 'assistant', 'text': coalesce(o.l[o.spots[1]].text, '')}]) AS r
  FROM s LEFT JOIN s o ON o.conv_id = s.conv_id + 1
), n AS (
  SELECT *, coalesce(list_position(list_transform(range(1, greatest(len(a), len(r)) + 1), lambda i: a[i] IS NOT DISTINCT FROM r[i]), false) - 1, len(a)) AS n FROM b
)
SELECT pair_id, CAST(n AS BIGINT) AS n_prompt_turns,
  array_to_string(list_transform(a[1:n], lambda x: '<|im_start|>' || x.role || chr(10) || x.text || '<|im_end|>' || chr(10)), '') AS prompt,
  array_to_string(list_transform(a[n + 1:], lambda x: '<|im_start|>' || x.role || chr(10) || x.text || '<|im_end|>' || chr(10)), '') AS chosen,
  array_to_string(list_transform(a[n + 1:], lambda x: length('<|im_start|>' || x.role || chr(10)) || ':0,' || length(x.text || '<|im_end|>' || chr(10)) || ':' || CAST(x.role = 'assistant' AS INT)), ',') AS chosen_mask,
  array_to_string(list_transform(r[n + 1:], lambda x: '<|im_start|>' || x.role || chr(10) || x.text || '<|im_end|>' || chr(10)), '') AS rejected,
  array_to_string(list_transform(r[n + 1:], lambda x: length('<|im_start|>' || x.role || chr(10)) || ':0,' || length(x.text || '<|im_end|>' || chr(10)) || ':' || CAST(x.role = 'assistant' AS INT)), ',') AS rejected_mask
FROM n
"""

SQL["op13_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
w AS (SELECT html, max(page_id) AS first FROM p WHERE strlen(html) >= 1000 GROUP BY html)
SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN w USING (html)
"""
