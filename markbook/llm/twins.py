"""SQL twins, for DuckDB, of the queries that SQL can express."""

from __future__ import annotations

EXACT_DEDUP = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept,
       text_sha256
FROM d
"""


def _kind_sql(rank: int, name: str, pattern: str, check: str, score: int, context: str) -> str:
    """Spans of one kind: gaps and hits side by side, their lengths summed up to each hit."""
    return rf"""
  SELECT doc_id, {rank} AS rank, '{name}' AS kind, start, start + length(hit) AS stop,
         {score} + CASE WHEN regexp_matches(
             substring(body, greatest(start - 40, 0) + 1, start - greatest(start - 40, 0)),
             '(?i)(?:^|[^a-z])(?:{context})') THEN 20 ELSE 0 END AS score
  FROM (
    SELECT doc_id, body, hit,
           sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT - length(hit) AS start
    FROM (
      SELECT doc_id, body, i, hits[i] AS hit, gaps[i] AS gap
      FROM (
        SELECT doc_id, body, regexp_extract_all(body, '{pattern}') AS hits,
               string_split_regex(body, '{pattern}') AS gaps
        FROM d
      ), unnest(range(1, len(hits) + 1)) AS u(i)
    )
  )
  WHERE {check}"""


_DIGITS = "regexp_replace(hit, '[^0-9]', '', 'g')"
_LUHN = rf"""length({_DIGITS}) BETWEEN 14 AND 19 AND list_sum([
      CASE WHEN k % 2 = 0 THEN {_DIGITS}[-1 - k]::INT
           WHEN {_DIGITS}[-1 - k]::INT > 4 THEN {_DIGITS}[-1 - k]::INT * 2 - 9
           ELSE {_DIGITS}[-1 - k]::INT * 2 END
      FOR k IN range(0, length({_DIGITS}))]) % 10 = 0"""
_MOD_97 = r"""list_reduce(
      list_prepend(0, [CASE WHEN ascii(c) < 65 THEN ascii(c) - 48 ELSE ascii(c) - 55 END
                       FOR c IN string_split(hit[5:] || hit[:4], '')]),
      lambda r, v: CASE WHEN v > 9 THEN (r * 100 + v) % 97 ELSE (r * 10 + v) % 97 END) = 1"""

PERSONAL_DATA = (
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents), s AS ("
    + " UNION ALL ".join(
        _kind_sql(*x)
        for x in (
            (0, "email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true", 70, "mail|contact|write to"),
            (
                1,
                "ip",
                r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
                "list_max([p::HUGEINT FOR p IN string_split(hit, '.')]) <= 255",
                50,
                "ip|host|server|address",
            ),
            (2, "card", r"[0-9](?:[\x20-]?[0-9])+", _LUHN, 60, "card|credit|visa|payment"),
            (
                3,
                "phone",
                r"\+[0-9][\x20().0-9-]+[0-9]",
                f"length({_DIGITS}) BETWEEN 10 AND 15",
                50,
                "phone|tel|call|mobile|fax",
            ),
            (4, "iban", r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", _MOD_97, 80, "iban|bank|account"),
        )
    )
    + r""")
SELECT d.doc_id,
       count(*) FILTER (WHERE kind = 'email') AS n_email,
       count(*) FILTER (WHERE kind = 'ip') AS n_ip,
       count(*) FILTER (WHERE kind = 'card') AS n_card,
       count(*) FILTER (WHERE kind = 'phone') AS n_phone,
       count(*) FILTER (WHERE kind = 'iban') AS n_iban,
       sha256(coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank)
                       FILTER (WHERE rank < 4), '')) AS base_sha256,
       coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank), '') AS spans,
       coalesce(string_agg(score::VARCHAR, ',' ORDER BY start, rank), '') AS scores
FROM d LEFT JOIN s USING (doc_id)
GROUP BY d.doc_id
"""
)

_WORDS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = rf"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format("coalesce(text, '')")} AS w FROM benchmark WHERE item_id IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS size, w[i:i + least(13, len(w)) - 1] AS g
  FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS u(i)
  WHERE len(w) > 0
),
grams AS (
  SELECT doc_id, size, i, w[i:i + size - 1] AS g
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i
        FROM d, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size)
),
found AS (SELECT doc_id, grams.size, i, item_id FROM grams JOIN windows USING (size, g)),
hits AS (
  SELECT doc_id, count(*) AS n_hit
  FROM (SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS k FROM (SELECT DISTINCT doc_id, size, i FROM found))
  GROUP BY doc_id
),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS name FROM found) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

COLLOCATIONS = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?
-]')) AS piece
  FROM documents
), listed AS (
  SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM pieces
), totals AS (
  SELECT lang, sum(len(w)) AS n FROM listed GROUP BY lang
), sized AS (
  SELECT lang, w, unnest(range(1, 5)) AS k FROM listed WHERE len(w) > 0
), grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS p
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM sized)
), f AS (
  SELECT lang, k, p, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 30
), covered AS (
  SELECT DISTINCT c.lang, c.p
  FROM (SELECT lang, a AS b, k, p, string_split(p, ' ') AS w FROM f WHERE k >= 3) q,
    unnest(range(2, q.k)) AS s(m), unnest(range(1, q.k - s.m + 2)) AS t(i), f c
  WHERE c.lang = q.lang AND c.k = s.m AND c.p = array_to_string(q.w[t.i:t.i + s.m - 1], ' ')
    AND 100 * q.b::HUGEINT >= 80 * c.a::HUGEINT
), cuts AS (
  SELECT lang, k, p, a, string_split(p, ' ') AS w, unnest(range(1, k)) AS cut
  FROM f WHERE k >= 2 AND NOT EXISTS (SELECT 1 FROM covered c WHERE c.lang = f.lang AND c.p = f.p)
), scored AS (
  SELECT c.lang, c.p, c.a, l.a AS l, r.a AS r, c.cut,
    (2000000::HUGEINT * c.a) // (l.a + r.a) AS score
  FROM cuts c
  JOIN f l ON l.lang = c.lang AND l.p = array_to_string(c.w[1:c.cut], ' ')
  JOIN f r ON r.lang = c.lang AND r.p = array_to_string(c.w[c.cut + 1:c.k], ' ')
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) = 1
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS place FROM best
)
SELECT b.lang, b.place::BIGINT AS rank, b.p AS phrase, b.a::BIGINT AS a, b.l::BIGINT AS l, b.r::BIGINT AS r,
  t.n::BIGINT AS n, b.score::BIGINT AS score
FROM ranked b JOIN totals t USING (lang) WHERE b.place <= 2000
"""
