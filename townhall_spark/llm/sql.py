"""The queries that SQL can express, for DuckDB.

The others have none: op4, op5, op6, op7, op9, op10, op13 and the pipeline are compared with
brute force, round trips, invariants and held-out labels in ``tests/llm``.
"""

from __future__ import annotations

from townhall_spark.llm import secrets
from townhall_spark.llm.queries import CONTROL_TURNS

_TURN = ", ".join(f"({c}, {t}, '{r}', '{x}')" for c, t, r, x in CONTROL_TURNS)
# Opener, closer and the two spaces, by role.
_AROUND = "CASE role WHEN 'system' THEN 17 WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 END"
_CONTROL = r"[<\[]\\*(<SYS>>|</SYS>>|/?INST\]|/?s>|/?ROLE)"

CHAT = f"""
    WITH turns AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
      FROM conversations UNION ALL SELECT * FROM (VALUES {_TURN}))
    SELECT conv_id, count(*) AS n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
      CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT)
        AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), ''))
        AS loss_sha256,
      CAST(sum(length(text) + {_AROUND} + len(regexp_extract_all(text, '{_CONTROL}'))) AS BIGINT)
        AS formatted_chars
    FROM turns GROUP BY conv_id"""

JACCARD = r"""
    WITH RECURSIVE words AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
      FROM documents),
    sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(
        range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
      FROM words),
    shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
    links AS (SELECT a.doc_id AS a, b.doc_id AS b
      FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n
      HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
    reach AS (SELECT a, b FROM links UNION
      SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
    SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(c, doc_id))
      AS component_id
    FROM sets LEFT JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) ON a = doc_id"""

NEAREST = """
    WITH usable AS (
      SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
      WHERE len(embedding) > 0 AND vec_id IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank
      FROM (SELECT q.vec_id AS query_id, c.vec_id, list_distance(q.v, c.v) AS score
        FROM usable q JOIN usable c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id))
    WHERE rank <= 10"""


def _either_case(pattern: str) -> str:
    head, tail = pattern.split(")", 1)
    letters = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c
                      for c in head.removeprefix("((?i:"))
    return f"({letters}{tail}"


def _found(place: int, kind: secrets.Kind) -> str:
    pattern = _either_case(kind.pattern) if kind.group else kind.pattern
    pattern = "'" + pattern.replace("'", "''") + "'"
    whole = f"regexp_extract_all(t, {pattern}, 0)"
    return f"""
      SELECT r, {place} AS place, '{kind.name}' AS kind, v, length(w) AS width, {kind.least} AS least,
        sum(length(b)) OVER (PARTITION BY r ORDER BY i)
          + coalesce(sum(length(w)) OVER (PARTITION BY r ORDER BY i
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM (SELECT r, generate_subscripts({whole}, 1) AS i, unnest({whole}) AS w,
          unnest(regexp_extract_all(t, {pattern}, {kind.group})) AS v,
          unnest(string_split_regex(t, {pattern})[:len({whole})]) AS b FROM docs)"""


SECRETS = f"""
    WITH docs AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t
      FROM documents),
    found AS (SELECT *, kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + width AS BIGINT)
        AS span FROM ({" UNION ALL ".join(_found(i, k) for i, k in enumerate(secrets.KINDS))})
      WHERE length(v) >= least),
    held AS (SELECT r, v, max(len(list_distinct(string_split(v, '')))
        >= {secrets.RANDOM_CHARACTERS}) AS random FROM found GROUP BY r, v),
    owned AS (SELECT v, count(DISTINCT coalesce(source, '')) AS owners,
        count(DISTINCT coalesce(source, '') || chr(0) || coalesce(CAST(doc_id AS VARCHAR), ''))
          AS repositories
      FROM held JOIN docs USING (r) GROUP BY v),
    judged AS (SELECT held.*, CASE WHEN owners >= {secrets.EXAMPLE_OWNERS}
          OR owners >= {secrets.SHARED_OWNERS} AND repositories >= {secrets.EXAMPLE_REPOSITORIES}
        THEN 'example' WHEN random THEN 'live' END AS label
      FROM held JOIN owned USING (v)),
    counted AS (SELECT r, count(*) FILTER (WHERE label = 'example') AS n_example,
        count(*) FILTER (WHERE label = 'live') AS n_live FROM judged GROUP BY r),
    spans AS (SELECT r, string_agg(span, ',' ORDER BY start, place) FILTER (WHERE base) AS base,
        string_agg(span, ',' ORDER BY start, place) AS spans
      FROM (SELECT r, start, place, span, true AS base FROM found UNION ALL
        SELECT r, start, {len(secrets.KINDS)} + CAST(label = 'live' AS INTEGER),
          label || ':' || CAST(start AS BIGINT) || ':' || CAST(start + width AS BIGINT), false
        FROM found JOIN judged USING (r, v) WHERE label IS NOT NULL) GROUP BY r)
    SELECT doc_id, {", ".join(f"coalesce(n_{k.name}, 0) AS n_{k.name}" for k in secrets.KINDS)},
      sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
      coalesce(n_example, 0) AS n_example, coalesce(n_live, 0) AS n_live
    FROM docs LEFT JOIN spans USING (r) LEFT JOIN counted USING (r) LEFT JOIN (SELECT r,
        {", ".join(f"count(*) FILTER (WHERE kind = '{k.name}') AS n_{k.name}"
                   for k in secrets.KINDS)}
      FROM found GROUP BY r) USING (r)"""

DIVERGENCE = r"""
    WITH docs AS (
      SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
          'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
      FROM documents),
    occurring AS (SELECT r, lang, source, unnest(w) AS term FROM docs),
    kept AS (SELECT lang, term FROM (SELECT DISTINCT r, lang, term FROM occurring)
      GROUP BY lang, term HAVING count(*) >= 30),
    counts AS (SELECT lang, source, term, count(*) AS n FROM occurring JOIN kept USING (lang, term)
      GROUP BY lang, source, term),
    sources AS (SELECT DISTINCT lang, source FROM docs),
    groups AS (SELECT lang, source, coalesce(total, 0) AS total FROM sources LEFT JOIN
      (SELECT lang, source, sum(n) AS total FROM counts GROUP BY lang, source) USING (lang, source)),
    languages AS (SELECT lang, count(DISTINCT term) AS v, sum(n) AS total FROM counts GROUP BY lang),
    shares AS (SELECT lang, g.source, term, coalesce(n, 0) AS n, CAST(1 + (1000000000 *
        (CAST(coalesce(n, 0) AS HUGEINT) + 5)) // (g.total + 5 * v) AS BIGINT) AS p
      FROM groups g JOIN kept USING (lang) JOIN languages USING (lang)
        LEFT JOIN counts USING (lang, source, term)),
    whole AS (SELECT lang, term, CAST(1 + (1000000000 * (CAST(sum(n) AS HUGEINT) + 5))
        // (max(l.total) + 5 * max(v)) AS BIGINT) AS q
      FROM counts JOIN languages l USING (lang) GROUP BY lang, term),
    pairs AS (SELECT a.lang, a.source, b.source AS item, 'pair' AS part,
        coalesce((SELECT sum(abs(x.p - y.p)) FROM shares x JOIN shares y USING (lang, term)
          WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value
      FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source),
    above AS (SELECT lang, source, term AS item, 'term' AS part, p - q AS value
      FROM shares JOIN whole USING (lang, term) WHERE n > 0 AND p > q)
    SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
    FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)
        AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM above))
    WHERE part = 'pair' OR rank <= 50"""

# Eight neighbouring words that come again some words on are where a run may be: a run has
# at least 16 words that come again a period on.
PERIODIC = r"""
    WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''),
        '[^\x20\x09-\x0D]+') AS w, xor(list_reduce(list_prepend(4294967295, list_transform(
          string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
          lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0],
            lambda c, z: xor(c >> 1, (c & 1) * 3988292384))), 4294967295) AS h
      FROM documents),
    planned AS (SELECT *, len(w) AS n, (h // 10) % greatest(len(w), 1) AS a, h // 10 AS g FROM docs),
    texts AS (SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(
        range(n), lambda i: w[1 + CASE WHEN i < a THEN i
          ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE w END AS w FROM planned),
    eights AS (SELECT r, n, i, array_to_string(w[i + 1:i + 8], ' ') AS e
      FROM texts, unnest(range(n - 7)) AS t(i)),
    again AS (SELECT a.r, b.i - a.i AS q, a.i, a.i - row_number()
        OVER (PARTITION BY a.r, b.i - a.i ORDER BY a.i) AS island
      FROM eights a JOIN eights b ON a.r = b.r AND a.e = b.e AND a.i < b.i
        AND 3 * (b.i - a.i) <= a.n),
    stretches AS (SELECT r, min(i) AS s, count(*) + 7 + q AS m, q FROM again GROUP BY r, q, island),
    runs AS (SELECT r, s, m, min(q) AS q FROM stretches WHERE m >= greatest(24, 3 * q)
      GROUP BY r, s, m),
    dropped AS (SELECT r, list(DISTINCT i) AS gone FROM runs, unnest(range(s + q, s + m)) AS t(i)
      GROUP BY r),
    found AS (SELECT r, count(*) AS n_runs, string_agg(s || ',' || m || ',' || q || chr(10), ''
        ORDER BY s, q) AS lines FROM runs GROUP BY r),
    best AS (SELECT * FROM runs a WHERE NOT EXISTS (SELECT 1 FROM runs b WHERE b.r = a.r AND
        (b.m * a.q > a.m * b.q OR b.m * a.q = a.m * b.q AND (b.s, b.q) < (a.s, a.q))))
    SELECT doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, m AS length, q AS period,
      1000 * m // q AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
      sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_transform(
        list_filter(list_zip(w, range(n)), lambda x: NOT list_contains(gone, x[2])),
        lambda x: x[1]) END, ' '), '')) AS collapsed_sha256
    FROM texts LEFT JOIN found USING (r) LEFT JOIN best USING (r) LEFT JOIN dropped USING (r)"""

ORACLES: dict[str, str] = {
    "op1_chat_formatting": CHAT,
    "op2_ngram_jaccard_join": JACCARD,
    "op3_nearest_neighbours": NEAREST,
    "op8_secret_scans": SECRETS,
    "op11_source_divergence": DIVERGENCE,
    "op12_periodic_runs": PERIODIC,
}
