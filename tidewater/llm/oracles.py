"""SQL for the operators that SQL can express, over the same tables, for an independent engine."""

from __future__ import annotations

from .licence_texts import DIGESTS, NOTICES, TEXTS
from .licences import OWNER, SPELLINGS

WORD = r"[^\x20\x09-\x0D]+"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def substrings(window: int = 20) -> str:
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
w AS (SELECT doc_id, s, array_to_string(ws[s:s + {window - 1}], ' ') AS run FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {window - 2})) AS s FROM d)),
again AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY run ORDER BY doc_id, s) AS n FROM w) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + {window})) AS p FROM again),
left_ AS (SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.p) AS kept, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM d) e ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN left_ USING (doc_id)"""


def jaccard(width: int = 4, percent: int = 85) -> str:
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce({LOWER.format("text")}, ''), '{WORD}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + {width - 1}], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {width - 1}, least(len(ws), 1)) + 1)) AS i FROM d)),
n AS (SELECT doc_id, count(*) AS size FROM s GROUP BY 1),
links AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS meet FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2)
JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * meet >= {percent} * (na.size + nb.size - meet)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT r.a AS doc_id, coalesce(any_value(n.size), 0)::BIGINT AS n_shingles, min(r.b) AS component_id FROM reach r LEFT JOIN n ON n.doc_id = r.a GROUP BY r.a"""


def decontamination(width: int = 10) -> str:
    cut = rf"regexp_extract_all(coalesce({LOWER.format('text')}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT doc_id, {cut} AS ws FROM documents), i AS (SELECT item_id, ws, least(len(ws), {width}) AS k FROM (SELECT item_id, {cut} AS ws FROM benchmark) WHERE len(ws) > 0),
iw AS (SELECT DISTINCT item_id, k, array_to_string(ws[s:s + k - 1], ' ') AS run FROM (SELECT item_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS s FROM i)),
dw AS (SELECT doc_id, k, s, array_to_string(ws[s:s + k - 1], ' ') AS run FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM i))),
m AS (SELECT doc_id, item_id, s, k FROM dw JOIN iw USING (k, run)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM m) GROUP BY 1),
f AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN f USING (doc_id)"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical(text: str) -> str:
    back = lambda s: s.replace("$", "\\")
    plain = f"regexp_replace(lower(regexp_replace({text}, chr(13) || chr(10) || '?', chr(10), 'g')), {_quoted(OWNER)}, '\\1', 'g')"
    plain = f"regexp_replace({plain}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')"
    for k, (a, b) in enumerate(SPELLINGS):
        plain = f"regexp_replace({plain}, '\\b(sub)?{a}', '\\1licens\\2', 'g')" if k == 0 else f"regexp_replace({plain}, '\\b{a}', '{back(b)}', 'g')"
    return f"sha256(trim({plain}))"


def licences() -> str:
    values = lambda rows: "VALUES " + ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in rows)
    lines = [(k, v) for k, of_ in NOTICES.items() for v in of_]
    return f"""
WITH known AS (SELECT min(licence) AS licence, digest FROM (SELECT licence, {_canonical("t")} AS digest FROM ({values(TEXTS.items())}) AS _(licence, t) UNION ALL {values(DIGESTS.items())}) GROUP BY digest),
named AS (SELECT DISTINCT licence, {_canonical("t")} AS digest FROM ({values(lines)}) AS _(licence, t)),
lines AS (SELECT DISTINCT doc_id, licence FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) JOIN named ON regexp_matches(line, '(?i)licen[cs]e') AND {_canonical("line")} = named.digest),
d AS (SELECT doc_id, {_canonical("text")} AS digest FROM documents)
SELECT d.doc_id, d.digest, known.licence, known.licence IS NOT NULL AS is_licence, coalesce((SELECT string_agg(licence, ',' ORDER BY licence) FROM lines WHERE lines.doc_id = d.doc_id), '') AS notices
FROM d LEFT JOIN known USING (digest)"""


def all_() -> dict[str, str]:
    return {"op5_substrings": substrings(), "op7_licences": licences(), "op8_jaccard": jaccard(), "op9_decontamination": decontamination()}
