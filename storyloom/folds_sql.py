"""SQL twins of the greedy folds over texts: recursive queries that take one step of every document at a time."""

from __future__ import annotations

from .functions import text as T

#: What Python's strip() and `\s` take for white space, as characters of SQL and as a class of regular expressions.
_WIDE = [*range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
_WIDE_SQL = " || ".join(f"chr({c})" for c in _WIDE)
_WIDE_CLASS = "[" + "".join(f"\\x{{{c:X}}}" for c in _WIDE) + "]"
_ASCII_CLASS = "[\\x{9}-\\x{D} ]"
#: A private character that parts are split at.
_CUT = "chr(57344)"


def _sentences(text: str, space: str) -> str:
    return f"string_split(regexp_replace({text}, '([.!?]){space}+', '\\1' || {_CUT}, 'g'), {_CUT})"


PASSAGES = f"""WITH RECURSIVE step(doc_id, text, n, start, stop) AS (
    SELECT doc_id, text, length(text), CAST(0 AS BIGINT), CAST(NULL AS BIGINT) FROM documents WHERE text IS NOT NULL AND text <> ''
    UNION ALL
    SELECT doc_id, text, n, CASE WHEN stop - {T.OVERLAP} > start THEN stop - {T.OVERLAP} ELSE start + {T.PASSAGE} END, NULL FROM (
        SELECT *, CASE WHEN e = n THEN e WHEN strpos(w, '.') > 1 THEN e + strpos(w, '.') WHEN strpos(w, '?') > 1 THEN e + strpos(w, '?')
            WHEN strpos(w, '!') > 1 THEN e + strpos(w, '!') ELSE e END AS stop FROM (
            SELECT doc_id, text, n, start, least(start + {T.PASSAGE}, n) AS e, substring(text, least(start + {T.PASSAGE}, n) + 1, {T.REACH}) AS w FROM step WHERE start < n))),
piece AS (SELECT doc_id, start, trim(substring(text, start + 1, stop - start), {_WIDE_SQL}) AS text FROM (
    SELECT *, CASE WHEN e = n THEN e WHEN strpos(w, '.') > 1 THEN e + strpos(w, '.') WHEN strpos(w, '?') > 1 THEN e + strpos(w, '?')
        WHEN strpos(w, '!') > 1 THEN e + strpos(w, '!') ELSE e END AS stop FROM (
        SELECT doc_id, text, n, start, least(start + {T.PASSAGE}, n) AS e, substring(text, least(start + {T.PASSAGE}, n) + 1, {T.REACH}) AS w FROM step WHERE start < n)))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS INTEGER) AS passage, text FROM piece WHERE length(text) >= {T.LEAST}"""


def _fold(keys: str, size: int, carry: str, between: str, counted: str) -> str:
    """Packs table sent (keys, i, x) greedily: (keys, chunk, text). counted: length of what is held, an expression of now."""
    on = " AND ".join(f"f.{k} = s.{k}" for k in keys.split(", "))
    own = ", ".join(f"f.{k}" for k in keys.split(", "))
    return f"""fold({keys}, i, chunk, now, done) AS (
    SELECT {keys}, i, 0, [x], CAST(NULL AS VARCHAR) FROM sent WHERE i = 1
    UNION ALL
    SELECT {keys}, i, CASE WHEN full_ THEN chunk + 1 ELSE chunk END, list_append(CASE WHEN full_ THEN {carry} ELSE now END, x),
        CASE WHEN full_ THEN array_to_string(now, '{between}') END
    FROM (SELECT {own}, s.i, s.x, f.chunk, f.now, {counted} + length(s.x) > {size} AS full_ FROM fold f JOIN sent s ON {on} AND s.i = f.i + 1)),
packed AS (SELECT {keys}, chunk - 1 AS chunk, done AS text FROM fold WHERE done IS NOT NULL
    UNION ALL SELECT {keys}, chunk, array_to_string(now, '{between}') FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY i DESC) AS back FROM fold) WHERE back = 1)"""


SENTENCE_CHUNKS = f"""WITH RECURSIVE parts AS (SELECT doc_id, list_filter(list_transform({_sentences(f"regexp_replace(text, '^{_ASCII_CLASS}+|{_ASCII_CLASS}+$', '', 'g')", _ASCII_CLASS)},
    lambda p: regexp_replace(p, '^{_ASCII_CLASS}+|{_ASCII_CLASS}+$', '', 'g')), lambda p: p <> '') AS ps FROM documents),
sent AS (SELECT doc_id, i, CASE WHEN regexp_matches(ps[i], '[.!?]$') THEN ps[i] || ' ' ELSE ps[i] || '. ' END AS x FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM parts)),
{_fold("doc_id", T.CHUNK, f"(CASE WHEN len(now) > {T.CARRIED} THEN now[-{T.CARRIED}:] ELSE [] END)", "", "length(array_to_string(now, ''))")}
SELECT doc_id, CAST(chunk AS INTEGER) AS chunk, text FROM packed"""

PARAGRAPH_CHUNKS = f"""WITH RECURSIVE para AS (SELECT doc_id, k, trim(ps[k], {_WIDE_SQL}) AS p FROM (
    SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS k FROM (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS ps FROM documents WHERE text IS NOT NULL))),
sent AS (SELECT doc_id, k, i, ps[i] AS x FROM (SELECT doc_id, k, ps, unnest(range(1, len(ps) + 1)) AS i FROM (
    SELECT doc_id, k, {_sentences("p", _WIDE_CLASS)} AS ps FROM para WHERE length(p) > 800))),
{_fold("doc_id, k", 600, "[]", " ", "length(array_to_string(now, ''))")}
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k, chunk) - 1 AS INTEGER) AS piece, text FROM (
    SELECT doc_id, k, chunk, text FROM packed UNION ALL SELECT doc_id, k, 0, p FROM para WHERE length(p) > 50 AND length(p) <= 800)"""
