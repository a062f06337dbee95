"""DuckDB SQL that says what corpus operators say, for those that SQL can express."""

from __future__ import annotations

_CRC_TABLE = """crc_table AS (
  SELECT list(c ORDER BY i) AS t
  FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) r(i))
)"""
_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_USER, _ASSISTANT, _OWN = "chr(10) || 'user:'", "chr(10) || 'assistant:'", "chr(10) || role || ':' || text"
_NEVER = 1_000_000_000


def _crc(x: str) -> str:
    """crc32 of the UTF-8 bytes of x, by the table t of crc_table."""
    digit = lambda at: f"instr('0123456789ABCDEF', substr(hex({x}), 2 * i + {at}, 1)) - 1"
    byte = f"({digit(1)}) * 16 + {digit(2)}"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(strlen({x})), lambda i: {byte})), lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])))"


def _with(state: str, cost: int | str, edit: str, line: str = "''") -> str:
    """A state (c: cost, a: audit, l: lines) after an edit."""
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}', 'l': {state}.l || {line}}}"


def _keep(initial: str) -> str:
    return f"(CASE WHEN role LIKE '{initial}%' THEN keep ELSE {_NEVER} END)"


def _inserts(f: str) -> str:
    """The states u and a after rows that are inserted."""
    both = f"{_USER} || {_ASSISTANT}"
    u = [f"{f}.u", *[_with(f"{f}.{x}", 3, "I", _USER) for x in "nsa"]]
    a = [f"{f}.a", _with(f"{f}.u", 3, "I", _ASSISTANT), *[_with(f"{f}.{x}", 6, "II", both) for x in "ns"]]
    return f"list_min([{', '.join(u)}]) AS u, list_min([{', '.join(a)}]) AS a"


REPAIR = f"""
WITH RECURSIVE {_CRC_TABLE}, named AS (
  SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations
), faulted AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc('name')} % 20 AS f FROM named, crc_table
), damaged AS (
  SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM (SELECT * FROM faulted WHERE f <> 0 UNION ALL SELECT * FROM faulted WHERE f = 3)
), laid AS (
  SELECT *, row_number() OVER o AS place, lag(left(role, 1)) OVER o || left(role, 1) AS neighbours, right(regexp_replace(text, '[\\x20\\x09-\\x0D]+$', ''), 1) AS last
  FROM damaged WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), rows AS (
  SELECT *, CASE WHEN last = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM laid
), fold AS (
  SELECT conv_id, 0::BIGINT AS place, {{'c': 0::BIGINT, 'a': '', 'l': ''}} AS n, {{'c': {_NEVER}::BIGINT, 'a': '', 'l': ''}} AS s, {{'c': {_NEVER}::BIGINT, 'a': '', 'l': ''}} AS u, {{'c': {_NEVER}::BIGINT, 'a': '', 'l': ''}} AS a
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, place, {_with('n', 4, 'D')}, list_min([{_with('s', 4, 'D')}, {_with('n', _keep('s'), 'K', _OWN)}]),
    list_min([{_with('u', 4, 'D')}, {_with('p', _keep('u'), 'K', _OWN)}, {_with('p', '3 + keep', 'R', _USER + ' || text')}]),
    list_min([{_with('a', 4, 'D')}, {_with('u', _keep('a'), 'K', _OWN)}, {_with('u', '3 + keep', 'R', _ASSISTANT + ' || text')}])
  FROM (
    SELECT *, list_min([n, s, a]) AS p, CASE WHEN fault IN ('blank', 'duplicate') THEN {_NEVER} WHEN fault = 'truncated' THEN 3 ELSE 0 END AS keep
    FROM (SELECT rows.conv_id, rows.place, rows.role, rows.text, rows.fault, fold.n, fold.s, {_inserts('fold')} FROM fold JOIN rows ON rows.conv_id IS NOT DISTINCT FROM fold.conv_id AND rows.place = fold.place + 1)
  )
), ended AS (
  SELECT conv_id, list_min([n, a]) AS best FROM (SELECT conv_id, place, n, {_inserts('fold')} FROM fold) QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY place DESC) = 1
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (neighbours NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rows GROUP BY conv_id
)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, best.c AS cost, best.a AS audit, sha256(substr(best.l, 2)) AS repaired_sha256
FROM ended e LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""

RESAMPLING = f"""
WITH {_CRC_TABLE}, texts AS (
  SELECT row_number() OVER () AS row, doc_id, text FROM documents
), words AS (
  SELECT row, unnest({_WORDS}) AS word FROM texts
), of_document AS (
  SELECT row, word, count(*) AS n FROM words GROUP BY ALL
), of_target AS (
  SELECT word, count(*) AS n
  FROM (SELECT unnest({_WORDS}) AS word FROM benchmark)
  GROUP BY word
), buckets AS (
  SELECT word, {_crc('word')} % 10000 AS bucket
  FROM (SELECT word FROM of_document UNION SELECT word FROM of_target), crc_table
), counted AS (
  SELECT bucket, sum(s)::DOUBLE AS s, sum(t)::DOUBLE AS t
  FROM (SELECT bucket, n AS s, 0 AS t FROM of_document JOIN buckets USING (word) UNION ALL SELECT bucket, 0, n FROM of_target JOIN buckets USING (word))
  GROUP BY bucket
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM counted) + 10000) / ((s + 1) * ((SELECT sum(t) FROM counted) + 10000)))) AS BIGINT) AS gain FROM counted
), weighed AS (
  SELECT row, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM of_document JOIN buckets USING (word) JOIN gains USING (bucket) GROUP BY row
), hashed AS (
  SELECT row, doc_id, list_reduce(list_transform(range(8), lambda i: instr('0123456789abcdef', substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), i + 1, 1)) - 1), lambda a, b: a * 16 + b) AS h FROM texts
), scored AS (
  SELECT row, doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM hashed LEFT JOIN weighed USING (row)
), placed AS (
  SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) END AS place FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * (SELECT count(place) FROM placed) // 100 THEN place END AS rank FROM placed
"""
