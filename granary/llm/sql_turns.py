"""SQL of the repair query: all four grammar states' cheapest edits, row by row."""

from __future__ import annotations

from granary.llm import turns

#: The bits of crc32, its polynomial reflected.
CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({key}, ''), lambda c: unicode(c)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)), 4294967295::BIGINT)"""


def _best(*choices: str) -> str:
    return f"list_sort([{', '.join(choices)}], 'ASC', 'NULLS LAST')[1]"


def _edit(state: str, cost: str, letter: str, line: str, there: str = "true") -> str:
    """A state, {k: cost and audit, t: the repaired text}, after an edit; null if it can't be."""
    k = f"lpad(CAST(CAST(left({state}.k, 12) AS BIGINT) + {cost} AS VARCHAR), 12, '0') || substr({state}.k, 13) || '{letter}'"
    return f"CASE WHEN {state} IS NOT NULL AND {there} THEN {{'k': {k}, 't': {state}.t || {line}}} END"


def _line(state: int, role: str, text: str = "''") -> str:
    return ("" if state == 0 else "chr(10) || ") + f"{role} || ':' || {text}"


def _insert(name: str, state: int) -> str:
    return _edit(name, str(turns.INSERT), "I", _line(state, f"'{turns.ROLE[turns.NEXT[state]]}'"))


def _closed(source: str) -> str:
    """The rows of ``source`` with the states that insertions give."""
    once = f"SELECT * REPLACE ({_best('s2', _insert('s0', 0), _insert('s1', 1), _insert('s3', 3))} AS s2) FROM {source}"
    return f"SELECT * REPLACE ({_best('s3', _insert('s2', 2))} AS s3) FROM ({once})"


def repair_sql() -> str:
    to: dict[int, list[str]] = {s: [_edit(f"s{s}", str(turns.DELETE), "D", "''")] for s in range(4)}
    for (state, initial), after in turns.STEP.items():
        to[after].append(_edit(f"s{state}", f"{turns.TRUNCATED} * extra", "K", _line(state, "role", "text"), f"NOT gone AND initial = '{initial}'"))
    for state, after in turns.NEXT.items():
        to[after].append(_edit(f"s{state}", f"({turns.REROLE} + {turns.TRUNCATED} * extra)", "R", _line(state, f"'{turns.ROLE[after]}'", "text"), "NOT gone"))
    states = ", ".join(f"{_best(*to[s])} AS s{s}" for s in range(4))
    struct = "STRUCT(k VARCHAR, t VARCHAR)"
    return rf"""
WITH RECURSIVE seeded AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations
), kinds AS (SELECT *, {CRC32.format(key="key")} % 20 AS kind FROM seeded),
hurt AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM kinds WHERE kind <> 0
), placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM hurt),
marked AS (
  SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS initial_before,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM placed
), ready AS (SELECT *, fault IN ('blank', 'duplicate') AS gone, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS extra FROM marked),
facts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (initial_before IS NOT NULL AND initial_before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM ready GROUP BY conv_id
), ids AS (SELECT DISTINCT conv_id FROM conversations),
walk(conv_id, i, s0, s1, s2, s3) AS (
  SELECT conv_id, CAST(0 AS BIGINT), CAST({{'k': '000000000000', 't': ''}} AS {struct}), CAST(NULL AS {struct}), CAST(NULL AS {struct}), CAST(NULL AS {struct}) FROM ids
  UNION ALL
  SELECT conv_id, i + 1, {states} FROM (
    SELECT w.*, r.role, r.text, r.initial, r.gone, r.extra FROM ({_closed("walk")}) w JOIN ready r ON w.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = w.i + 1
  )
), ended AS (SELECT w.* FROM walk w LEFT JOIN facts f ON w.conv_id IS NOT DISTINCT FROM f.conv_id WHERE w.i = coalesce(f.n, 0)),
done AS (SELECT conv_id, {_best("s0", "s3")} AS z FROM ({_closed("ended")}))
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(left(z.k, 12) AS BIGINT) AS cost, substr(z.k, 13) AS audit, sha256(z.t) AS repaired_sha256
FROM ids LEFT JOIN facts f ON ids.conv_id IS NOT DISTINCT FROM f.conv_id LEFT JOIN done d ON ids.conv_id IS NOT DISTINCT FROM d.conv_id
"""
