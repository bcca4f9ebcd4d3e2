"""Conversation repair in DuckDB SQL: a list of four states (cost, edits, text), reduced row by row.

The best of each state is kept as the least struct, so by cost, then by edits. Of two prefixes that took
equally many rows at equal cost into one state, none continues the other (that would be insertions only,
which cost), so the least prefix stays the least whatever follows.
"""

from __future__ import annotations

_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_START = "{'c': 0, 'a': '', 't': ''}"
_FAR = "{'c': 1000000, 'a': '', 't': ''}"


def _crc32(text: str) -> str:
    """Eight shifts a byte, over texts of ASCII."""
    shifts = "lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda y, z: xor(y >> 1, (y & 1) * 3988292384))"
    codes = f"list_transform(string_split({text}, ''), lambda c: unicode(c)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), {shifts}), 4294967295::BIGINT)"


def _moved(state: str, cost: str, edit: str, line: str = "''") -> str:
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}', 't': {state}.t || {line}}}"


def _inserted(state: str, role: str) -> str:
    return _moved(state, "2", "I", f"chr(10) || '{role}:'")


def _kept(state: str, initial: str) -> str:
    return f"CASE WHEN NOT e.m AND e.i = '{initial}' THEN {_moved(state, 'e.l', 'K', 'chr(10) || e.r || chr(58) || e.x')} END"


def _reroled(state: str, role: str) -> str:
    line = f"chr(10) || '{role}:' || e.x"
    return f"CASE WHEN NOT e.m THEN {_moved(state, '2 + e.l', 'R', line)} END"


def _filled(states: str, times: int = 3) -> str:
    """States 1 to 4 (nothing, system, user, assistant) with insertions allowed where they are."""
    for _ in range(times):
        user = ", ".join(["f[3]", *[_inserted(f"f[{q}]", "user") for q in (1, 2, 4)]])
        states = f"list_transform([{states}], lambda f: [f[1], f[2], list_min([{user}]), list_min([f[4], {_inserted('f[3]', 'assistant')}])])[1]"
    return states


def _step() -> str:
    deleted = [_moved(f"v[{q}]", "3", "D") for q in (1, 2, 3, 4)]
    system = [deleted[1], _kept("v[1]", "s")]
    user = [deleted[2], *[x for q in (1, 2, 4) for x in (_kept(f"v[{q}]", "u"), _reroled(f"v[{q}]", "user"))]]
    assistant = [deleted[3], _kept("v[3]", "a"), _reroled("v[3]", "assistant")]
    return f"[{deleted[0]}, {', '.join(f'list_min([{chr(44).join(x)}])' for x in (system, user, assistant))}]"


def _row(states: str) -> str:
    return f"{{'i': '', 'm': false, 'l': 0, 'r': '', 'x': '', 's': {states}}}"


_KEY = "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"
_REDUCED = f"list_reduce(es, lambda acc, e: list_transform([{_filled('acc.s')}], lambda v: {_row(_step())})[1], {_row(f'[{_START}, {_FAR}, {_FAR}, {_FAR}]')}).s"

#: The result of op11_convo_repair.
SQL = f"""WITH d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32(_KEY)} % 20 AS k FROM conversations),
rows AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
  unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy FROM d WHERE k <> 0),
said AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) > 1 AS again, right(rtrim(text, {_SPACE}), 1) AS last, left(role, 1) AS i,
  lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before FROM rows),
facts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (last = '') AS blank, count(*) FILTER (last <> '' AND again) AS duplicate,
  count(*) FILTER (last <> '' AND NOT again AND last NOT IN ('.', '!', '?')) AS truncated, count(*) FILTER (before || i NOT IN ('su', 'ua', 'au')) AS illegal,
  list({{'i': i, 'm': last = '' OR again, 'l': CASE WHEN last IN ('.', '!', '?') THEN 0 ELSE 1 END, 'r': role, 'x': text, 's': NULL::STRUCT(c INT, a VARCHAR, t VARCHAR)[]}}
  ORDER BY turn NULLS FIRST, role, text, again) AS es FROM said GROUP BY conv_id),
ends AS (SELECT * EXCLUDE (es), {_filled(_REDUCED)} AS v FROM facts),
best AS (SELECT *, list_min([v[1], v[4]]) AS b FROM ends)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
coalesce(b.c, 0)::BIGINT AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(substr(b.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id"""
