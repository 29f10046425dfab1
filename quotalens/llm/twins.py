"""DuckDB SQL for those queries of this folder that SQL can express, each by another way than the operator."""

from __future__ import annotations

# Conversations need no tree: every row is one turn.  The template's marks add 12 + 1 + 11 characters a turn.
REPLY_TREES = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '<|im_end|><|im_start|>assistant ok'
), pieces AS (
  SELECT *, length(replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '|', '%7C')) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + 24 AS chars FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM pieces GROUP BY conv_id
"""


def _structure_repair() -> str:
    """A fold over the rows keeps the least (cost, audit) of each state: 1 before the first kept row, 2 after a system
    row, 3 awaiting an answer, 4 complete.  Only the least prefix of a state can lead to the least whole."""
    none = "{'c': 1000000000, 'a': '', 't': ''}"

    def edit(state: str, cost: str, letter: str, text: str = "") -> str:
        added = f"{state}.t || CASE WHEN {state}.t = '' THEN '' ELSE chr(10) END || {text}" if text else f"{state}.t"
        return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {added}}}"

    def least(*parts: str) -> str:
        return f"list_sort([{', '.join(parts)}])[1]"

    def stays(state: str, role: str = "", initial: str = "") -> str:
        """Keep a row of this initial, or give it this role."""
        extra = "CASE WHEN x.fault = 3 THEN 5 ELSE 0 END"
        if role:
            return f"CASE WHEN x.fault IN (0, 3) THEN {edit(state, f'({extra} + 1)', 'R', f'{chr(39)}{role}:{chr(39)} || x.text')} ELSE {none} END"
        return f"CASE WHEN x.fault IN (0, 3) AND x.initial = '{initial}' THEN {edit(state, f'({extra})', 'K', 'x.said')} ELSE {none} END"

    asked = [e for k in (1, 2, 4) for e in (stays(f"s[{k}]", initial="u"), stays(f"s[{k}]", role="user"))]
    step = ", ".join([
        edit("s[1]", "2", "D"),
        least(edit("s[2]", "2", "D"), stays("s[1]", initial="s")),
        least(edit("s[3]", "2", "D"), *asked),
        least(edit("s[4]", "2", "D"), stays("s[3]", initial="a"), stays("s[3]", role="assistant")),
    ])
    # one insertion a state is enough at any place: a user row from 1, 2 or 4, then an answer
    asks = least("w[3]", *(edit(f"w[{k}]", "5", "I", "'user:'") for k in (1, 2, 4)))
    answers = least("v[4]", edit("v[3]", "5", "I", "'assistant:'"))
    fold = f"list_transform(list_transform([[{step}]], lambda w: [w[1], w[2], {asks}, w[4]]), lambda v: [v[1], v[2], v[3], {answers}])[1]"
    start = f"[{{'c': 0, 'a': '', 't': ''}}, {none}, {{'c': 5, 'a': 'I', 't': 'user:'}}, {{'c': 10, 'a': 'II', 't': 'user:' || chr(10) || 'assistant:'}}]"
    # crc32 bit by bit: each byte enters with the first of its eight steps
    crc = """xor(list_reduce(flatten(list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
           lambda c: [CAST(ascii(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0])), lambda r, b: xor(xor(r, b) >> 1, 3988292384 * (xor(r, b) & 1)), 4294967295::BIGINT), 4294967295::BIGINT)"""
    return rf"""
WITH drawn AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS draw FROM conversations
), damaged AS (
  SELECT conv_id, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN draw = 1 THEN '' WHEN draw = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN draw = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM drawn WHERE draw <> 0
), placed AS (
  SELECT *, row_number() OVER w AS place, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
         lag(role) OVER w AS role_before, regexp_replace(text, '[ 	-]+$', '') AS body
  FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)
), judged AS (
  SELECT *, CASE WHEN body = '' THEN 1 WHEN seen > 1 THEN 2 WHEN NOT regexp_matches(body, '[.!?]$') THEN 3 ELSE 0 END AS fault FROM placed
), gathered AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
         count(*) FILTER (role_before IS NOT NULL AND left(role_before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal,
         list({{'initial': left(role, 1), 'fault': fault, 'said': role || ':' || text, 'text': text}} ORDER BY place) AS rows
  FROM judged GROUP BY conv_id
), folded AS (
  SELECT * EXCLUDE (rows), list_reduce(rows, lambda s, x: {fold}, {start}) AS states FROM gathered
), solved AS (
  SELECT * EXCLUDE (states), list_sort([states[1], states[4]])[1] AS best FROM folded
)
SELECT named.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, CAST(coalesce(best.c, 0) AS BIGINT) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(best.t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS named LEFT JOIN solved ON named.conv_id IS NOT DISTINCT FROM solved.conv_id
"""


STRUCTURE_REPAIR = _structure_repair()


def _code_books(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Rounds written out one after the other; parts as rows, components as lists."""
    square = "list_sum(list_transform(list_zip(v, e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    text = [f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 4096) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), numbered AS (
  SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, q) - 1 AS row_no FROM kept
), pieces AS (
  SELECT row_no, p, q[p * (len(q) // {parts}) + 1 : (p + 1) * (len(q) // {parts})] AS v FROM numbered, range({parts}) AS r(p)
), book_0 AS (SELECT p, row_no AS entry, v AS e FROM pieces WHERE row_no < {entries})"""]
    for r in range(rounds + 1):
        text.append(f"""near_{r} AS MATERIALIZED (
  SELECT row_no, p, any_value(v) AS v, min({{'d': CAST({square} AS BIGINT), 'entry': entry}}) AS best FROM pieces JOIN book_{r} USING (p) GROUP BY row_no, p
)""")
        if r < rounds:
            text.append(f"""place_{r} AS (
  SELECT p, best.entry AS entry, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS c FROM near_{r}, range(1, (SELECT max(len(v)) FROM pieces) + 1) AS w(i) GROUP BY ALL
), mean_{r} AS (
  SELECT p, entry, list((s - ((s % c) + c) % c) // c ORDER BY i) AS m FROM place_{r} GROUP BY p, entry
), book_{r + 1} AS MATERIALIZED (SELECT p, entry, coalesce(m, e) AS e FROM book_{r} LEFT JOIN mean_{r} USING (p, entry))""")
    text.append(f"""coded AS (
  SELECT row_no, string_agg(printf('%02x', best.entry), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM near_{rounds} GROUP BY row_no
), sealed AS (
  SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY p, entry)) AS codebooks_sha256 FROM book_{rounds}
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM numbered JOIN coded USING (row_no), sealed
""")
    return ", ".join(text)


CODE_BOOKS = _code_books()
