"""Stems and term indices in SQL, written down apart from the Python functions, which they check."""

from __future__ import annotations

from ..functions.hashing import LEXICAL_BASE, LEXICAL_SPAN
from ..functions.stem import DOUBLES, KEPT_1A, LI_ENDING, STEP_2, STEP_3, STEP_4, V, WHOLE


def _map(pairs) -> str:
    return "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in pairs) + "}"


def _ending(names) -> str:
    """The longest of these endings: a search for any of them at the end begins as far left as it can."""
    return f"regexp_extract(w, '({'|'.join(names)})$')"


_REGION = f"'^[^{V}]*[{V}]+[^{V}]'"
_SHORT = f"(regexp_matches(w, '[^{V}][{V}][^{V}wxY]$') OR regexp_matches(w, '^[{V}][^{V}]$'))"
_CUT = "w[:length(w) - length(e)]"


def stems(tokens: str) -> str:
    """SELECT of (token, stem) for the relation tokens(token): a column list for each step; e is the ending in question."""
    steps = [
        f"SELECT token, token AS w FROM {tokens} WHERE length(token) > 2 AND token NOT IN ({', '.join(repr(x) for x in WHOLE)})",
        f"SELECT token, regexp_replace(regexp_replace(w, '^y', 'Y'), '([{V}])y', '\\1Y', 'g') AS w FROM s0",
        f"SELECT token, w, CASE WHEN regexp_matches(w, '^(gener|commun|arsen)') THEN length(regexp_extract(w, '^(gener|commun|arsen)')) WHEN regexp_matches(w, {_REGION}) THEN length(regexp_extract(w, {_REGION})) ELSE length(w) END AS r1 FROM s1",
        f"SELECT *, CASE WHEN regexp_matches(w[r1 + 1:], {_REGION}) THEN r1 + length(regexp_extract(w[r1 + 1:], {_REGION})) ELSE length(w) END AS r2 FROM s2",
        f"""SELECT token, r1, r2, CASE WHEN w LIKE '%sses' THEN w[:length(w) - 2] WHEN regexp_matches(w, '(ied|ies)$') THEN w[:length(w) - CASE WHEN length(w) > 4 THEN 2 ELSE 1 END]
          WHEN w LIKE '%s' AND NOT regexp_matches(w, '(us|ss)$') AND regexp_matches(w[:length(w) - 1], '[{V}].') THEN w[:length(w) - 1] ELSE w END AS w FROM s3""",
        f"SELECT *, w IN ({', '.join(repr(x) for x in sorted(KEPT_1A))}) AS kept, {_ending(('eedly', 'eed'))} AS ee, {_ending(('ingly', 'edly', 'ing', 'ed'))} AS e FROM s4",
        f"""SELECT token, r1, r2, kept, w AS before, CASE WHEN ee <> '' THEN CASE WHEN length(w) - length(ee) >= r1 THEN w[:length(w) - length(ee)] || 'ee' ELSE w END
          WHEN e <> '' AND regexp_matches({_CUT}, '[{V}]') THEN {_CUT} ELSE w END AS w, ee = '' AND e <> '' AND regexp_matches({_CUT}, '[{V}]') AS taken FROM s5""",
        f"""SELECT token, r1, r2, kept, before, CASE WHEN NOT taken THEN w WHEN regexp_matches(w, '(at|bl|iz)$') THEN w || 'e' WHEN w[-2:] IN ({', '.join(repr(x) for x in DOUBLES)}) THEN w[:length(w) - 1]
          WHEN r1 >= length(w) AND {_SHORT} THEN w || 'e' ELSE w END AS w FROM s6""",
        f"SELECT * REPLACE (CASE WHEN regexp_matches(w, '.[^{V}][yY]$') THEN w[:length(w) - 1] || 'i' ELSE w END AS w) FROM s7",
        f"SELECT *, {_ending([a for a, _ in STEP_2])} AS e FROM s8",
        f"""SELECT token, r1, r2, kept, before, CASE WHEN e = '' OR length(w) - length(e) < r1 OR (e = 'ogi' AND w NOT LIKE '%logi') OR (e = 'li' AND NOT regexp_matches(w, '[{LI_ENDING}]li$')) THEN w
          ELSE {_CUT} || {_map(STEP_2)}[e] END AS w FROM s9""",
        f"SELECT *, {_ending([a for a, _ in STEP_3])} AS e FROM s10",
        f"SELECT token, r1, r2, kept, before, CASE WHEN e = '' OR length(w) - length(e) < CASE WHEN e = 'ative' THEN r2 ELSE r1 END THEN w ELSE {_CUT} || {_map(STEP_3)}[e] END AS w FROM s11",
        f"SELECT *, {_ending(STEP_4)} AS e FROM s12",
        f"SELECT token, r1, r2, kept, before, CASE WHEN e = '' OR length(w) - length(e) < r2 OR (e = 'ion' AND NOT regexp_matches(w, '[st]ion$')) THEN w ELSE {_CUT} END AS w FROM s13",
        f"""SELECT token, kept, before, CASE WHEN w LIKE '%e' AND (length(w) - 1 >= r2 OR (length(w) - 1 >= r1 AND NOT (regexp_matches(w, '[^{V}][{V}][^{V}wxY]e$') OR regexp_matches(w, '^[{V}][^{V}]e$')))) THEN w[:length(w) - 1]
          WHEN w LIKE '%ll' AND length(w) - 1 >= r2 THEN w[:length(w) - 1] ELSE w END AS w FROM s14""",
    ]
    body = ",\n".join(f"s{i} AS ({s})" for i, s in enumerate(steps))
    return f"""WITH {body}
      SELECT token, CASE WHEN kept THEN before ELSE replace(w, 'Y', 'y') END AS stem FROM s{len(steps) - 1}
      UNION ALL SELECT token, CASE WHEN length(token) <= 2 THEN token ELSE {_map(WHOLE.items())}[token] END FROM {tokens} WHERE length(token) <= 2 OR token IN ({', '.join(repr(x) for x in WHOLE)})"""


_32 = "4294967296"


def _rotl(x: str, r: int) -> str:
    return f"(({x}) * {1 << r} % {_32} + ({x}) // {1 << (32 - r)})"


def _mix(x: str) -> str:
    return f"({_rotl(f'({x}) * 3432918353 % {_32}', 15)} * 461845907 % {_32})"


def indices(terms: str) -> str:
    """SELECT of (term, idx) for the relation terms(term): Murmur3 (32 bits, seed 0) by whole numbers, a fold over four-byte blocks."""
    fold = f"({_rotl(f'xor(h, k)', 13)} * 5 + 3864292196) % {_32}"
    tail = f"CASE WHEN len(b) % 4 = 0 THEN h ELSE xor(h, {_mix('rest')}) END"
    last = "xor(h, len(b)::UBIGINT)"
    for shift, factor in ((16, 2246822507), (13, 3266489909)):
        last = f"(xor(x{shift}, x{shift} // {1 << shift}) * {factor} % {_32})".replace(f"x{shift}", f"({last})")
    return f"""WITH b0 AS (SELECT term, hex(encode(term)) AS x FROM {terms}),
      b1 AS (SELECT term, [('0x' || x[2 * i + 1:2 * i + 2])::UBIGINT FOR i IN range(0, length(x) // 2)] AS b FROM b0),
      b2 AS (SELECT term, b, [b[4 * i + 1] + b[4 * i + 2] * 256 + b[4 * i + 3] * 65536 + b[4 * i + 4] * 16777216 FOR i IN range(0, len(b) // 4)] AS ks,
        list_sum([b[len(b) // 4 * 4 + i + 1] * (256 ** i)::UBIGINT FOR i IN range(0, len(b) % 4)])::UBIGINT AS rest FROM b1),
      b3 AS (SELECT term, b, rest, list_reduce(list_concat([0::UBIGINT], list_transform(ks, lambda k: {_mix('k')}::UBIGINT)), lambda h, k: ({fold})::UBIGINT) AS h FROM b2),
      b4 AS (SELECT term, b, ({tail})::UBIGINT AS h FROM b3), b5 AS (SELECT term, ({last})::UBIGINT AS h FROM b4), b6 AS (SELECT term, xor(h, h // 65536)::BIGINT AS h FROM b5)
      SELECT term, {LEXICAL_BASE} + (CASE WHEN h >= 2147483648 THEN {_32} - h ELSE h END) % {LEXICAL_SPAN} AS idx FROM b6"""
