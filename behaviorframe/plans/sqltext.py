"""Fragments of DuckDB SQL for the registered queries' oracles."""

from __future__ import annotations

import re

WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def norm(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}', ' ', 'g'))"


def stripped(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}|{WS}$', '', 'g')"


def words(x: str) -> str:
    return f"list_filter(string_split(regexp_replace({x}, '{WS}', ' ', 'g'), ' '), lambda w: w <> '')"


def hit(x: str, phrase: str) -> str:
    wanted = re.escape(re.sub(r"\s+", " ", phrase.strip().lower())).replace(r"\ ", " ").replace("'", "''")
    return f"regexp_matches(trim(regexp_replace(lower({x}), '{WS}', ' ', 'g')), '(^|[^\\p{{L}}\\p{{N}}_]){wanted}($|[^\\p{{L}}\\p{{N}}_])')"


def u01(seed: str, *keys: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(f'CAST({k} AS VARCHAR)' for k in keys)})), 1, 8))::BIGINT / 4294967296.0)"


def md5(seed: str, *keys: str) -> str:
    return f"md5(concat_ws('|', '{seed}', {', '.join(f'CAST({k} AS VARCHAR)' for k in keys)}))"


def lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def pick(options, u: str) -> str:
    return f"(['" + "', '".join(o.replace("'", "''") for o in options) + f"'])[CAST(floor(({u}) * {len(options)}) AS BIGINT) + 1]"


def weighted(options, weights, u: str) -> str:
    whole, low, out = float(sum(weights)), 0.0, []
    for o, w in zip(options, weights):
        if w > 0:
            low += w
            out.append(f"WHEN ({u}) * {whole} < {low} THEN {lit(o)}")
            last = o
    return f"CASE {' '.join(out)} ELSE {lit(last)} END"


def splice(x: str, phrase: str, position: str, cut: str | None = None) -> str:
    if position == "prefix":
        return f"({phrase} || ' ' || {x})"
    if position == "suffix":
        return f"({x} || ' ' || {phrase})"
    if position == "retrieved_doc":
        return f"({x} || chr(10) || chr(10) || '[document] ' || {phrase} || chr(10))"
    w = f"string_split({x}, ' ')"
    cut = cut or f"len({w}) // 2"
    return f"CASE WHEN len({w}) < 2 THEN {phrase} || ' ' || {x} ELSE array_to_string(list_concat(({w})[1:({cut})], [{phrase}], ({w})[({cut}) + 1:]), ' ') END"


def cut(x: str, u: str) -> str:
    return f"CAST(1 + floor(({u}) * (len(string_split({x}, ' ')) - 1)) AS BIGINT)"


def cased(phrase: str, kind: str) -> str:
    title = " ".join(w.capitalize() for w in phrase.split(" "))
    return f"CASE {kind} WHEN 'upper' THEN {lit(phrase.upper())} WHEN 'lower' THEN {lit(phrase.lower())} WHEN 'double_space' THEN {lit(phrase.replace(' ', '  '))} WHEN 'title' THEN {lit(title)} ELSE {lit(phrase)} END"


def stub(rel: str, key: str, text: str, phrase: str, canary: str, seed: str = "stub") -> str:
    """A relation with detected and output added."""
    u, c = u01(seed, key), lit(canary)
    return f"""(SELECT *, CASE WHEN detected AND u < 0.9 THEN {c} WHEN detected AND u < 0.95 THEN 'Sure. ' || {c} WHEN NOT detected AND u < 0.02 THEN {c}
      WHEN NOT detected AND u < 0.03 THEN {c} || '.' ELSE 'an ordinary reply' END AS output
      FROM (SELECT *, {hit(text, phrase)} AS detected, {u} AS u FROM {rel}))"""


def hash_percent(key: str) -> str:
    """SHA-256 modulo 100, in pieces of twelve digits."""
    d, out = f"sha256(CAST({key} AS VARCHAR))", "0"
    for low in range(0, 64, 12):
        width = min(12, 64 - low)
        out = f"(({out}) * {16**width % 100} + ('0x' || substr({d}, {low + 1}, {width}))::BIGINT) % 100"
    return out


def wilson(k: str, n: str, z: float = 1.96) -> tuple[str, str]:
    p, zz = f"(CAST({k} AS DOUBLE) / {n})", z * z
    centre = f"(({p} + {zz} / (2 * CAST({n} AS DOUBLE))) / (1 + {zz} / CAST({n} AS DOUBLE)))"
    half = f"({z} * sqrt({p} * (1 - {p}) / {n} + {zz} / (4 * CAST({n} AS DOUBLE) * {n})) / (1 + {zz} / CAST({n} AS DOUBLE)))"
    return f"CASE WHEN {n} > 0 THEN greatest(0.0, {centre} - {half}) ELSE 0.0 END", f"CASE WHEN {n} > 0 THEN least(1.0, {centre} + {half}) ELSE 0.0 END"


def values(rows: list[tuple], names: str) -> str:
    """Rows of text and whole numbers as a relation."""
    cell = lambda v: lit(v).replace("\n", "' || chr(10) || '") if isinstance(v, str) else str(v)
    return f"(VALUES {', '.join('(' + ', '.join(cell(v) for v in r) + ')' for r in rows)}) t({names})"
