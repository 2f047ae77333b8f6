"""JSON texts as column expressions that keep the order of their members."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from glasswake.functions.text import sql_text

# a string, an empty object or list, a bracket or mark, a number or word
_TOKEN = r'"(?:[^"\\]|\\.)*+"|\{\s*\}|\[\s*\]|[{}\[\]:,]|[^\s{}\[\]:,"]+'
_EXPONENT = r"^-?[0-9.]+[eE]"
CUT_MARK = "\n…"


def _token_text(t: str) -> str:
    """SQL text: strings with the fewest escapes, numbers without trailing zeros."""
    number = f"try_cast(try_cast({t} AS double) AS decimal(38, 9))"
    plain = f"regexp_replace(regexp_replace(CAST({number} AS string), '(\\\\.[0-9]*?)0+$', '$1'), '\\\\.$', '')"
    return (f"CASE WHEN {t} RLIKE '^[{{\\\\[]\\\\s' THEN regexp_replace({t}, '\\\\s', '') "
            f"WHEN {t} RLIKE {sql_text(_EXPONENT)} THEN CASE WHEN {number} = try_cast({t} AS double) "
            f"AND abs({number}) < 1e21 AND ({number} = 0 OR abs({number}) >= 1e-6) THEN {plain} ELSE {t} END "
            f"WHEN contains({t}, {sql_text(chr(92))}) OR contains({t}, '.') "
            f"THEN coalesce(to_json(try_parse_json({t})), {t}) "
            f"WHEN {t} = '-0' THEN '0' ELSE {t} END")


def indented(text: str, limit: int) -> Column:
    """The JSON in column ``text``, two spaces a level; beyond ``limit`` characters cut and
    marked. NULL for texts that are no JSON.

    Members keep their order; a name that occurs twice is kept twice. Numbers with an exponent
    become plain ones where that is exact. A token has one character at least, so that
    ``limit`` + 1 tokens decide both the text that is shown and whether it is cut.
    """
    line = "concat('\\n', repeat('  ', {}))".format
    step = f"""CASE
        WHEN t IN ('{{', '[') THEN named_struct('out', concat(a.out, t, {line('a.depth + 1')}), 'depth', a.depth + 1)
        WHEN t IN ('}}', ']') THEN named_struct('out', concat(a.out, {line('a.depth - 1')}, t), 'depth', a.depth - 1)
        WHEN t = ',' THEN named_struct('out', concat(a.out, ',', {line('a.depth')}), 'depth', a.depth)
        WHEN t = ':' THEN named_struct('out', concat(a.out, ': '), 'depth', a.depth)
        ELSE named_struct('out', concat(a.out, {_token_text('t')}), 'depth', a.depth) END"""
    tokens = f"slice(regexp_extract_all({text}, {sql_text(_TOKEN)}, 0), 1, {limit + 1})"
    shown = F.expr(f"aggregate({tokens}, named_struct('out', '', 'depth', 0), (a, t) -> {step}, a -> "
                   f"CASE WHEN length(a.out) > {limit} THEN concat(left(a.out, {limit}), {sql_text(CUT_MARK)}) ELSE a.out END)")
    return F.when(F.try_parse_json(F.col(text)).isNotNull(), shown)
