"""International host names in their ASCII form (RFC 3492), as column expressions.

A label is encoded by folds over its code points; only labels with a character beyond ASCII
come that far. Names are lower-cased before; their Unicode normal form is left as it is.
"""

from __future__ import annotations

from glasswake.functions.text import sql_text

# Fixed values of RFC 3492, section 5.
BASE, T_MIN, T_MAX, SKEW, DAMP, FIRST_BIAS, FIRST_CODE = 36, 1, 26, 38, 700, 72, 128
DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"
PREFIX = "xn--"
# Full stops that divide labels like "." does, and the block of wide ASCII characters.
FULL_STOPS = "。．｡"
WIDE_FIRST, WIDE_LAST, WIDE_SHIFT = 0xFF01, 0xFF5E, 0xFEE0

_ROUNDS = 12            # digits of the largest number: each divides by ten at least
_NOT_ASCII = r"[^\x00-\x7f]"


def _number(delta: str, bias: str) -> str:
    """SQL text: ``delta`` as digits of falling weight, the last one below its threshold."""
    t = f"greatest({T_MIN}, least({T_MAX}, {BASE} * (j + 1) - {bias}))"
    digit = f"substring('{DIGITS}', CAST({{}} AS int) + 1, 1)"
    return (f"aggregate(sequence(0, {_ROUNDS - 1}), named_struct('q', {delta}, 'out', '', 'ended', false), (v, j) -> CASE "
            f"WHEN v.ended THEN v "
            f"WHEN v.q < {t} THEN named_struct('q', v.q, 'out', concat(v.out, {digit.format('v.q')}), 'ended', true) "
            f"ELSE named_struct('q', (v.q - {t}) div ({BASE} - {t}), 'out', "
            f"concat(v.out, {digit.format(f'({t} + (v.q - {t}) % ({BASE} - {t}))')}), 'ended', false) END, v -> v.out)")


def _bias(delta: str, done: str, first: str) -> str:
    """SQL text: the next bias, from the number just written and how many characters stand."""
    halved = f"CASE WHEN {first} THEN {delta} div {DAMP} ELSE {delta} div 2 END"
    limit = (BASE - T_MIN) * T_MAX // 2
    return (f"aggregate(sequence(1, {_ROUNDS}), named_struct('d', {halved} + ({halved}) div {done}, 'k', 0L), (w, j) -> CASE "
            f"WHEN w.d > {limit} THEN named_struct('d', w.d div {BASE - T_MIN}, 'k', w.k + {BASE}L) ELSE w END, "
            f"w -> w.k + ({BASE - T_MIN + 1} * w.d) div (w.d + {SKEW}))")


def _label(label: str) -> str:
    """SQL text: one label; characters are inserted in the order of their code points."""
    points = f"transform(sequence(1, char_length({label})), i -> CAST(ascii(substring({label}, i, 1)) AS bigint))"
    basic = f"regexp_replace({label}, '{_NOT_ASCII}', '')".replace("\\", "\\\\")
    start = (f"named_struct('n', {FIRST_CODE}L, 'delta', 0L, 'bias', {FIRST_BIAS}L, 'done', CAST(length({basic}) AS bigint), "
             f"'out', CASE WHEN {basic} = '' THEN '' ELSE concat({basic}, '-') END)")
    here = (f"named_struct('n', s.n, 'delta', 0L, 'bias', {_bias('s.delta', '(s.done + 1)', f'(s.done = length({basic}))')}, "
            f"'done', s.done + 1, 'out', concat(s.out, {_number('s.delta', 's.bias')}))")
    earlier = "named_struct('n', s.n, 'delta', s.delta + 1, 'bias', s.bias, 'done', s.done, 'out', s.out)"
    opened = ("named_struct('n', m, 'delta', z.delta + (m - z.n) * (z.done + 1), 'bias', z.bias, 'done', z.done, 'out', z.out)")
    closed = "r -> named_struct('n', r.n + 1, 'delta', r.delta + 1, 'bias', r.bias, 'done', r.done, 'out', r.out)"
    through = (f"aggregate({points}, {opened}, (s, c) -> CASE WHEN c < s.n THEN {earlier} WHEN c = s.n THEN {here} ELSE s END, {closed})")
    wanted = f"array_sort(array_distinct(filter({points}, c -> c >= {FIRST_CODE})))"
    return f"concat('{PREFIX}', aggregate({wanted}, {start}, (z, m) -> {through}, z -> z.out))"


def ascii_host(host: str) -> str:
    """SQL text: a lower-cased host name with each international label in ASCII form."""
    wide = "".join(map(chr, range(WIDE_FIRST, WIDE_LAST + 1)))
    plain = "".join(chr(ord(c) - WIDE_SHIFT) for c in wide)
    dots = "." * len(FULL_STOPS)
    folded = f"lower(translate({host}, {sql_text(wide + FULL_STOPS)}, {sql_text(plain + dots)}))"
    not_ascii = sql_text(_NOT_ASCII)
    return (f"CASE WHEN {host} RLIKE {not_ascii} THEN array_join(transform(split({folded}, '[.]', -1), "
            f"l -> CASE WHEN l RLIKE {not_ascii} THEN {_label('l')} ELSE l END), '.') ELSE {host} END")
