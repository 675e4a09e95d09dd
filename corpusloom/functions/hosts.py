"""Hosts in the normal form of the URL standard, as SQL expressions.

`canonical_host` decodes percent escapes, folds case and full-width forms, encodes
labels of other scripts by Bootstring (RFC 3492, `xn--`) and writes numeric spellings of IPv4
addresses as four decimal parts. A plain host costs one pattern. Not covered: composing
a letter with a combining mark that follows it, and the check of labels that come
as `xn--` already.

The rules are SQL text: parsed at once, where as many column calls would take longer to
put together than a query over small tables runs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the host rules: full stops of other scripts, characters that vanish,
# and full-width forms of ASCII, a constant distance away.
_STOPS = "。．｡"
_IGNORED = "\u00ad\u200b\u2060\ufeff"
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_NARROW = "".join(map(chr, range(0x21, 0x7F)))

# Fixed values of RFC 3492: base 36, thresholds 1 to 26, skew 38, damp 700, bias 72,
# first code point 128; digits a to z, then 0 to 9.
_DIGITS = "'abcdefghijklmnopqrstuvwxyz0123456789'"

_ENDS_IN_NUMBER = r"(?:^|\.)(?:[0-9]+|0x[0-9a-f]*)\.?$"
# Most hosts: plain characters and no number at the end, or a bracketed address.
_AS_IT_IS = rf"^(?:\[.*|(?!.*{_ENDS_IN_NUMBER})[a-z0-9!$&'()*+,;=_.~\-]*)$"


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, use: str) -> str:
    """`use`, in which `name` stands for `value`."""
    return f"transform(array({value}), {name} -> {use})[0]"


# A difference d as digits of growing weight, the last one below its threshold. A 64-bit number
# has no more than 20.
_WRITTEN = f"""aggregate(sequence(36, 720, 36), struct(d AS q, '' AS txt),
  (w, k) -> if(w.q < 0, w, {_let("t", "least(greatest(k - s.bias, 1L), 26L)", f'''
    if(w.q < t,
      struct(-1L AS q, concat(w.txt, substring({_DIGITS}, int(w.q) + 1, 1)) AS txt),
      struct((w.q - t) div (36 - t) AS q,
        concat(w.txt, substring({_DIGITS}, int(t + (w.q - t) % (36 - t)) + 1, 1)) AS txt))''')}),
  w -> w.txt)"""

# The bias after d was written.
_ADAPTED = f"""aggregate(sequence(1, 20),
  {_let("g", "d div if(s.h = char_length(plain), 700L, 2L)", "struct(g + g div (s.h + 1) AS q, 0L AS k)")},
  (a, i) -> if(a.q > 455, struct(a.q div 35 AS q, a.k + 36 AS k), a),
  a -> a.k + a.q * 36 div (a.q + 38))"""

# The state s holds the last code point n, the place i behind it and the length h so far. The
# next letter x goes behind all that is not larger and stands before it.
_INSERTED = _let(
    "place",
    "bigint(size(filter(points, y -> y.c <= x.c AND y.p < x.p)))",
    _let(
        "d",
        "(x.c - s.n) * (s.h + 1) + place - s.i",
        f"""struct(bigint(x.c) AS n, place + 1 AS i, s.h + 1 AS h, {_ADAPTED} AS bias,
          concat(s.txt, {_WRITTEN}) AS txt)""",
    ),
)

# Letters go in by code point, then place.
_BOOTSTRING = _let(
    "points",
    "transform(sequence(1, char_length(label)),"
    " p -> struct(ascii(substring(label, p, 1)) AS c, p AS p))",
    _let(
        "plain",
        r"regexp_replace(label, r'[^\x00-\x7f]+', '')",
        f"""aggregate(array_sort(filter(points, x -> x.c >= 128)),
          struct(128L AS n, 0L AS i, bigint(char_length(plain)) AS h, 72L AS bias,
            if(plain = '', '', concat(plain, '-')) AS txt),
          (s, x) -> {_INSERTED}, s -> s.txt)""",
    ),
)


def _numeral(prefix: str, digits: str, base: int) -> str:
    """The value of `part`, NULL if it has other digits or far too many."""
    found = f"regexp_extract(part, r'^{prefix}0*({digits}{{0,11}})$', 1)"
    return f"if(part RLIKE r'^{prefix}0*{digits}{{0,11}}$', bigint(conv(concat('0', {found}), {base}, 10)), NULL)"


_NUMBER = f"""CASE WHEN part = '' THEN NULL
  WHEN part LIKE '0x%' THEN {_numeral("0x", "[0-9a-f]", 16)}
  WHEN part LIKE '0_%' THEN {_numeral("0", "[0-7]", 8)}
  ELSE {_numeral("", "[0-9]", 10)} END"""

# The last part fills all places that are left.
_ADDRESS = _let(
    "parts",
    rf"transform(split(regexp_replace(host, r'\.$', ''), r'\.'), part -> {_NUMBER})",
    _let(
        "heads",
        "slice(parts, 1, size(parts) - 1)",
        f"""CASE WHEN size(parts) <= 4 AND NOT exists(parts, x -> x IS NULL)
          AND NOT exists(heads, x -> x > 255) AND element_at(parts, -1) < pow(256, 5 - size(parts))
        THEN {_let(
            "total",
            "element_at(parts, -1) + aggregate("
            "transform(heads, (x, i) -> x * bigint(pow(256, 3 - i))), 0L, (a, x) -> a + x)",
            "array_join(transform(array(16777216, 65536, 256, 1),"
            " w -> string(total div w % 256)), '.')",
        )} END""",
    ),
)

# `+` means itself in a host. Bytes that were no text have no name.
_NORMAL = _let(
    "folded",
    f"""lower(translate(
      if(contains(raw, '%'), try_url_decode(replace(raw, '+', '%2B')), raw),
      {_text(_STOPS + _WIDE + _IGNORED)}, {_text("..." + _NARROW)}))""",
    _let(
        "host",
        rf"""CASE WHEN contains(folded, '{chr(0xFFFD)}') THEN NULL
          WHEN folded RLIKE r'[^\x00-\x7f]' THEN array_join(transform(split(folded, r'\.'),
            label -> if(label RLIKE r'[^\x00-\x7f]', concat('xn--', {_BOOTSTRING}), label)), '.')
          ELSE folded END""",
        f"if(host RLIKE r'{_ENDS_IN_NUMBER}', {_ADDRESS}, host)",
    ),
)


def _applied(name: str, rule: str, value: Column) -> Column:
    return F.call_function("transform", F.array(value), F.expr(f"{name} -> {rule}"))[0]


def bootstring(label: Column) -> Column:
    """A label's letters as ASCII by RFC 3492, without the `xn--`."""
    return _applied("label", _BOOTSTRING, label)


def canonical_host(raw: Column) -> Column:
    """A name in its normal form, NULL if it has none; `raw` is lower-cased."""
    return F.when(raw.rlike(_AS_IT_IS), raw).otherwise(_applied("raw", _NORMAL, raw))
