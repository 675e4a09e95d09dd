"""Text expressions: trimming, ordered concatenation, character references."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space that JavaScript's trim() and \s know.
JS_SPACE = (
    "\t\n\x0b\x0c\r   "
    "           "
    "    　﻿"
)


def js_trim(c: Column) -> Column:
    """Trim both ends of every JavaScript white-space character (linear time)."""
    return F.btrim(c, F.lit(JS_SPACE))


def ordered_concat(value: str, order: str) -> Column:
    """Aggregate: concatenate the non-null `value`s of a group in `order`."""
    return F.expr(f"listagg({value}, '') WITHIN GROUP (ORDER BY {order})")


# The standard's names with `;`, and those that also work without it.
_NAMES = {name[:-1]: text for name, text in html5.items() if name.endswith(";")}
_BARE = {name: text for name, text in html5.items() if not name.endswith(";")}
_BARE_SIZES = sorted({len(name) for name in _BARE}, reverse=True)

_PIECES = r"(?s)&#[0-9]+;?|&#[xX][0-9A-Fa-f]+;?|&[A-Za-z][A-Za-z0-9]*[;=]?|[^&]+|&"


def _table(pairs: dict[str, str]) -> Column:
    """A constant string map, built in one call and folded by Catalyst."""
    return F.str_to_map(F.lit(" ".join(f"{k}:{v}" for k, v in pairs.items())), F.lit(" "), F.lit(":"))


# No character has this number.
_BEYOND = 0x110000


def _code_point(n: Column) -> Column:
    """Character of a numeric reference; references to nothing give U+FFFD."""
    legacy = {str(b): bytes([b]).decode("cp1252", "replace") for b in range(0x80, 0xA0)}
    legacy_table = _table({b: ch for b, ch in legacy.items() if ch != "\ufffd"})
    bad = (n == 0) | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF)
    wide = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    return (
        F.when(bad, F.lit("\ufffd"))
        .when(
            n.between(0x80, 0x9F),
            F.coalesce(F.try_element_at(legacy_table, n.cast("string")), wide),
        )
        .otherwise(wide)
    )


def _numbered(piece: Column) -> Column:
    """A numeric reference decoded."""
    hexa = F.regexp_extract(piece, "^&#[xX]0*([0-9A-Fa-f]+)", 1)
    deci = F.regexp_extract(piece, "^&#0*([0-9]+)", 1)
    # More digits than any character has name none; they stay short of an overflow.
    read = F.when(piece.rlike("^&#[xX]"), F.conv(F.substring(hexa, 1, 8), 16, 10)).otherwise(
        F.substring(deci, 1, 10)
    )
    number = F.when((F.length(hexa) > 8) | (F.length(deci) > 10), F.lit(_BEYOND)).otherwise(
        read.try_cast("bigint")
    )
    return F.coalesce(_code_point(number), piece)


def _named(piece: Column, in_attribute: bool) -> Column:
    """A named reference decoded: the whole name before `;`, else its longest bare beginning."""
    name = F.regexp_extract(piece, "^&([A-Za-z0-9]+)", 1)
    bare = _table(_BARE)
    whole = F.when(piece.endswith(";"), F.try_element_at(_table(_NAMES), name))
    if in_attribute:
        # There a bare name counts only if neither more of a name nor `=` follows.
        begun = F.when(F.concat(F.lit("&"), name) == piece, F.try_element_at(bare, name))
        return F.coalesce(whole, begun, piece)
    begun = [
        F.concat(
            F.when(F.length(name) >= n, F.try_element_at(bare, F.substring(name, 1, n))),
            F.substring(piece, n + 2, 1 << 30),
        )
        for n in _BARE_SIZES
    ]
    return F.coalesce(whole, *begun, piece)


def decode_entities(c: Column, in_attribute: bool = False) -> Column:
    """Decode character references once, as the HTML standard reads them.

    All of its names count; unknown ones stay as they are.
    """

    def decode(piece: Column) -> Column:
        return (
            F.when(~piece.startswith("&") | (piece == "&"), piece)
            .when(piece.startswith("&#"), _numbered(piece))
            .otherwise(_named(piece, in_attribute))
        )

    pieces = F.regexp_extract_all(c, F.lit(_PIECES), F.lit(0))
    return F.when(F.contains(c, F.lit("&")), F.array_join(F.transform(pieces, decode), "")).otherwise(c)
