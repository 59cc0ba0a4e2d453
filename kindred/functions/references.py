"""Character references of markup decoded as the HTML standard says, in one pass and inside Catalyst.

A text is split at its ampersands and each piece is looked at once, so what one reference decodes to is never decoded again.
Names are looked up in a hash table that travels as one literal: the standard's 2,231 names, as Python's ``html.entities``
lists them, dealt over ``BUCKETS`` by crc32. A name without its semicolon counts if it is one of the old names that need
none, also as the beginning of a longer word, the longest first.
"""

from __future__ import annotations

import json
from functools import cache
from html.entities import html5
from zlib import crc32

from pyspark.sql import Column
from pyspark.sql import functions as F

BUCKETS = 4_096
#: Fixed value: what may follow an ampersand.
REFERENCE = r"^(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
LAST_CODE_POINT = 0x10FFFF


@cache
def _names() -> str:
    """The table as JSON: an array of maps, so that a name's bucket is found by its place."""
    table: list[dict[str, str]] = [{} for _ in range(BUCKETS)]
    for name, text in html5.items():
        table[crc32(name.encode()) % BUCKETS][name] = text
    return json.dumps(table)


@cache
def _lengths() -> range:
    """Lengths of the names that need no semicolon, longest first."""
    found = {len(name) for name in html5 if not name.endswith(";")}
    return range(max(found), min(found) - 1, -1)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _windows_1252(code: int) -> str:
    try:
        return bytes([code]).decode("cp1252")
    except UnicodeDecodeError:
        return chr(code)


def character(code: Column) -> Column:
    """The text of a numeric reference: 0x80 to 0x9F mean Windows-1252, surrogates and numbers beyond Unicode become the
    replacement character, and what is no character nothing."""
    old = F.array(*[F.lit(_windows_1252(c)) for c in range(0x80, 0xA0)])
    control = code.between(1, 8) | (code == 0x0B) | code.between(0x0E, 0x1F) | (code == 0x7F)
    no_character = code.between(0xFDD0, 0xFDEF) | (code.bitwiseAND(0xFFFE) == 0xFFFE)
    unknown = (code == 0) | code.between(0xD800, 0xDFFF) | (code > LAST_CODE_POINT)
    plain = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return F.when(code.between(0x80, 0x9F), F.get(old, code - 0x80)).when(unknown, "�").when(control | no_character, "").otherwise(plain)


def _numeric(m: Column) -> Column:
    digits = F.regexp_extract(m, "^#[xX]?0*([0-9a-fA-F]*)", 1)
    number = F.when(m.rlike("^#[xX]"), F.conv(digits, 16, 10)).otherwise(F.conv(digits, 10, 10))
    code = F.when(F.length(digits) > 7, LAST_CODE_POINT + 1).when(digits == "", 0).otherwise(number.cast("int"))
    return let(code, character)


def _named(table: Column, m: Column) -> Column:
    text = lambda name: F.try_element_at(F.get(table, (F.crc32(name.cast("binary")) % BUCKETS).cast("int")), name)
    begins = [F.when(F.length(m) > k, F.concat(text(F.substr(m, F.lit(1), F.lit(k))), F.substr(m, F.lit(k + 1)))) for k in _lengths()]
    return F.coalesce(text(m), *begins, F.concat(F.lit("&"), m))


def decoded(x: Column) -> Column:
    """Text with its character references decoded; null stays null."""

    def piece(table: Column, p: Column) -> Column:
        def found(m: Column) -> Column:
            rest = F.substr(p, F.length(m) + 1)
            return F.when(m == "", F.concat(F.lit("&"), p)).otherwise(F.concat(F.when(F.startswith(m, F.lit("#")), _numeric(m)).otherwise(_named(table, m)), rest))

        return let(F.regexp_extract(p, REFERENCE, 0), found)

    names = F.from_json(F.lit(_names()), "array<map<string,string>>")
    whole = lambda table: F.array_join(F.transform(F.split(x, "&"), lambda p, i: F.when(i == 0, p).otherwise(piece(table, p))), "")
    return F.when(F.contains(x, F.lit("&")), let(names, whole)).otherwise(x)
