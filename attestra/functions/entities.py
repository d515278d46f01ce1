"""Character references of HTML, read as a browser reads them: by number or name, with or without the closing sign."""

from __future__ import annotations

import html
import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
MARK = "\x01"
#: What the low numbers stand for, by the rule of the standard library: some are other characters, some none.
LOW = {str(n): html.unescape(f"&#{n};") for n in range(160)}


def _map(values: dict[str, str]) -> Column:
    """A map that is a literal of the plan, whatever its size."""
    return F.from_json(F.lit(json.dumps(values)), "map<string,string>")


def _character(code: Column) -> Column:
    """The character of a number (a long): none for what is no character, the sign for unknown ones beyond the last."""
    plain = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    odd = code.between(0xFDD0, 0xFDEF) | (code.bitwiseAND(0xFFFE) == 0xFFFE)
    return F.when(code < 160, F.element_at(_map(LOW), code.cast("string"))).when(code.between(0xD800, 0xDFFF) | (code > 0x10FFFF), "�").when(odd, "").otherwise(plain)


def _number(digits: Column, base: int) -> Column:
    """Of digits too many to count, one beyond the last character."""
    bare = F.regexp_replace(digits, "^0+", "")
    return F.when(F.length(bare) > 9, 0x110000).otherwise(F.conv(F.when(bare == "", "0").otherwise(bare), base, 10).cast("long"))


def _named(name: Column) -> Column:
    """A name, else the longest beginning of it that is one, else as it stands."""
    known = _map(html5)
    whole = F.try_element_at(known, name)
    sizes = F.when(F.char_length(name) > 2, F.sequence(F.char_length(name) - 1, F.lit(2), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    parts = F.transform(sizes, lambda n: F.concat(F.try_element_at(known, F.substr(name, F.lit(1), n)), F.substr(name, n + 1, F.char_length(name))))
    return F.coalesce(whole, F.try_element_at(F.filter(parts, lambda p: p.isNotNull()), F.lit(1)), F.concat(F.lit("&"), name))


def unescaped(text: Column) -> Column:
    """text with every character reference replaced, once."""

    def one(m: Column) -> Column:
        body = F.substr(m, F.lit(2), F.char_length(m))
        digits = F.rtrim(body, F.lit(";"))
        by_hex = F.when(m.rlike("^&#[xX]"), _character(_number(F.substr(digits, F.lit(3), F.char_length(digits)), 16)))
        by_ten = F.when(m.rlike("^&#[0-9]"), _character(_number(F.substr(digits, F.lit(2), F.char_length(digits)), 10)))
        return F.coalesce(by_hex, by_ten, _named(body))

    def of(t: Column) -> Column:
        cut = F.split(F.regexp_replace(F.replace(t, F.lit(MARK), F.lit("")), REFERENCE, f"{MARK}$0{MARK}"), MARK)
        return F.array_join(F.transform(cut, lambda p, i: F.when(i % 2 == 1, one(p)).otherwise(p)), "")

    return let(text, lambda t: F.when(F.contains(t, F.lit("&")), of(t)).otherwise(t))
