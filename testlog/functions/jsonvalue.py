"""JSON lines as VARIANT values and typed field access."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from testlog.functions.text import MAX_BIGINT

# The characters a JSON value can start with, and those that end it then.
DIGITS = "0123456789"
ONE_STRING = r'(?s)\A"[^"\\]*+(?:\\.[^"\\]*+)*+"\z'
VALUE_ENDS = {"{": "}", "[": "]", '"': '"', "t": "e", "f": "e", "n": "l"} | dict.fromkeys("-" + DIGITS, DIGITS)


def json_value(text: Column) -> Column:
    """``{"v": value}`` as VARIANT when the trimmed text is exactly one JSON value.

    ``try_parse_json`` ignores what follows the first value, so the text is tried
    inside an object and counted inside an array; only a single value fits both.  Most lines of a
    pretty-printed document already show by their ends that they are none, and members of one line
(``"key": "text"``) by a quote within: a parse that fails costs far more than one that succeeds.
    """
    alone = F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1
    in_object = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    begin, end = F.left(text, F.lit(1)), F.right(text, F.lit(1))
    bounded = F.lit(False)
    for ends in dict.fromkeys(VALUE_ENDS.values()):
        bounded = bounded | (begin.isin(*[b for b, e in VALUE_ENDS.items() if e == ends]) & end.isin(*ends))
    bounded = bounded & ((begin != '"') | text.rlike(ONE_STRING))
    # one character alone is no text, list or object
    return F.when(bounded & (begin.isin(*DIGITS) | (F.octet_length(text) > 1)) & alone, in_object)


def field_type(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def string_at(v: Column, path: str) -> Column:
    """The field when it is a JSON string; numbers and others give null."""
    return F.when(field_type(v, path) == "STRING", F.try_variant_get(v, path, "string"))


def count_at(v: Column, path: str) -> Column:
    """The field when it is a non-negative integer, as BIGINT clamped at the top."""
    kind = field_type(v, path)
    small = F.when(kind == "BIGINT", F.try_variant_get(v, path, "bigint"))
    large = F.when(
        kind.isin("DECIMAL(19,0)", "DECIMAL(20,0)"), F.try_variant_get(v, path, "decimal(20,0)")
    )
    top = F.lit(str(MAX_BIGINT)).cast("decimal(20,0)")
    return F.coalesce(F.when(small >= 0, small), F.when(large > top, F.lit(MAX_BIGINT)))


def array_at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "array<variant>")
