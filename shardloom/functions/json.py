"""JSON cells, payload objects and number cleaning as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shardloom.functions.rows import let
from shardloom.functions.text import is_blank, trim_ws

# Closes the wrapping array in strict_json; text that holds it is treated as plain text.
_END_MARK = "shardloom-end-of-cell"


def strict_json(c: Column) -> Column:
    """Parse ``c`` as one JSON value, null when anything else surrounds it.

    ``try_parse_json`` ignores text after the first value, so the cell is parsed as the first of two
    array elements: the second is a marker that only survives if the cell was exactly one value.
    """
    wrapped = F.try_parse_json(F.concat(F.lit("["), c, F.lit(f',"{_END_MARK}"]')))

    def first_of_two(elements: Column) -> Column:
        marked = F.try_variant_get(F.get(elements, F.lit(1)), "$", "string") == _END_MARK
        complete = (F.size(elements) == 2) & marked & ~F.contains(c, F.lit(_END_MARK))
        return F.when(complete, F.get(elements, F.lit(0)))

    return let(F.try_variant_get(wrapped, "$", "array<variant>"), first_of_two)


def repaired_json(c: Column) -> Column:
    """Strict JSON, or strict JSON after doubled quotes are undone."""
    return F.coalesce(strict_json(c), F.when(F.contains(c, F.lit('""')), strict_json(
        F.replace(c, F.lit('""'), F.lit('"')))))


def json_cell(c: Column) -> Column:
    """A CSV cell as VARIANT: blank is null, JSON-looking text is parsed, the rest stays as written."""
    s = trim_ws(c)
    looks_json = s.startswith("[") | s.startswith("{")
    return F.when(~is_blank(c), F.when(looks_json, F.coalesce(repaired_json(s), c.cast("variant")))
                  .otherwise(c.cast("variant")))


def finite(c: Column, data_type: T.DataType) -> Column:
    """Replace NaN and infinities by null, through arrays, maps and structs."""
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    if isinstance(data_type, T.ArrayType):
        return F.transform(c, lambda x: finite(x, data_type.elementType))
    if isinstance(data_type, T.MapType):
        return F.transform_values(c, lambda _, v: finite(v, data_type.valueType))
    if isinstance(data_type, T.StructType):
        fields = F.struct(*[finite(c[f.name], f.dataType).alias(f.name) for f in data_type.fields])
        return F.when(c.isNotNull(), fields)
    return c


def text_from_doc(text: Column, doc: Column) -> Column:
    """``text``, or the ``text`` key of the JSON in ``doc`` where ``text`` is blank."""

    def key_text(parsed: Column) -> Column:
        is_string = F.schema_of_variant(F.try_variant_get(parsed, "$.text", "variant")) == "STRING"
        value = F.try_variant_get(parsed, "$.text", "string")
        return F.when(is_string & ~is_blank(value), value)

    as_written, repaired = strict_json(doc), strict_json(F.replace(doc, F.lit('""'), F.lit('"')))
    return F.when(~is_blank(text), text).otherwise(F.coalesce(let(as_written, key_text), let(repaired, key_text)))
