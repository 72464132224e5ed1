"""Filters and projections that prepare records and payloads (DataFrame to DataFrame)."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shardloom.functions.json import finite, json_cell, text_from_doc
from shardloom.functions.rows import only_if
from shardloom.functions.text import is_blank, point_id, trim_ws
from shardloom.functions.vectors import parse_vector

# Fixed value: how spreadsheet exports label a column without a header.
JUNK_PREFIX = "Unnamed:"


def filter_tenant(df: DataFrame, tenant: str, field: str = "org_id", trim: bool = False) -> DataFrame:
    value = F.col(field)
    return df.where((trim_ws(value) if trim else value) == tenant)


def parse_vectors(df: DataFrame, column: str = "embedding", keep_failures: bool = False) -> DataFrame:
    """Parse vector text; rows whose vector is missing, malformed or empty are dropped."""
    parsed = parse_vector(F.col(column))
    return df.withColumn(column, parsed if keep_failures else only_if(parsed, lambda v: F.size(v) > 0))


def drop_blank_text(df: DataFrame, column: str = "text") -> DataFrame:
    return df.where(~is_blank(F.col(column)))


def has_no_header(name: str) -> bool:
    """Columns that carry no name of their own: Spark calls them ``_c<N>``, spreadsheets ``Unnamed: <N>``."""
    return re.fullmatch(rf"\s*|_c\d+|{JUNK_PREFIX}.*", name, re.DOTALL) is not None


def prune_columns(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{name}`") for name in df.columns if not has_no_header(name)])


def prune_payload_keys(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Drop ``Unnamed:`` keys from stored payloads (VARIANT objects or maps)."""
    is_variant = isinstance(df.schema[payload].dataType, T.VariantType)
    entries = F.try_variant_get(payload, "$", "map<string,variant>") if is_variant else F.col(payload)
    kept = F.map_filter(entries, lambda key, _: ~key.startswith(JUNK_PREFIX))
    return df.withColumn(payload, F.to_variant_object(kept) if is_variant else kept)


def payload_object(
    df: DataFrame,
    drop: Sequence[str] = ("embedding",),
    stamp: dict[str, str | Column] | None = None,
) -> Column:
    """One VARIANT object of the kept columns: blank and NaN become null, JSON-looking cells are parsed."""
    fields = []
    for field in df.schema.fields:
        if field.name in drop or field.name in (stamp or {}) or has_no_header(field.name):
            continue
        cell = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.StringType):
            cell = json_cell(cell)
        else:
            cell = finite(cell, field.dataType)
            nested = isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType))
            cell = F.to_variant_object(cell) if nested else cell.cast("variant")
        fields.append(cell.alias(field.name))
    stamped = {key: F.lit(value) if isinstance(value, str) else value for key, value in (stamp or {}).items()}
    fields += [value.cast("variant").alias(key) for key, value in stamped.items()]
    return F.to_variant_object(F.struct(*fields))


def build_payload(df: DataFrame, drop: Sequence[str] = ("embedding",), stamp: dict[str, str] | None = None,
                  name: str = "payload") -> DataFrame:
    return df.withColumn(name, payload_object(df, drop, stamp))


def assign_point_ids(df: DataFrame, uid: str = "uid", ordinal: str = "row_pos", name: str = "point_id") -> DataFrame:
    uid_column = F.col(uid).cast("string") if uid in df.columns else F.lit(None).cast("string")
    return df.withColumn(name, point_id(uid_column, F.col(ordinal)))


def fill_text_from_doc(df: DataFrame, text: str = "text", doc: str = "doc") -> DataFrame:
    """Take the text from the JSON in ``doc`` where it is blank; a table without both columns is left alone."""
    if text not in df.columns or doc not in df.columns:
        return df
    return df.withColumn(text, text_from_doc(F.col(text), F.col(doc)))


def payload_keys(option: str | Sequence[str] | None) -> list[str] | None:
    """The keys of a comma-separated option; None means the whole payload."""
    if option is None:
        return None
    names = option.split(",") if isinstance(option, str) else option
    return [name.strip() for name in names if name.strip()] or None


def project_payload(df: DataFrame, keys: str | Sequence[str] | None, payload: str = "payload") -> DataFrame:
    """Keep only the listed payload keys; keys stored as columns of their own are not read here."""
    wanted = payload_keys(keys)
    if wanted is None:
        return df
    is_variant = isinstance(df.schema[payload].dataType, T.VariantType)
    entries = F.try_variant_get(payload, "$", "map<string,variant>") if is_variant else F.col(payload)
    kept = F.map_filter(entries, lambda key, _: key.isin(*wanted))
    return df.withColumn(payload, F.to_variant_object(kept) if is_variant else kept)


def project_vectors(df: DataFrame, with_vectors: bool, vector: str = "vector") -> DataFrame:
    return df if with_vectors else df.drop(vector)


def match_filter(df: DataFrame, matches: dict[str, str], payload: str = "payload") -> DataFrame:
    """Rows where every key equals its value, read from a column of that name or else from the payload.

    Columns push down to the scan; payload keys do not, so keys that are often filtered belong in columns.
    """
    for key, value in matches.items():
        if key in df.columns:
            df = df.where(F.col(key) == value)
        else:
            df = df.where(F.try_variant_get(payload, f"$['{key}']", "string") == value)
    return df


def stamp_tenant(payload: Column, tenant: Column, field: str = "tenant_name") -> Column:
    """The payload with the tenant under ``field``, where it is an object (or null) without that key."""
    entries = F.coalesce(F.try_variant_get(payload, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    stamped = F.to_variant_object(F.map_concat(entries, F.create_map(F.lit(field), tenant.cast("string").cast("variant"))))
    plain = payload.isNull() | F.schema_of_variant(payload).startswith("OBJECT")
    named = tenant.isNotNull() & F.try_variant_get(payload, f"$['{field}']", "variant").isNull()
    return F.when(plain & named, stamped).otherwise(payload)


def import_tenant(shard_key: str = "shard_key", payload: str = "payload", field: str = "tenant_name") -> Column:
    """The tenant of a backup line: its shard key, else the payload field."""
    return F.coalesce(F.when(F.col(shard_key) != "", F.col(shard_key)),
                      F.try_variant_get(payload, f"$['{field}']", "string"))


def import_tenant_filter(df: DataFrame, tenant: str, field: str = "tenant_name") -> DataFrame:
    """The lines of one tenant, and every line that could not be read: it may be the tenant's too."""
    return df.where((import_tenant(field=field) == tenant) | ~F.col("parsed"))


def sanitize_numbers(df: DataFrame) -> DataFrame:
    """NaN and infinities become null in every column, nested ones included."""
    return df.select(*[finite(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])
