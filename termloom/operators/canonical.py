"""Canonical records: any row becomes an accession and a key-sorted metadata map.

Everything here is a projection. The plan is derived from the schema, so a table of any
width is canonicalised in the scan stage without a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termloom.functions.fixed_values import (
    ACCESSION_COLUMN,
    ACCESSION_FALLBACK_KEYS,
    REPEAT_SEPARATOR,
    UNPREFIXED_COLUMNS,
)
from termloom.functions.render import scalar_text
from termloom.functions.text import is_missing_word, strip_text

_SPLIT_PATTERN = r"\Q" + REPEAT_SEPARATOR + r"\E"
_ENTRIES = "array<struct<key:string,value:string>>"


def _no_entries() -> Column:
    return F.array().cast(_ENTRIES)


def _sub_key(key: Column, sub: Column) -> Column:
    return F.when(key == "", sub).otherwise(F.concat(key, F.lit("."), sub))


def _entries_of(key: Column, value: Column, data_type: T.DataType) -> Column:
    """Leaves below ``value`` as an array of (key, value), in source order."""
    if isinstance(data_type, T.StructType):
        parts = [
            _entries_of(_sub_key(key, F.lit(f.name)), value.getField(f.name), f.dataType) for f in data_type
        ]
        inner = F.concat(*parts) if parts else _no_entries()
        return F.when(value.isNull(), _no_entries()).otherwise(inner)
    if isinstance(data_type, T.MapType):
        return _map_entries_of(key, value, data_type)
    if isinstance(data_type, T.ArrayType):
        return _array_entries_of(key, value, data_type)
    return F.array(F.struct(key.alias("key"), scalar_text(value, data_type).alias("value")))


def _map_entries_of(key: Column, value: Column, data_type: T.MapType) -> Column:
    if isinstance(data_type.keyType, T.StringType):
        def one(entry: Column) -> Column:
            return _entries_of(_sub_key(key, entry["key"]), entry["value"], data_type.valueType)
    else:
        # Keys that are not text carry no path: key and value both count as values.
        def one(entry: Column) -> Column:
            return F.concat(
                _entries_of(key, entry["key"], data_type.keyType),
                _entries_of(key, entry["value"], data_type.valueType),
            )

    return F.coalesce(F.flatten(F.transform(F.map_entries(value), one)), _no_entries())


def _array_entries_of(key: Column, value: Column, data_type: T.ArrayType) -> Column:
    element = data_type.elementType
    plain = F.coalesce(
        F.flatten(F.transform(value, lambda item: _entries_of(key, item, element))), _no_entries()
    )
    is_pair_type = isinstance(element, T.ArrayType) and isinstance(element.elementType, T.StringType)
    if not is_pair_type:
        return plain
    # A non-empty list of two-element text lists reads as key/value pairs.
    all_pairs = (F.size(value) > 0) & F.forall(
        value, lambda p: F.coalesce((F.size(p) == 2) & p[0].isNotNull(), F.lit(False))
    )
    as_map = F.flatten(
        F.transform(value, lambda p: _entries_of(_sub_key(key, F.get(p, 0)), F.get(p, 1), T.StringType()))
    )
    return F.when(F.coalesce(all_pairs, F.lit(False)), as_map).otherwise(plain)


def flatten_columns(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """All leaves of the row as (key, value) entries, in column order."""
    chosen = set(columns) if columns is not None else None
    parts = []
    for field in df.schema:
        if chosen is not None and field.name not in chosen:
            continue
        prefix = "" if field.name in UNPREFIXED_COLUMNS else field.name
        parts.append(_entries_of(F.lit(prefix), F.col(f"`{field.name}`"), field.dataType))
    entries = F.concat(*parts) if parts else _no_entries()
    return F.filter(entries, lambda e: (e["key"] != "") & e["value"].isNotNull())


def _fixed_leaves(prefix: str, value: Column, data_type: T.DataType) -> list[tuple[str, Column]] | None:
    """Leaves whose keys follow from the schema alone, or None below a map or an array."""
    if isinstance(data_type, (T.MapType, T.ArrayType)):
        return None
    if not isinstance(data_type, T.StructType):
        return [(prefix, scalar_text(value, data_type))]
    leaves: list[tuple[str, Column]] = []
    for field in data_type:
        key = f"{prefix}.{field.name}" if prefix else field.name
        inner = _fixed_leaves(key, value.getField(field.name), field.dataType)
        if inner is None:
            return None
        leaves += inner
    return leaves


def fixed_leaves(df: DataFrame, columns: Sequence[str]) -> list[tuple[str, Column]] | None:
    """Keys in order with their texts when the schema fixes all keys and none occurs twice.

    Then nothing has to be merged or sorted per row. None for any other schema.
    """
    leaves: list[tuple[str, Column]] = []
    for field in df.schema:
        if field.name in set(columns):
            prefix = "" if field.name in UNPREFIXED_COLUMNS else field.name
            inner = _fixed_leaves(prefix, F.col(f"`{field.name}`"), field.dataType)
            if inner is None:
                return None
            leaves += [(key, text) for key, text in inner if key]
    keys = [key for key, _ in leaves]
    if len(set(keys)) < len(keys):
        return None
    return sorted(leaves, key=lambda leaf: leaf[0])


def append_value(kept: Column, value: Column) -> Column:
    """Join ``value`` to ``kept`` unless it is already one of its parts."""
    seen = F.array_contains(F.split(kept, _SPLIT_PATTERN), value)
    return (
        F.when(kept.isNull(), value)
        .when(seen, kept)
        .otherwise(F.concat(kept, F.lit(REPEAT_SEPARATOR), value))
    )


def merge_values(values: Column) -> Column:
    """Fold an ordered array of values of one key into one text."""
    return F.aggregate(values, F.lit(None).cast("string"), append_value)


def merge_repeated(entries: Column) -> Column:
    """One entry per key, sorted by key; repeated keys are folded in source order.

    Rows without a repeated key, the usual case, only pay for the sort.
    """
    def merged(entries: Column, distinct_keys: Column) -> Column:
        def folded(key: Column) -> Column:
            values = F.transform(F.filter(entries, lambda e: e["key"] == key), lambda e: e["value"])
            return F.struct(key.alias("key"), merge_values(values).alias("value"))

        return F.when(F.size(entries) == F.size(distinct_keys), entries).otherwise(F.transform(distinct_keys, folded))

    # Bound by lambda functions, so that entries and keys are made once however often they are read.
    bound = F.transform(
        F.array(entries), lambda es: F.get(F.transform(F.array(F.array_distinct(es["key"])), lambda keys: merged(es, keys)), F.lit(0))
    )
    return F.array_sort(F.get(bound, F.lit(0)))


def resolve_accession(column: Column | None, metadata: Column) -> Column:
    """The structural accession first, then the metadata keys that may carry one."""
    choices = [] if column is None else [F.nullif(column, F.lit(""))]
    choices += [F.nullif(F.try_element_at(metadata, F.lit(k)), F.lit("")) for k in ACCESSION_FALLBACK_KEYS]
    return F.coalesce(*choices)


def canonicalise(
    df: DataFrame, keep: Sequence[str] = (), columns: Sequence[str] | None = None
) -> DataFrame:
    """``accession`` and ``metadata`` of every row, after the passed-through ``keep`` columns.

    Columns named in ``keep`` are not metadata unless ``columns`` lists them.
    """
    if columns is None:
        columns = [c for c in df.columns if c not in set(keep)]
    accession_type = next((f.dataType for f in df.schema if f.name == ACCESSION_COLUMN), None)
    structural = None
    if accession_type is not None and not isinstance(accession_type, (T.StructType, T.MapType, T.ArrayType)):
        structural = scalar_text(F.col(ACCESSION_COLUMN), accession_type)
    kept = [F.col(f"`{c}`") for c in keep]
    fixed = fixed_leaves(df, columns)
    if fixed is not None:
        # Texts are made in a step of their own: below, in a lambda function, Spark would interpret them.
        texts = df.select(
            *kept,
            (F.lit(None).cast("string") if structural is None else structural).alias("__accession"),
            *[text.alias(f"__text{i}") for i, (_, text) in enumerate(fixed)],
        )
        entries = [
            F.when(F.col(f"__text{i}").isNotNull(), F.struct(F.lit(key).alias("key"), F.col(f"__text{i}").alias("value")))
            for i, (key, _) in enumerate(fixed)
        ]
        merged = F.map_from_entries(F.array_compact(F.array(*entries)) if entries else _no_entries())
        staged = texts.select(*kept, "__accession", merged.alias("__merged"))
        return _resolved(staged, F.col("__accession"), keep)
    staged = df.select(
        *kept,
        (F.lit(None).cast("string") if structural is None else structural).alias("__accession"),
        flatten_columns(df, columns).alias("__entries"),
    )
    return canonicalise_entries(staged, F.col("__entries"), F.col("__accession"), keep)


def canonicalise_entries(
    df: DataFrame, entries: Column, accession: Column | None, keep: Sequence[str] = ()
) -> DataFrame:
    """Shared tail of all record sources: merge, sort, resolve the accession."""
    # The entries are named once so that the merge reads a column, not the flattening again.
    staged = df.withColumn("__merged", F.map_from_entries(merge_repeated(entries)))
    return _resolved(staged, accession, keep)


def _resolved(staged: DataFrame, accession: Column | None, keep: Sequence[str]) -> DataFrame:
    return staged.select(
        *[F.col(f"`{c}`") for c in keep],
        resolve_accession(accession, F.col("__merged")).alias("accession"),
        F.col("__merged").alias("metadata"),
    )


def metadata_entries(records: DataFrame, *id_columns: str) -> DataFrame:
    """Long form: one row per record and key.

    Spark infers a filter on the size of what a plain ``explode`` reads and pushes it below the projections, where
    it makes every map again, several times over. The outer form has no such filter; its rows without a key leave.
    """
    return records.select(*id_columns, F.explode_outer("metadata").alias("key", "value")).filter(F.col("key").isNotNull())


def count_nonempty(metadata: Column | str = "metadata") -> Column:
    return F.size(metadata)


def at_least_fields(records: DataFrame, threshold: int) -> DataFrame:
    """Records with at least ``threshold`` metadata keys."""
    if threshold < 0:
        raise ValueError("The threshold must not be negative")
    return records.filter(count_nonempty() >= threshold) if threshold else records


def select_fields(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The listed columns in the listed order; missing names are reported together."""
    missing = [f for f in fields if f not in df.columns]
    if missing:
        raise ValueError(f"Missing requested fields: {', '.join(missing)}")
    return df.select(*[F.col(f"`{f}`") for f in fields])


def fields_to_metadata(df: DataFrame, fields: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """All-text columns as a metadata map in field order, nothing dropped."""
    select_fields(df, fields)
    pairs = [F.struct(F.lit(f).alias("key"), F.col(f"`{f}`").cast("string").alias("value")) for f in fields]
    return df.select(*[F.col(f"`{c}`") for c in keep], F.map_from_entries(F.array(*pairs)).alias("metadata"))


def record_to_text(metadata: Column | str = "metadata") -> Column:
    """``key=value`` lines in record order, without null, blank and missing-word values."""
    stripped = F.transform(
        F.map_entries(metadata),
        lambda e: F.struct(e["key"].alias("key"), strip_text(e["value"]).alias("value")),
    )
    kept = F.filter(stripped, lambda e: ~F.coalesce(is_missing_word(e["value"]), F.lit(True)))
    return F.array_join(F.transform(kept, lambda e: F.concat(e["key"], F.lit("="), e["value"])), "\n")


def missing_accession_count(records: DataFrame) -> DataFrame:
    missing = F.coalesce(F.col("accession"), F.lit("")) == ""
    return records.agg(F.count_if(missing).alias("missing_accessions"))
