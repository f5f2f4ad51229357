"""Deeply nested records as flat related tables.

``nested_tables`` walks a DataFrame's merged schema and explodes each array of
structs into a child table that carries the parent's surrogate key and the
array ordinal. ``parse_merged`` brings JSON text of varying shape under one
merged schema first. Everything is row-local: no table is shuffled, and a
record's children stay in the task that holds the record.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _records(kind: T.DataType) -> bool:
    return isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.ArrayType))


def _flat_fields(schema: T.StructType, at: Column | None = None, prefix: str = "") -> list[tuple[str, Column, T.DataType]]:
    """Name, expression and type of each leaf; structs are opened, arrays of records are kept as they are."""
    found: list[tuple[str, Column, T.DataType]] = []
    for field in schema.fields:
        col = F.col(_quoted(field.name)) if at is None else at.getField(field.name)
        name = f"{prefix}{field.name}"
        if isinstance(field.dataType, T.StructType):
            found += _flat_fields(field.dataType, col, f"{name}_")
        else:
            found.append((name, col, field.dataType))
    return found


def _unique(names: list[str], taken: set[str]) -> list[str]:
    """Names without clashes, also in other case: a clash gets ``_2``, ``_3`` and so on."""
    out: list[str] = []
    for name in names:
        base, k = name, 2
        while name.lower() in taken:
            name, k = f"{base}_{k}", k + 1
        taken.add(name.lower())
        out.append(name)
    return out


def _level(df: DataFrame, record: Column | None, schema: T.StructType, keys: list[Column], handed: list[str] = []) -> tuple[DataFrame, list[tuple[str, str, T.DataType]]]:
    fields = _flat_fields(schema, record)
    names = _unique([n for n, _, _ in fields], {"_sk", "_parent_sk", "_ordinal", *(h.lower() for h in handed)})
    flat = df.select(*keys, *[col.alias(name) for name, (_, col, _) in zip(names, fields)])
    return flat, [(path, name, kind) for name, (path, _, kind) in zip(names, fields) if _records(kind)]


def nested_tables(df: DataFrame, key: Column, name: str = "root", carry: dict[str, dict[str, str]] | None = None) -> dict[str, DataFrame]:
    """Flat tables of ``df``, by path: ``root``, ``root.annotations``, ``root.annotations.result`` and so on.

    ``key`` is a row's surrogate key as text and must be unique (deduplicate
    re-delivered rows before). Each table has ``_sk``; child tables also
    ``_parent_sk`` and ``_ordinal``, the place in the parent's array from 0. A
    child's ``_sk`` is its parent's, a stroke and the ordinal, so it is unique
    without counting and the same in every run. Structs become columns joined
    with ``_``; arrays of scalars and maps stay columns; arrays of arrays become
    a child table of their own. Names that clash get a number. Null and empty
    arrays give no child rows; a null element gives a row of nulls, so that
    ordinals agree with the stored order. Null keys stay null.

    ``carry`` names, by path, columns that all descendants get as well, and the
    names they get there, so that they need no join with their ancestors.
    """
    carry = carry or {}
    flat, arrays = _level(df, None, df.schema, [key.cast("string").alias("_sk")])
    tables = {name: flat.drop(*[column for _, column, _ in arrays])}
    todo = [(name, f"{name}.{path}", flat, column, kind, []) for path, column, kind in arrays]
    while todo:
        above, path, parent, column, kind, handed = todo.pop(0)
        new = carry.get(above, {})
        kept = [F.col(_quoted(c)) for c in handed] + [F.col(_quoted(c)).alias(as_) for c, as_ in new.items()]
        handed = [*handed, *new.values()]
        children = parent.select(F.col("_sk").alias("_parent_sk"), *kept, F.posexplode(F.col(_quoted(column))).alias("_ordinal", "_record"))
        children = children.withColumn("_sk", F.concat_ws("/", "_parent_sk", F.col("_ordinal")))
        element = kind.elementType
        if isinstance(element, T.ArrayType):
            element = T.StructType([T.StructField("items", element)])
            children = children.withColumn("_record", F.struct(F.col("_record").alias("items")))
        flat, arrays = _level(children, F.col("_record"), element, [F.col(_quoted(c)) for c in ("_sk", "_parent_sk", "_ordinal", *handed)], handed)
        tables[path] = flat.drop(*[c for _, c, _ in arrays])
        todo += [(path, f"{path}.{p}", flat, c, k, handed) for p, c, k in arrays]
    return tables


def _let(value: str, body: str) -> str:
    """SQL: ``body`` over ``_v``, with ``value`` computed once (a lambda binds it; a plain column would be inlined at each use)."""
    return f"get(transform(array({value}), _v -> {body}), 0)"


_LIST = "try_variant_get(_v, '$', 'array<variant>')"
_OBJECT = "try_variant_get(_v, '$', 'map<string, variant>')"
_DECODED = f"CASE WHEN {_LIST} IS NULL AND {_OBJECT} IS NULL THEN try_parse_json(try_variant_get(_v, '$', 'string')) ELSE _v END"


def json_records(df: DataFrame, column: str, path: list[str], out: str = "records", depth: int = 2) -> DataFrame:
    """Add ``out``: ARRAY<VARIANT> of the records that JSON text holds at ``path``, in stored order.

    Text encoded as a JSON string inside JSON is decoded on the way, up to
    ``depth`` times at each step; a single object counts as a list of one.
    Null, malformed or absent JSON gives an empty array.
    """
    value = f"try_parse_json({_quoted(column)})"
    for name in [None, *path]:
        if name is not None:
            value = _let(value, f"try_variant_get(_v, '$.{name}', 'variant')")
        for _ in range(depth):
            value = _let(value, _DECODED)
    return df.withColumn(out, F.expr(f"coalesce({_let(value, f'coalesce({_LIST}, IF({_OBJECT} IS NOT NULL, array(_v), NULL))')}, array())"))


def _to_ddl(shape: str) -> str:
    """DDL of a variant's schema: objects become structs, decimals doubles; what the rows disagree on stays VARIANT."""
    return re.sub(r"DECIMAL\(\d+,\d+\)", "DOUBLE", shape.replace("OBJECT<", "STRUCT<").replace("VOID", "STRING"))


def merged_type(df: DataFrame, records: str) -> str:
    """DDL of the merged schema of all records of all rows: one aggregate, combined before the shuffle."""
    row = df.select(F.explode(records).alias("_r")).agg(F.expr("schema_of_variant_agg(_r)").alias("shape")).first()
    return _to_ddl(row["shape"] if row and row["shape"] and row["shape"].startswith("OBJECT") else "OBJECT<>")


def parse_merged(df: DataFrame, column: str, path: list[str], out: str = "records", shapes: DataFrame | None = None) -> DataFrame:
    """Add ``out``: ARRAY<STRUCT> of the records at ``path`` of JSON text, under the merged schema of all rows.

    ``shapes`` may have the same texts from where they are cheaper to read, as
    before copies were taken out.

    Fields that one export lacks are null; fields whose type differs between
    exports stay VARIANT. If no row has a record, the struct has one null field
    ``empty``.
    """
    found = json_records(df, column, path, out)
    ddl = merged_type(found if shapes is None else json_records(shapes, column, path, out), out)
    if ddl == "STRUCT<>":
        ddl = "STRUCT<empty: STRING>"
    return found.withColumn(out, F.expr(f"transform({_quoted(out)}, r -> try_variant_get(r, '$', '{ddl}'))"))


def ungroup(df: DataFrame, column: str, inner: str, inherit: list[str]) -> DataFrame:
    """Replace each group in an array of records by its members, in stored order, within the row.

    A group is an element whose ``inner`` is an array, or that has no field
    set but those of ``inherit``. Members take the ``inherit`` fields from
    their group where they lack them. So the ordinal of :func:`nested_tables`
    is the place among all records. Fields whose type differs between groups and
    members become text. Without a field ``inner`` nothing changes.
    """
    element = df.schema[column].dataType.elementType
    if inner not in element.fieldNames():
        return df
    member_type = element[inner].dataType
    if not (isinstance(member_type, T.ArrayType) and isinstance(member_type.elementType, T.StructType)):
        return df
    own, theirs = ({f.name: f.dataType for f in t.fields} for t in (element, member_type.elementType))
    del own[inner]
    names = [*own, *[n for n in theirs if n not in own]]
    kinds = {n: own.get(n, theirs.get(n)) if own.get(n, theirs.get(n)) == theirs.get(n, own.get(n)) else T.StringType() for n in names}

    def fields(record: Column, have: dict, group: Column | None) -> Column:
        out = []
        for n in names:
            value = record.getField(n).cast(kinds[n]) if n in have else F.lit(None).cast(kinds[n])
            if group is not None and n in inherit and n in own:
                value = F.coalesce(value, group.getField(n).cast(kinds[n]))
            out.append(value.alias(n))
        return F.struct(*out)

    def members(e: Column) -> Column:
        bare = e.isNotNull()
        for n in own:
            bare = bare & (e.getField(n).isNotNull() if n in inherit else e.getField(n).isNull())
        empty = F.array().cast(T.ArrayType(T.StructType([T.StructField(n, kinds[n]) for n in names])))
        return (
            F.when(e.getField(inner).isNotNull(), F.transform(e.getField(inner), lambda m: fields(m, theirs, e)))
            .when(bare, empty)
            .otherwise(F.array(fields(e, own, None)))
        )

    return df.withColumn(column, F.flatten(F.transform(F.col(_quoted(column)), members)))
