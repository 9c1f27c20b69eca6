"""JSON answers against a definition's schema, then against the declared kinds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.definition import Definition, FieldSpec
from docsieve.functions.values import norm_by_kind, normalize_record

_KIND_ERRORS = {"date": "unparseable date", "money": "unparseable amount", "quantity": "unparseable amount", "rate": "unparseable rate"}


def _error(path: str, message: Column | str, when: Column, family: str = "ValidationError") -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    return F.when(when, F.concat(F.lit(f"{family}: {path}: "), text))



def _unreadable(column: FieldSpec):
    return lambda row: row[column.name].isNotNull() & norm_by_kind(row[column.name], column.kind).isNull()


def _listed(keys: Column) -> Column:
    names = F.array_join(F.transform(F.array_sort(keys), lambda k: F.concat(F.lit("'"), k, F.lit("'"))), ", ")
    return F.concat(F.lit("additional properties are not allowed ("), names, F.lit(")"))


def _sound(items: dict, spec: FieldSpec, shape: Column, rows: Column) -> Column:
    """Whether the shape of a table and its cells, read as text, already show that no row has an error. It may be false without one."""
    props = items.get("properties", {})
    read_as_text = set(props) <= {c.name for c in spec.columns.values()} and all(p.get("type") == "string" for p in props.values())
    if not props or not read_as_text or not set(items.get("required", [])) <= set(props):
        return F.lit(False)
    # rows are merged in a shape, so that it hides what is missing from some of them; as text that is NULL
    declared = f"ARRAY<OBJECT<{', '.join(f'{p}: STRING' for p in sorted(props))}>>"
    gaps = F.exists(rows, lambda row: reduce(lambda a, p: a | row[p].isNull(), props, F.lit(False)))
    return F.coalesce((shape == declared) & ~gaps, F.lit(False))


def _row_errors(name: str, items: dict, cell: Column) -> Column:
    """Errors of the rows of a table (a variant), row by row: its type, undeclared and missing columns, types of cells."""
    props = items.get("properties", {})

    def of_row(row: Column, at: Column) -> Column:
        path = F.concat(F.lit(f"ValidationError: {name}/"), at.cast("string"))
        whole = F.startswith(F.schema_of_variant(row), F.lit("OBJECT"))
        cells = F.try_variant_get(row, "$", "map<string,variant>")
        keys = F.coalesce(F.map_keys(cells), F.array().cast("array<string>"))
        checks = [F.when(~whole, F.concat(path, F.lit(": not of type 'object'")))]
        if items.get("additionalProperties") is False:
            extra = F.array_except(keys, F.array(*[F.lit(p) for p in props]))
            checks.append(F.when(whole & (F.size(extra) > 0), F.concat(path, F.lit(": "), _listed(extra))))
        for column in items.get("required", []):
            checks.append(F.when(whole & ~F.array_contains(keys, column), F.concat(path, F.lit(f": '{column}' is a required property"))))
        for column, prop in props.items():
            value = F.try_element_at(cells, F.lit(column))
            wrong = whole & F.array_contains(keys, column) & (F.schema_of_variant(value) != "STRING")
            if prop.get("type") == "string":
                checks.append(F.when(wrong, F.concat(path, F.lit(f"/{column}: not of type 'string'"))))
        return F.array_compact(F.array(*checks))

    rows = F.try_variant_get(cell, "$", "array<variant>")
    return F.coalesce(F.flatten(F.transform(rows, of_row)), F.array().cast("array<string>"))


def validate_payload(df: DataFrame, definition: Definition, payload: str = "payload") -> DataFrame:
    """Add `errors` (empty when valid) and `record` (NULL when not).

    Shape errors come first: not an object, undeclared or missing properties,
    wrong types, enum values and empty strings; then the same inside each row of a table,
    with the row's position in the path; then values that cannot be read.
    """
    schema = definition.schema
    props, required = schema.get("properties", {}), schema.get("required", [])
    text = F.col(payload)
    # parsed twice: into a variant, which properties and types are told by, and into the declared columns as text
    out = df.withColumn("_parsed", F.try_parse_json(text)).withColumns(
        {
            "_raw": F.from_json(text, definition.record_type(raw=True)),
            "_cells": F.try_variant_get("_parsed", "$", "map<string,variant>"),
        }
    )
    shapes = {f"_shape_{name}": F.schema_of_variant(F.try_element_at("_cells", F.lit(name))) for name in props}
    out = out.withColumns({"_keys": F.map_keys("_cells"), **shapes})
    raw, cells = F.col("_raw"), F.col("_cells")
    known = F.array(*[F.lit(p) for p in props])
    extra = F.array_except("_keys", known)
    checks, row_checks = [], []
    if schema.get("additionalProperties") is False:
        checks.append(_error("<root>", _listed(extra), F.size(extra) > 0))
    for name in required:
        checks.append(_error("<root>", f"'{name}' is a required property", ~F.array_contains("_keys", name)))
    for name, prop in props.items():
        has = F.array_contains("_keys", name)
        kind = F.col(f"_shape_{name}")
        if prop["type"] == "string":
            wrong = has & (kind != "STRING")
            checks.append(_error(name, "not of type 'string'", wrong))
            value = raw[name]
            if "enum" in prop:
                message = F.concat(F.lit("'"), value, F.lit("' is not one of the allowed values"))
                checks.append(_error(name, message, has & ~wrong & ~value.isin(*prop["enum"])))
            if prop.get("minLength"):
                checks.append(_error(name, "'' should be non-empty", has & ~wrong & (F.length(value) < prop["minLength"])))
        elif prop["type"] == "array":
            checks.append(_error(name, "not of type 'array'", has & ~F.startswith(kind, F.lit("ARRAY"))))
            if prop.get("items", {}).get("type") == "object":
                errors = _row_errors(name, prop["items"], F.try_element_at(cells, F.lit(name)))
                row_checks.append(F.when(_sound(prop["items"], definition.fields[name], kind, raw[name]), F.array().cast("array<string>")).otherwise(errors))
    shape_checks, checks = checks, []
    for name, spec in definition.fields.items():
        if spec.kind in _KIND_ERRORS:
            unread = raw[name].isNotNull() & norm_by_kind(raw[name], spec.kind).isNull()
            checks.append(_error(name, _KIND_ERRORS[spec.kind], unread, "ValueError"))
        elif spec.kind == "table":
            for column in spec.columns.values():
                if column.kind in _KIND_ERRORS:
                    unread = F.exists(raw[name], _unreadable(column))
                    checks.append(_error(f"{name}/{column.name}", _KIND_ERRORS[column.kind], unread, "ValueError"))
    shape = F.when(F.col("_keys").isNull(), F.array(F.lit("ValidationError: <root>: not a JSON object"))).otherwise(
        F.concat(F.array_compact(F.array(*shape_checks)), *row_checks, F.array_compact(F.array(*checks)))
    )
    out = out.withColumn("errors", shape)
    record = F.when(F.size("errors") == 0, normalize_record(raw, definition))
    return out.withColumn("record", record).drop("_parsed", "_keys", "_raw", "_cells", *[f"_shape_{name}" for name in props])
