"""Nested JSON whose fields differ in type from record to record (Spark's VARIANT).

``files.json_flatten`` needs one schema for all records. Here each record is
parsed into a variant, which keeps its own types: a field may be a number in
one record, text or an object in the next, a list of records may be a single
record or a scalar, and a field that is missing is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ENTRIES = "map<string,variant>"
_ITEMS = "array<variant>"
# types a column keeps if all its values have it; whole numbers count as BIGINT
_TYPES = {"BIGINT": "bigint", "DOUBLE": "double", "BOOLEAN": "boolean", "STRING": "string"}
_DECIMAL = "DECIMAL("


def read_variant_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row a line of JSON text: ``record``, a variant; null where the line is no JSON."""
    return spark.read.text(path).select(F.try_parse_json("value").alias("record"))


def _step(name: str) -> str:
    """A key of an object as a step of a variant path."""
    if '"' not in name:
        return f'["{name}"]'
    if "'" not in name:
        return f"['{name}']"
    raise ValueError(f"a field name with both kinds of quotes has no path: {name}")


def _path(names: list[str]) -> str:
    return "$" + "".join(_step(n) for n in names)


def _names(path: str | list[str]) -> list[str]:
    return list(path) if isinstance(path, (list, tuple)) else path.split(".")


def is_null(v: Column) -> Column:
    """Missing, or JSON's null."""
    return v.isNull() | F.is_variant_null(v)


def items_of(record: Column, path: list[str]) -> Column:
    """The elements at ``path`` as an array of variants; anything but a list counts as a list of one.

    Missing and null give no elements, as an empty list does.
    """
    at = F.try_variant_get(record, _path(path), "variant")
    return F.when(is_null(at), F.array().cast(_ITEMS)) \
        .otherwise(F.coalesce(F.try_variant_get(at, "$", _ITEMS), F.array(at)))


def leaf_types(records: DataFrame, column: str) -> dict[tuple[str, ...], str]:
    """Path of every leaf in the variants of a column, with the type its values share (else string).

    A leaf is a value that is no object, or an empty one; lists are leaves. A job a level of
    nesting; what reaches the driver is a row a distinct path, the width of the result.
    A path that holds only nulls is text.
    """
    found: dict[tuple[str, ...], str] = {}
    level = records.select(F.array().cast("array<string>").alias("path"), F.col(column).alias("v"))
    while True:
        entries = level.select("path", F.try_variant_get("v", "$", _ENTRIES).alias("m")).where(F.size("m") > 0)
        level = entries.select("path", F.explode("m").alias("k", "v")) \
            .select(F.concat("path", F.array("k")).alias("path"), "v")
        inner = F.size(F.try_variant_get("v", "$", _ENTRIES)) > 0
        rows = level.groupBy("path").agg(
            F.schema_of_variant_agg(F.when(~F.coalesce(inner, F.lit(False)), F.col("v"))).alias("type"),
            F.count(F.when(~F.coalesce(inner, F.lit(False)), 1)).alias("leaves"),
            F.count(F.when(inner, 1)).alias("objects")).collect()
        for r in rows:
            if r["leaves"]:
                t = r["type"]
                found[tuple(r["path"])] = _TYPES.get(t) or (t.lower() if t.startswith(_DECIMAL) else "string")
        if not any(r["objects"] for r in rows):
            return found
        level = level.where(inner)


def _value(v: Column, dtype: str) -> Column:
    """A leaf; an object in its place is null (its own fields have columns)."""
    inner = F.size(F.try_variant_get(v, "$", _ENTRIES)) > 0
    return F.when(~F.coalesce(inner, F.lit(False)) & ~F.is_variant_null(v), F.try_variant_get(v, "$", dtype))


def variant_flatten(df: DataFrame, column: str = "record", record_path: str | list[str] | None = None,
                    meta: list[str | list[str]] | None = None,
                    fields: dict[str, str] | None = None, scalar_name: str = "0") -> DataFrame:
    """``json_normalize`` over a variant column whose records differ in shape.

    Without ``record_path`` there is one row a record; with it one row per element at that
    path, where a single record or a scalar counts as a list of one and a
    missing, null or empty list gives no row. An object's leaves become columns
    named ``a.b``; an element that is no object goes to the column
    ``scalar_name``. ``fields`` maps the flat names wanted to types (no
    discovery pass then; a value that doesn't convert is null), else every leaf found in any
    record is a column, of the type its values share or text. Lists
    stay whole, as JSON text. ``meta`` paths follow, as text; missing ones
    are null, and an object is its JSON text.

    Null records and texts that were no JSON give no row.
    """
    rows = df.where(F.col(column).isNotNull())
    metas = [_names(m) for m in (meta or [])]
    keep = [F.try_variant_get(column, _path(m), "string").alias(f"_meta{i}") for i, m in enumerate(metas)]
    if record_path is None:
        recs = rows.select(F.col(column).alias("_rec"), *keep)
    else:
        recs = rows.select(F.explode(items_of(F.col(column), _names(record_path))).alias("_rec"), *keep)
    is_object = F.try_variant_get("_rec", "$", _ENTRIES).isNotNull()
    if fields is None:
        leaves = leaf_types(recs, "_rec")
        others = recs.where(~is_object & ~F.is_variant_null("_rec")) \
            .agg(F.schema_of_variant_agg("_rec").alias("t"), F.count("_rec").alias("n")).first()
        scalar = None
        if others["n"]:
            t = others["t"]
            scalar = _TYPES.get(t) or (t.lower() if t.startswith(_DECIMAL) else "string")
        wanted = [(".".join(p), list(p), leaves[p]) for p in sorted(leaves)]
    else:
        scalar = fields.get(scalar_name)
        wanted = [(n, n.split("."), t) for n, t in fields.items() if n != scalar_name]
    cols = [_value(F.try_variant_get("_rec", _path(p), "variant"), t).alias(n) for n, p, t in wanted]
    if scalar:
        cols.append(F.when(~is_object, F.try_variant_get("_rec", "$", scalar)).alias(scalar_name))
    return recs.select(*cols, *[F.col(f"_meta{i}").alias(".".join(m)) for i, m in enumerate(metas)])
