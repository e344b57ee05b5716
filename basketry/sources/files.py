"""File sources and sinks: CSV, nested JSON, landed Parquet, summaries.

The reference pulls JSON pages from a web service into memory. Here the same
data is *landed* as files in shared storage and read back with Spark, so the
date / customer / price-level parameters become predicates that reach the
Parquet scan (row-group statistics, partition pruning).
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.functions.quantiles import exact_quantiles_multi
from basketry.schemas import require_columns
from basketry.session import app_id, scratch_path
from basketry.sources.csv_ranges import read_text_columns

# RFC 4180: quotes are doubled, a quoted value may hold separators and line ends.
# An empty field is null, a quoted empty one is the empty string.
_CSV = {"header": "true", "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false",
        "ignoreTrailingWhiteSpace": "false"}
CSV_WRITE = _CSV | {"nullValue": "", "emptyValue": '""', "lineSep": "\n"}
_NULL = "\u0001null\u0001"      # what the reader puts for an empty field
CSV_READ = _CSV | {"nullValue": _NULL, "emptyValue": "", "multiLine": "true"}

_LANDED: dict[tuple, str] = {}


# -- CSV ---------------------------------------------------------------------

def csv_sink(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Write a headered CSV folder (one file per task; parents are created)."""
    df.write.mode(mode).options(**CSV_WRITE).csv(path)
    return path


def csv_scan(spark: SparkSession, path: str, schema: T.StructType | None = None, ranges: bool = True) -> DataFrame:
    """Read headered CSV files; with no schema the types are inferred (one extra pass).

    With a schema the columns are found by their names in the header, in any
    order; a value that doesn't parse is null, a missing column an error.
    Values may hold line ends; files are still read in ranges (``csv_ranges``),
    so a large file takes many tasks. ``ranges=False`` reads each file in one
    task, by Spark's multi-line parser.
    """
    if schema is None:
        return spark.read.options(**CSV_READ).option("inferSchema", "true").csv(path)
    text = require_columns(spark.read.options(**CSV_READ).csv(path), schema.names)
    if ranges:
        text = read_text_columns(spark, path, text.columns, CSV_READ)
    return text.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema.fields])


# -- nested JSON -------------------------------------------------------------

def _leaf_columns(dtype: T.StructType, path: str = "", name: str = "") -> list[tuple[str, str]]:
    """(path for ``col()``, flat ``a.b`` name) of every leaf; arrays stay whole."""
    out = []
    for f in dtype.fields:
        p = f"`{f.name}`" if not path else f"{path}.`{f.name}`"
        n = f.name if not name else f"{name}.{f.name}"
        if isinstance(f.dataType, T.StructType):
            out += _leaf_columns(f.dataType, p, n)
        else:
            out.append((p, n))
    return out


def flatten(df: DataFrame) -> DataFrame:
    """Struct fields become top-level columns named ``a.b``; arrays are kept."""
    return df.select(*[F.col(p).alias(n) for p, n in _leaf_columns(df.schema)])


def _meta_col(df: DataFrame, path: str):
    try:
        df.select(F.col(path))          # resolves nested paths such as a.b
        return F.col(path)
    except Exception:                   # missing meta -> null, like errors="ignore"
        return F.lit(None).cast("string")


def json_flatten(df: DataFrame, record_path: str | None = None,
                 meta: list[str | list[str]] | None = None) -> DataFrame:
    """``json_normalize``: flatten structs; with ``record_path`` one row per
    element of that array (empty or missing arrays give no row), the record's
    fields first, then each ``meta`` path (missing ones are null)."""
    if record_path is None:
        return flatten(df)
    meta_paths = [".".join(m) if isinstance(m, (list, tuple)) else m for m in (meta or [])]
    exploded = df.select(F.explode(F.col(record_path)).alias("_rec"),
                         *[_meta_col(df, p).alias(f"_meta{i}") for i, p in enumerate(meta_paths)])
    rec_type = exploded.schema["_rec"].dataType
    leaves = (_leaf_columns(rec_type, "`_rec`") if isinstance(rec_type, T.StructType)
              else [("`_rec`", "0")])
    return exploded.select(*[F.col(p).alias(n) for p, n in leaves],
                           *[F.col(f"_meta{i}").alias(p) for i, p in enumerate(meta_paths)])


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None,
              multi_line: bool = False) -> DataFrame:
    reader = spark.read.option("multiLine", str(multi_line).lower())
    return (reader.schema(schema) if schema is not None else reader).json(path)


# -- landed tables -----------------------------------------------------------

def land(spark: SparkSession, df: DataFrame, name: str, key: tuple,
         partition_by: list[str] | None = None) -> str:
    """Write ``df`` once per session as Parquet under the checkpoint folder."""
    k = (app_id(spark), name) + tuple(key)
    if k not in _LANDED:
        path = scratch_path(spark, f"landed-{name}")
        w = df.write.mode("overwrite")
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.parquet(path)
        _LANDED[k] = path
    return _LANDED[k]


def orders_source(spark: SparkSession, path: str, start: str | None = None,
                  end: str | None = None, column: str = "periodStart") -> DataFrame:
    """Landed order items limited to ``[start, end]`` (inclusive, pushed down)."""
    df = spark.read.parquet(path)
    if start:
        df = df.where(F.col(column) >= F.lit(start).cast("date"))
    if end:
        df = df.where(F.col(column) <= F.lit(end).cast("date"))
    return df


def customers_source(spark: SparkSession, path: str, last_order_after: str | None = None) -> DataFrame:
    """Landed customers whose last order is after the given date (None: all)."""
    df = spark.read.parquet(path)
    if last_order_after:
        df = df.where(F.col("lastOrder") > F.lit(last_order_after).cast("timestamp"))
    return df


def price_levels_source(spark: SparkSession, path: str) -> DataFrame:
    from basketry.schemas import PRICE_LEVELS
    return spark.read.schema(PRICE_LEVELS).parquet(path)


def availability_source(spark: SparkSession, path: str, levels: DataFrame,
                        price_level_id: int | None = None) -> DataFrame:
    """Availability of one price level from a folder partitioned by ``priceLevel``.

    0 or None selects the default level, resolved by a semi join against the
    (tiny) price level table; Spark prunes partitions dynamically for it.
    """
    df = spark.read.parquet(path)
    if price_level_id:
        return df.where(F.col("priceLevel") == F.lit(int(price_level_id)))
    default = levels.where(F.col("default")).select(F.col("id").alias("priceLevel"))
    return df.join(default, "priceLevel", "left_semi")


# -- previews and summaries -----------------------------------------------------

def preview(df: DataFrame, n: int = 5, order_by: list[str] | None = None) -> DataFrame:
    """First ``n`` rows by a key (a distributed top-n, not a full sort)."""
    return df.orderBy(*(order_by or df.columns[:1])).limit(n)


def describe_types(df: DataFrame) -> DataFrame:
    """(column, type, non_null): the type of each column and how many rows have a value."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)])
    rows = [F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.col(f"c{i}").alias("non_null"))
            for i, (c, t) in enumerate(df.dtypes)]
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
            T.DecimalType)
_LIMB = 2 ** 32


def _scale(t: T.DataType) -> int | None:
    """Digits after the point of whole numbers and decimals of up to 18 digits, whose sums are exact."""
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return 0
    return t.scale if isinstance(t, T.DecimalType) and t.precision <= 18 else None


def _exact_sums(x: Column, scale: int, i: int) -> list[Column]:
    """Sums that give the exact sum and sum of squares of a column's unscaled values.

    A 64-bit value is split as high * 2^32 + low with low from -2^31 to 2^31 - 1,
    so that the products fit 64 bits and only their sums are decimals.
    """
    whole = (x * F.lit(10 ** scale)).cast("long") if scale else x.cast("long")
    carry = F.shiftright(whole, 31).bitwiseAND(F.lit(1))
    high = F.shiftright(whole, 32) + carry
    low = whole.bitwiseAND(F.lit(_LIMB - 1)) - carry * F.lit(_LIMB)
    return [F.sum(a.cast("decimal(20,0)")).alias(f"{n}{i}") for n, a in
            (("h", high), ("l", low), ("hh", high * high), ("hl", high * low), ("ll", low * low))]


def _exact_mean_std(row, scale: int, i: int) -> tuple[float | None, float | None]:
    """Mean and sample standard deviation from the exact sums, each rounded once."""
    n = row[f"c{i}"]
    if not n:
        return None, None
    h, l, hh, hl, ll = (int(row[f"{x}{i}"]) for x in ("h", "l", "hh", "hl", "ll"))
    total = h * _LIMB + l
    squares = hh * _LIMB ** 2 + 2 * hl * _LIMB + ll
    unit = 10 ** scale
    if n < 2:
        return float(Fraction(total, unit)), None
    variance = Fraction(n * squares - total * total, n * (n - 1) * unit * unit)
    return float(Fraction(total, n * unit)), math.sqrt(variance)


def describe_all(df: DataFrame) -> DataFrame:
    """Summary per column: numeric columns get count, mean, std, min, quartiles,
    max; other columns get count, unique, top (most frequent, smallest value
    on ties) and freq.

    NaN counts as missing. Means and standard deviations of whole numbers and
    decimals come from exact sums, those of floating columns from Spark's
    (numerically stable) aggregates. Numeric statistics of all columns come
    from one aggregate (plus the quantile passes); all other columns are unpivoted to (column, value)
    pairs and counted in one grouped aggregate, so the number of jobs does
    not grow with the number of columns.
    """
    num = [f.name for f in df.schema.fields if isinstance(f.dataType, _NUMERIC)]
    other = [f for f in df.schema.fields if not isinstance(f.dataType, _NUMERIC)]
    parts = []
    if num:
        types = {f.name: f.dataType for f in df.schema.fields}
        aggs = []
        for i, c in enumerate(num):
            raw = F.col(f"`{c}`")
            x = F.nanvl(raw.cast("double"), F.lit(None).cast("double"))      # NaN counts as missing
            aggs += [F.count(x).alias(f"c{i}"), F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
            scale = _scale(types[c])
            aggs += [F.avg(x).alias(f"a{i}"), F.stddev_samp(x).alias(f"s{i}")] if scale is None else \
                _exact_sums(raw, scale, i)
        row = df.agg(*aggs).first()              # a few numbers a column
        q, _ = exact_quantiles_multi(df, {c: [0.25, 0.5, 0.75] for c in num},
                                     counts={c: row[f"c{i}"] for i, c in enumerate(num)})
        rows = []
        for i, c in enumerate(num):
            scale = _scale(types[c])
            mean, std = (row[f"a{i}"], row[f"s{i}"]) if scale is None else _exact_mean_std(row, scale, i)
            rows.append((c, row[f"c{i}"], None, None, None, mean, std, row[f"lo{i}"], *q[c], row[f"hi{i}"]))
        parts.append(df.sparkSession.createDataFrame(
            rows, "column string, count long, `unique` long, top string, freq long, mean double, std double, "
                  "min double, p25 double, p50 double, p75 double, max double"))
    if other:
        def text(f):
            c = F.col(f"`{f.name}`")
            return F.date_format(c, "yyyy-MM-dd") if isinstance(f.dataType, T.DateType) \
                else c.cast("string")
        pairs = df.select(F.explode(F.array(*[F.struct(F.lit(f.name).alias("column"),
                                                       text(f).alias("v")) for f in other]))
                          .alias("p")).select("p.*").where(F.col("v").isNotNull())
        counts = pairs.groupBy("column", "v").agg(F.count(F.lit(1)).alias("n"))
        per = counts.groupBy("column").agg(
            F.sum("n").cast("long").alias("count"),
            F.count(F.lit(1)).cast("long").alias("unique"),
            F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("top"),
            F.max("n").cast("long").alias("freq"))
        parts.append(per.select("column", "count", "unique", "top", "freq",
                                *[F.lit(None).cast("double").alias(n)
                                  for n in ["mean", "std", "min", "p25", "p50", "p75", "max"]]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
