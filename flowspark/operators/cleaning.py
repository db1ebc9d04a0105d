"""Cleaning of raw flow tables."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark import domains as D
from flowspark.functions.text import strip
from flowspark.operators.bounded import dimension, small_side
from flowspark.session import written

FRACTIONAL = (T.DoubleType, T.FloatType)


def name(column: str) -> Column:
    """Column by its literal name, whatever characters it holds."""
    return F.col("`" + column.replace("`", "``") + "`")


def drop_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Drop exact names only, even under a case-insensitive resolver."""
    unwanted = set(columns)
    return df.select(*[name(c) for c in df.columns if c not in unwanted])


def resolve_column(df: DataFrame, candidates: Iterable[str]) -> str | None:
    """First candidate present, ignoring case."""
    by_lower = {c.lower(): c for c in df.columns}
    return next((by_lower[c.lower()] for c in candidates if c.lower() in by_lower), None)


def numeric_columns(df: DataFrame, exclude: Iterable[str] = D.META_COLS) -> list[str]:
    skipped = set(exclude)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in skipped]


def is_fractional(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, FRACTIONAL)


def non_finite(col: Column) -> Column:
    return F.isnan(col) | (F.abs(col) == float("inf"))


def finite_only(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """NaN and infinities become null (integer columns have none)."""
    changed = {c: F.when(~non_finite(name(c)), name(c)) for c in columns if is_fractional(df, c)}
    return df.withColumns(changed) if changed else df


def drop_empty_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Drop rows in which every given column is null."""
    return df.filter(F.coalesce(*[name(c).cast("double") for c in columns]).isNotNull()) if columns else df


def exact_medians(df: DataFrame, columns: list[str], window_rows: int = 1_000_000,
                  accuracy: int = 10_000) -> dict[str, float | None]:
    """Exact medians of many columns without gathering a column anywhere.

    A mergeable quantile sketch brackets the middle of each column, counts on both sides of the
    bracket say which ranks lie inside, and the bracket is narrowed until it holds few rows.
    Only those rows are grouped by value and ranked.  Every pass covers all columns at once, and
    only one row of bounds and counts per pass reaches the driver.
    """
    if not columns:
        return {}
    narrow = comparable(df, columns)
    values = dict(zip(columns, [F.col(x) for x in narrow.columns]))
    totals = narrow.agg(*[F.count(v) for v in values.values()]).first()
    state = {
        c: {"n": totals[i], "low": None, "high": None, "below": 0, "inside": totals[i], "slack": 3.0 / accuracy}
        for i, c in enumerate(columns) if totals[i] > 0
    }
    open_columns = [c for c in state if state[c]["inside"] > window_rows]
    while open_columns:
        bounds = narrow.agg(*[
            F.percentile_approx(F.when(_within(values[c], state[c]), values[c]),
                                F.array(*[F.lit(p) for p in _rank_bracket(state[c])]), accuracy).alias(f"q{i}")
            for i, c in enumerate(open_columns)
        ]).first()
        trial = {c: {**state[c], "low": bounds[i][0], "high": bounds[i][1]} for i, c in enumerate(open_columns)}
        counted = narrow.agg(*[
            part for i, c in enumerate(open_columns) for part in (
                F.count_if(values[c] < trial[c]["low"]).alias(f"b{i}"),
                F.count_if(_within(values[c], trial[c])).alias(f"i{i}"))
        ]).first()
        still_open = []
        for i, c in enumerate(open_columns):
            below, inside = counted[f"b{i}"], counted[f"i{i}"]
            first, last = _middle_ranks(state[c]["n"])
            if below >= first or below + inside < last:
                state[c]["slack"] *= 4
                still_open.append(c)
                continue
            narrowed = inside < state[c]["inside"]
            state[c] = {**trial[c], "below": below, "inside": inside}
            if inside > window_rows and narrowed and trial[c]["low"] < trial[c]["high"]:
                still_open.append(c)
        open_columns = still_open
    found: dict[str, float | None] = {c: None for c in columns}
    found.update({c: s["low"] for c, s in state.items() if s["low"] is not None and s["low"] == s["high"]})
    ranked = {f"x{i}": c for i, c in enumerate(columns) if c in state and found[c] is None}
    if ranked:
        found.update(_ranked_medians(narrow, ranked, state))
    return found


def comparable(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns alone, as finite doubles or null, named x0, x1, ...

    Later aggregates use every value many times; this projection computes it once per row.
    """
    return df.select(*[_comparable(df, c).alias(f"x{i}") for i, c in enumerate(columns)])


def _comparable(df: DataFrame, column: str) -> Column:
    value = name(column).cast("double")
    return F.when(~non_finite(value), value) if is_fractional(df, column) else value


def _within(value: Column, bounds: dict) -> Column:
    return value.isNotNull() if bounds["low"] is None else value.between(bounds["low"], bounds["high"])


def _middle_ranks(n: int) -> tuple[int, int]:
    return (n + 1) // 2, n // 2 + 1


def _rank_bracket(s: dict) -> tuple[float, float]:
    first, last = _middle_ranks(s["n"])
    start, end = (first - s["below"]) / s["inside"], (last - s["below"]) / s["inside"]
    return max(0.0, start - s["slack"]), min(1.0, end + s["slack"])


def _ranked_medians(narrow: DataFrame, ranked: dict[str, str], state: dict[str, dict]) -> dict[str, float]:
    """Rank the values inside the brackets, all columns in one job."""
    def any_of(tests: list[Column]) -> Column:
        return reduce(lambda a, b: a | b, tests)

    long = narrow.unpivot([], list(ranked), "i", "v").filter(any_of([
        (F.col("i") == x) & _within(F.col("v"), state[c]) for x, c in ranked.items()]))
    counted = long.groupBy("i", "v").agg(F.count("*").alias("m"))
    upto = F.sum("m").over(Window.partitionBy("i").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    hit = any_of([
        (F.col("i") == x) & (F.col("upto") >= rank - state[c]["below"]) & (F.col("upto") - F.col("m") < rank - state[c]["below"])
        for x, c in ranked.items() for rank in set(_middle_ranks(state[c]["n"]))])
    rows = (
        counted.withColumn("upto", upto).filter(hit).groupBy("i")
        .agg(((F.min("v") + F.max("v")) / 2).alias("median")).collect()
    )
    return {ranked[r["i"]]: r["median"] for r in rows}


def impute(df: DataFrame, fill_values: dict[str, float | None]) -> DataFrame:
    """Replace nulls by given values; whole-number columns keep their type when the value is whole."""
    changed = {}
    for column, value in fill_values.items():
        if value is None:
            continue
        whole = not is_fractional(df, column) and float(value).is_integer()
        target = df.schema[column].dataType if whole or is_fractional(df, column) else T.DoubleType()
        changed[column] = F.coalesce(name(column), F.lit(value)).cast(target)
    return df.withColumns(changed) if changed else df


def impute_medians(df: DataFrame, columns: list[str]) -> DataFrame:
    return impute(df, exact_medians(df, columns))


def non_negative_columns(columns: Iterable[str]) -> list[str]:
    return [c for c in columns if any(part in c for part in D.NON_NEGATIVE_NAME_PARTS)]


def clip_negatives(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Negatives become 0 in columns that cannot be negative by name; nulls stay null."""
    changed = {c: F.when(name(c) < 0, F.lit(0).cast(df.schema[c].dataType)).otherwise(name(c))
               for c in non_negative_columns(columns)}
    return df.withColumns(changed) if changed else df


def plain_dashes(label: Column) -> Column:
    """Any dash or control run between words becomes one en dash, so that re-encoded labels still match."""
    return F.regexp_replace(label, r"\s+[\x{2010}-\x{2015}\x{0080}-\x{009f}\x{fffd}-]+\s+", " – ")


def map_labels(df: DataFrame, raw: str, source: str, tidy_dashes: bool = False) -> DataFrame:
    """Unified ``label`` by broadcast lookup, ``label_original`` and ``dataset_source``.

    Matching is exact after trimming; anything else becomes Unknown.
    """
    cleaned = strip(name(raw).cast("string"))
    cleaned = plain_dashes(cleaned) if tidy_dashes else cleaned
    labels = dimension(df.sparkSession, list(D.LABELS_BY_SOURCE[source].items()), "label_original string, label string")
    base = drop_columns(df.withColumn("label_original", cleaned), [c for c in ("label", raw) if c != "label_original"])
    return (
        base.join(labels, "label_original", "left")
        .withColumns({"label": F.coalesce("label", F.lit(D.UNKNOWN)), "dataset_source": F.lit(source)})
    )


def resolve_label(category: Column | None, binary: Column | None) -> Column:
    """Attack category from the text column, the 0/1 column, or both."""
    if category is None and binary is None:
        raise ValueError("no label column found")
    if category is None:
        return F.when(binary == 0, "Normal").when(binary == 1, "Attack")
    resolved = category
    if binary is not None:
        resolved = F.when(category.isNull() & (binary == 0), "Normal").when(
            category.isNull() & (binary == 1), "Attack").otherwise(category)
    text = strip(resolved)
    return F.when(text.isNull() | text.isin(*D.EMPTY_LABEL_MARKERS), "Normal").otherwise(text)


def to_number(col: Column) -> Column:
    """Numeric value of a text; a lone dash or any other text is null."""
    return strip(col).try_cast("double")


def coerce_numeric(df: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """Make every column outside ``keep`` numeric."""
    kept = set(keep)
    changed = {f.name: to_number(name(f.name)) for f in df.schema.fields
               if f.name not in kept and not isinstance(f.dataType, T.NumericType)}
    return df.withColumns(changed) if changed else df


def ordered_codes(values: DataFrame, column: str, code: str) -> DataFrame:
    """0-based position of every distinct value in text order.

    Distinct values are dealt into ranges of about equal size by sampled bounds and written once,
    so that every read sees the same ranges.  Positions are counted inside a range and shifted by
    the sizes of the ranges before: no single task sorts all values, whatever prefix they share.
    """
    ranged = written(values.select(column).distinct().repartitionByRange(column).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_size"))  # one row per shuffle partition
    before = F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_range", F.coalesce(before, F.lit(0)).alias("_offset"))
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(column)) - 1
    return ranged.join(F.broadcast(offsets), "_range").select(column, (rank + F.col("_offset")).cast("bigint").alias(code))


def encode_categories(df: DataFrame, columns: Iterable[str], suffix: str = "") -> DataFrame:
    """Alphabetical 0-based codes for text columns; null counts as the category "nan"."""
    for column in columns:
        if isinstance(df.schema[column].dataType, T.NumericType):
            continue
        key, code = f"_key_{column}", f"_code_{column}"
        keyed = df.withColumn(key, F.coalesce(name(column).cast("string"), F.lit("nan")))
        codes = small_side(ordered_codes(keyed.select(key), key, code))
        df = keyed.join(codes, key).drop(key)
        target = column + suffix
        df = (df.drop(column) if target == column else df).withColumnRenamed(code, target)
    return df


def unify(left: DataFrame, right: DataFrame) -> DataFrame:
    """Outer union of two tables with different columns; gaps and non-numbers become 0."""
    both = left.unionByName(right, allowMissingColumns=True)
    changed = {}
    for field in both.schema.fields:
        if field.name in D.META_COLS:
            changed[field.name] = F.coalesce(name(field.name), F.lit("0"))
        elif isinstance(field.dataType, T.NumericType):
            filled = F.coalesce(name(field.name), F.lit(0))
            changed[field.name] = F.when(F.isnan(name(field.name)), 0).otherwise(filled) \
                if isinstance(field.dataType, FRACTIONAL) else filled
        else:
            changed[field.name] = F.coalesce(to_number(name(field.name)), F.lit(0.0))
    return both.withColumns(changed)


def column_ranges(df: DataFrame, columns: list[str]) -> dict[str, dict[str, float]]:
    """Minimum and maximum of every column, in one pass, as scaling parameters."""
    narrow = comparable(df, columns)
    row = narrow.agg(*[f(x) for x in narrow.columns for f in (F.min, F.max)]).first()
    return {c: {"min": row[2 * i], "max": row[2 * i + 1]} for i, c in enumerate(columns)}


def scale(df: DataFrame, ranges: dict[str, dict[str, float]]) -> DataFrame:
    """Min-max scaling with stored parameters; constant columns become 0."""
    changed = {}
    for column, r in ranges.items():
        low, high = r["min"], r["max"]
        if low is not None and high - low > 0:
            changed[column] = (name(column).cast("double") - low) / F.lit(high - low)
        else:
            changed[column] = F.lit(0.0)
    return df.withColumns(changed) if changed else df


def quality_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column with its null, NaN, infinite and negative counts, in one pass."""
    counts = []
    for column in columns:
        v = name(column)
        fractional = is_fractional(df, column)
        counts.append(F.struct(
            F.lit(column).alias("column_name"),
            F.count_if(v.isNull()).alias("n_null"),
            (F.count_if(F.isnan(v)) if fractional else F.lit(0).cast("bigint")).alias("n_nan"),
            (F.count_if(F.abs(v) == float("inf")) if fractional else F.lit(0).cast("bigint")).alias("n_inf"),
            (F.count_if((v < 0) & ~non_finite(v)) if fractional else F.count_if(v < 0)).alias("n_negative"),
        ))
    return df.agg(F.array(*counts).alias("all")).select(F.inline("all"))


def range_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """Scaling parameters as a table (column, min, max), computed in one pass."""
    parts = [F.struct(F.lit(c).alias("column_name"), F.min(f"x{i}").alias("min_value"), F.max(f"x{i}").alias("max_value"))
             for i, c in enumerate(columns)]
    return comparable(df, columns).agg(F.array(*parts).alias("all")).select(F.inline("all"))
