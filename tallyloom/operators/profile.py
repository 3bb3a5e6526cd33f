"""Table profiles, the choice of analyses, and a fixed catalogue of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Parts of column names that mark dates.
DATE_WORDS = ("datum", "date", "zeit", "time", "tag", "monat", "jahr", "year", "month", "day")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def long_form(row: DataFrame, names: list[str], label: str = "column", value: str = "value") -> DataFrame:
    """One row of aggregates as (label, value) rows."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias(label), F.col(f"`{n}`").alias(value)) for n in names])).alias("p")
    return row.select(pairs).select("p.*")


def null_counts(df: DataFrame) -> DataFrame:
    """column, value: columns with nulls and how many, in one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return long_form(counts, df.columns).where("value > 0")


def exact_quantiles(df: DataFrame, wanted: dict[str, list[float]], keep: int = 10_000, bins: int = 1_000) -> dict[str, list[float | None]]:
    """Quantiles of each column with linear interpolation, exact for any number of rows; nulls and NaN are left out.

    The values around each wanted rank are closed in on: a pass over the table, one
    for all columns, counts them in `bins` equal bins between the bounds so far and
    keeps the bin that has the rank, with its least and greatest value as the new
    bounds, until at most `keep` values are left (or one). Infinite values are counted
    beside the bins. Only bins and those values reach the driver, and no task holds
    more than its counts.
    """
    names = list(wanted)
    rows = df.select(*[F.nullif(F.col(f"`{c}`").cast("double"), F.lit(float("nan"))).alias(f"v{k}") for k, c in enumerate(names)])
    finite = lambda k: F.when(F.abs(f"v{k}") < float("inf"), F.col(f"v{k}"))
    ends = rows.agg(*[x for k in range(len(names)) for x in (F.min(finite(k)), F.max(finite(k)), F.count(finite(k)), F.count_if(F.col(f"v{k}") == float("-inf")), F.count(f"v{k}"))]).first()
    bounds: dict[tuple[int, int], tuple] = {}  # column and rank: least, greatest, values below, values within
    totals = []
    for k, c in enumerate(names):
        low, high, within, under, n = ends[5 * k : 5 * k + 5]
        totals.append(n)
        for r in {r for q in wanted[c] for r in (int(q * (n - 1)), min(n - 1, int(q * (n - 1)) + 1))} if n else ():
            bounds[k, r] = (low, high, under, within) if under <= r < under + within else ((float("-inf"),) if r < under else (float("inf"),)) * 2 + (0, 1)
    while open_ones := sorted({(k, *b) for (k, _), b in bounds.items() if b[3] > keep and b[0] < b[1]}):
        hits = [
            F.when(F.col(f"v{k}").between(lo, hi), F.struct(F.lit(i).alias("i"), F.least(F.lit(bins - 1), F.floor((F.col(f"v{k}") / 2 - lo / 2) / (hi / 2 - lo / 2) * bins)).cast("int").alias("b"), F.col(f"v{k}").alias("v")))
            for i, (k, lo, hi, _, _) in enumerate(open_ones)
        ]
        counted = rows.select(F.explode(F.array_compact(F.array(*hits))).alias("h")).groupBy("h.i", "h.b").agg(F.count("*").alias("n"), F.min("h.v").alias("lo"), F.max("h.v").alias("hi")).collect()
        for (k, r), old in list(bounds.items()):
            if (k, *old) in open_ones:
                below = old[2]
                for x in sorted((c for c in counted if c.i == open_ones.index((k, *old))), key=lambda c: c.b):
                    if r < below + x.n:
                        bounds[k, r] = (x.lo, x.hi, below, x.n)
                        break
                    below += x.n
    wide = sorted({(k, lo, hi) for (k, _), (lo, hi, _, _) in bounds.items() if lo < hi})
    held: dict[tuple, list[float]] = {w: [] for w in wide}
    if wide:
        hits = [F.when(F.col(f"v{k}").between(lo, hi), F.struct(F.lit(i).alias("i"), F.col(f"v{k}").alias("v"))) for i, (k, lo, hi) in enumerate(wide)]
        for i, v in rows.select(F.explode(F.array_compact(F.array(*hits))).alias("h")).select("h.i", "h.v").collect():
            held[wide[i]].append(v)
    value = {}
    for (k, r), (lo, hi, below, _) in bounds.items():
        value[k, r] = sorted(held[k, lo, hi])[r - below] if lo < hi else lo

    def at(k: int, q: float) -> float | None:
        if not totals[k]:
            return None
        x = q * (totals[k] - 1)
        a, b = value[k, int(x)], value[k, min(totals[k] - 1, int(x) + 1)]
        return a if a == b or x == int(x) else a + (x - int(x)) * (b - a)

    return {c: [at(k, q) for q in wanted[c]] for k, c in enumerate(names)}


def describe_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, count, mean, std, min, p25, p50, p75, max; quartiles are exact and interpolated."""
    quartiles = exact_quantiles(df, {c: [0.25, 0.5, 0.75] for c in columns})
    parts = []
    for c in columns:
        v = F.col(c).cast("double")
        q = [F.round(F.lit(x).cast("double"), 4) for x in quartiles[c]]
        parts.append(F.struct(F.lit(c).alias("column"), F.count(v).alias("count"), F.round(F.avg(v), 4).alias("mean"), F.round(F.stddev_samp(v), 4).alias("std"), F.min(v).alias("min"), q[0].alias("p25"), q[1].alias("p50"), q[2].alias("p75"), F.max(v).alias("max")))
    return df.agg(F.array(*parts).alias("x")).select(F.explode("x").alias("r")).select("r.*")


def describe_categorical(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, count, unique, top, freq; the smallest of the most frequent values is the top."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("p")).select("p.*").where("value is not null")
    counts = long.groupBy("column", "value").agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("m"), "value"))
    return counts.groupBy("column").agg(F.sum("n").alias("count"), F.count("*").alias("unique"), best.alias("b")).select("column", "count", "unique", F.col("b.value").alias("top"), (-F.col("b.m")).alias("freq"))


def choose_analyses(df: DataFrame, has_nulls: bool) -> list[str]:
    """numerisch, kategorisch, zeitreihe, fehlende_werte, as the columns call for them."""
    out = ["numerisch"] if numeric_columns(df) else []
    out += ["kategorisch"] if text_columns(df) else []
    out += ["zeitreihe"] if any(w in c.lower() for c in df.columns for w in DATE_WORDS) else []
    return out + (["fehlende_werte"] if has_nulls else [])


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def histogram(df: DataFrame, column: str, width: float) -> DataFrame:
    return df.groupBy((F.floor(F.col(column) / width) * width).cast("double").alias("bin")).agg(F.count("*").alias("n"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, r for each pair of columns, in one pass."""
    pairs = [(a, b) for k, a in enumerate(columns) for b in columns[k + 1 :]]
    parts = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.corr(F.col(a).cast("double"), F.col(b).cast("double")), 6).alias("r")) for a, b in pairs])
    return df.agg(parts.alias("x")).select(F.explode("x").alias("p")).select("p.*")


def iqr_outliers(df: DataFrame, column: str, factor: float = 1.5) -> DataFrame:
    """Rows outside the quartiles by more than factor times their distance."""
    q1, q3 = exact_quantiles(df, {column: [0.25, 0.75]})[column]
    if q1 is None:
        return df.limit(0)
    reach = factor * (q3 - q1)
    return df.where((F.col(column) < q1 - reach) | (F.col(column) > q3 + reach))


def z_outliers(df: DataFrame, column: str, most: float = 3.0) -> DataFrame:
    stats = df.agg(F.avg(column).alias("_m"), F.stddev_samp(column).alias("_s"))
    return df.crossJoin(F.broadcast(stats)).where(F.abs(F.col(column) - F.col("_m")) > most * F.col("_s")).drop("_m", "_s")


def crosstab(df: DataFrame, rows: str, columns: str, values: list[str]) -> DataFrame:
    return df.groupBy(rows).agg(*[F.count_if(F.col(columns) == v).alias(v) for v in values])


def growth(monthly: DataFrame, month: str, value: str, *keys: str) -> DataFrame:
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(month))
    return monthly.withColumn("growth", F.round(F.col(value) / before - 1, 6))


def hash_bucket(key: Column, n: int = 100) -> Column:
    """A bucket from 0 to n - 1 by the first 28 bits of the key's MD5."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 7), 16, 10).cast("long") % n
