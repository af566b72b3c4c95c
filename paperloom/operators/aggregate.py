"""Group-by aggregation with named functions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.plans.orderstats import quantiles

AggBuilder = Callable[[str, "str | None"], Column]


def _present(name: str, order: str) -> Column:
    return F.when(F.col(name).isNotNull(), F.struct(F.col(name), F.col(order)))


def _truth(name: str) -> Column:
    return F.col(name).cast("boolean")


def _skew(name: str) -> Column:
    n = F.count(name).cast("double")
    return F.when(n > 2, F.skewness(name) * F.sqrt(n * (n - 1)) / (n - 2))


def _last_value(name: str, order: str, order_type: T.DataType) -> Column:
    """``idxmax`` of a column that has no negative (text, dates): the least order among its largest values."""
    if name == order:
        return F.max(name)
    if isinstance(order_type, T.DateType):
        back = -F.unix_date(order)
    elif isinstance(order_type, T.TimestampType):
        back = -F.unix_micros(order)
    elif isinstance(order_type, T.NumericType):
        back = -F.col(order)
    else:
        raise ValueError("idxmax of text or dates needs an order_by of numbers, dates or timestamps")
    return F.max_by(order, F.when(F.col(name).isNotNull(), F.struct(F.col(name).alias("x"), back.alias("back"))))


# name -> builder(column, order column); callers may add their own
AGGREGATES: dict[str, AggBuilder] = {
    "sum": lambda c, o: F.coalesce(F.sum(c), F.lit(0)),
    "mean": lambda c, o: F.avg(c),
    "min": lambda c, o: F.min(c),
    "max": lambda c, o: F.max(c),
    "count": lambda c, o: F.count(c),
    "size": lambda c, o: F.count("*"),
    "nunique": lambda c, o: F.count_distinct(c),
    "std": lambda c, o: F.stddev_samp(c),
    "var": lambda c, o: F.var_samp(c),
    "sem": lambda c, o: F.stddev_samp(c) / F.sqrt(F.count(c)),
    "skew": lambda c, o: _skew(c),
    "prod": lambda c, o: F.coalesce(F.product(c), F.lit(1.0)),
    "any": lambda c, o: F.coalesce(F.bool_or(_truth(c)), F.lit(False)),
    "all": lambda c, o: F.coalesce(F.bool_and(_truth(c)), F.lit(True)),
    "first": lambda c, o: F.min_by(F.struct(c), o)[c],
    "last": lambda c, o: F.max_by(F.struct(c), o)[c],
    "idxmin": lambda c, o: F.min_by(o, _present(c, o)),
    "idxmax": lambda c, o: F.min(F.struct(-F.col(c), F.col(o)))[o] if c == o else F.min_by(
        o, F.when(F.col(c).isNotNull(), F.struct((-F.col(c)).alias("x"), F.col(o)))
    ),
}
ORDERED = {"first", "last", "idxmin", "idxmax"}


def aggregate(
    df: DataFrame,
    group_by: Sequence[str],
    agg_funcs: Mapping[str, str | Sequence[str]],
    order_by: str | None = None,
    sort: bool = True,
    functions: Mapping[str, AggBuilder] | None = None,
    hot_rows: int = 100_000,
) -> DataFrame:
    """``{column: function or [functions]}`` per group; groups with a NULL key are dropped.

    Output columns keep the input name when every column has one function, else
    they are ``column_function``.  ``first``, ``last``, ``idxmin`` and ``idxmax``
    follow ``order_by``, as a table has no row order of its own; of equal extremes
    the one with the least ``order_by`` counts.  ``median`` is
    exact and computed without holding a large group in one task.
    """
    registry = {**AGGREGATES, **(functions or {})}
    keys = [group_by] if isinstance(group_by, str) else list(group_by)
    wanted: list[tuple[str, str]] = []
    for column, names in agg_funcs.items():
        wanted += [(column, fn) for fn in ([names] if isinstance(names, str) else names)]
    for name in [*keys, *agg_funcs]:
        if name not in df.columns:
            raise ValueError(f"no column {name!r}")
    unknown = {fn for _, fn in wanted if fn != "median" and fn not in registry}
    if unknown:
        raise ValueError(f"unknown aggregate functions {sorted(unknown)}")
    if order_by is None and any(fn in ORDERED for _, fn in wanted):
        raise ValueError("first, last, idxmin and idxmax need order_by")

    several = any(not isinstance(names, str) and len(names) > 1 for names in agg_funcs.values())
    outputs = [(c, fn, f"{c}_{fn}" if several else c) for c, fn in wanted if several or c not in keys]
    rows = df.dropna(subset=keys)
    # work under private names so that an output may reuse an input column's name
    plain = [(c, fn, out) for c, fn, out in outputs if fn != "median"]

    def built(column: str, fn: str) -> Column:
        if registry[fn] is AGGREGATES["idxmax"] and not isinstance(df.schema[column].dataType, T.NumericType):
            return _last_value(column, order_by, df.schema[order_by].dataType)
        return registry[fn](column, order_by)

    aggregates = [built(c, fn).alias(f"_out_{out}") for c, fn, out in plain]
    result = rows.groupBy(*keys).agg(*(aggregates or [F.count("*").alias("_rows")]))
    medians = [(c, out) for c, fn, out in outputs if fn == "median"]
    if medians:
        # all columns in one long table: one set of passes, however many medians
        values = [F.struct(F.lit(i).alias("_i"), F.col(c).cast("double").alias("_x")) for i, (c, _) in enumerate(medians)]
        long = rows.select(*keys, F.inline(F.array(*values)))
        found = quantiles(long, [*keys, "_i"], "_x", {"_q": 0.5}, hot_rows=hot_rows)
        wide = [F.max(F.when(F.col("_i") == i, F.col("_q"))).alias(f"_out_{out}") for i, (_, out) in enumerate(medians)]
        result = result.join(found.groupBy(*keys).agg(*wide), keys, "left")
    result = result.select(*keys, *[F.col(f"_out_{out}").alias(out) for _, _, out in outputs])
    return result.orderBy(*keys) if sort else result


def category_distribution(df: DataFrame, column: str = "category") -> DataFrame:
    """Rows per category, most frequent first."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)
