"""Ordered computations per key that stay parallel when one key holds much of the data.

A plain ``Window.partitionBy(key).orderBy(ts)`` sorts all rows of a key in one task. Here a key is
cut into time buckets, and each (key, bucket) is a window of its own. What a row needs from other
buckets is either near in time, then the neighbours' edge rows are copied in as context, or it is
a summary of all earlier buckets (last value, running sum or maximum), then it comes from a table
with one row per bucket. The results are those of the plain window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions.common import micros

BUCKET = "__bucket"
DAY = 86400


def bucketed(df: DataFrame, ts: str, seconds: int) -> DataFrame:
    return df.withColumn(BUCKET, F.floor(micros(ts) / F.lit(seconds * 1_000_000)))


def with_context(df: DataFrame, ts: str, back: float = 0, ahead: float = 0, seconds: int = DAY, of: Column | None = None) -> DataFrame:
    """Rows with their bucket, and copies for the neighbours that need them as context.

    A bucket sees ``back`` seconds before its start and ``ahead`` seconds after its end; ``of``
    tells which rows can matter there. Adds ``__at`` (microseconds) and ``__context``.
    """
    width = max(int(seconds), int(back) + 1, int(ahead) + 1) * 1_000_000
    at, home = F.col("__at"), F.floor(F.col("__at") / F.lit(width))
    useful = F.lit(True) if of is None else of
    places = F.array_compact(F.array(
        F.lit(0),
        F.when(useful & (at - home * width >= width - int(back * 1_000_000)), 1) if back else F.lit(None).cast("int"),
        F.when(useful & (at - home * width < int(ahead * 1_000_000)), -1) if ahead else F.lit(None).cast("int"),
    ))
    placed = df.withColumn("__at", micros(ts)).withColumns({"__home": home, "__place": F.explode(places)})
    return placed.withColumns({BUCKET: F.col("__home") + F.col("__place"), "__context": F.col("__place") != 0}).drop("__home", "__place")


def _range(span: float, open_end: bool = False) -> int:
    return -int(span * 1_000_000) + (1 if open_end else 0)


def trailing(
    df: DataFrame, keys: Sequence[str], ts: str, span: float, aggregates: Mapping[str, Column], include_edge: bool = True,
    seconds: int = DAY,
) -> DataFrame:
    """Adds aggregates over the rows of the last ``span`` seconds, the row itself and its time-mates included."""
    frame = Window.partitionBy(*keys, BUCKET).orderBy("__at").rangeBetween(_range(span, not include_edge), 0)
    out = with_context(df, ts, back=span, seconds=seconds).withColumns({n: a.over(frame) for n, a in aggregates.items()})
    return out.where(~F.col("__context")).select(*df.columns, *aggregates)


def near_before(df: DataFrame, keys: Sequence[str], order: Sequence[str], span: float, seconds: int = DAY) -> DataFrame:
    """Adds ``since_before``: microseconds since the row before, null if it is more than ``span`` seconds back."""
    local = Window.partitionBy(*keys, BUCKET).orderBy("__at", *order[1:])
    out = with_context(df, order[0], back=span, seconds=seconds)
    gap = F.col("__at") - F.lag("__at").over(local)
    out = out.withColumn("since_before", F.when(gap <= int(span * 1_000_000), gap))
    return out.where(~F.col("__context")).select(*df.columns, "since_before")


def lagged(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Mapping[str, str], seconds: int = DAY) -> DataFrame:
    """Adds ``values`` (new name -> column): the value in the row before, per key in ``order``.

    The first column of ``order`` is the time; the others break ties.
    """
    src = bucketed(df, order[0], seconds)
    local = Window.partitionBy(*keys, BUCKET).orderBy(*order)
    last = src.groupBy(*keys, BUCKET).agg(F.max_by(F.struct(*set(values.values())), F.struct(*order)).alias("__last"))
    carried = last.select(*keys, BUCKET, F.lag("__last").over(Window.partitionBy(*keys).orderBy(BUCKET)).alias("__prev"))
    out = src.withColumns({
        "__first": F.row_number().over(local) == 1, **{f"__lag_{new}": F.lag(old).over(local) for new, old in values.items()},
    }).join(carried, [*keys, BUCKET])
    return out.select(*df.columns, *[
        F.when(F.col("__first"), F.col("__prev")[old]).otherwise(F.col(f"__lag_{new}")).alias(new) for new, old in values.items()])


def latest_mark(df: DataFrame, keys: Sequence[str], order: Sequence[str], mark: Column, name: str, seconds: int = DAY) -> DataFrame:
    """Adds the largest ``mark`` up to and including each row, null before the first one."""
    src = bucketed(df, order[0], seconds).withColumn("__mark", mark)
    local = Window.partitionBy(*keys, BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    whole = src.groupBy(*keys, BUCKET).agg(F.max("__mark").alias("__b"))
    carried = whole.select(*keys, BUCKET, F.max("__b").over(earlier).alias("__c"))
    out = src.withColumn("__l", F.max("__mark").over(local)).join(carried, [*keys, BUCKET])
    return out.select(*df.columns, F.greatest("__l", "__c").alias(name))


def spaced(df: DataFrame, keys: Sequence[str], order: Sequence[str], step: Column, name: str, seconds: int = DAY) -> DataFrame:
    """Adds the earliest time, in microseconds, at which each row can go when rows of a key keep ``step`` apart.

    ``step`` is constant per key. It is max over earlier rows j of at(j) + (k - j) * step: with k
    counted over all buckets, a running maximum of at(j) - j * step.
    """
    local = Window.partitionBy(*keys, BUCKET).orderBy(*order)
    upto = local.rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    src = bucketed(df, order[0], seconds).withColumns({"__step": step, "__k": F.row_number().over(local).cast("long")})
    src = src.withColumn("__m", F.max(micros(order[0]) - F.col("__k") * F.col("__step")).over(upto))
    whole = src.groupBy(*keys, BUCKET).agg(F.max("__k").alias("__n"), F.max("__m").alias("__bm"), F.max("__step").alias("__bs"))
    offset = whole.withColumn("__off", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
    carried = offset.select(
        *keys, BUCKET, "__off", F.max(F.col("__bm") - F.col("__off") * F.col("__bs")).over(earlier).alias("__cm"))
    out = src.join(carried, [*keys, BUCKET])
    best = F.greatest(F.col("__m") - F.col("__off") * F.col("__step"), F.col("__cm"))
    return out.select(*df.columns, (best + (F.col("__off") + F.col("__k")) * F.col("__step")).alias(name))


def failure_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], failed: str, seconds: int = DAY) -> DataFrame:
    """Adds ``run_length``: failures in a row up to this one, 0 for a success."""
    local = Window.partitionBy(*keys, BUCKET).orderBy(*order)
    upto = local.rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    src = bucketed(df, order[0], seconds).withColumn("__k", F.row_number().over(local).cast("long"))
    src = src.withColumn("__ok", F.max(F.when(~F.col(failed), F.col("__k"))).over(upto))
    whole = src.groupBy(*keys, BUCKET).agg(F.max("__k").alias("__n"), F.max("__ok").alias("__bok"))
    offset = whole.withColumn("__off", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
    carried = offset.select(*keys, BUCKET, "__off", F.max(F.col("__off") + F.col("__bok")).over(earlier).alias("__cok"))
    out = src.join(carried, [*keys, BUCKET])
    last_ok = F.coalesce(F.col("__off") + F.col("__ok"), F.col("__cok"), F.lit(0))
    length = F.when(F.col(failed), F.col("__off") + F.col("__k") - last_ok).otherwise(0)
    return out.select(*df.columns, length.cast("long").alias("run_length"))


def _far_enough(keys: Sequence[str], span: float, count: int, include_edge: bool) -> Column:
    """True where the row ``count`` places before lies in the ``span`` up to this row.

    Time-mates share the answer of the last of them, which sees them all: take the maximum over them.
    """
    gap = F.col("__at") - F.lag("__at", count).over(Window.partitionBy(*keys, BUCKET).orderBy("__at"))
    within = int(span * 1_000_000)
    return F.coalesce(gap <= within if include_edge else gap < within, F.lit(False))


def troubled_stretches(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], span: float, limit: int, include_edge: bool = True, seconds: int = DAY,
) -> tuple[DataFrame, DataFrame]:
    """Splits rows for a rule that allows ``limit`` rows in ``span`` seconds and remembers only those.

    Where the rows of a window, allowed or not, number at most ``limit``, the rule cannot bite.
    Result: (settled, troubled). ``settled`` rows have no crowded window in the ``span`` before
    them. ``troubled`` rows carry ``hot`` (false: here as memory only, also in ``settled``) and
    ``island``: stretches more than ``span`` apart, which can be worked on one by one.
    """
    ts, tie = order[0], order[1]
    src = with_context(df, ts, back=3 * span, ahead=span, seconds=seconds)
    # running values only: each row costs the same however many lie in its span
    near = Window.partitionBy(*keys, BUCKET).orderBy("__at")
    back = Window.partitionBy(*keys, BUCKET).orderBy(F.desc("__at"))
    low, first = _range(span), Window.unboundedPreceding
    marked = src.withColumn("__full", _far_enough(keys, span, limit, include_edge))
    marked = marked.withColumn("__u", F.max("__full").over(near.rangeBetween(0, 0)))
    crowd = F.when(F.col("__u"), F.col("__at"))
    marked = marked.withColumns({
        "hot": F.coalesce(F.max(crowd).over(near.rangeBetween(first, 0)) >= F.col("__at") + low, F.lit(False)),
        "__next": F.coalesce(F.min(crowd).over(back.rangeBetween(first, 0)) <= F.col("__at") - low, F.lit(False))})
    marked = marked.withColumn("__in", (F.col("hot") | F.col("__next")).cast("int"))
    earlier = F.max(F.when(F.col("__in") == 1, F.col("__at"))).over(near.rangeBetween(first, -1))
    alone = F.coalesce(earlier < F.col("__at") + low, F.lit(True))
    first_mate = F.min(tie).over(near.rangeBetween(0, 0)) == F.col(tie)
    marked = marked.withColumn("__start", F.when((F.col("__in") == 1) & alone & first_mate, F.col("__at"))).where(~F.col("__context"))
    settled = marked.where(~F.col("hot")).select(*df.columns)
    involved = marked.where("__in = 1").select(*df.columns, "hot", "__start")
    return settled, latest_mark(involved, keys, order, F.col("__start"), "island", seconds).drop("__start")
