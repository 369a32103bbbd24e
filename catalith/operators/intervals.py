"""Continuous periods and gaps of overlapping, nested, touching or broken intervals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalith.session import BROADCAST_ROWS

OPEN_END = 2147483647
#: Distinct starts of one entity up to which its intervals are ordered by one task.
ENTITY_STARTS = 1_000_000


@dataclass(frozen=True)
class Timeline:
    """How many points of each scope lie before and up to a place.

    ``table (scope, block, before, points)`` has one row for each block of ``width`` places from ``low`` to ``high``, with the number of
    points before the block and, where a block is more than one place, the sorted points in it; a place outside counts as the nearest end.
    ``fits`` says whether the table is small enough to be broadcast.
    """

    table: DataFrame
    low: int
    high: int
    width: int
    fits: bool

    def ranked(self, rows: DataFrame, scope: str, at: str, out: str, through: bool) -> DataFrame:
        """Adds the number of points of the row's scope before the place ``at``, or up to it; null for a null or unknown scope."""
        place = F.greatest(F.lit(self.low), F.least(F.lit(self.high), F.col(at))).cast("long")
        side = F.broadcast(self.table) if self.fits else self.table
        side = side.select(F.col("scope").alias(scope), F.col("block").alias("_block"), F.col("before").alias("_before_block"), F.col("points").alias("_points"))
        rows = rows.withColumns({"_place": place, "_block": F.floor((place - self.low) / self.width).cast("long")}).join(side, [scope, "_block"], "left")
        if self.width == 1:  # all points of a block lie at its place
            inside = F.when(F.lit(through), F.size("_points")).otherwise(0)
        else:
            inside = F.size(F.filter("_points", lambda p: p <= F.col("_place") if through else p < F.col("_place")))
        return rows.withColumn(out, (F.col("_before_block") + inside).cast("int")).drop("_place", "_block", "_before_block", "_points")


def timeline_of(points: DataFrame, scope: str, point: str, rows: int = BROADCAST_ROWS) -> Timeline:
    """The ``Timeline`` of ``points (scope, point)`` with at most about ``rows`` rows, whatever span the places have.

    Null scopes and points are no points; copies count once.
    """
    points = points.select(F.col(scope).alias("scope"), F.col(point).cast("long").alias("point")).where(F.col("scope").isNotNull() & F.col("point").isNotNull()).distinct()
    low, high, scopes, n = points.agg(F.min("point"), F.max("point"), F.count_distinct("scope"), F.count(F.lit(1))).first()
    low, high = (0, 0) if low is None else (low - 1, high + 1)
    width = max(1, -(-(high - low + 1) * scopes // rows))
    own = points.groupBy("scope", F.floor((F.col("point") - low) / width).cast("long").alias("block")).agg(F.array_sort(F.collect_list("point")).alias("points"))  # the points of one block
    own = own.unionByName(points.select("scope").distinct().select("scope", F.lit(-1).cast("long").alias("block"), F.array().cast("array<bigint>").alias("points")))
    w = Window.partitionBy("scope").orderBy("block")
    steps = own.select("scope", "block", "points", F.sum(F.size("points")).over(w).alias("_upto"), F.lead("block").over(w).alias("_next"))
    last = (high - low) // width
    at = F.explode(F.sequence(F.col("block"), F.coalesce(F.col("_next") - 1, F.lit(last).cast("long")))).alias("at")
    table = steps.select("scope", at, "block", "points", "_upto")
    here = F.col("at") == F.col("block")
    table = table.select("scope", F.col("at").alias("block"), (F.col("_upto") - F.when(here, F.size("points")).otherwise(0)).alias("before"), F.when(here, F.col("points")).otherwise(F.array().cast("array<bigint>")).alias("points"))
    return Timeline(table, low, high, width, n <= rows)


def continuous_periods(
    ranges: DataFrame,
    entity: str,
    start: str,
    end: str,
    *,
    scope_of: DataFrame | None = None,
    points: DataFrame | None = None,
    scope: str = "scope",
    point: str = "point",
    entity_starts: int = ENTITY_STARTS,
    bounds: tuple[int, int] | None = None,
) -> DataFrame:
    """Merges each entity's closed integer intervals into periods and lists the gaps between them.

    Returns ``(entity, piece, start, end)``, piece ``period`` or ``gap``. Intervals belong together when
    they share a place or when no point of the timeline lies strictly between them; without ``points``
    every integer is a point. With ``points (scope, point)``, ``scope_of (entity, scope)`` says whose points count for
    an entity; without a scope there are none, so all its intervals are one period. A gap runs from the
    place after a period to the place before the next.

    A null end is open (2147483647). Rows with a null entity or start, or an end below the start, are no
    intervals. Copies and intervals of one start are one before anything is shuffled. Extra columns are
    ignored. An empty table gives no rows.

    Order by start, running maximum of the previous ends, islands by cumulative sum, aggregate. Before that
    an entity keeps one row for each start, so the timeline bounds its rows; if the starts span more than
    ``entity_starts`` places, entities that have more are cut into blocks of the timeline and the running maximum is
    carried from block to block. ``bounds`` are the least and the greatest start, where the caller knows them cheaply.
    """
    e, s, t = "_entity", "_start", "_end"
    rows = ranges.select(F.col(entity).alias(e), F.col(start).alias(s), F.coalesce(F.col(end), F.lit(OPEN_END)).alias(t))
    rows = rows.where(F.col(e).isNotNull() & F.col(s).isNotNull() & (F.col(t) >= F.col(s)))
    low, high = bounds or rows.agg(F.min(s), F.max(s)).first()
    rows = rows.groupBy(e, s).agg(F.max(t).alias(t))
    if points is None:
        rows = rows.withColumns({"_before": F.col(s).cast("long"), "_through": F.col(t).cast("long") + 1})
    else:
        rows = _ranked(rows, e, s, t, scope_of.select(F.col(entity).alias(e), F.col(scope).alias("_scope")), points, scope, point)
    if low is None or high - low < entity_starts:
        pieces = _ordinary(rows, e, s, t)
    else:
        counts = rows.groupBy(e).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > entity_starts).select(e)
        heavy = rows.join(counts, e, "left_semi")
        pieces = _ordinary(rows.join(counts, e, "left_anti"), e, s, t).unionByName(_blocked(heavy, e, s, t, entity_starts))
    return pieces.select(F.col(e).alias(entity), "piece", F.col(s).alias(start), F.col(t).alias(end))


def _ranked(rows, e, s, t, scopes, points, scope, point):
    scopes = scopes.where(F.col(e).isNotNull()).groupBy(e).agg(F.min("_scope").alias("_scope"))
    timeline = timeline_of(points, scope, point)
    rows = rows.join(scopes, e, "left")
    for at, out in ((s, "_before"), (t, "_through")):
        rows = timeline.ranked(rows, "_scope", at, out, through=at == t)
    return rows.select(e, s, t, F.coalesce("_before", F.lit(0)).alias("_before"), F.coalesce("_through", F.lit(0)).alias("_through"))


def _ordinary(rows, e, s, t):
    earlier = Window.partitionBy(e).orderBy(s).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(e).orderBy(s).rowsBetween(Window.unboundedPreceding, 0)
    new = F.when(F.col("_before") > F.max("_through").over(earlier), 1).otherwise(0)
    islands = rows.withColumn("_new", new).withColumn("_island", F.sum("_new").over(upto))
    periods = islands.groupBy(e, "_island").agg(F.min(s).alias(s), F.max(t).alias(t))
    last = F.lag(t).over(Window.partitionBy(e).orderBy(s))
    return _pieces(periods.withColumn("_last", last), e, s, t)


def _pieces(periods, e, s, t):
    """Each period and, before it, the gap since ``_last``."""
    gap = F.struct(F.lit("gap").alias("piece"), (F.col("_last") + 1).alias(s), (F.col(s) - 1).alias(t))
    period = F.struct(F.lit("period").alias("piece"), F.col(s), F.col(t))
    both = F.when(F.col("_last").isNotNull(), F.array(period, gap)).otherwise(F.array(period))
    return periods.select(e, F.explode(both).alias("_p")).select(e, "_p.piece", f"_p.{s}", f"_p.{t}")


def _blocked(rows, e, s, t, width):
    """The same for entities too large for one task: blocks of the timeline, carried maxima between them."""
    rows = rows.withColumn("_block", F.floor(F.col(s) / width))
    inner = Window.partitionBy(e, "_block").orderBy(s)
    earlier, upto = inner.rowsBetween(Window.unboundedPreceding, -1), inner.rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(e).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)

    def carried(df, **cols):
        blocks = df.groupBy(e, "_block").agg(*(F.max(c).alias(k) for k, c in cols.items()))
        return df.join(blocks.select(e, "_block", *(F.max(k).over(before).alias(k) for k in cols)), [e, "_block"])

    rows = carried(rows, _c_through="_through", _c_end=t)
    rows = rows.withColumn("_prev", F.greatest("_c_through", F.max("_through").over(earlier)))
    rows = rows.withColumn("_last", F.greatest("_c_end", F.max(t).over(earlier)))
    rows = rows.withColumn("_opens", F.when(F.col("_prev").isNull() | (F.col("_before") > F.col("_prev")), F.col(s)))
    rows = carried(rows.drop("_c_through", "_c_end"), _c_opens="_opens")
    rows = rows.withColumn("_island", F.coalesce(F.max("_opens").over(upto), F.col("_c_opens")))
    last = F.max(F.when(F.col("_opens").isNotNull(), F.col("_last"))).alias("_last")
    periods = rows.groupBy(e, "_island").agg(F.min(s).alias(s), F.max(t).alias(t), last)
    return _pieces(periods, e, s, t)
