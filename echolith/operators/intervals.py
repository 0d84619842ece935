"""Interval joins as equi-joins on time buckets, so that neither side is broadcast or crossed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def _buckets(df: DataFrame, start: str, end: str, width: int) -> DataFrame:
    first, last = F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width)
    return df.withColumn("_bucket", F.explode(F.sequence(first, F.greatest(first, last))))


def containing(points: DataFrame, periods: DataFrame, t: str, start: str, end: str, width: int, open_start: bool = False) -> DataFrame:
    """Each point with each period that holds it, [start, end) or (start, end)."""
    left = points.withColumn("_bucket", F.floor(F.col(t) / width))
    low = F.col(t) > F.col(start) if open_start else F.col(t) >= F.col(start)
    return left.join(_buckets(periods, start, end, width), "_bucket").filter(low & (F.col(t) < F.col(end))).drop("_bucket")


def _sweep(at: str, point: str) -> WindowSpec:
    """Back through the time of each bucket, points before what else there is at their time."""
    return Window.partitionBy("_bucket").orderBy(F.desc(at), F.col(point).isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def first_by_start(points: DataFrame, periods: DataFrame, t: str, start: str, end: str, order: list[str], width: int, open_start: bool = False) -> DataFrame:
    """Of containing() each point's first pair in an order that begins with the starts; pairs are never made.

    In a bucket a period counts only if it ends after all those that come before it. What is left starts and
    ends in the same order, so a point's period is the next one to end after it, if it has begun.
    """
    if order[0] != start:
        raise ValueError(f"order must begin with {start}")
    before = Window.partitionBy("_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    left = _buckets(periods.filter(F.col(end) > F.col(start)), start, end, width).withColumn("_m", F.max(end).over(before)).filter(F.col("_m").isNull() | (F.col(end) > F.col("_m")))
    ends = left.select("_bucket", F.col(end).alias("_at"), F.struct(*periods.columns).alias("_period"))
    rows = points.filter(F.col(t).isNotNull()).select(F.floor(F.col(t) / width).alias("_bucket"), F.col(t).alias("_at"), F.struct(*points.columns).alias("_point"))
    both = rows.unionByName(ends, allowMissingColumns=True)
    met = both.withColumn("_period", F.last("_period", ignorenulls=True).over(_sweep("_at", "_point"))).filter("_point IS NOT NULL")
    low = F.col(f"_period.{start}") < F.col(f"_point.{t}") if open_start else F.col(f"_period.{start}") <= F.col(f"_point.{t}")
    return met.filter(low).select("_point.*", "_period.*")


def without_points(periods: DataFrame, points: DataFrame, key: str, t: str, start: str, end: str, width: int) -> DataFrame:
    """The periods [start, end) that hold no point, by the next point after their start in each bucket; pairs are never made."""
    own = _buckets(periods.filter(F.col(end) > F.col(start)), start, end, width)
    own = own.select("_bucket", F.greatest(F.col(start), F.col("_bucket") * width).alias("_at"), F.struct(F.col(key).alias("key"), F.col(end).alias("end")).alias("_period"))
    rows = points.filter(F.col(t).isNotNull()).select(F.floor(F.col(t) / width).alias("_bucket"), F.col(t).alias("_at"), F.col(t).alias("_point"))
    both = rows.unionByName(own, allowMissingColumns=True)
    held = both.withColumn("_next", F.last("_point", ignorenulls=True).over(_sweep("_at", "_point"))).filter("_next < _period.end")
    return periods.join(held.select(F.col("_period.key").alias(key)), key, "left_anti")


def overlapping(a: DataFrame, b: DataFrame, a_span: tuple[str, str], b_span: tuple[str, str], width: int) -> DataFrame:
    """Each pair of intervals that overlap, once, with the length ``overlap``."""
    (s, e), (u, v) = a_span, b_span
    both = _buckets(a, s, e, width).join(_buckets(b, u, v, width), "_bucket")
    once = F.col("_bucket") == F.greatest(F.floor(F.col(s) / width), F.floor(F.col(u) / width))
    hit = both.filter(once & (F.col(u) < F.col(e)) & (F.col(v) > F.col(s)))
    return hit.withColumn("overlap", F.least(e, v) - F.greatest(s, u)).drop("_bucket")


def overlapping_any_length(a: DataFrame, b: DataFrame, a_span: tuple[str, str], b_span: tuple[str, str]) -> DataFrame:
    """What overlapping() gives, for lengths from moments to years (whole numbers): no width to choose, no interval in many buckets.

    An interval's level is the power of two that is its length or more. Of a pair, the longer one lies in the buckets of
    its own level, three at most, and the shorter one in those of every level above its own that the other side has, so
    rows grow by the number of levels (63 at most) whatever the lengths are.
    """
    found = []
    for (left, own), (right, other), strict in (((a, a_span), (b, b_span), False), ((b, b_span), (a, a_span), True)):
        level = lambda s: F.ceil(F.log2(F.greatest(F.col(s[1]) - F.col(s[0]), F.lit(1)))).cast("int")
        long = right.withColumn("_l", level(other))
        present = sorted(r[0] for r in long.select("_l").distinct().collect() if r[0] is not None)  # 63 at most
        above = F.filter(F.array(*map(F.lit, present)).cast("array<int>"), lambda k: k > F.col("_own") if strict else k >= F.col("_own"))  # noqa: B023
        short = left.withColumn("_own", level(own)).withColumn("_l", F.explode(above)).drop("_own")

        def buckets(df: DataFrame, span: tuple[str, str], name: str) -> DataFrame:
            first, last = (F.floor(x / F.expr("shiftleft(1L, _l)")) for x in (F.col(span[0]), F.col(span[1]) - 1))
            return df.withColumn(name, first).withColumn("_bucket", F.explode(F.sequence(first, F.greatest(first, last))))

        both = buckets(short, own, "_f1").join(buckets(long, other, "_f2"), ["_l", "_bucket"])
        found.append(both.filter(F.col("_bucket") == F.greatest("_f1", "_f2")).drop("_l", "_bucket", "_f1", "_f2"))
    (s, e), (u, v) = a_span, b_span
    hit = found[0].unionByName(found[1]).filter((F.col(u) < F.col(e)) & (F.col(v) > F.col(s)))
    return hit.withColumn("overlap", F.least(e, v) - F.greatest(s, u)).select(*a.columns, *b.columns, "overlap")


def first_period(points: DataFrame, periods: DataFrame, key: str, t: str, start: str, end: str, order: list[str], width: int, keep: bool = True) -> DataFrame:
    """Each point with the first period that holds it (start < t < end); unmatched points stay if keep."""
    if order[0] == start:
        found = first_by_start(points, periods, t, start, end, order, width, open_start=True)
    else:
        found = containing(points, periods, t, start, end, width, open_start=True)
    w = Window.partitionBy(key).orderBy(*order)
    best = found.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", *(c for c in points.columns if c != key))
    return points.join(best, key, "left" if keep else "inner")


def best_overlap(
    windows: DataFrame, calls: DataFrame, key: str, w_span: tuple[str, str], c_span: tuple[str, str], call_id: str, label: str,
    width: int, min_cover: float = 0.5, of: str = "call", ignore: tuple[str, ...] = ("untyped",),
) -> DataFrame:
    """(key, label, cover): the label of the call of the greatest overlap among those covered enough.

    Coverage is the share of the call, or of the window; ``partial`` where no
    call reaches min_cover, ``none`` without a call. ``mixed`` where calls have
    several labels outside ``ignore``: all that touch a window count, but only
    those covered enough where coverage is the window's. Ties go to the least
    call id; cover is that of the call taken, else of the greatest overlap.
    """
    pairs = overlapping(windows, calls, w_span, c_span, width)
    span = c_span if of == "call" else w_span
    pairs = pairs.withColumn("_cover", F.col("overlap") / F.greatest(F.col(span[1]) - F.col(span[0]), F.lit(1)))
    full = F.col("_cover") >= min_cover
    counted = ~F.col(label).isin(*ignore) if ignore else F.lit(True)
    if of != "call":
        counted = counted & full
    agg = pairs.groupBy(key).agg(
        F.max_by(F.struct(F.col(label).alias("l"), "_cover"), F.struct(full, "overlap", -F.col(call_id))).alias("best"),
        F.count_distinct(F.when(counted, F.col(label))).alias("labels"),
    )
    out = windows.select(key).join(agg, key, "left")
    label_ = F.when(F.col("best").isNull(), "none").when(F.col("labels") > 1, "mixed").when(F.col("best._cover") < min_cover, "partial").otherwise(F.col("best.l"))
    return out.select(key, label_.alias("label"), F.coalesce("best._cover", F.lit(0.0)).alias("cover"))


def overlap_labels(
    windows: DataFrame, calls: DataFrame, key: str, w_span: tuple[str, str], c_span: tuple[str, str], label: str, width: int,
    value_map: dict[str, str] | None = None, other: str | None = None, weak: tuple[str, ...] = (), mixed: str = "mixed",
) -> DataFrame:
    """(key, label): the one strong label of the calls that overlap a window, ``mixed`` for several, else the least weak one, else ``none``.

    value_map renames labels; ``other`` is what labels outside of it become.
    """
    value = F.col(label).cast("string")
    if value_map:
        lookup = F.create_map(*(F.lit(x) for kv in value_map.items() for x in kv))
        value = F.coalesce(F.try_element_at(lookup, value), value if other is None else F.lit(other))
    pairs = overlapping(windows, calls, w_span, c_span, width).select(key, value.alias("_v"))
    strong = F.when(~F.col("_v").isin(*weak), F.col("_v")) if weak else F.col("_v")
    agg = pairs.groupBy(key).agg(F.min(strong).alias("_s"), F.max(strong).alias("_t"), F.min("_v").alias("_w"))
    out = F.when(F.col("_s") < F.col("_t"), mixed).otherwise(F.coalesce("_s", "_w", F.lit("none")))
    return windows.select(key).join(agg, key, "left").select(key, out.alias("label"))


def period_labels(
    windows: DataFrame, periods: DataFrame, key: str, w_span: tuple[str, str], p_span: tuple[str, str], order: list[str], columns: list[str],
    source: str, width: int, overwrite: bool = False,
) -> DataFrame:
    """windows with columns and ``label_source`` from the period that holds their midpoint.

    Windows of an earlier source keep theirs and the first period counts, unless
    overwrite, when the last one does. Absent columns start as ``none`` and
    ``unannotated``.
    """
    base = windows.withColumns({c: F.lit("none") for c in columns if c not in windows.columns})
    if "label_source" not in base.columns:
        base = base.withColumn("label_source", F.lit("unannotated"))
    middle = base.select(key, ((F.col(w_span[0]) + F.col(w_span[1])) / 2).alias("_mid"))
    named = periods.select(*(F.col(c).alias(f"_p_{c}") for c in dict.fromkeys([*p_span, *order, *columns])))
    span = f"_p_{p_span[0]}", f"_p_{p_span[1]}"
    if overwrite or order[0] != p_span[0]:
        found = containing(middle, named, "_mid", *span, width)
    else:
        found = first_by_start(middle, named, "_mid", *span, [f"_p_{c}" for c in order], width)
    pick = F.max_by if overwrite else F.min_by
    best = found.groupBy(key).agg(pick(F.struct(*(F.col(f"_p_{c}").alias(c) for c in columns)), F.struct(*(F.col(f"_p_{c}") for c in order))).alias("_best"))
    out = base.join(best, key, "left")
    new = F.col("_best").isNotNull() if overwrite else F.col("_best").isNotNull() & (F.col("label_source") == "unannotated")
    new_columns = {c: F.when(new, F.col(f"_best.{c}")).otherwise(F.col(c)) for c in columns}
    return out.withColumns({**new_columns, "label_source": F.when(new, source).otherwise(F.col("label_source"))}).drop("_best")


def sessions(df: DataFrame, keys: list[str], start: str, end: str, max_gap: int) -> DataFrame:
    """df with ``session``: a new one where start passes the running end by more than max_gap."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    prior = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    flagged = df.withColumn("_new", F.coalesce((F.col(start) - prior > max_gap).cast("int"), F.lit(1)))
    return flagged.withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """a with b's columns where the keys, nulls included, are the same; a row for each of a."""
    other = b.toDF(*(f"_o_{c}" if c in keys else c for c in b.columns))
    on = F.lit(True)
    for c in keys:
        on = on & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    return a.join(other, on, "left").drop(*(f"_o_{c}" for c in keys))


def split_sessions(df: DataFrame, keys: list[str], start: str, end: str, max_gap: int, bucket: int) -> DataFrame:
    """What sessions() gives, with the rows of a key dealt by time, so that no task gets all rows of a hot one.

    Within a bucket of starts the running end and the number of sessions are local; what lies before it is one row a
    bucket: the greatest end and the number of sessions begun until then.
    """
    at = [*keys, "_b"]
    x = df.withColumn("_b", F.floor(F.col(start) / bucket))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # a row a bucket
    ends = x.groupBy(*at).agg(F.max(end).alias("_m"))
    x = _same(x, ends.select(*at, F.max("_m").over(before).alias("_carry")), at)
    local = Window.partitionBy(*at).orderBy(start, end)
    prior = F.greatest(F.max(end).over(local.rowsBetween(Window.unboundedPreceding, -1)), F.col("_carry"))
    x = x.withColumn("_new", F.coalesce((F.col(start) - prior > max_gap).cast("int"), F.lit(1)))
    begun = x.groupBy(*at).agg(F.sum("_new").alias("_n"))
    x = _same(x, begun.select(*at, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")), at)
    number = F.col("_offset") + F.sum("_new").over(local.rowsBetween(Window.unboundedPreceding, 0))
    return x.withColumn("session", number).select(*df.columns, "session")


def labelled_periods(windows: DataFrame, detector: str, label: str, start: str, end: str, max_gap: int, bucket: int, min_windows: int = 1) -> DataFrame:
    """(event_id, label, start, end, detector, n_windows): windows of a detector with one label whose gaps are at most max_gap, as periods.

    Periods of fewer windows go; windows without a label have no period. Ids are ``<label>_<detector>_0001`` in order of
    starts over all periods, then of detectors and labels; they are numbered within buckets from an offset for each.
    """
    rows = windows.filter(F.col(label).isNotNull() & (F.col(label) != ""))
    found = split_sessions(rows, [detector, label], start, end, max_gap, bucket)
    p = found.groupBy(detector, label, "session").agg(F.min(start).alias("_s"), F.max(end).alias("_e"), F.count("*").alias("n_windows")).filter(F.col("n_windows") >= min_windows)
    p = p.withColumn("_b", F.floor(F.col("_s") / bucket))
    offset = F.coalesce(F.sum("_k").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a bucket
    p = _same(p, p.groupBy("_b").agg(F.count("*").alias("_k")).select("_b", offset.alias("_offset")), ["_b"])
    number = F.col("_offset") + F.row_number().over(Window.partitionBy("_b").orderBy("_s", detector, label, "session"))
    width = F.greatest(F.length(number.cast("string")), F.lit(4))
    event = F.concat_ws("_", label, detector, F.lpad(number.cast("string"), width, F.lit("0")))
    return p.select(event.alias("event_id"), F.col(label).alias("label"), F.col("_s").alias("start"), F.col("_e").alias("end"), F.col(detector).alias("detector"), "n_windows")
