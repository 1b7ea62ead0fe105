"""Windows of recordings: inside events, before events, and away from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cortigraph.functions.ranking import spread_rank
from cortigraph.operators.intervals import periods_and_gaps
from cortigraph.session import cut_lineage

#: Places of a grid that are made together.
PIECE = 65_536


def sliding(df: DataFrame, start: str, end: str, length: float, step: float) -> DataFrame:
    """start_sec, end_sec of the complete windows of each span [start, end); step 0 takes the one in the middle."""
    if step == 0:
        s = F.greatest(F.col(start).cast("double"), (F.col(start) + F.col(end)) / 2 - length / 2)
        return df.where(F.col(end) - F.col(start) >= length).withColumn("start_sec", s).withColumn("end_sec", s + length)
    n = F.floor((F.col(end) - F.col(start) - F.lit(float(length))) / F.lit(float(step)) + 1e-9)
    spread = df.where(F.col(end) - F.col(start) >= length).withColumn("_k", F.explode(F.sequence(F.lit(0).cast("bigint"), n)))
    return spread.withColumn("_s", F.col(start) + F.col("_k") * F.lit(float(step))).drop("_k").withColumn("start_sec", F.col("_s")).withColumn("end_sec", F.col("_s") + length).drop("_s")


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def _buckets(df: DataFrame, start: str, end: str, width: float) -> DataFrame:
    """One row per bucket of `width` that the span touches: the equi-key of an interval join."""
    lo, hi = F.floor(F.col(start) / F.lit(width)), F.floor(F.col(end) / F.lit(width))
    return df.withColumn("_bucket", F.explode(F.sequence(lo, F.greatest(lo, hi))))


def overlapping(windows: DataFrame, spans: DataFrame, keys: list[str], condition: Column | None = None, how: str = "left_anti", width: float = 300.0) -> DataFrame:
    """Windows (start_sec, end_sec) that meet no span (lo, hi) of the same keys, or that meet one (left_semi).

    Both sides are spread over time buckets, so the join has an equality key and
    a key with most of the rows is spread over its own time; a window is dropped
    or kept once. Windows may be of any length: they are spread over the time that
    spans of their key reach only. Windows must be distinct rows.
    """
    condition = condition if condition is not None else (F.col("start_sec") < F.col("hi")) & (F.col("end_sec") > F.col("lo"))
    s = spans.select(*keys, "lo", "hi")
    near = windows.join(s.groupBy(*keys).agg(F.min("lo").alias("_from"), F.max("hi").alias("_to")), keys).where("start_sec <= _to and end_sec >= _from")
    near = near.withColumn("_a", F.greatest("start_sec", "_from")).withColumn("_z", F.least("end_sec", "_to"))
    w, s = _buckets(near, "_a", "_z", width).drop("_from", "_to", "_a", "_z"), _buckets(s, "lo", "hi", width)
    met = w.join(s, [*keys, "_bucket"]).where(condition).select(*windows.columns).distinct()
    if how == "left_semi":
        return met
    on = [windows[c].eqNullSafe(met[c]) for c in windows.columns]
    return windows.join(met, on, "left_anti")


def majority_inside(windows: DataFrame, spans: DataFrame, keys: list[str], share: float = 0.5, width: float = 300.0) -> DataFrame:
    """Windows with more than `share` of their length inside one span (overlap semi-join).

    A window that is too long for its key's longest span is none; the others are
    compared with the spans near them.
    """
    longest = spans.groupBy(*keys).agg(F.max(F.col("hi") - F.col("lo")).alias("_longest"))
    windows = windows.join(longest, keys).where(share * (F.col("end_sec") - F.col("start_sec")) < F.col("_longest")).select(*windows.columns)
    inside = overlap(F.col("start_sec"), F.col("end_sec"), F.col("lo"), F.col("hi")) > share * (F.col("end_sec") - F.col("start_sec"))
    return overlapping(windows, spans, keys, inside, "left_semi", width)


def global_offsets(files: DataFrame, patient: str, file: str, duration: str) -> DataFrame:
    """offset: where each file begins on its patient's clock, files in name order."""
    before = Window.partitionBy(patient).orderBy(file).rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("offset", F.coalesce(F.sum(duration).over(before), F.lit(0)))


def predecessors(files: DataFrame, patient: str, file: str, duration: str) -> DataFrame:
    """previous_file and previous_duration: the file before, by name."""
    w = Window.partitionBy(patient).orderBy(file)
    return files.withColumn("previous_file", F.lag(file).over(w)).withColumn("previous_duration", F.lag(duration).over(w))


def preictal(events: DataFrame, files: DataFrame, length: float, overlap_share: float, horizon: float) -> DataFrame:
    """Windows walking back from each onset; one that crosses the file's start borrows from the file before.

    events: patient_id, file_name, onset. files: patient_id, file_name,
    duration_sec. Windows end at onset - k * step; kept if the pieces together
    are within 0.1 s of the length.
    """
    step = length * (1 - overlap_share)
    f = predecessors(files, "patient_id", "file_name", "duration_sec")
    n = int(max(0.0, horizon - length) / step + 1e-9)
    w = events.join(f, ["patient_id", "file_name"]).withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(n))))
    w = w.withColumn("end_sec", F.col("onset") - F.col("_k") * F.lit(step)).withColumn("start_sec", F.col("end_sec") - F.lit(float(length))).where("end_sec > 0")
    own = F.struct(F.col("file_name").alias("file_name"), F.greatest(F.lit(0.0), F.col("start_sec")).alias("start_sec"), F.col("end_sec").alias("end_sec"))
    borrowed = F.struct(F.col("previous_file").alias("file_name"), F.greatest(F.lit(0.0), F.col("previous_duration") + F.col("start_sec")).alias("start_sec"), F.col("previous_duration").cast("double").alias("end_sec"))
    crossing = (F.col("start_sec") < 0) & F.col("previous_file").isNotNull()
    w = w.withColumn("segments", F.when(crossing, F.array(borrowed, own)).otherwise(F.array(own)))
    covered = F.aggregate("segments", F.lit(0.0), lambda s, x: s + x["end_sec"] - x["start_sec"])
    return w.where(F.abs(covered - length) <= 0.1).select("patient_id", "file_name", "onset", "start_sec", "end_sec", "segments")


def exclusion_zones(events: DataFrame, files: DataFrame, gap: float) -> DataFrame:
    """lo, hi on the patient's clock of [onset - gap, offset + gap): back into earlier files, not beyond the own file's end."""
    f = global_offsets(files, "patient_id", "file_name", "duration_sec")
    e = events.join(f, ["patient_id", "file_name"])
    lo = F.greatest(F.lit(0.0), F.col("offset") + F.col("start_sec") - gap)
    hi = F.col("offset") + F.least(F.col("end_sec") + gap, F.col("duration_sec").cast("double"))
    return e.select("patient_id", lo.alias("lo"), hi.alias("hi")).where("hi > lo")


def merge_strict(spans: DataFrame, keys: list[str], block: float = 3600.0) -> DataFrame:
    """Overlapping spans (lo, hi) merged; touching ones stay apart. Spread over blocks of time."""
    merged = periods_and_gaps(spans, keys, "lo", "hi", block, touch=False).where("kind = 'period'")
    return merged.select(*keys, F.col("start_ms").alias("lo"), F.col("end_ms").alias("hi"))


def _away(files: DataFrame, events: DataFrame, length: float, step: float, gap: float, width: float, only: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The files (of `only`) with a grid, its places 0 to _n; and of those the runs of places _k0 to _k1 away from every zone.

    The zones that reach into a file are merged together with a mark before and one
    behind it, so that the gaps between them are all the time away from zones. The
    places that fit are worked out by comparing the bounds of windows as they will be,
    so that no grid is made to find them. Nothing here is sent to all executors by a
    join: repeated names compress so well that large tables would pass for small ones.
    """
    keys = ["patient_id", "file_name"]
    # The clock of a patient runs over all files, those without a window included.
    f = global_offsets(files, "patient_id", "file_name", "duration_sec").where(F.col("duration_sec") >= length)
    if only is not None:
        f = f.join(only.select(*keys).distinct().hint("merge"), keys, "left_semi")
    n = F.floor((F.col("duration_sec") - F.lit(float(length))) / F.lit(float(step)) + 1e-9) if step else F.lit(0).cast("bigint")
    f = cut_lineage(f.select(*keys, "duration_sec", "offset", n.alias("_n")))
    reach = f.select(*keys, F.col("offset").cast("double").alias("_from"), (F.col("offset") + F.col("duration_sec")).cast("double").alias("_to"))
    zones = exclusion_zones(events, files, gap).distinct()
    near = _buckets(reach, "_from", "_to", width).join(_buckets(zones, "lo", "hi", width).hint("merge"), ["patient_id", "_bucket"]).where("lo < _to and hi > _from").select(*keys, "lo", "hi")
    mark = lambda c: F.struct(c.alias("lo"), (c + 1).alias("hi"))
    marks = reach.select(*keys, F.explode(F.array(mark(F.col("_from") - length - 1), mark(F.col("_to") + length))).alias("_m")).select(*keys, "_m.lo", "_m.hi")
    free = periods_and_gaps(near.unionByName(marks), keys, "lo", "hi", width, touch=False).where((F.col("kind") == "gap") & (F.col("end_ms") > F.col("start_ms")))
    at = lambda k: F.col("offset") + _place(k, length, step)
    begins, fits = lambda k: at(k) >= F.col("start_ms"), lambda k: F.col("offset") + (_place(k, length, step) + length) <= F.col("end_ms")
    first, last = F.lit(0).cast("bigint"), F.col("_n")
    if step:
        first = F.greatest(first, F.ceil((F.col("start_ms") - F.col("offset")) / step) - 1)
        last = F.least(last, F.floor((F.col("end_ms") - length - F.col("offset")) / step) + 1)
    c = free.join(f.hint("merge"), keys).withColumn("_c", first).withColumn("_d", last)
    c = c.withColumn("_k0", F.when(begins(F.col("_c")), F.col("_c")).when(begins(F.col("_c") + 1), F.col("_c") + 1).otherwise(F.col("_c") + 2))
    c = c.withColumn("_k1", F.when(fits(F.col("_d")), F.col("_d")).when(fits(F.col("_d") - 1), F.col("_d") - 1).otherwise(F.col("_d") - 2))
    return f, c.where("_k1 >= _k0").select(*keys, "duration_sec", "_k0", "_k1")


def _place(k: Column, length: float, step: float) -> Column:
    """Where the k-th window of a file's grid begins; see `sliding`."""
    return k * F.lit(float(step)) if step else F.greatest(F.lit(0.0), F.col("duration_sec") / 2 - length / 2)


def interictal(files: DataFrame, events: DataFrame, length: float, step: float, gap: float, width: float = 3600.0) -> DataFrame:
    """Complete windows of each file's grid that meet no exclusion zone of the patient."""
    _, away = _away(files, events, length, step, gap, width)
    w = away.withColumn("_k", F.explode(F.sequence("_k0", "_k1"))).withColumn("start_sec", _place(F.col("_k"), length, step))
    return w.select("patient_id", "file_name", "start_sec", (F.col("start_sec") + length).alias("end_sec"))


def extended(spans: DataFrame, before: float, after: float) -> DataFrame:
    """Spans (lo, hi) with `before` and `after` added at their ends, not below 0."""
    return spans.withColumn("lo", F.greatest(F.lit(0.0), F.col("lo") - before)).withColumn("hi", F.col("hi") + after)


def interictal_draw(files: DataFrame, events: DataFrame, wanted: DataFrame, length: float, step: float, gap: float, seed: int = 42, width: float = 3600.0) -> DataFrame:
    """`wanted` (patient_id, file_name, n) windows of each file at random, away from every zone of its patient.

    A file without such a window draws from all of its grid. Fewer come out where
    there are fewer. The order is fixed by seed, file and start, and a file with most of
    the windows is numbered in pieces.
    """
    keys = ["patient_id", "file_name"]
    wanted = wanted.groupBy(*keys).agg(F.sum("n").alias("_w"))
    f, away = _away(files, events, length, step, gap, width, only=wanted)
    away = cut_lineage(away)
    none = f.join(away.select(*keys).distinct().hint("merge"), keys, "left_anti").select(*keys, "duration_sec", F.lit(0).cast("bigint").alias("_k0"), F.col("_n").alias("_k1"))
    runs = away.withColumn("fallback", F.lit(False)).unionByName(none.withColumn("fallback", F.lit(True))).join(wanted.hint("merge"), keys)
    # Windows are made where they are drawn: a piece of the grid gives its first by hash, as many as the file wants at most, and only these travel.
    part = lambda k: F.expr(f"{k} div {PIECE}")
    runs = runs.withColumn("_part", F.explode(F.sequence(part("_k0"), part("_k1")))).repartition(*keys, "_part")
    runs = runs.withColumn("_k", F.explode(F.sequence(F.greatest("_k0", F.col("_part") * PIECE), F.least("_k1", F.col("_part") * PIECE + PIECE - 1))))
    h = F.xxhash64(F.lit(seed), *keys, F.col("start_sec"))
    band, order = F.shiftrightunsigned(h, 58).cast("int"), [h, F.col("start_sec")]
    grid = runs.withColumn("start_sec", _place(F.col("_k"), length, step)).withColumn("end_sec", F.col("start_sec") + length)
    grid = grid.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(band, *order))).where("_r <= _w")
    ranked = spread_rank(grid.select(*keys, "start_sec", "end_sec", "fallback", "_w"), keys, band, order, "_r")
    return ranked.where("_r <= _w").drop("_r", "_w")


def clock_seconds(c: Column) -> Column:
    """Seconds of HH:MM:SS text; hours may pass 24."""
    p = F.split(c, ":")
    part = lambda i: F.get(p, F.lit(i)).try_cast("int")
    return part(0) * 3600 + part(1) * 60 + part(2)


def clock_duration(start: Column, end: Column) -> Column:
    """Seconds from start to end; an earlier end is on the next day."""
    d = clock_seconds(end) - clock_seconds(start)
    return F.when(d < 0, d + 86400).otherwise(d)
