"""Implausible readings: impossible values, short spikes and stuck runs, judged against each source's own behaviour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brookmill.session import SharedTable

#: A series of at least this many readings (and of a ten-thousandth of all) is cut into pieces of about as many, so that it is
#: not one task; readings at the ends of pieces are judged with their neighbours in the pieces beside them.
PIECE = 200_000
#: Readings that a measure looks back and ahead.
BACK, AHEAD = 2, 4
#: Spikes of up to so many readings are measured reading by reading, longer ones between the steps at their ends.
WIDEST = 3
#: Seconds that a spike may last at most, however many readings it has: beyond that it is a level of its own.
LONGEST = 1800
#: A context's sketch holds if it saw this many readings; else the source's does, else that of all sources.
LEAST_CONTEXT, LEAST_SOURCE = 400, 60
HOUR_BANDS = 4
#: Size of the quantile sketches: a rank is off by about 0.2 %.
SKETCH = 2000
KINDS = ("impossible", "spike", "stuck", "jump")


def _pieced(readings: DataFrame, piece: int = PIECE) -> tuple[DataFrame, bool]:
    """Adds ``piece`` to readings, 0 but for those of large series; and whether there are such series, of which fewer than 10000 can exist."""
    s = F.unix_micros(F.col("at").cast("timestamp"))
    counts = readings.groupBy("series").agg(F.count("*").alias("_n"), F.min(s).alias("_first"), F.max(s).alias("_last"))
    seen = counts.agg(F.sum("_n").alias("n"), F.max("_n").alias("most")).first()
    least = max(piece, (seen["n"] or 0) // 10_000)
    if (seen["most"] or 0) < least:
        return readings.withColumn("piece", F.lit(0)), False
    large = counts.where(F.col("_n") >= least)
    share = F.try_divide((s - F.col("_first")).cast("double"), (F.col("_last") - F.col("_first") + 1).cast("double"))
    return readings.join(F.broadcast(large), "series", "left").withColumn("piece", F.coalesce(F.floor(share * F.ceil(F.col("_n") / piece)).cast("int"), F.lit(0))).drop("_n", "_first", "_last"), True


def _neighbours(points: DataFrame, by: list[str]) -> DataFrame:
    """Adds ``b1, b2, a1 .. a4``: STRUCT<t, v, at> of the readings before and after in the same group."""
    w = W.partitionBy(*by).orderBy("at")
    x = F.struct("t", "v", "at")
    return points.select("*", *(F.lag(x, k).over(w).alias(f"b{k}") for k in range(1, BACK + 1)), *(F.lead(x, k).over(w).alias(f"a{k}") for k in range(1, AHEAD + 1)))


def in_order(readings: DataFrame, piece: int = PIECE) -> DataFrame:
    """series, source, at, v, t, the readings beside each one, and ``run``, how many readings in a row have this value.

    ``readings``: series, source, at, v, without null, NaN and impossible values. Readings of one time are one, that
    of the largest value. Readings near the end of a piece take their neighbours, and runs that reach it their length,
    from the whole series: only those at the ends of pieces are looked at once more.
    """
    given, cut = _pieced(readings, piece)
    of = ["series", "piece"]
    copies = W.partitionBy(*of).orderBy("at", F.desc("v"), "source")
    once = given.withColumn("_same", F.lag("at").over(copies).eqNullSafe(F.col("at"))).where("not _same").drop("_same")
    once = once.withColumn("t", F.unix_micros(F.col("at").cast("timestamp")) / 1e6)
    rows = _neighbours(once, of)
    w = W.partitionBy(*of).orderBy("at")
    rows = rows.withColumn("_run", F.sum(F.when(F.col("b1.v") == F.col("v"), 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("run", F.count("*").over(W.partitionBy(*of, "_run")))
    if not cut:
        return rows.drop("_run", "piece")
    rows = SharedTable(rows.withColumns({"_at": F.row_number().over(w), "_of": F.count("*").over(W.partitionBy(*of))}), "pieces").read()
    # a reading's neighbours in the whole series: of the readings at the ends of pieces, those beside them are there too
    reach = BACK + AHEAD
    near = (F.col("_at") <= 2 * reach) | (F.col("_at") > F.col("_of") - 2 * reach)
    wrong = (F.col("_at") <= BACK) | (F.col("_at") > F.col("_of") - AHEAD)
    beside = [f"b{k}" for k in range(1, BACK + 1)] + [f"a{k}" for k in range(1, AHEAD + 1)]
    ends = _neighbours(rows.where(near).drop(*beside), ["series"]).where(wrong)
    rows = rows.where(~wrong).unionByName(ends)
    # runs that reach over the ends of pieces: the first and last run of each piece, in order, are joined where the value stays
    runs = rows.groupBy(*of, "_run").agg(F.min("at").alias("at"), F.min("v").alias("v"), F.count("*").alias("n"), F.max((F.col("_at") == 1).cast("int")).alias("_head"), F.max((F.col("_at") == F.col("_of")).cast("int")).alias("_tail"))
    runs = runs.where("_head = 1 or _tail = 1")
    order = W.partitionBy("series").orderBy("piece", "_run")
    new = F.when((F.lag("v").over(order) == F.col("v")) & (F.lag("piece").over(order) < F.col("piece")), 0).otherwise(1)
    runs = runs.withColumn("_new", new).withColumn("_joined", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    runs = runs.select(*of, "_run", F.sum("n").over(W.partitionBy("series", "_joined")).alias("_long"))
    return rows.join(runs, [*of, "_run"], "left").withColumn("run", F.coalesce("_long", "run")).drop("_long", "_run", "_at", "_of", "piece")


def shapes(readings: DataFrame, piece: int = PIECE) -> DataFrame:
    """For each reading how far it and its next ones leave the line between their neighbours, and how long its value stays.

    To what in_order gives are added for k = 1..WIDEST ``dev_k`` (least distance of the k readings from the line, 0 if
    they aren't all on one side of it), ``near_k`` (how badly the next neighbours on both sides fit the line), ``out_k``
    (how far the k readings lie outside both neighbours' values). Measures are null where the k readings stay
    within their neighbours' values, but for dev_1; ``at_k`` is the time of the k-th next reading where a wider measure needs it.
    ``rate`` is the change per second since the reading before, ``step`` that change itself where the steps next to it
    go less far in its direction, ``calm`` how far those go and ``from`` the time of the reading before.
    """
    p = in_order(readings, piece)
    at = lambda c, j: F.col(c) if j == 0 else F.col(f"a{j}.{c}") if j > 0 else F.col(f"b{-j}.{c}")
    for k in range(1, WIDEST + 1):
        left, right = at("v", -1), at("v", k)
        vs = [at("v", j) for j in range(k)]
        top, bottom = (F.greatest(*vs), F.least(*vs)) if k > 1 else (vs[0], vs[0])
        out = F.greatest(bottom - F.greatest(left, right), F.least(left, right) - top)
        p = p.withColumns({f"out_{k}": F.when(out > 0, out).cast("float"), f"_slope_{k}": F.try_divide(right - left, at("t", k) - at("t", -1))})
    for k in range(1, WIDEST + 1):
        left, slope = at("v", -1), F.col(f"_slope_{k}")
        away = lambda j: at("v", j) - left - slope * (at("t", j) - at("t", -1))  # noqa: B023, E731
        leaves = F.col(f"out_{k}").isNotNull()
        if k == 1:
            dev = F.abs(away(0))
        else:
            # the readings lie outside both neighbours, so all on one side of the line
            dev = F.when(leaves, F.least(*(F.abs(away(j)) for j in range(k))))
        misfit = F.when(leaves, F.greatest(F.coalesce(F.abs(away(-2)), F.lit(0.0)), F.coalesce(F.abs(away(k + 1)), F.lit(0.0))))
        p = p.withColumns({f"dev_{k}": dev.cast("float"), f"near_{k}": misfit.cast("float")})
    step = F.col("v") - at("v", -1)
    calm = F.greatest(F.lit(0.0), *(F.coalesce(F.signum(step) * x, F.lit(0.0)) for x in (at("v", -1) - at("v", -2), at("v", 1) - F.col("v"))))
    p = p.withColumns({"_step": step, "_calm": calm, "rate": F.abs(F.try_divide(step, F.col("t") - at("t", -1))).cast("float")})
    stands = F.abs("_step") > F.col("_calm")
    p = p.withColumns({"step": F.when(stands, F.col("_step")), "calm": F.when(stands, F.col("_calm")).cast("float"), "from": F.when(stands, F.col("b1.at"))})
    later = [F.when(F.coalesce(*(F.col(f"out_{j}") for j in range(k + 1, WIDEST + 1))).isNotNull(), F.col(f"a{k}.at")).alias(f"at_{k}") for k in range(1, WIDEST)]
    measures = [f"{c}_{k}" for k in range(1, WIDEST + 1) for c in ("dev", "near", "out")]
    return p.select("series", "source", "at", "v", "run", "rate", "step", "calm", "from", *measures, *later)


def usual(shaped: DataFrame) -> DataFrame:
    """(source, band, fence, rate_fence, usual_run): per source and band of hours the upper fence of deviations, of change per second and of run lengths.

    Quantile sketches (KLL) are built on every partition and merged: per source and band, per source from those of its
    bands, and for all from those of the sources. The fence is q75 plus once the interquartile range of single
    readings' deviations, or of their rates; callers expand it. Where a band saw too little the source's sketch holds, and so on.
    """
    band = F.floor(F.hour(F.col("at").cast("timestamp")) * HOUR_BANDS / 24).cast("int")
    runs = F.when((F.col("v") > 0), F.col("run").cast("double"))
    fine = shaped.groupBy("source", band.alias("band")).agg(
        F.count_if(F.col("dev_1") > 0).alias("n"), F.kll_sketch_agg_double(F.when(F.col("dev_1") > 0, F.col("dev_1")), SKETCH).alias("dev"),
        F.count_if(F.col("rate") > 0).alias("n_rates"), F.kll_sketch_agg_double(F.when(F.col("rate") > 0, F.col("rate")), SKETCH).alias("rates"),
        F.count(runs).alias("n_runs"), F.kll_sketch_agg_double(runs, SKETCH).alias("runs"))
    fine = SharedTable(fine, "sketches").read()
    coarse = fine.groupBy("source").agg(F.sum("n").alias("n_s"), F.kll_merge_agg_double("dev", SKETCH).alias("dev_s"), F.sum("n_rates").alias("n_rates_s"), F.kll_merge_agg_double("rates", SKETCH).alias("rates_s"), F.sum("n_runs").alias("n_runs_s"), F.kll_merge_agg_double("runs", SKETCH).alias("runs_s"))

    def fence(sketch: str) -> Column:
        q = F.kll_sketch_get_quantile_double(sketch, F.array(F.lit(0.25), F.lit(0.75)))
        return 2 * q[1] - q[0]

    def long(sketch: str) -> Column:
        # readings are counted, not runs, so a run weighs as much as it is long: its median is what readings usually see
        return F.kll_sketch_get_quantile_double(sketch, F.lit(0.5))

    # one row of four numbers for all sources; the sketches themselves are merged where they are
    total = coarse.agg(F.sum("n_s").alias("n"), F.kll_merge_agg_double("dev_s", SKETCH).alias("dev"), F.sum("n_rates_s").alias("n_rates"), F.kll_merge_agg_double("rates_s", SKETCH).alias("rates"), F.sum("n_runs_s").alias("n_runs"), F.kll_merge_agg_double("runs_s", SKETCH).alias("runs"))
    every = total.select(F.when(F.col("n") > 0, fence("dev")).alias("fence"), F.when(F.col("n_rates") > 0, fence("rates")).alias("rate"), F.when(F.col("n_runs") > 0, long("runs")).alias("run")).first()
    of_all = {k: F.lit(v).cast("double") for k, v in every.asDict().items()}
    return fine.join(coarse, "source").select(
        "source", "band",
        F.when(F.col("n") >= LEAST_CONTEXT, fence("dev")).when(F.col("n_s") >= LEAST_SOURCE, fence("dev_s")).otherwise(of_all["fence"]).alias("fence"),
        F.when(F.col("n_rates") >= LEAST_CONTEXT, fence("rates")).when(F.col("n_rates_s") >= LEAST_SOURCE, fence("rates_s")).otherwise(of_all["rate"]).alias("rate_fence"),
        F.when(F.col("n_runs_s") >= LEAST_SOURCE, long("runs_s")).otherwise(of_all["run"]).alias("usual_run"),
    )


def wide_spikes(edges: DataFrame, points: DataFrame, expand: float) -> DataFrame:
    """(series, at): the readings of spikes of more than WIDEST readings, found between the steps at their ends.

    ``edges``: series, at, v, step, fence; ``points``: series, at, v. A spike starts at a step and ends before the first
    step back within LONGEST seconds; all its readings lie outside the values before and after it by over ``expand``
    fences. What lies between two spikes is none, though it starts and ends with such steps too.
    """
    bucket = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / LONGEST)
    side = F.signum("step")
    first = edges.select("series", F.col("at").alias("a"), F.col("v").alias("v_a"), side.alias("side"), (F.col("v") - F.col("step")).alias("before"), "fence")
    first = first.withColumn("bucket", F.explode(F.array(bucket("a"), bucket("a") + 1)))
    last = edges.select("series", F.col("at").alias("b"), F.col("v").alias("after"), side.alias("back"), bucket("at").alias("bucket"))
    seconds = F.unix_seconds(F.col("b").cast("timestamp")) - F.unix_seconds(F.col("a").cast("timestamp"))
    least = expand * F.col("fence")
    pairs = first.join(last, ["series", "bucket"]).where((F.col("back") == -F.col("side")) & (F.col("b") > F.col("a")) & (seconds <= LONGEST) & (F.col("side") * (F.col("v_a") - F.col("after")) > least))
    pairs = pairs.groupBy("series", "a").agg(F.min_by(F.struct("b", "after", "side", "before", "fence"), "b").alias("x")).select("series", "a", "x.*")
    # of pairs that follow on each other every second one is a way back
    w = W.partitionBy("series").orderBy("a")
    pairs = pairs.withColumn("_new", F.when(F.lag("b").over(w) == F.col("a"), 0).otherwise(1)).withColumn("_chain", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    pairs = pairs.withColumn("_no", F.row_number().over(W.partitionBy("series", "_chain").orderBy("a"))).where("_no % 2 = 1")
    pairs = pairs.withColumn("bucket", F.explode(F.sequence(bucket("a"), bucket("b"))))
    held = points.withColumn("bucket", bucket("at")).join(pairs, ["series", "bucket"]).where((F.col("at") >= F.col("a")) & (F.col("at") < F.col("b")))
    of = W.partitionBy("series", "a")
    out = F.col("side") * F.col("v") - F.greatest(F.col("side") * F.col("before"), F.col("side") * F.col("after"))
    held = held.withColumn("_n", F.count("*").over(of)).withColumn("_out", F.min(out).over(of))
    return held.where((F.col("_n") > WIDEST) & (F.col("_out") > least)).select("series", "at")


def flag_spikes(
    readings: DataFrame, source: str = "vehicle_id", series: str = "timeseries_path", at: str = "timestamp", value: str = "vEgo", ident: str = "reading_id",
    low: float = 0.0, high: float = 90.0, expand: float = 4.5, contrast: float = 2.2, outside: float = 0.2, stuck_factor: float = 4.0, stuck_least: int = 9, piece: int = PIECE,
) -> DataFrame:
    """(ident, kind): the readings that cannot be true, one row each; kind is the first of KINDS that applies.

    impossible: under ``low``, over ``high`` or infinite. The others are judged in time order within a series, resent
    copies once, without null, NaN and impossible values. spike: up to WIDEST readings that leave the line between
    their neighbours by over ``expand`` fences of the source (see usual) and ``contrast`` times what fence and next
    neighbours explain, outside both neighbours' values; or any number of them within LONGEST seconds between a step
    and the step back (see wide_spikes), each over ``expand`` fences of the source in value and in change per second
    and over ``contrast`` times what fence and the steps next to it explain. stuck: a run of one value over 0 of at least ``stuck_least``
    readings and over ``stuck_factor`` times the source's usual run. jump: the reading after a step, judged like those at
    the ends of a spike, that isn't taken back. All copies of a flagged reading are flagged.
    Copies that differ in value are judged by their largest. Null series or times: only the impossible ones come out.
    """
    r = readings.select(F.col(ident).alias("_id"), F.col(series).alias("series"), F.col(source).alias("source"), F.col(at).alias("at"), F.col(value).cast("double").alias("v"))
    r = r.where("v is not null and not isnan(v)")
    possible = (F.col("v") >= low) & (F.col("v") <= high)
    points = r.where(possible & F.col("series").isNotNull() & F.col("at").isNotNull()).drop("_id")
    shaped = SharedTable(shapes(points, piece), "shapes").read()
    band = F.floor(F.hour(F.col("at").cast("timestamp")) * HOUR_BANDS / 24).cast("int")
    some = F.coalesce(*(F.col(f"out_{k}") for k in range(1, WIDEST + 1))).isNotNull()
    # only readings that could be cases go on: everything else was summed up in the sketches
    able = shaped.where(some | (F.col("run") >= stuck_least) | (F.abs("step") > contrast * F.col("calm"))).withColumn("band", band)
    judged = able.join(usual(shaped), ["source", "band"])
    spike = lambda k: (F.col(f"out_{k}") >= outside * F.col(f"dev_{k}")) & (F.col(f"dev_{k}") > expand * F.col("fence")) & (
        F.col(f"dev_{k}") > contrast * (F.col("fence") + F.col(f"near_{k}")))
    stuck = (F.col("v") > 0) & (F.col("run") >= stuck_least) & (F.col("run") > stuck_factor * F.least(F.col("usual_run"), F.lit(1e9)))
    # a spike of k readings is known at its first one; its length is the longest that holds
    length = F.when(spike(WIDEST), WIDEST)
    for k in range(WIDEST - 1, 0, -1):
        length = length.when(spike(k), k)
    edge = (F.abs("step") > expand * F.col("fence")) & (F.abs("step") > contrast * (F.col("fence") + F.col("calm"))) & (F.col("rate") > expand * F.col("rate_fence"))
    judged = judged.withColumn("_len", length).withColumn("_stuck", stuck).withColumn("_edge", F.coalesce(edge, F.lit(False)))
    judged = SharedTable(judged.where(F.col("_len").isNotNull() | F.col("_stuck") | F.col("_edge")).select("series", "at", "v", "step", "from", "fence", "_len", "_stuck", "_edge", *(f"at_{k}" for k in range(1, WIDEST))), "judged").read()
    times = F.array("at", *(f"at_{k}" for k in range(1, WIDEST)))
    spiked = judged.where("_len is not null").select("series", F.explode(F.slice(times, 1, F.col("_len"))).alias("at"), F.lit(1).alias("k"))
    held = judged.where("_stuck").select("series", "at", F.lit(2).alias("k"))
    narrow = spiked.unionByName(held)
    # a step from or to a reading that is wrong by itself says nothing about the readings on its other side
    edges = judged.where("_edge").join(narrow, ["series", "at"], "left_anti").join(narrow.select("series", F.col("at").alias("from")), ["series", "from"], "left_anti")
    edges = SharedTable(edges.select("series", "at", "from", "v", "step", "fence"), "edges").read()
    wide = SharedTable(wide_spikes(edges, shaped.select("series", "at", "v"), expand), "wide").read()
    # a step neither into nor out of a spike
    jumps = edges.join(wide, ["series", "at"], "left_anti").join(wide.select("series", F.col("at").alias("from")), ["series", "from"], "left_anti")
    cases = narrow.unionByName(wide.withColumn("k", F.lit(1))).unionByName(jumps.select("series", "at", F.lit(3).alias("k"))).groupBy("series", "at").agg(F.min("k").alias("k"))
    out = r.where(possible).join(cases, ["series", "at"]).select("_id", "k").unionByName(r.where(~possible).select("_id", F.lit(0).alias("k")))
    return out.select(F.col("_id").alias(ident), F.element_at(F.array(*(F.lit(k) for k in KINDS)), F.col("k") + 1).alias("kind"))
