"""Irregular readings onto a regular grid; missing cells filled by low-rank factors of the matrix of sources by steps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brookmill.session import SharedTable

#: Status of a cell: a reading was there, a value was estimated, or too few readings support one.
OBSERVED, FILLED, UNSUPPORTED = "observed", "filled", "unsupported"
#: Steps are kept in blocks of WIDTH, each with the REACH steps on both sides of it, so no series is one record or task.
WIDTH, REACH, RANK = 16, 8, 3
SPAN = WIDTH + 2 * REACH
#: One observed cell in so many is left out of the fit and tells whether factors hold: their squared error must be under
#: TRUST of what the source's mean leaves.
HELD_OUT, TRUST = 20, 0.8
#: Weight of the ridge, times the observed cells of a row or column.
RIDGE = 0.02


def grid_cells(readings: DataFrame, series: DataFrame, key: str = "timeseries_path", at: str = "timestamp", value: str = "vEgo") -> DataFrame:
    """(key, kind, block, steps, values ARRAY<DOUBLE>, seen ARRAY<BOOLEAN>): the observed means on each series' grid, in blocks of WIDTH steps.

    ``series``: key (unique), started_at, step_ms, n_steps. Step k covers started_at + k * step_ms, included, to the
    next step, excluded, and holds the mean of its readings that are neither null, NaN nor infinite; other cells are
    null. Every step of every series with n_steps > 0 and step_ms > 0 has a cell, series without readings too; a
    reading outside the grid or of an unknown series is not used. Times are compared in whole microseconds. ``values``
    has the block's cells and REACH on both sides, null where there are none. ``kind`` is the step length.
    """
    spec = series.where("n_steps > 0 and step_ms > 0 and started_at is not null").select(key, "started_at", "step_ms", "n_steps")
    v = F.col(value)
    r = readings.where(v.isNotNull() & ~F.isnan(v)).select(key, F.col(at).alias("_at"), v.alias("_v"))
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    step = F.floor((us(F.col("_at")) - us(F.col("started_at"))) / (F.col("step_ms").cast("bigint") * 1000))
    on = r.join(spec, key).withColumn("_step", step).where("_step >= 0 and _step < n_steps")
    # an infinite reading makes the step observed, as it is neither null nor NaN, but gives the mean no value
    finite = F.when(F.abs("_v") < F.lit(float("inf")), F.col("_v"))
    cells = on.groupBy(key, F.floor(F.col("_step") / WIDTH).alias("block"), (F.col("_step") % WIDTH).cast("int").alias("_j")).agg(F.avg(finite).alias("_m"))
    # each cell goes to its own block and to the one beside it that it is in reach of
    cell = lambda n, j: F.struct((F.col("block") + n).alias("block"), (j + REACH).alias("j"))
    beside = F.when(F.col("_j") < REACH, cell(-1, F.col("_j") + WIDTH)).otherwise(cell(1, F.col("_j") - WIDTH))
    rows = cells.select(key, "_m", F.explode(F.array(cell(0, F.col("_j")), beside)).alias("x")).groupBy(key, F.col("x.block").alias("block")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("x.j"), "_m"))).alias("_cells"))
    frame = spec.select(key, "step_ms", "n_steps", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n_steps") - 1) / WIDTH).cast("bigint"))).alias("block"))
    joined = frame.join(rows, [key, "block"], "left")
    return joined.select(
        key, F.col("step_ms").cast("bigint").alias("kind"), "block", F.least(F.lit(WIDTH), F.col("n_steps") - F.col("block") * WIDTH).cast("int").alias("steps"),
        F.transform(F.sequence(F.lit(0), F.lit(SPAN - 1)), lambda j: F.try_element_at("_cells", j)).alias("values"),
        F.transform(F.sequence(F.lit(REACH), F.lit(REACH + WIDTH - 1)), lambda j: F.coalesce(F.map_contains_key("_cells", j), F.lit(False))).alias("seen"),
    )


N_SUMS = RANK * RANK + RANK + 1
_SUMS = [f"s{k}" for k in range(N_SUMS)]


def _stack(values: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, dtype=float) for x in values]) if len(values) else np.zeros((0, 1))


def _held(keys: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Which cells of each block are left out of the fit: the same ones in every pass."""
    h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + block.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    h = (h[:, None] + np.arange(WIDTH, dtype=np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(40)) % np.uint64(HELD_OUT) == 0


def _products(x: np.ndarray, other: np.ndarray) -> np.ndarray:
    """What a cell adds to the normal equations of its row or column: outer product, side and count of ``other`` (.., RANK)."""
    seen = ~np.isnan(x)
    outer = (other[..., :, None] * other[..., None, :]).reshape(*other.shape[:-1], RANK * RANK)
    out = np.concatenate([outer, np.where(seen, x, 0.0)[..., None] * other, np.ones((*x.shape, 1))], axis=-1)
    return out * seen[..., None]


def _solve(sums: np.ndarray) -> np.ndarray:
    gram, side, n = sums[:, : RANK * RANK].reshape(-1, RANK, RANK), sums[:, RANK * RANK : -1], sums[:, -1]
    return np.linalg.solve(gram + (RIDGE * n + 1e-6)[:, None, None] * np.eye(RANK), side[..., None])[..., 0]


def _fit_cells(pdf: pd.DataFrame) -> np.ndarray:
    """The block's own cells, levelled by the source's mean and spread, those held out missing."""
    x = (_stack(pdf["values"])[:, REACH : REACH + WIDTH] - pdf["mean"].to_numpy()[:, None]) / pdf["spread"].to_numpy()[:, None]
    return np.where(_held(pdf["_h"].to_numpy(), pdf["block"].to_numpy()), np.nan, x)


def source_levels(cells: DataFrame, key: str) -> DataFrame:
    """(key, mean, spread) of the observed cells of each source; one without any has none, one without spread has 1."""
    own = F.filter(F.slice("values", REACH + 1, WIDTH), lambda v: v.isNotNull())
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q"))
    x = cells.select(key, F.size(own).alias("n"), F.aggregate(own, zero, lambda a, v: F.struct((a["s"] + v).alias("s"), (a["q"] + v * v).alias("q"))).alias("x"))
    x = x.groupBy(key).agg(F.sum("n").alias("n"), F.sum("x.s").alias("s"), F.sum("x.q").alias("q")).where("n > 0").withColumn("mean", F.col("s") / F.col("n"))
    spread = F.sqrt(F.greatest(F.col("q") / F.col("n") - F.col("mean") * F.col("mean"), F.lit(0.0)))
    return x.select(key, "mean", F.when(spread > 1e-9, spread).otherwise(1.0).alias("spread"))


def fit_factors(cells: DataFrame, key: str, rounds: int = 3) -> tuple[DataFrame, DataFrame]:
    """Source factors (key, u) and time factors (kind, block, v, n) by alternating least squares.

    Rows of the matrix are the sources, columns the steps of one kind of grid, both levelled by source. A round solves
    all source factors from the time factors and then all time factors from the source factors; what either needs are
    sums of RANK**2 + RANK + 1 numbers a row or column, added up within tasks before they are shuffled. Neither cells nor
    factors go to the driver; the time factors are written, as each round reads the last. ``cells`` has mean and
    spread of its source.
    """
    some = cells.where("mean is not null").select(key, "kind", "block", "values", "mean", "spread", "_h")
    schema = ", ".join(f"{s} double" for s in _SUMS)

    def start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            v = [np.random.default_rng([int(k) & 0xFFFFFFFF, int(b)]).normal(size=WIDTH * RANK) for k, b in zip(pdf["kind"], pdf["block"])]
            yield pd.DataFrame({"kind": pdf["kind"], "block": pdf["block"], "v": v, "n": [np.zeros(WIDTH)] * len(v)})

    def row_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                sums = _products(_fit_cells(pdf), _stack(pdf["v"]).reshape(-1, WIDTH, RANK)).sum(axis=1)
                yield pd.DataFrame(sums, columns=_SUMS).assign(key=pdf[key].to_numpy())

    def column_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                u = _stack(pdf["u"])
                each = _products(_fit_cells(pdf), np.broadcast_to(u[:, None, :], (len(u), WIDTH, RANK)))
                code = pdf.groupby(["kind", "block"], sort=False).ngroup().to_numpy()
                sums = np.zeros((code.max() + 1, WIDTH, N_SUMS))
                np.add.at(sums, code, each)
                first = pdf.drop_duplicates(["kind", "block"])
                yield pd.DataFrame(sums.reshape(-1, N_SUMS), columns=_SUMS).assign(kind=np.repeat(first["kind"].to_numpy(), WIDTH), block=np.repeat(first["block"].to_numpy(), WIDTH), j=np.tile(np.arange(WIDTH), len(first)))

    def solve(names: list[str], out: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    yield pdf[names].assign(n=pdf[_SUMS[-1]], **{out: list(_solve(pdf[_SUMS].to_numpy()))})

        return run

    total = [F.sum(s).alias(s) for s in _SUMS]
    kind_of_key = cells.schema[key].dataType.simpleString()
    v = SharedTable(some.select("kind", "block").distinct().mapInPandas(start, "kind bigint, block bigint, v array<double>, n array<double>"), "times").read()
    u = None
    for k in range(rounds):
        sums = some.join(v.drop("n"), ["kind", "block"]).mapInPandas(row_sums, f"{schema}, key {kind_of_key}").groupBy("key").agg(*total)
        u = sums.mapInPandas(solve(["key"], "u"), f"key {kind_of_key}, n double, u array<double>").select(F.col("key").alias(key), "u", F.col("n").alias("n_row"))
        if k == rounds - 1:  # before, each is read once only, by the time factors solved from it
            u = SharedTable(u, "sources").read()
        sums = some.join(u, key).mapInPandas(column_sums, f"{schema}, kind bigint, block bigint, j int").groupBy("kind", "block", "j").agg(*total)
        each = sums.mapInPandas(solve(["kind", "block", "j"], "v"), "kind bigint, block bigint, j int, n double, v array<double>")
        sorted_ = F.array_sort(F.collect_list(F.struct("j", "v", "n")))
        v = SharedTable(each.groupBy("kind", "block").agg(sorted_.alias("x")).select("kind", "block", F.flatten("x.v").alias("v"), F.col("x.n").alias("n")), "times").read()
    return u, v


def trusted(cells: DataFrame, u: DataFrame, v: DataFrame, key: str) -> DataFrame:
    """(kind, holds): whether factors explain the cells that were held out of their fit better than a source's mean does."""

    def errors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = (_stack(pdf["values"])[:, REACH : REACH + WIDTH] - pdf["mean"].to_numpy()[:, None]) / pdf["spread"].to_numpy()[:, None]
                x = np.where(_held(pdf["_h"].to_numpy(), pdf["block"].to_numpy()), x, np.nan)
                guess = np.einsum("njr,nr->nj", _stack(pdf["v"]).reshape(-1, WIDTH, RANK), _stack(pdf["u"]))
                yield pd.DataFrame({"kind": pdf["kind"], "model": np.nansum((x - guess) ** 2, axis=1), "level": np.nansum(x**2, axis=1)})

    on = cells.where("mean is not null").join(u, key).join(v.drop("n"), ["kind", "block"])
    sums = on.select("kind", "block", "values", "mean", "spread", "_h", "u", "v").mapInPandas(errors, "kind bigint, model double, level double").groupBy("kind").agg(F.sum("model").alias("m"), F.sum("level").alias("l"))
    return sums.select("kind", (F.col("m") < TRUST * F.col("l")).alias("holds"))


def _with_reach(v: DataFrame) -> DataFrame:
    """(kind, block, v, n): the factors of a block's steps and of REACH on both sides, 0 where there are none."""
    near = v.select("kind", F.posexplode(F.array(*(F.struct((F.col("block") - d).alias("block"), F.lit(d).alias("d")) for d in (-1, 0, 1)))).alias("_", "x"), "v", "n")
    sides = near.select("kind", "x.block", "x.d", "v", "n").groupBy("kind", "block").agg(*(F.max(F.when(F.col("d") == d, F.struct("v", "n"))).alias(f"_{d + 1}") for d in (-1, 0, 1)))
    none = F.array_repeat(F.lit(0.0), WIDTH * RANK)
    left = F.slice(F.coalesce("_0.v", none), (WIDTH - REACH) * RANK + 1, REACH * RANK)
    right = F.slice(F.coalesce("_2.v", none), 1, REACH * RANK)
    return sides.where("_1 is not null").select("kind", "block", F.concat(left, F.col("_1.v"), right).alias("v"), F.col("_1.n").alias("n"))


def near_residuals(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What known residuals (NaN elsewhere) say about each place of a row: on the line between the known ones on both
    sides, or falling to nothing within REACH where there is one side only; and whether one is within REACH."""
    n, width = r.shape
    place = np.arange(width)
    known = ~np.isnan(r)
    left = np.maximum.accumulate(np.where(known, place, -1), axis=1)
    right = np.minimum.accumulate(np.where(known, place, width)[:, ::-1], axis=1)[:, ::-1]
    row = np.arange(n)[:, None]
    a, b = np.where(left >= 0, r[row, np.maximum(left, 0)], 0.0), np.where(right < width, r[row, np.minimum(right, width - 1)], 0.0)
    to_left, to_right = place - left, right - place
    both = (left >= 0) & (right < width)
    share = np.where(both & (left < right), to_left / np.maximum(right - left, 1), 0.0)
    fade = lambda d: np.clip(1 - (d - 1) / REACH, 0, 1)
    one = np.where(left >= 0, a * fade(to_left), np.where(right < width, b * fade(to_right), 0.0))
    close = ((left >= 0) & (to_left <= REACH)) | ((right < width) & (to_right <= REACH))
    return np.where(both, a * (1 - share) + b * share, one), close


def regular_grid(
    readings: DataFrame, series: DataFrame, key: str = "timeseries_path", at: str = "timestamp", value: str = "vEgo", rounds: int = 3
) -> DataFrame:
    """(key, step BIGINT, value DOUBLE, status): one row per nominal step of every series.

    Observed cells keep their mean exactly. The matrix of sources by steps is factorised (fit_factors); a missing cell
    is what its source's and its step's factors say plus what the source's observed cells within REACH differ from
    theirs. Where factors don't hold on cells held out (trusted), the source's mean stands in for them, so that missing
    cells lie on the line between the observed ones. A missing cell is supported if its source has more than RANK
    observed cells and either one of them is within REACH steps, or factors hold and more than RANK sources are
    observed at its step; all others are marked unsupported and null. Empty inputs give no rows; repeated readings
    enter the mean; ``series`` must have one row per key.
    """
    kept = SharedTable(grid_cells(readings, series, key, at, value), "grid").read()
    levels = SharedTable(source_levels(kept, key), "levels").read()
    cells = kept.join(levels, key, "left").withColumn("_h", F.xxhash64(key).bitwiseAND(F.lit((1 << 62) - 1)))
    u, v = fit_factors(cells, key, rounds)
    holds = trusted(cells, u, v, key)

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            mean, spread = pdf["mean"].to_numpy(dtype=float)[:, None], pdf["spread"].to_numpy(dtype=float)[:, None]
            x = _stack(pdf["values"])
            known = ~np.isnan(x)
            has = (pdf["u"].notna() & pdf["v"].notna() & pdf["holds"].fillna(False).astype(bool)).to_numpy()
            model = np.zeros(x.shape)
            if has.any():
                some = pdf[has]
                model[has] = np.einsum("njr,nr->nj", _stack(some["v"]).reshape(-1, SPAN, RANK), _stack(some["u"]))
            model = mean + spread * model
            rest, close = near_residuals(np.where(known, x - model, np.nan))
            own = slice(REACH, REACH + WIDTH)
            seen = _stack(pdf["seen"]).astype(bool)
            enough = (pdf["n_row"].fillna(0).to_numpy() > RANK)[:, None]
            column = np.zeros(seen.shape)
            if has.any():
                column[has] = _stack(pdf["n"][has])
            able = enough & (close[:, own] | (has[:, None] & (column > RANK)))
            status = np.where(seen, OBSERVED, np.where(able, FILLED, UNSUPPORTED))
            out = np.where(known[:, own], x[:, own], np.where(able & ~seen, (model + rest)[:, own], np.nan))
            inside = np.arange(WIDTH)[None, :] < pdf["steps"].to_numpy()[:, None]
            step = pdf["block"].to_numpy()[:, None] * WIDTH + np.arange(WIDTH)[None, :]
            yield pd.DataFrame({key: np.repeat(pdf[key].to_numpy(), inside.sum(axis=1)), "step": step[inside], "value": out[inside], "status": status[inside]})

    counts = kept.select(key, F.size(F.filter(F.slice("values", REACH + 1, WIDTH), lambda c: c.isNotNull())).alias("n")).groupBy(key).agg(F.sum("n").alias("n_row"))
    full = cells.join(u.drop("n_row"), key, "left").join(counts, key, "left").join(_with_reach(v), ["kind", "block"], "left").join(holds, "kind", "left")
    cols = [key, "block", "steps", "values", "seen", "mean", "spread", "u", "n_row", "v", "n", "holds"]
    out = full.select(cols).mapInPandas(fill, f"`{key}` {kept.schema[key].dataType.simpleString()}, step bigint, value double, status string")
    return out.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def clip_series(clips: DataFrame, manifest: DataFrame) -> DataFrame:
    """The grid of each clip: its start and nominal step, and as many steps as the manifest's ts_shape says.

    Manifest rows count by exactly the clip's timeseries_path; of several shapes the longest holds, and a clip without
    any is left out, as is one whose shape has no positive first element.
    """
    steps = manifest.where("timeseries_path is not null and ts_shape is not null").groupBy("timeseries_path").agg(F.max(F.try_element_at("ts_shape", F.lit(1))).cast("bigint").alias("n_steps"))
    return clips.select("timeseries_path", "started_at", "step_ms").join(steps, "timeseries_path").where("n_steps > 0")
