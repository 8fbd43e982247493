"""Per-pixel time series.

A pixel's series has one value per time index, so its length is bounded by the layer's time
axis. Windows are partitioned by pixel and band, never by band or layer alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bands import stretch
from ..functions.kernels import savgol_weights
from ..functions.timeindex import DAY, STEP_DAYS, STEPS_PER_YEAR, slot_before
from ..plans.joins import small_join, summary_join

SERIES_KEY = ["layer", "col", "row", "band"]

#: errors this close to the least, relative to it or (tighter) to the series' own sum of squares, count
#: as tied: the last bits of a sum are noise
TIE, TIE_OF_ENERGY = 1e-9, 1e-15

#: (window, degree) choices that smooth; window = degree + 1 interpolates and is left out
SAVGOL_CHOICES = [(4, 2), (5, 2), (5, 3)]


def pixel_series(cells: DataFrame) -> DataFrame:
    """Per pixel and band: the array of (time_index, value), in time order."""
    return (
        cells.filter(F.col("value").isNotNull())
        .groupBy(*SERIES_KEY)
        .agg(F.sort_array(F.collect_list(F.struct("time_index", "value"))).alias("series"))
    )


def _smoothed(window: int, degree: int, by_time) -> Column:
    half = window // 2
    total = None
    for offset, weight in sorted(savgol_weights(window, degree).items()):
        shifted = F.col("value") if offset == 0 else F.lead("value", offset).over(by_time)
        term = shifted * F.lit(weight)
        total = term if total is None else total + term
    edge = F.lag(F.lit(1), half).over(by_time).isNull() | F.lead(F.lit(1), half).over(by_time).isNull()
    return F.when(edge, F.col("value")).otherwise(total)


def savgol(cells: DataFrame, window: int = 5, degree: int = 2) -> DataFrame:
    """Savitzky-Golay smoothing along time; the first and last window // 2 points stay.

    Positions are ranks in time within the pixel. Cells without a value take no part.
    """
    if window < 3 or degree >= window:
        raise ValueError("need window >= 3 and degree < window")
    by_time = Window.partitionBy(*SERIES_KEY).orderBy("time_index")
    valid = cells.filter(F.col("value").isNotNull())
    return valid.withColumn("value", _smoothed(window, degree, by_time)).select(*cells.columns)


def savgol_auto(cells: DataFrame, choices: list[tuple[int, int]] | None = None) -> DataFrame:
    """Savitzky-Golay with the choice of least squared error per pixel; the first wins ties.

    All fits and errors use one sort of each pixel's series.
    """
    choices = choices or SAVGOL_CHOICES
    by_time = Window.partitionBy(*SERIES_KEY).orderBy("time_index")
    whole = Window.partitionBy(*SERIES_KEY)
    fits = cells.filter(F.col("value").isNotNull()).withColumns(
        {f"_f{i}": _smoothed(w, p, by_time) for i, (w, p) in enumerate(choices)}
    )
    errors = fits.withColumns(
        {
            f"_e{i}": F.sum((F.col(f"_f{i}") - F.col("value")) * (F.col(f"_f{i}") - F.col("value"))).over(whole)
            for i in range(len(choices))
        }
    )
    errors = errors.withColumn("_energy", F.sum(F.col("value") * F.col("value")).over(whole))
    least = F.least(*[F.col(f"_e{i}") for i in range(len(choices))])
    pick, w_pick, p_pick = F.lit(None).cast("double"), F.lit(None).cast("int"), F.lit(None).cast("int")
    for i in reversed(range(len(choices))):
        hit = F.col(f"_e{i}") <= least * (1.0 + TIE) + F.col("_energy") * TIE_OF_ENERGY
        pick = F.when(hit, F.col(f"_f{i}")).otherwise(pick)
        w_pick = F.when(hit, F.lit(choices[i][0])).otherwise(w_pick)
        p_pick = F.when(hit, F.lit(choices[i][1])).otherwise(p_pick)
    keep = [c for c in cells.columns if c != "value"]
    return errors.select(*keep, pick.alias("value"), w_pick.alias("window"), p_pick.alias("degree"))


def minmax_stretch(cells: DataFrame, by: list[str]) -> DataFrame:
    """Values to 0..255 by the range of their group, as an int column `stretched`.

    The range is a partially aggregated summary joined back, so a group as large as a band is
    never brought into one task.
    """
    ranges = cells.groupBy(*by).agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    joined = summary_join(cells, ranges, by)
    return joined.withColumn("stretched", stretch("value", "_lo", "_hi")).drop("_lo", "_hi")


def minmax_stretch_series(cells: DataFrame) -> DataFrame:
    """Stretch each pixel's own series; the series is short, so a window does."""
    whole = Window.partitionBy(*SERIES_KEY)
    return cells.withColumn(
        "stretched", stretch("value", F.min("value").over(whole), F.max("value").over(whole))
    )


def latest_per_cell(cells: DataFrame, from_time: int | None = None, to_time: int | None = None) -> DataFrame:
    """Most recent non-null value of each cell within an optional time range (closed)."""
    ranged = time_range(cells, from_time, to_time).filter(F.col("value").isNotNull())
    last = F.max(F.struct("time_index", "value")).alias("_l")
    return (
        ranged.groupBy(*SERIES_KEY)
        .agg(last)
        .select(*SERIES_KEY, F.col("_l.time_index").alias("time_index"), F.col("_l.value").alias("value"))
    )


def time_range(df: DataFrame, start=None, end=None, column: str = "time_index") -> DataFrame:
    """Closed time range; a bound that is None is not applied."""
    if start is not None:
        df = df.filter(F.col(column) >= F.lit(start))
    if end is not None:
        df = df.filter(F.col(column) <= F.lit(end))
    return df


def band_to_timestep(cells: DataFrame, step_days: int = STEP_DAYS, steps: int | None = None) -> DataFrame:
    """Year files whose bands are time steps: band i of a file starting at t0 is t0 + (i-1) steps.

    All bands are taken. Where the caller states how many steps a file has (a year of ten-day steps has STEPS_PER_YEAR), a band
    beyond them is an error.
    """
    band = F.col("band")
    if steps is not None:
        beyond = F.raise_error(F.concat(F.lit("band "), band.cast("string"), F.lit(f" is beyond {steps} steps")))
        band = F.when(band <= steps, band).otherwise(beyond)
    return cells.withColumn("time_index", F.col("time_index") + (band - 1).cast("bigint") * (step_days * DAY)).withColumn("band", F.lit(1))


def timestep_slots(cells: DataFrame, step_days: int = STEP_DAYS) -> DataFrame:
    """Adds `slot`: whole steps before the latest time of the layer."""
    latest = cells.groupBy("layer").agg(F.max("time_index").alias("_latest"))
    return (
        summary_join(cells, latest, ["layer"])
        .withColumn("slot", slot_before("time_index", "_latest", step_days))
        .drop("_latest")
    )


def pixel_drill(points: DataFrame, cells: DataFrame, grid, start=None, end=None, fill: float = 0.0) -> DataFrame:
    """Values under each point (point_id, lon, lat) for each time and band; no value reads as `fill`."""
    located = points.select(
        "point_id", grid.col_of("lon").alias("col"), grid.row_of("lat").alias("row")
    )
    ranged = time_range(cells, start, end)
    value = F.coalesce(F.nanvl("value", F.lit(fill)), F.lit(fill))
    return small_join(ranged, located, ["col", "row"], ["point_id"]).withColumn("value", value)
