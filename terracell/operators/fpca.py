"""Rank-1 functional PCA of a time x pixel matrix, without centring.

M has one row per time step (N, small) and one column per pixel (T, unbounded). Only the N x N
second-moment matrix G = M M' / T is brought together. With G v = s^2 v, the component of
pixel p is sum_i M[i,p] v_i / s and the score of step i is v_i s.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bands import stretch
from ..plans.joins import summary_join
from .series import timestep_slots

MAX_STEPS = 512


def layer_steps(cells: DataFrame, step: str = "time_index", max_steps: int = MAX_STEPS) -> list[int]:
    """The distinct steps of a layer, ascending; an error beyond max_steps, which the caller may raise: the matrix that is
    brought together has max_steps squared entries."""
    found = [r[0] for r in cells.select(step).distinct().limit(max_steps + 1).collect()]
    if len(found) > max_steps:
        raise ValueError(f"more than {max_steps} time steps")
    return sorted(found)


def fpca_gram(cells: DataFrame, step: str = "time_index", steps: list[int] | None = None, pixel: list[str] | None = None) -> DataFrame:
    """Upper triangle of G as (i, j, g) over positions of the sorted steps.

    Pixels are brought together once (at most N values each); every task reduces its
    pixels to one N x N matrix, so what is shuffled after that does not grow with T. A missing
    value counts as 0, several values of a pixel and step as their mean. With `steps` given, in any order, other steps are left out.
    """
    steps = sorted(set(steps)) if steps else layer_steps(cells, step)
    pixel = pixel or ["col", "row"]
    n = len(steps)
    vectors = (
        cells.filter(F.col("value").isNotNull() & F.col(step).isin(steps))
        .groupBy(*pixel)
        .agg(F.collect_list(F.struct(F.col(step).cast("bigint").alias("s"), "value")).alias("pairs"))
        .select(
            F.transform("pairs", lambda p: p["s"]).alias("s"), F.transform("pairs", lambda p: p["value"]).alias("v")
        )
    )

    def partial(batches):
        import numpy as np
        import pandas as pd

        order = np.array(steps)
        total, count = np.zeros((n, n)), 0
        for batch in batches:
            if len(batch) == 0:
                continue
            sizes = batch["s"].map(len).to_numpy()
            m = np.zeros((len(batch), n))
            who = np.repeat(np.arange(len(batch)), sizes)
            where = np.searchsorted(order, np.concatenate(batch["s"].to_list()))
            times = np.zeros_like(m)
            np.add.at(m, (who, where), np.concatenate(batch["v"].to_list()))
            np.add.at(times, (who, where), 1)
            m /= np.maximum(times, 1)
            total += m.T @ m
            count += len(batch)
        if count:
            i, j = np.triu_indices(n)
            yield pd.DataFrame({"i": i.astype("int32"), "j": j.astype("int32"), "g": total[i, j], "t": count})

    parts = vectors.mapInPandas(partial, "i int, j int, g double, t bigint")
    return parts.groupBy("i", "j").agg((F.sum("g") / F.sum("t")).alias("g"))


@dataclass(frozen=True)
class FpcaModel:
    """Leading eigenpair over the layer's steps; s is 0 for an all-zero layer."""

    steps: list[int]
    v: list[float]
    s: float

    @property
    def scores(self) -> list[float]:
        return [x * self.s for x in self.v]


def leading_pair(gram: np.ndarray) -> tuple[np.ndarray, float]:
    """Leading eigenvector (largest entry positive, lowest index on ties) and singular value."""
    values, vectors = np.linalg.eigh(gram)
    v, s = vectors[:, -1], float(np.sqrt(max(values[-1], 0.0)))
    size = np.abs(v)
    top = int(np.argmax(size >= size.max() - 1e-12))
    return (v if v[top] >= 0 else -v), s


def fpca_fit(
    cells: DataFrame,
    step: str = "time_index",
    pixel: list[str] | None = None,
    steps: list[int] | None = None,
    max_steps: int = MAX_STEPS,
) -> FpcaModel:
    """Fit the leading pair; N(N+1)/2 numbers reach the driver.

    Steps known from the catalog (at most max_steps) spare the scan that looks for them.
    """
    steps = sorted(set(steps)) if steps is not None else layer_steps(cells, step, max_steps)
    if len(steps) > max_steps:
        raise ValueError(f"more than {max_steps} time steps")
    gram = np.zeros((len(steps), len(steps)))
    for r in fpca_gram(cells, step, steps, pixel).collect():
        gram[r["i"], r["j"]] = gram[r["j"], r["i"]] = r["g"]
    v, s = leading_pair(gram) if steps else (np.zeros(0), 0.0)
    return FpcaModel(steps, [float(x) for x in v], s)


def _lookup(model: FpcaModel, values: list[float], step: str) -> Column:
    entries = [F.lit(x) for k, v in zip(model.steps, values) for x in (k, float(v))]
    return F.try_element_at(F.create_map(*entries), F.col(step))


def fpca_components(cells: DataFrame, model: FpcaModel, step: str = "time_index", pixel: list[str] | None = None) -> DataFrame:
    """(pixel, component): a sum per pixel over the mean value of each step. Null for an all-zero layer.

    Cells are shuffled by pixel once; both groupings work on that.
    """
    pixel = pixel or ["col", "row"]
    if not model.steps:
        return cells.groupBy(*pixel).agg(F.lit(None).cast("double").alias("component"))
    weight = _lookup(model, [v / model.s if model.s else 0.0 for v in model.v], step)
    means = cells.repartition(*pixel).groupBy(*pixel, step).agg(F.avg("value").alias("value"))
    total = F.sum(F.col("value") * weight)
    return means.groupBy(*pixel).agg((total if model.s else F.lit(None).cast("double")).alias("component"))


def fpca_scores(components: DataFrame, model: FpcaModel) -> DataFrame:
    """(step, score, energy): score of each step, and the components' total square that goes with it."""
    energy = components.agg(F.sum(F.col("component") * F.col("component")).alias("energy"))
    pairs = F.array(
        *[F.struct(F.lit(k).cast("bigint").alias("step"), F.lit(s).alias("score")) for k, s in zip(model.steps, model.scores)]
    )
    return energy.select(F.explode(pairs).alias("p"), "energy").select("p.step", "p.score", "energy")


def fpca_reconstruct(components: DataFrame, model: FpcaModel) -> DataFrame:
    """Rank-1 approximation: component times score, one row per pixel and step."""
    pixel = [c for c in components.columns if c != "component"]
    pairs = F.array(
        *[F.struct(F.lit(k).cast("bigint").alias("step"), F.lit(s).alias("score")) for k, s in zip(model.steps, model.scores)]
    )
    return components.select(*pixel, "component", F.explode(pairs).alias("p")).select(
        *pixel, "p.step", (F.col("component") * F.col("p.score")).alias("value")
    )


MOMENTS = "layer string, a bigint, b bigint, g double, t bigint"


def layer_moments(cells: DataFrame, step: str = "time_index", max_steps: int = MAX_STEPS) -> DataFrame:
    """Second moments of every layer over pairs of its steps: (layer, a, b, g) with a <= b and g summed over
    its pixels, and a row without a and b whose t counts the pixels.

    One job for all layers. Every task reduces its pixels to a matrix per layer and batch over the steps found there, which are added up before
    anything is shuffled, so what is shuffled follows layers and steps, not pixels. A missing value counts as 0, several values
    of a pixel and step as their mean. More than max_steps steps of a layer are an error.
    """
    vectors = (
        cells.filter(F.col("value").isNotNull())
        .groupBy("layer", "col", "row")
        .agg(F.collect_list(F.struct(F.col(step).cast("bigint").alias("s"), "value")).alias("pairs"))
        .select("layer", F.transform("pairs", lambda p: p["s"]).alias("s"), F.transform("pairs", lambda p: p["value"]).alias("v"))
    )

    def partial(batches):
        import numpy as np
        import pandas as pd

        for batch in batches:
            codes, names = pd.factorize(batch["layer"], use_na_sentinel=False)
            for code, name in enumerate(names):
                part = batch[codes == code]
                sizes = part["s"].map(len).to_numpy()
                who = np.repeat(np.arange(len(part)), sizes)
                order, where = np.unique(np.concatenate(part["s"].to_list()), return_inverse=True)
                if len(order) > max_steps:
                    raise ValueError(f"more than {max_steps} time steps in layer {name}")
                m, times = np.zeros((len(part), len(order))), np.zeros((len(part), len(order)))
                np.add.at(m, (who, where), np.concatenate(part["v"].to_list()))
                np.add.at(times, (who, where), 1)
                m /= np.maximum(times, 1)
                i, j = np.triu_indices(len(order))
                name = None if pd.isna(name) else name
                yield pd.DataFrame({"layer": name, "a": order[i], "b": order[j], "g": (m.T @ m)[i, j], "t": 0}).astype({"layer": object})
                # the layer's pixels are counted apart from its pairs, since a batch need not have every step
                yield pd.DataFrame({"layer": [name], "a": [None], "b": [None], "g": [0.0], "t": [len(part)]}).astype({"layer": object, "a": "Int64", "b": "Int64"})

    return vectors.mapInPandas(partial, MOMENTS).groupBy("layer", "a", "b").agg(F.sum("g").alias("g"), F.sum("t").alias("t"))


def layer_pairs(moments: DataFrame, max_steps: int = MAX_STEPS) -> DataFrame:
    """The leading pair of every layer: (layer, step, weight, score), weight null for an all-zero layer.

    A layer's group is at most max_steps * (max_steps + 1) / 2 + 1 rows.
    """

    def solve(rows):
        import numpy as np
        import pandas as pd

        pairs = rows[rows["a"].notna()]
        pixels = rows.loc[rows["a"].isna(), "t"].sum()
        steps = np.unique(pairs["a"].to_numpy(dtype="int64"))
        if len(steps) > max_steps:
            raise ValueError(f"more than {max_steps} time steps in layer {rows['layer'].iloc[0]}")
        gram = np.zeros((len(steps), len(steps)))
        i, j = (np.searchsorted(steps, pairs[c].to_numpy(dtype="int64")) for c in ("a", "b"))
        gram[i, j] = gram[j, i] = pairs["g"].to_numpy() / pixels
        v, s = leading_pair(gram)
        weight = v / s if s else np.full(len(steps), np.nan)
        return pd.DataFrame({"layer": rows["layer"].iloc[0], "step": steps, "weight": weight, "score": v * s})

    found = moments.groupBy("layer").applyInPandas(solve, "layer string, step bigint, weight double, score double")
    return found.withColumn("weight", F.when(~F.isnan("weight"), F.col("weight")))


def layer_components(cells: DataFrame, step: str = "time_index", max_steps: int = MAX_STEPS) -> DataFrame:
    """(layer, col, row, component) of every layer by a model of its own; null for an all-zero layer."""
    pairs = layer_pairs(layer_moments(cells, step, max_steps), max_steps).select("layer", F.col("step").alias("_step"), "weight")
    pixel = ["layer", "col", "row"]
    means = cells.repartition(*pixel).groupBy(*pixel, F.col(step).cast("bigint").alias("_step")).agg(F.avg("value").alias("value"))
    weighted = summary_join(means, pairs, ["layer", "_step"], "left")
    return weighted.groupBy(*pixel).agg(F.sum(F.col("value") * F.col("weight")).alias("component"))


def fpca_image(cells: DataFrame, step_days: int = 10, max_steps: int = MAX_STEPS) -> DataFrame:
    """First component over 10-day slots as a 0..255 image: (layer, col, row, component, stretched).

    Every layer has a model of its own, and all of them are fitted in the same job, however many there are; scenes of one slot are averaged.
    """
    components = layer_components(timestep_slots(cells, step_days), "slot", max_steps)
    ranges = components.groupBy("layer").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi"))
    return (
        summary_join(components, ranges, ["layer"])
        .withColumn("stretched", stretch("component", "_lo", "_hi"))
        .drop("_lo", "_hi")
    )


def fpca_per_pixel(cells: DataFrame, steps: list[int] | None = None) -> DataFrame:
    """Per pixel (several values of a year and step as their mean, other steps than those given left out): years x within-year steps matrix (rows = time_index, columns = band) to one
    component per step: (layer, col, row, step, component).

    A pixel's matrix is at most years x steps. Pixels are solved in stacked numpy batches.
    """
    steps = sorted(set(steps)) if steps else layer_steps(cells, "band")
    n = len(steps)
    matrices = (
        cells.filter(F.col("value").isNotNull() & F.col("band").isin(steps))
        .groupBy("layer", "col", "row")
        .agg(F.collect_list(F.struct("time_index", "band", "value")).alias("m"))
        .select(
            "layer",
            "col",
            "row",
            F.transform("m", lambda p: p["time_index"]).alias("t"),
            F.transform("m", lambda p: p["band"]).alias("b"),
            F.transform("m", lambda p: p["value"]).alias("v"),
        )
    )

    def solve(batches):
        import numpy as np
        import pandas as pd

        order = np.array(steps)
        for batch in batches:
            rows = len(batch)
            if rows == 0:
                continue
            sizes = batch["t"].map(len).to_numpy()
            who = np.repeat(np.arange(rows), sizes)
            times, year = np.unique(np.concatenate(batch["t"].to_list()), return_inverse=True)
            where = np.searchsorted(order, np.concatenate(batch["b"].to_list()))
            m = np.zeros((rows, len(times), n))
            seen = np.zeros_like(m)
            np.add.at(m, (who, year, where), np.concatenate(batch["v"].to_list()))
            np.add.at(seen, (who, year, where), 1)
            m /= np.maximum(seen, 1)
            values, vectors = np.linalg.eigh(m @ m.transpose(0, 2, 1) / n)
            v, s = vectors[:, :, -1], np.sqrt(np.maximum(values[:, -1], 0.0))
            size = np.abs(v)
            top = np.argmax(size >= size.max(axis=1, keepdims=True) - 1e-12, axis=1)
            v = v * np.where(v[np.arange(rows), top] < 0, -1.0, 1.0)[:, None]
            with np.errstate(divide="ignore", invalid="ignore"):
                comp = np.einsum("pys,py->ps", m, v) / s[:, None]
            comp[s == 0] = np.nan
            yield pd.DataFrame(
                {
                    "layer": np.repeat(batch["layer"].to_numpy(), n),
                    "col": np.repeat(batch["col"].to_numpy(), n),
                    "row": np.repeat(batch["row"].to_numpy(), n),
                    "step": np.tile(order.astype("int32"), rows),
                    "component": comp.ravel(),
                }
            )

    solved = matrices.mapInPandas(solve, "layer string, col int, row int, step int, component double")
    return solved.withColumn("component", F.when(~F.isnan("component"), F.col("component")))


def fpca_per_pixel_image(cells: DataFrame) -> DataFrame:
    """Per-pixel components stretched within the pixel, then within the step over the layer."""
    comp = fpca_per_pixel(cells)
    pixel = ["layer", "col", "row"]
    packed = (
        comp.groupBy(*pixel)
        .agg(F.min("component").alias("_lo"), F.max("component").alias("_hi"), F.collect_list(F.struct("step", "component")).alias("c"))
        .select(*pixel, "_lo", "_hi", F.explode("c").alias("c"))
        .select(*pixel, "c.step", stretch("c.component", "_lo", "_hi").alias("value"))
    )
    ranges = packed.groupBy("layer", "step").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    return (
        summary_join(packed, ranges, ["layer", "step"])
        .withColumn("stretched", stretch("value", "_lo", "_hi"))
        .drop("_lo", "_hi")
    )
