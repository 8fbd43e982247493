"""Time series and functional PCA."""

from __future__ import annotations

from pyspark.sql import functions as F

from terracell.operators import fpca, series
from terracell.plans.storage import cut

from .fixture import GRID
from .registry import check, micro
from .sql import micro as sql_micro


@check(
    "pixel_series",
    """select col, row, band, time_index, value, cast(row_number() over (partition by col, row, band order by time_index) as integer) as pos
       from {{cells}}""",
)
def pixel_series(fx):
    return series.pixel_series(fx.cells).select("col", "row", "band", F.posexplode("series").alias("p", "s")).select(
        "col", "row", "band", "s.time_index", "s.value", (F.col("p") + 1).alias("pos")
    )


_LAGS = """(select *, row_number() over w as rn, count(*) over (partition by col, row, band) as n,
    lag(value, 2) over w as m2, lag(value, 1) over w as m1, lead(value, 1) over w as p1, lead(value, 2) over w as p2
    from {{cells}} window w as (partition by col, row, band order by time_index))"""
_INNER = "rn > 2 and rn <= n - 2"
_F52 = f"case when {_INNER} then (-3 * m2 + 12 * m1 + 17 * value + 12 * p1 - 3 * p2) / 35 else value end"
_F42 = f"case when {_INNER} then -0.15e0 * m2 + 0.45e0 * m1 + 0.55e0 * value + 0.15e0 * p1 else value end"


@check("savgol", f"select time_index, col, row, band, {sql_micro(_F52, 'value')} from {_LAGS}")
def savgol(fx):
    return series.savgol(fx.cells).select("time_index", "col", "row", "band", micro("value", "value"))


@check(
    "savgol_auto",
    f"""select time_index, col, row, band, {sql_micro("case when e42 <= least(e42, e52) * (1 + 1e-9) + en * 1e-15 then f42 else f52 end", "value")},
               case when e42 <= least(e42, e52) * (1 + 1e-9) + en * 1e-15 then 4 else 5 end as window from
        (select *, sum(value * value) over w as en, sum((f42 - value) * (f42 - value)) over w as e42, sum((f52 - value) * (f52 - value)) over w as e52
         from (select *, {_F42} as f42, {_F52} as f52 from {_LAGS}) window w as (partition by col, row, band))""",
)
def savgol_auto(fx):
    out = series.savgol_auto(fx.cells)
    return out.select("time_index", "col", "row", "band", micro("value", "value"), "window")


@check(
    "minmax_stretch",
    """select time_index, col, row, band, cast(floor(255e0 * (value - lo) / nullif(hi - lo, 0) + 1e-9) as integer) as stretched
       from (select *, min(value) over (partition by band) as lo, max(value) over (partition by band) as hi from {{cells}})""",
)
def minmax_stretch(fx):
    return series.minmax_stretch(fx.cells, ["band"]).select("time_index", "col", "row", "band", "stretched")


@check(
    "minmax_stretch_series",
    """select time_index, col, row, band, cast(floor(255e0 * (value - lo) / nullif(hi - lo, 0) + 1e-9) as integer) as stretched
       from (select *, min(value) over w as lo, max(value) over w as hi from {{cells}} window w as (partition by col, row, band))""",
)
def minmax_stretch_series(fx):
    return series.minmax_stretch_series(fx.cells).select("time_index", "col", "row", "band", "stretched")


@check(
    "latest_per_cell",
    """select layer, col, row, band, max(time_index) as time_index, arg_max(value, time_index) as value
       from {{cells}} where time_index between 864000 and 4320000 group by 1, 2, 3, 4""",
)
def latest_per_cell(fx):
    return series.latest_per_cell(fx.cells, 864000, 4320000)


@check(
    "pixel_drill",
    """select p.point_id, c.time_index, c.band, c.value from {{points}} p join {{cells}} c
       on c.col = cast(floor((p.lon - 68e0) / 0.03125e0) as integer) and c.row = cast(floor((36e0 - p.lat) / 0.03125e0) as integer)
       where c.time_index >= 864000""",
)
def pixel_drill(fx):
    return series.pixel_drill(fx.points, fx.cells, GRID, 864000).select("point_id", "time_index", "band", "value")


# ---- functional PCA. The oracle finds the leading pair by repeated squaring of G.

_BAND1 = "(select col, row, time_index // 864000 as i, cast(b1 as double) as v from {{wide}})"
_GRAM = f"""gram as materialized (select a.i, b.i as j, sum(a.v * b.v) / (select count(*) from (select distinct col, row from {{{{wide}}}})) as g
    from {_BAND1} a join {_BAND1} b using (col, row) group by 1, 2)"""
_POWER = """power(k, i, j, g) as (select 0, i, j, g / (select sum(g) from gram) from gram
    union all select * from (
      with sq as (select a.k + 1 as k, a.i, b.j, sum(a.g * b.g) as g from power a join power b on a.j = b.i where a.k < 9 group by 1, 2, 3)
      select k, i, j, g / (select sum(g) from sq) from sq))"""
_PAIR = """raw as (select i, sum(g) as v from power where k = 9 group by i),
    vec as (select i, v / sqrt((select sum(v * v) from raw)) as v from raw),
    eig as (select sqrt(sum(g.g * a.v * b.v)) as s from gram g join vec a on a.i = g.i join vec b on b.i = g.j)"""
_COMP = f"comp as (select col, row, sum(m.v * vec.v) / (select s from eig) as component from {_BAND1} m join vec using (i) group by 1, 2)"
_FPCA = f"with recursive {_GRAM}, {_POWER}, {_PAIR}, {_COMP} "


def _band1(fx):
    return fx.cells.filter("band = 1")


@check(
    "fpca_gram",
    f"""select cast(a.i as integer) as i, cast(b.i as integer) as j,
               sum(a.v * b.v) / (select count(*) from (select distinct col, row from {{{{wide}}}})) as g
        from {_BAND1} a join {_BAND1} b using (col, row) where a.i <= b.i group by 1, 2""",
)
def fpca_gram(fx):
    return fpca.fpca_gram(_band1(fx))


@check("fpca_components", _FPCA + f"select col, row, {sql_micro('component', 'component')} from comp")
def fpca_components(fx):
    layer = cut(_band1(fx))
    return fpca.fpca_components(layer, fpca.fpca_fit(layer)).select("col", "row", micro("component", "component"))


@check(
    "fpca_scores",
    _FPCA + f"""select i * 864000 as step, {sql_micro("v * (select s from eig)", "score")},
        {sql_micro("(select sum(component * component) from comp) / 1e3", "energy")} from vec""",
)
def fpca_scores(fx):
    layer = cut(_band1(fx))
    model = fpca.fpca_fit(layer)
    scores = fpca.fpca_scores(fpca.fpca_components(layer, model), model)
    return scores.select("step", micro("score", "score"), micro(F.col("energy") / 1e3, "energy"))


@check(
    "fpca_reconstruct",
    _FPCA + f"select col, row, i * 864000 as step, {sql_micro('component * v * (select s from eig)', 'value')} from comp, vec",
)
def fpca_reconstruct(fx):
    layer = cut(_band1(fx))
    model = fpca.fpca_fit(layer)
    out = fpca.fpca_reconstruct(fpca.fpca_components(layer, model), model)
    return out.select("col", "row", "step", micro("value", "value"))


@check(
    "fpca_image",
    _FPCA + """select col, row, cast(floor(255e0 * (component - lo) / (hi - lo) + 1e-9) as integer) as stretched
        from comp, (select min(component) as lo, max(component) as hi from comp)""",
)
def fpca_image(fx):
    return fpca.fpca_image(cut(_band1(fx))).select("col", "row", "stretched")


_PIXEL = """with recursive m as materialized (select col, row, time_index as y, band as b, value / 1e3 as v from {{cells}}),
    gram as materialized (select m1.col, m1.row, m1.b as i, m2.b as j, sum(m1.v * m2.v) as g
        from m m1 join m m2 using (col, row, y) group by 1, 2, 3, 4),
    power(k, col, row, i, j, g) as (select 0, col, row, i, j, g / sum(g) over (partition by col, row) from gram
      union all select k, col, row, i, j, g / sum(g) over (partition by col, row) from (
        select a.k + 1 as k, a.col, a.row, a.i, b.j, sum(a.g * b.g) as g from power a
        join power b on a.col = b.col and a.row = b.row and a.j = b.i where a.k < 6 group by 1, 2, 3, 4, 5)),
    raw as (select col, row, i, sum(g) as u from power where k = 6 group by 1, 2, 3),
    comp as (select col, row, i as step, u / sqrt(sum(u * u) over (partition by col, row)) * sqrt(5e0) as component from raw) """


@check("fpca_per_pixel", _PIXEL + f"select col, row, step, {sql_micro('component', 'component')} from comp")
def fpca_per_pixel(fx):
    return fpca.fpca_per_pixel(cut(fx.cells)).select("col", "row", "step", micro("component", "component"))


@check(
    "fpca_per_pixel_image",
    _PIXEL + """, one as (select col, row, step, cast(floor(255e0 * (component - lo) / nullif(hi - lo, 0) + 1e-9) as integer) as value
        from (select *, min(component) over w as lo, max(component) over w as hi from comp window w as (partition by col, row)))
        select col, row, step, value, cast(floor(255e0 * (value - lo) / nullif(hi - lo, 0) + 1e-9) as integer) as stretched
        from (select *, min(value) over (partition by step) as lo, max(value) over (partition by step) as hi from one)""",
)
def fpca_per_pixel_image(fx):
    return fpca.fpca_per_pixel_image(cut(fx.cells)).select("col", "row", "step", "value", "stretched")
