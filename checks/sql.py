"""Common table expressions of the fixture, as SQL over the raw tables."""

from __future__ import annotations

import re

CTES = {
    "wide": """
        select 'lineitem' as layer, cast(l_linenumber - 1 as bigint) * 864000 as time_index,
               cast((l_orderkey // 4) % 64 as integer) as col, cast((l_orderkey // 4) // 64 as integer) as row,
               cast(sum(cast(l_quantity as bigint)) as bigint) as b1, count(*) as b2,
               cast(sum(cast(round(l_extendedprice * 100) as bigint)) as bigint) as b3,
               cast(sum(cast(round(l_discount * 100) as bigint)) as bigint) as b4,
               cast(sum(cast(round(l_tax * 100) as bigint)) as bigint) as b5
        from lineitem group by 1, 2, 3, 4""",
    "cells": """
        select layer, time_index, col, row, 1 as band, cast(b1 as double) as value from {{wide}}
        union all select layer, time_index, col, row, 2, cast(b2 as double) from {{wide}}
        union all select layer, time_index, col, row, 3, cast(b3 as double) from {{wide}}
        union all select layer, time_index, col, row, 4, cast(b4 as double) from {{wide}}
        union all select layer, time_index, col, row, 5, cast(b5 as double) from {{wide}}""",
    "scenes": """
        select o_orderkey as ingest_id, o_custkey % 10 as dataset_id,
               cast(epoch(o_orderdate) as bigint) - 631152000 as time_index,
               67.5e0 + (o_orderkey * 37 % 160) / 64e0 as xmin, 35.75e0 - o_orderkey / 8192e0 as ymin,
               67.5e0 + (o_orderkey * 37 % 160) / 64e0 + 0.25e0 + (o_custkey % 4) / 16e0 as xmax,
               35.75e0 - o_orderkey / 8192e0 + 0.25e0 + (o_custkey % 4) / 16e0 as ymax
        from orders""",
    "aois": """
        select aoi_id, aoi_code, xmin, ymin, xmin + s as xmax, ymin + s as ymax,
               xmin + s / 2 as cx, ymin + s / 2 as cy, s / 2 as h
        from (select c_custkey as aoi_id, c_name as aoi_code, 68e0 + (c_custkey * 37 % 56) / 32e0 as xmin,
                     35.875e0 - c_custkey / 1024e0 as ymin, (2 + c_nationkey % 8) / 32e0 as s from customer)""",
    "points": """
        select event_id as point_id, 68e0 + (event_id * 31 % 2048) / 1024e0 as lon,
               35.9990234375e0 - event_id / 8192e0 as lat, cast(floor(value) as double) as weight from events""",
    "datasets": """
        select s_suppkey as dataset_id, s_name as ds_name, 5 as no_of_bands,
               (1 + s_nationkey % 4) / 64e0 as scale_factor, (s_nationkey % 5) / 8e0 as value_offset,
               s_suppkey % 2 = 0 as is_querable, s_nationkey from supplier""",
    "candidates": """
        select s.*, cast(z as integer) as zoom, cast(x as integer) as tile_x, cast(y as integer) as tile_y,
               x / pow(2, z) * 360e0 - 180e0 as tx0, (x + 1) / pow(2, z) * 360e0 - 180e0 as tx1,
               degrees(atan(sinh(pi() * (1 - 2 * y / pow(2, z))))) as ty1,
               degrees(atan(sinh(pi() * (1 - 2 * (y + 1) / pow(2, z))))) as ty0
        from {{scenes}} s, unnest(generate_series(4, 12)) g(z),
             unnest(generate_series(cast(floor((xmin + 180) / 360 * pow(2, z)) as bigint) - 1,
                                    cast(floor((xmax + 180) / 360 * pow(2, z)) as bigint) + 1)) gx(x),
             unnest(generate_series(cast(floor((1 - asinh(tan(radians(ymax))) / pi()) / 2 * pow(2, z)) as bigint) - 1,
                                    cast(floor((1 - asinh(tan(radians(ymin))) / pi()) / 2 * pow(2, z)) as bigint) + 1)) gy(y)""",
    "cover": """
        select ingest_id, dataset_id, time_index, zoom, tile_x, tile_y, xmin, ymin, xmax, ymax from {{candidates}}
        where tx0 <= xmax and tx1 >= xmin and ty0 <= ymax and ty1 >= ymin""",
    "aoi_cover": """
        select aoi_id, tile_x, tile_y from (
          select a.*, x as tile_x, y as tile_y,
                 x / 4096e0 * 360e0 - 180e0 as tx0, (x + 1) / 4096e0 * 360e0 - 180e0 as tx1,
                 degrees(atan(sinh(pi() * (1 - 2 * y / 4096e0)))) as ty1,
                 degrees(atan(sinh(pi() * (1 - 2 * (y + 1) / 4096e0)))) as ty0
          from {{aois}} a,
               unnest(generate_series(cast(floor((xmin + 180) / 360 * 4096) as bigint) - 1,
                                      cast(floor((xmax + 180) / 360 * 4096) as bigint) + 1)) gx(x),
               unnest(generate_series(cast(floor((1 - asinh(tan(radians(ymax))) / pi()) / 2 * 4096) as bigint) - 1,
                                      cast(floor((1 - asinh(tan(radians(ymin))) / pi()) / 2 * 4096) as bigint) + 1)) gy(y))
        where tx0 <= xmax and tx1 >= xmin and ty0 <= ymax and ty1 >= ymin""",
    # cells of band 1..5 under AOI diamonds; centres on the left and lower edges are inside
    "zonal": """
        select a.aoi_id, c.* from {{cells}} c join {{aois}} a
          on 36e0 - (c.row + 0.5e0) * 0.03125e0 between a.ymin and a.ymax
         and 68e0 + (c.col + 0.5e0) * 0.03125e0 - a.cx >= -(a.h - abs(36e0 - (c.row + 0.5e0) * 0.03125e0 - a.cy))
         and 68e0 + (c.col + 0.5e0) * 0.03125e0 - a.cx < a.h - abs(36e0 - (c.row + 0.5e0) * 0.03125e0 - a.cy)""",
}

_REF = re.compile(r"\{\{(\w+)\}\}")


def _needed(text: str, seen: list[str]) -> list[str]:
    for name in _REF.findall(text):
        if name not in seen:
            _needed(CTES[name], seen)
            if name not in seen:
                seen.append(name)
    return seen


def expand(sql: str) -> str:
    """SQL with its {{name}} references as common table expressions in front."""
    names = _needed(sql, [])
    body = _REF.sub(r"fx_\1", sql)
    if not names:
        return body.strip()
    ctes = ",\n".join(f"fx_{n} as materialized ({_REF.sub(r'fx_\1', CTES[n])})" for n in names)
    head = body.strip()
    if head.lower().startswith("with recursive "):
        return f"with recursive {ctes},\n{head[len('with recursive '):]}"
    if head.lower().startswith("with "):
        return f"with {ctes},\n{head[len('with '):]}"
    return f"with {ctes}\n{head}"


def micro(expression: str, name: str) -> str:
    return f"cast(floor(({expression}) * 1e6 + 0.3e0) as bigint) as {name}"
