"""Rings as array<struct<x,y>>: predicates and text/binary forms.

Touching counts as intersecting. The cheap envelope tests are plain comparisons that
Parquet can prune on; the exact ones run only on rows the envelope test lets through.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import RING
from ._col import as_col


def envelope(ring) -> Column:
    ring = as_col(ring)
    xs = F.transform(ring, lambda p: p["x"])
    ys = F.transform(ring, lambda p: p["y"])
    return F.struct(
        F.array_min(xs).alias("xmin"),
        F.array_min(ys).alias("ymin"),
        F.array_max(xs).alias("xmax"),
        F.array_max(ys).alias("ymax"),
    )


def boxes_overlap(a: dict | Column, b: dict | Column) -> Column:
    """Closed boxes; each side is a struct column or a dict of four columns or numbers."""
    a = {k: as_col(a[k]) for k in ("xmin", "ymin", "xmax", "ymax")}
    b = {k: as_col(b[k]) for k in ("xmin", "ymin", "xmax", "ymax")}
    return (
        (a["xmin"] <= b["xmax"])
        & (a["xmax"] >= b["xmin"])
        & (a["ymin"] <= b["ymax"])
        & (a["ymax"] >= b["ymin"])
    )


def edges_of(ring) -> Column:
    """Edges of a closed ring as array<struct<x1,y1,x2,y2>>; null for a null ring."""
    ring = as_col(ring)
    n = F.size(ring) - 1
    return F.zip_with(
        F.slice(ring, F.lit(1), n),
        F.slice(ring, F.lit(2), n),
        lambda p, q: F.struct(
            p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2")
        ),
    )


def edges_of_rings(rings) -> Column:
    """Edges of all rings of a polygon with holes, or of several polygons."""
    return F.flatten(F.transform(as_col(rings), edges_of))


def polygon_edges(df) -> Column:
    """Edges from the column `rings` where df has it, else from `ring`."""
    return edges_of_rings("rings") if "rings" in df.columns else edges_of("ring")


def point_in_ring(x, y, ring) -> Column:
    """Even-odd rule on half-open edges."""
    return point_in_edges(x, y, edges_of(ring))


def point_in_edges(x, y, edges) -> Column:
    x, y = as_col(x), as_col(y)

    def crosses(e):
        at = e["x1"] + (y - e["y1"]) * (e["x2"] - e["x1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0))
        return ((e["y1"] > y) != (e["y2"] > y)) & (x < at)

    hits = F.size(F.filter(as_col(edges), crosses))
    return hits % 2 == 1


def ring_meets_box(ring, box: Column | dict) -> Column:
    """Closed polygon against closed box: an edge meets the box, or the box lies inside."""
    return edges_meet_box(edges_of(ring), box)


def edges_meet_box(edges, box: Column | dict) -> Column:
    edges = as_col(edges)
    xmin, ymin, xmax, ymax = (as_col(box[k]) for k in ("xmin", "ymin", "xmax", "ymax"))
    # a one-element array, so that the box is computed once and not once per edge
    frame = F.struct(
        ((xmin + xmax) / 2.0).alias("cx"),
        ((ymin + ymax) / 2.0).alias("cy"),
        ((xmax - xmin) / 2.0).alias("hx"),
        ((ymax - ymin) / 2.0).alias("hy"),
        xmin.alias("xmin"),
        ymin.alias("ymin"),
        xmax.alias("xmax"),
        ymax.alias("ymax"),
    )

    def edge_meets(e, f):
        dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
        return (
            (F.least(e["x1"], e["x2"]) <= f["xmax"])
            & (F.greatest(e["x1"], e["x2"]) >= f["xmin"])
            & (F.least(e["y1"], e["y2"]) <= f["ymax"])
            & (F.greatest(e["y1"], e["y2"]) >= f["ymin"])
            & (F.abs(dx * (f["cy"] - e["y1"]) - dy * (f["cx"] - e["x1"])) <= F.abs(dx) * f["hy"] + F.abs(dy) * f["hx"])
        )

    return F.exists(
        F.array(frame),
        lambda f: F.exists(edges, lambda e: edge_meets(e, f)) | point_in_edges(f["cx"], f["cy"], edges),
    )


def footprint_meets_box(edges, own_box: dict, box: Column | dict) -> Column:
    """Envelope test, then the exact test where edges are given. CASE keeps that order, whatever
    join or filter the condition ends up in."""
    edges = as_col(edges)
    exact = F.when(edges.isNull(), F.lit(True)).otherwise(edges_meet_box(edges, box))
    return F.when(boxes_overlap(own_box, box), exact).otherwise(F.lit(False))


def rings_from_geojson(text) -> Column:
    """All rings of a GeoJSON Polygon or MultiPolygon, holes included; null when malformed."""
    text = as_col(text)
    one = F.from_json(text, "type string, coordinates array<array<array<double>>>")
    many = F.from_json(text, "type string, coordinates array<array<array<array<double>>>>")

    def points(ring):
        return F.transform(ring, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))

    kind = F.get_json_object(text, "$.type")
    return F.when(kind == "Polygon", F.transform(one["coordinates"], points)).when(
        kind == "MultiPolygon", F.transform(F.flatten(many["coordinates"]), points)
    )


def ring_from_geojson(text) -> Column:
    """Outer ring of a GeoJSON Polygon; null when malformed."""
    parsed = F.from_json(as_col(text), "type string, coordinates array<array<array<double>>>")
    outer = F.get(parsed["coordinates"], F.lit(0))
    return F.when(
        parsed["type"] == "Polygon",
        F.transform(outer, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))),
    )


def ring_to_geojson(ring) -> Column:
    coords = F.array(F.transform(as_col(ring), lambda p: F.array(p["x"], p["y"])))
    return F.to_json(F.struct(F.lit("Polygon").alias("type"), coords.alias("coordinates")))


def box_to_geojson(xmin, ymin, xmax, ymax) -> Column:
    from .grid import box_ring

    return ring_to_geojson(box_ring(xmin, ymin, xmax, ymax))


def ring_from_ewkb(hex_text) -> Column:
    """First ring of a hex (E)WKB polygon, either byte order. Arrow-batched."""
    return F.get(rings_from_ewkb(hex_text), F.lit(0))


def rings_from_ewkb(hex_text) -> Column:
    """All rings of a hex (E)WKB polygon or multipolygon, either byte order. Arrow-batched.

    Only the few counts of a geometry are read one by one; its points are taken as one buffer a ring.
    """

    @F.arrow_udf(f"array<{RING}>")
    def decode(texts: pa.Array) -> pa.Array:
        import numpy as np

        def rings_at(raw, at, found):
            order = "<" if raw[at] == 1 else ">"
            kind = int(np.frombuffer(raw, order + "u4", 1, at + 1)[0])
            at += 5 + (4 if kind & 0x20000000 else 0)
            count = int(np.frombuffer(raw, order + "u4", 1, at)[0])
            at += 4
            if kind & 0xFF == 6:
                for _ in range(count):
                    at = rings_at(raw, at, found)
            elif kind & 0xFF == 3:
                width = 2 + bool(kind & 0x80000000) + bool(kind & 0x40000000)
                for _ in range(count):
                    n = int(np.frombuffer(raw, order + "u4", 1, at)[0])
                    found.append(np.frombuffer(raw, order + "f8", n * width, at + 4).reshape(n, width)[:, :2].astype("<f8"))
                    at += 4 + 8 * n * width
            else:
                raise ValueError("not a polygon")
            return at

        rings, per_row, known = [], [], []
        for text in texts:
            found: list = []
            try:
                rings_at(bytes.fromhex(text.as_py()), 0, found)
                known.append(True)
            except (TypeError, ValueError, IndexError):
                found = []
                known.append(False)
            rings += found
            per_row.append(len(found))
        points = np.concatenate([np.zeros((0, 2)), *rings])
        xy = pa.StructArray.from_arrays([pa.array(points[:, 0].copy()), pa.array(points[:, 1].copy())], names=["x", "y"])
        ring_ends = np.concatenate([[0], np.cumsum([len(r) for r in rings])]).astype("int32")
        row_ends = np.concatenate([[0], np.cumsum(per_row)]).astype("int32")
        whole = pa.ListArray.from_arrays(pa.array(ring_ends), xy)
        mask = pa.array([not k for k in known])
        return pa.ListArray.from_arrays(pa.array(row_ends), whole, mask=mask)

    return decode(as_col(hex_text))


def ring_to_ewkb(ring, srid: int = 4326) -> Column:
    """Hex EWKB of a one-ring polygon, little endian. Arrow-batched."""

    @F.pandas_udf("string")
    def encode(rings: pd.Series) -> pd.Series:
        import struct

        def one(pts):
            if pts is None:
                return None
            head = struct.pack("<BIIII", 1, 0x20000003, srid, 1, len(pts))
            body = b"".join(struct.pack("<dd", p["x"], p["y"]) for p in pts)
            return (head + body).hex().upper()

        return rings.map(one, na_action=None)

    return encode(as_col(ring))
