"""Time the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default all cores),
BENCH_QUERIES (comma-separated names, or "all").
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import checks  # noqa: E402
from terracell.session import local_session  # noqa: E402

HEADLINE = [
    "mean_ndi_by_aoi",
    "ndi",
    "local_avg",
    "run_model",
    "mosaic",
    "raster_calc",
    "focal_conv",
    "pixel_series",
    "savgol",
    "savgol_auto",
    "minmax_stretch",
    "latest_per_cell",
    "pixel_drill",
    "fpca_gram",
    "fpca_components",
    "fpca_per_pixel",
    "zonal_histogram",
    "zonal_mean",
    "clip_to_aoi",
    "kernel_density",
    "resample_nearest",
    "resample_bilinear",
    "resample_bicubic",
    "reproject_webmercator",
    "pyramid",
    "ingest_pyramid",
    "retile",
    "scene_tile_cover",
    "polygon_intersects",
    "aoi_scenes",
    "aoi_tile_refs",
    "tile_point_lookup",
    "z_index",
    "rgb_composite",
    "tile_render_query",
    "write_layer",
    "write_tile_catalog",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    asked = os.environ.get("BENCH_QUERIES", "")
    names = list(checks.QUERIES) if asked == "all" else [n for n in asked.split(",") if n] or HEADLINE
    spark = local_session(cores, shuffle_partitions=int(cores))
    checks.QUERIES["ts_to_time_index"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        checks.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
