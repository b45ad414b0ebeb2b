import math

import pytest
from conftest import as_dict
from pyspark.sql import functions as F

from gridspark.operators import spatial

GRID = [(i * 36 + j, i, j, -87.5 + 5.0 * i, 10.0 * j) for i in range(36) for j in range(36)]


@pytest.fixture(scope="module")
def cells(frame):
    return frame(GRID, "cell_id int, lat_idx int, lon_idx int, lat double, lon double")


def edges(frame, rings):
    """rings: (region_id, part_id, ring_id, points)"""
    rows = []
    for region, part, ring, points in rings:
        for (x1, y1), (x2, y2) in zip(points, points[1:] + points[:1]):
            rows.append((region, f"r{region}", part, ring, float(x1), float(y1), float(x2), float(y2)))
    return frame(rows, "region_id int, region string, part_id int, ring_id int, x1 double, y1 double, x2 double, y2 double")


def brute(rings, x, y):
    inside = {}
    for region, part, _, pts in rings:
        for (x1, y1), (x2, y2) in zip(pts, pts[1:] + pts[:1]):
            if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
                inside[region, part] = not inside.get((region, part), False)
    return {region for (region, _), v in inside.items() if v}


STAR = [(40 + (60 if k % 2 else 25) * math.cos(k * math.pi / 9 + 0.1), (50 if k % 2 else 20) * math.sin(k * math.pi / 9 + 0.1)) for k in range(18)]
RINGS = [
    (0, 0, 0, [(-31, -41), (61, -41), (61, 43), (-31, 43)]), (0, 0, 1, [(1, -21), (29, -21), (29, 21), (1, 21)]),
    (1, 0, 0, STAR), (2, 0, 0, [(150, -89), (181, -89), (181, -40), (150, -40)]), (2, 1, 0, [(-180, -89), (-150, -89), (-150, -40), (-180, -40)]),
]


def test_polygons_match_brute_force(frame, cells):
    got = {(r["region_id"], r["cell_id"]) for r in spatial.point_in_polygon(cells, edges(frame, RINGS)).collect()}
    want = {(region, c) for c, _, _, lat, lon in GRID for region in brute(RINGS, lon - 360 if lon > 180 else lon, lat)}
    assert got == want and len(want) > 100
    assert {r for r, _ in want} == {0, 1, 2}


def test_hole_and_masks(frame, cells):
    e = edges(frame, RINGS)
    region = {r["cell_id"] for r in spatial.region_mask(cells, e, "r0").collect()}
    by = {(lat, lon): c for c, _, _, lat, lon in GRID}
    assert by[(2.5, 50.0)] in region and by[(2.5, 10.0)] not in region
    land = {r["cell_id"] for r in spatial.land_mask(cells, e).collect()}
    assert region < land


def test_country_totals(frame, cells):
    e = edges(frame, RINGS[:2])
    countries = spatial.assign_country(cells, e)
    assert countries.count() == len(GRID)
    x = cells.select("cell_id", F.lit(2015).alias("year"), F.when(F.col("cell_id") % 2 == 0, F.lit(1.0)).alias("value"))
    out = as_dict(spatial.country_totals(x, countries), "cell_id")
    inside = {c for c, _, _, lat, lon in GRID if brute(RINGS[:2], (lon + 180) % 360 - 180, lat)}
    total = float(sum(c % 2 == 0 for c in inside))
    assert all(out[c] == (total if c in inside else 0.0) for c, *_ in GRID)


def test_regrid_onto_the_same_grid_is_identity(frame, cells):
    x = cells.select("cell_id", F.lit("k").alias("k"), F.sin(F.col("cell_id")).alias("value"))
    out = as_dict(spatial.bilinear_regrid(x, cells, cells, ["k"]), "cell_id")
    assert out == pytest.approx({c: math.sin(c) for c, *_ in GRID})


def test_regrid_is_exact_for_planes_and_wraps(frame, cells):
    target = frame([(0, 0, 0, 0.0, 355.0), (1, 0, 1, 0.0, 12.5), (2, 1, 0, 89.0, 355.0), (3, 1, 1, 89.0, 12.5)], "cell_id int, lat_idx int, lon_idx int, lat double, lon double")
    x = cells.select("cell_id", F.lit("k").alias("k"), (F.col("lat") + F.cos(F.radians("lon"))).alias("value"))
    out = as_dict(spatial.bilinear_regrid(x, cells, target, ["k"]), "cell_id")
    wrap = (math.cos(math.radians(350)) + 1) / 2
    near = 0.75 * math.cos(math.radians(10)) + 0.25 * math.cos(math.radians(20))
    assert [out[0], out[1]] == pytest.approx([wrap, near])
    assert set(out) == {0, 1, 2, 3} and out[2] is None and out[3] is None  # latitude 89 lies outside the source rows


def test_regrid_with_a_missing_source_is_missing(frame, cells):
    hole = F.when(F.col("cell_id") != 18 * 36, F.lit(1.0))
    target = frame([(0, 0, 0, 4.0, 355.0), (1, 0, 1, 4.0, 55.0)], "cell_id int, lat_idx int, lon_idx int, lat double, lon double")
    out = as_dict(spatial.bilinear_regrid(cells.select("cell_id", F.lit("k").alias("k"), hole.alias("value")), cells, target, ["k"]), "cell_id")
    assert out == {0: None, 1: 1.0}


def test_even_axis(frame):
    out = as_dict(spatial.even_axis(frame([(i,) for i in range(5)], "lat_idx int"), "lat_idx", -90, 90), "src", "x")
    assert out == {0: -90, 1: -45, 2: 0, 3: 45, 4: 90}
