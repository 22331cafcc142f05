"""Unions of areas, held against the plain version in one piece and against counted cells."""

import numpy as np
import plain_areas
import pytest

from gridwright.operators import areas

SCHEMA = "g int, rings array<array<struct<x: double, y: double>>>"


def box(x, y, w, h):
    return np.array([(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)], float)


def as_rows(g, given):
    return [(g, [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in rings]) for rings in given]


def normal(ring):
    """A ring's corners, from the smallest on."""
    p = [tuple(np.round(q, 5).tolist()) for q in np.asarray(ring)[:-1]]
    at = p.index(min(p))
    return tuple(p[at:] + p[:at])


def boxes(seed):
    rng = np.random.default_rng(seed)
    return [[box(*rng.integers(0, 9, 2), *rng.integers(1, 5, 2))] for _ in range(int(rng.integers(1, 14)))]


def slanted(seed):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(int(rng.integers(2, 9))):
        at = np.sort(rng.random(int(rng.integers(3, 7)))) * 2 * np.pi
        p = rng.random(2) * 20 + np.column_stack([np.cos(at), np.sin(at)]) * rng.uniform(1, 8)
        out.append([np.concatenate([p, p[:1]])])
    return out


@pytest.fixture(scope="module")
def cases():
    frame = [[box(0, 0, 10, 2)], [box(0, 8, 10, 2)], [box(0, 0, 2, 10)], [box(8, 0, 2, 10)]]
    star = [[np.array([(0, 0), (4, 0), (2, 3), (0, 0)], float)], [np.array([(0, 2), (4, 2), (2, -1), (0, 2)], float)]]
    holed = [[box(0, 0, 6, 6), box(2, 2, 2, 2)[::-1]], [box(0, 0, 6, 6), box(2, 2, 2, 2)[::-1]], [box(3, 3, 0.5, 0.5)]]
    touching = [[box(0, 0, 1, 1)], [box(1, 1, 1, 1)]]
    return {**{s: boxes(s) for s in range(8)}, **{100 + s: slanted(s) for s in range(10)}, 200: frame, 201: star, 202: holed, 203: touching, 204: [[box(0, 0, 100, 1)], *[[box(k, -1, 0.5, 3)] for k in range(100)]]}


def test_unions_match_the_plain_version(spark, cases):
    got = {r["g"]: r for r in areas.dissolved(spark.createDataFrame([r for g, given in cases.items() for r in as_rows(g, given)], SCHEMA), ["g"]).collect()}
    for g, given in cases.items():
        want = plain_areas.union(given)
        rings = [np.array([(c["x"], c["y"]) for c in r]) for r in got[g]["rings"]]
        assert got[g]["area"] == pytest.approx(sum(map(plain_areas.signed_area, want)), abs=1e-4), g
        assert got[g]["area"] == pytest.approx(sum(map(plain_areas.signed_area, rings)), abs=1e-4), g
        assert sorted(map(normal, rings)) == sorted(map(normal, want)), g


def test_unions_cover_the_cells(spark, cases):
    some = {g: given for g, given in cases.items() if g < 100}
    for r in areas.dissolved(spark.createDataFrame([r for g, given in some.items() for r in as_rows(g, given)], SCHEMA), ["g"]).collect():
        cells = {(x, y) for (b,) in some[r["g"]] for x in range(int(b[0, 0]), int(b[1, 0])) for y in range(int(b[0, 1]), int(b[2, 1]))}
        outline = sum(((x + a, y + b) not in cells) for x, y in cells for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1)))
        length = sum(np.abs(np.diff(np.array([(c["x"], c["y"]) for c in ring]), axis=0)).sum() for ring in r["rings"])
        assert (r["area"], length) == (pytest.approx(len(cells)), pytest.approx(outline))


def test_null_and_empty_areas(spark):
    square = as_rows(1, [[box(0, 0, 1, 1)[[0, 1, 2, 4]]]])[0][1]
    rows = spark.createDataFrame([(1, square), (1, square), (1, None), (2, None), (3, []), (None, square), (4, [[]]), (4, [None])], SCHEMA)
    assert {r["g"]: (len(r["rings"]), r["area"]) for r in areas.dissolved(rows, ["g"]).collect()} == {1: (1, 0.5), 2: (0, 0.0), 3: (0, 0.0), None: (1, 0.5), 4: (0, 0.0)}
    assert areas.dissolved(rows.limit(0), ["g"]).count() == 0
