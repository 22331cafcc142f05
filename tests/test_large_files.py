"""Files of many features or rows: the work and the memory grow with the file, not faster."""

import time
import tracemalloc

import numpy as np
import pyarrow as pa

from gridwright.operators import nearest
from gridwright.sources import shapefiles, workbooks


def test_many_shapes_are_written_in_time_that_grows_with_them():
    rows = [([[(x - 1.0, 0.0), (x - 1.0, 2.0), (x + 1.0, 2.0), (x - 1.0, 0.0)]], {"osm_id": x}) for x in range(80_000)]
    began = time.process_time()
    shp, dbf = shapefiles.write_shapes(shapefiles.POLYGON, rows, {"osm_id": 18})
    assert time.process_time() - began < 10
    assert sum(1 for _ in shapefiles.records(shp)) == sum(1 for _ in shapefiles.attributes(dbf)) == 80_000


def _peak(work) -> int:
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_rows_of_a_large_sheet_are_not_held_together():
    books = {n: workbooks.write_sheets({"a": (["id", "use"], [(i, "SFH" if i % 3 else None) for i in range(n)])}) for n in (2_000, 20_000)}
    assert list(workbooks.sheet_rows(books[2_000]))[:3] == [["id", "use"], ["0"], ["1", "SFH"]]
    small, large = (_peak(lambda raw=raw: [None for row in workbooks.sheet_rows(raw)]) for raw in books.values())
    assert large < 3 * small


def test_distances_that_are_held_at_a_time_are_bounded():
    n = np.arange(6000)
    points = pa.table({"id": n, "x": (n * 7919 % 9973).astype(float), "y": (n * 104729 % 9967).astype(float)})
    assert _peak(lambda: nearest._k_nearest(points, points, 4, False)) < 64 << 20
