"""Functions for SQL: registered by name in a session."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


class SplitWay:
    """Table function: the parts of a line (xs, ys) cut at shares of its length; shares that do not advance are passed over."""

    def eval(self, xs: list, ys: list, shares: list) -> Iterator[tuple]:
        steps = [((x2 - x1) ** 2 + (y2 - y1) ** 2) ** 0.5 for x1, x2, y1, y2 in zip(xs, xs[1:], ys, ys[1:], strict=False)]
        total, last, part = sum(steps), 0.0, 0
        for share in [*sorted(s for s in shares if 0 < s < 1), 1.0]:
            if share > last:
                part += 1
                yield part, last, share, (share - last) * total
                last = share


_SIM_LOAD = "CREATE OR REPLACE TEMPORARY FUNCTION sim_load(p DOUBLE, n DOUBLE, g DOUBLE) RETURNS DOUBLE RETURN CASE WHEN p > 0 AND n > 0 THEN p * (g + (1 - g) * pow(n, -0.75D)) ELSE 0.0D END"
_CABLE_NAME = r"CREATE OR REPLACE TEMPORARY FUNCTION cable_name(text STRING) RETURNS STRING RETURN regexp_replace(regexp_replace(regexp_replace(trim(BOTH FROM text), r'\s+', '_'), r'(\d)x(\d)', '$1_$2'), '_?SE$', '')"


def register(spark: SparkSession) -> list[str]:
    """sim_load(p, n, g) and cable_name(text), which are SQL expressions, and the table function split_way(xs, ys, shares)."""
    spark.sql(_SIM_LOAD)
    spark.sql(_CABLE_NAME)
    spark.udtf.register("split_way", F.udtf(SplitWay, returnType="part int, share_from double, share_to double, length double"))
    return ["sim_load", "cable_name", "split_way"]
