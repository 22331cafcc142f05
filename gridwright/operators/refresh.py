"""Derived tables kept up to date from changes alone.

Base and derived tables lie in folders by a bucket of their key. A change is a row with a sign: 1 comes, -1 goes,
an update is both. Counts and sums of the changes are added to what is stored; least and largest values are
looked up again only for keys that lost one of theirs. Only buckets with a change are read and written.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from gridwright.checkpoints import cut

BUCKET = "bucket"


@dataclass
class Store:
    """A table in Parquet under ``path``, in ``buckets`` folders by its key."""

    spark: SparkSession
    path: str
    key: list[str]
    buckets: int = 64
    schema: StructType | None = field(default=None, repr=False)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int").alias(BUCKET)

    def write(self, rows: DataFrame) -> Store:
        """The whole table anew."""
        self.schema = rows.schema
        rows.select("*", self.bucket()).repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(self.path)
        return self

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets; other folders are not listed for files then."""
        found = self.spark.read.schema(StructType([*self.schema.fields]).add(BUCKET, IntegerType())).parquet(self.path)
        return (found if buckets is None else found.where(F.col(BUCKET).isin(buckets))).drop(BUCKET)

    def replace(self, rows: DataFrame, buckets: list[int]) -> None:
        """New content of some buckets. ``rows`` is cut off from the folders first; a bucket that has no row any more goes."""
        rows = cut(rows.select(*self.schema.names, self.bucket()))
        left = {r[0] for r in rows.select(BUCKET).distinct().collect()}  # at most one row a bucket
        rows.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)
        jvm = self.spark.sparkContext._jvm
        for b in set(buckets) - left:
            folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{BUCKET}={b}")
            folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)

    def touched(self, changes: DataFrame) -> list[int]:
        """Buckets of the keys of some rows: at most ``buckets`` of them."""
        return sorted(r[0] for r in changes.select(self.bucket()).distinct().collect())

    def apply(self, changes: DataFrame) -> list[int]:
        """Rows with ``sign`` 1 are added, as many equal rows as have -1 are taken out. Returns the touched buckets."""
        changes = cut(changes.select(*self.schema.names, "sign"))
        buckets = self.touched(changes)
        if buckets:
            plain = lambda sign: changes.where(F.col("sign") == sign).drop("sign")
            self.replace(self.read(buckets).exceptAll(plain(-1)).unionByName(plain(1)), buckets)
        return buckets


@dataclass(frozen=True)
class Totals:
    """What a derived table has of each key: n, and sums, least and largest values of columns."""

    key: tuple[str, ...]
    sums: tuple[str, ...] = ()
    extremes: tuple[str, ...] = ()

    def of(self, rows: DataFrame) -> DataFrame:
        """The full build. Null values do not count; a sum without values is 0."""
        sums = [F.coalesce(F.sum(c), F.lit(0)).cast(_wide(rows, c)).alias(f"sum_{c}") for c in self.sums]
        ends = [f(c).alias(f"{n}_{c}") for c in self.extremes for n, f in (("min", F.min), ("max", F.max))]
        return rows.groupBy(*self.key).agg(F.count("*").alias("n"), *sums, *ends)


def _wide(rows: DataFrame, column: str) -> str:
    kind = rows.schema[column].dataType.simpleString()
    return "bigint" if kind in ("tinyint", "smallint", "int", "bigint") else f"decimal(38,{kind.split(',')[1][:-1]})" if kind.startswith("decimal") else "double"


def _matched(left: DataFrame, right: DataFrame, key: list[str], how: str) -> DataFrame:
    """A join over keys that may be null; the right side's columns are named apart already."""
    named = right.select(*[F.col(c).alias(f"__gw_{c}") for c in key], *[c for c in right.columns if c not in key])
    same = F.lit(True)
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"__gw_{c}"))
    return left.join(named, same, how)


def refresh_totals(derived: Store, totals: Totals, base: Store, changes: DataFrame) -> list[int]:
    """Bring ``derived`` (the totals of ``base``) up to date with changes of the base, which are applied to it too.

    changes: the base's columns and ``sign``. Both stores have the totals' key and as many buckets. Returns the
    buckets that were read and written. Sums of floats may differ from those of a full build in their last digits.
    """
    key = list(totals.key)
    changes = cut(changes.select(*base.schema.names, "sign"))
    buckets = base.apply(changes)
    if not buckets:
        return []
    sign, gone = F.col("sign"), F.col("sign") < 0
    sums = [F.coalesce(F.sum(F.col(c) * sign), F.lit(0)).cast(_wide(changes, c)).alias(f"d_{c}") for c in totals.sums]
    ends = [f(F.when(side, F.col(c))).alias(f"{m}_{n}_{c}") for c in totals.extremes for n, f in (("min", F.min), ("max", F.max)) for m, side in (("new", ~gone), ("old", gone))]
    delta = changes.groupBy(*key).agg(F.sum(sign).alias("d_n"), *sums, *ends)
    held = derived.read(buckets)
    both = _matched(held.withColumn("__gw_in", F.lit(True)), delta, key, "full")
    c = F.col
    keys = {k: F.when(c("__gw_in"), c(k)).otherwise(c(f"__gw_{k}")) for k in key}
    lost = F.lit(False)
    for x in totals.extremes:
        lost = lost | F.coalesce(c(f"old_min_{x}") <= c(f"min_{x}"), F.lit(False)) | F.coalesce(c(f"old_max_{x}") >= c(f"max_{x}"), F.lit(False))
    least = {f"min_{x}": F.least(f"min_{x}", f"new_min_{x}") for x in totals.extremes} | {f"max_{x}": F.greatest(f"max_{x}", f"new_max_{x}") for x in totals.extremes}
    added = {f"sum_{x}": (F.coalesce(f"sum_{x}", F.lit(0)) + F.coalesce(f"d_{x}", F.lit(0))).cast(_wide(changes, x)) for x in totals.sums}
    now = both.select(*[e.alias(k) for k, e in keys.items()], (F.coalesce("n", F.lit(0)) + F.coalesce("d_n", F.lit(0))).alias("n"), *[e.alias(k) for k, e in (added | least).items()], lost.alias("__gw_lost"))
    now = cut(now.where("n > 0"))
    if totals.extremes and not (seek := now.where("__gw_lost").select(*key)).isEmpty():
        again = _matched(base.read(buckets), cut(seek), key, "left_semi")
        found = again.groupBy(*key).agg(*[f(x).alias(f"again_{n}_{x}") for x in totals.extremes for n, f in (("min", F.min), ("max", F.max))])
        now = _matched(now, found, key, "left")
        now = now.withColumns({f"{n}_{x}": F.when(c("__gw_lost"), c(f"again_{n}_{x}")).otherwise(c(f"{n}_{x}")) for x in totals.extremes for n in ("min", "max")})
    derived.replace(now.select(*derived.schema.names), buckets)
    return buckets


def refresh_joined(view: Store, rows: Store, parents: Store, row_changes: DataFrame, parent_changes: DataFrame) -> list[int]:
    """Bring ``view`` (rows with the columns of their parent) up to date with changes of either side, which are applied to both.

    All three stores have the join key and as many buckets. What goes and comes is the changed rows with their parents,
    and the old rows of changed parents with these, old and new; other rows of a bucket are copied as they are.
    """
    key = view.key
    row_changes, parent_changes = cut(row_changes.select(*rows.schema.names, "sign")), cut(parent_changes.select(*parents.schema.names, "sign"))
    buckets = sorted({*view.touched(row_changes), *view.touched(parent_changes)})
    if not buckets:
        return []
    before = cut(rows.read(buckets))
    parents.apply(parent_changes)
    # d(R x P) = R x dP + dR x (P + dP)
    moved = before.join(parent_changes, key).select(*view.schema.names, "sign")
    came = row_changes.join(parents.read(buckets), key).select(*view.schema.names, "sign")
    rows.apply(row_changes)
    changes = cut(moved.unionByName(came).groupBy(*view.schema.names).agg(F.sum("sign").alias("__gw_n")).where("__gw_n <> 0"))
    each = changes.select(*view.schema.names, F.explode(F.array_repeat(F.signum("__gw_n").cast("int"), F.abs("__gw_n").cast("int"))).alias("sign"))
    plain = lambda sign: each.where(F.col("sign") == sign).drop("sign")
    view.replace(view.read(buckets).exceptAll(plain(-1)).unionByName(plain(1)), buckets)
    return buckets
