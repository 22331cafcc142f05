"""What several operators of this package share."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwright.checkpoints import ensure_checkpoint_dir

#: Rows of a small keyed table up to which it is broadcast (a few tens of MB); beyond it the join shuffles.
BROADCAST_ROWS = 300_000


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bucket_of(doc_id: Column, buckets: int) -> Column:
    """crc32 of the id's decimal text, modulo ``buckets``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % buckets


def fresh(columns: list[str], *wanted: str) -> list[str]:
    """Names like the wanted ones that no column has, whatever its case; for columns that are added for a while."""
    taken = {c.lower() for c in columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if a count shows that it is small. ``df`` should be cut already."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


@contextlib.contextmanager
def shelf(spark) -> Iterator[str]:
    """A folder of its own in the checkpoint folder for tables that steps hand on; deleted at the end, after a failure too."""
    ensure_checkpoint_dir(spark)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/tables-{uuid.uuid4().hex}")
    try:
        yield folder.toString()
    finally:
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def written(df: DataFrame, folder: str, group: int | None = None) -> DataFrame:
    """``df`` written as Parquet to a new place in a shared folder, and read from there. group: bytes of a row group, for tables whose rows are large.

    Row groups are held in whole where they are written and read; their size is looked at after 100 rows only, unless it is told otherwise.
    """
    place = f"{folder}/{uuid.uuid4().hex}"
    options = {"parquet.block.size": group, "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 8} if group else {}
    df.write.options(**options).parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def give_back() -> None:
    """Return freed memory to the system: Arrow's pool and the C library keep it otherwise, and worker processes live on."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: str, most_bytes: int = 2 << 20, most_rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches where their texts pass ``most_bytes``, so that what is derived from one stays small."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, min(at + most_rows, int(np.searchsorted(ends, done + most_bytes, "right"))))
            yield batch.slice(at, to - at)
            at = to
        del batch, ends
        give_back()


def words_of(texts: pa.Array):
    """Codes and dictionary of the words of each text (runs without \\x20 \\x09-\\x0D), and the texts' offsets into the codes."""
    import numpy as np
    import pyarrow.compute as pc

    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    coded = flat.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    offsets = lists.offsets.to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(full)])[offsets - offsets[0]]
    return codes[full], coded.dictionary, offsets


class Remembered(dict):
    """A bounded cache in two generations: when the young one is full it becomes the old one; what is used again is young again."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.old = most // 2, {}

    def missing(self, keys: set) -> list:
        """Keys that have to be computed; those of the old generation come back."""
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()
        new = keys.difference(self)
        back = new.intersection(self.old)
        self.update((k, self.old[k]) for k in back)
        return list(new - back)
