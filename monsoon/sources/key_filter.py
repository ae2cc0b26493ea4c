"""Bloom filters over the keys of a stored table, so that an append reads only the files that may hold one of its keys.

The filter of a file is a blocked one: the upper half of a key's 64-bit hash names one of 2^32 blocks of 64 bits, the lower
half sets up to five bits in it. Only blocks with bits are kept, as rows (file, block, bits) of a Parquet table in the folder
``_keys`` beside the data, which readers of the data skip. So a filter takes some twelve bytes a key whatever the size of its
file, and a probe is one equi-join on evenly spread block numbers. For a file of a million keys about one new key in 10^10 is
taken for a stored one, so an append of new keys reads no stored file, and one of old keys the files that hold them.

The filters only ever leave out files; what is stored is decided by the rows themselves. Files without a filter (plain
appends, a run that was lost between data and filter) get theirs before they are probed; filters of files that are gone
select nothing. A moved table starts anew. Like the append itself, this expects one writer at a time.

Defined results: nulls in a key equal each other; an empty table, or no new row, selects no file; repeated rows set the
same bits.
"""

from __future__ import annotations

import functools
import operator
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_BITS = 5
_FILES = "file long, path string"
_BLOCKS = "file long, block long, bits long"


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _block_and_bits(key: Sequence[str]) -> tuple[Column, Column]:
    # Hashing leaves nulls out, so whether a column is null is hashed beside it.
    hashed = F.xxhash64(*[part for c in key for part in (F.col(c), F.col(c).isNull())])
    one = F.lit(1).cast("long")
    places = [F.shiftright(hashed, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(_BITS)]
    bits = functools.reduce(Column.bitwiseOR, [F.call_function("shiftleft", one, p) for p in places])
    return F.shiftrightunsigned(hashed, 32), bits


class KeyFilter:
    """The filters of one table.

    ``table`` reads the files under ``path`` that count (it may hold a filter on partition columns). ``partitions`` are
    columns of the key that the table is partitioned by: only folders of values among the new rows are looked at.
    """

    def __init__(self, table: DataFrame, path: str, key: Sequence[str], partitions: Sequence[str] = ()):
        self.spark = table.sparkSession
        self.table = table
        self.key = list(key)
        self.partitions = list(partitions)
        types = dict(table.dtypes)
        self._files_path = f"{path}/_keys/files"
        self._blocks_path = f"{path}/_keys/blocks"
        self._blocks_schema = ", ".join([_BLOCKS, *[f"{c} {types[c]}" for c in self.partitions]])

    def _read(self, path: str, schema: str) -> DataFrame:
        if exists(self.spark, path):
            return self.spark.read.schema(schema).parquet(path)
        return self.spark.createDataFrame([], schema)

    def _own(self, new: DataFrame) -> Column:
        """Rows in the folders of ``new``: few values, one per model of a run."""
        if not self.partitions:
            return F.lit(True)
        values = new.select(*self.partitions).distinct().collect()
        one = [[F.col(c).eqNullSafe(F.lit(row[c])) for c in self.partitions] for row in values]
        return functools.reduce(operator.or_, [functools.reduce(operator.and_, c) for c in one], F.lit(False))

    def _known(self) -> list[str]:
        return [row.path for row in self._read(self._files_path, _FILES).select("path").distinct().collect()]

    def refresh(self, where: Column | None = None) -> int:
        """Build the filters of files that have none; returns how many files that were."""
        table = self.table if where is None else self.table.filter(where)
        known = self._known()
        # The listing spells a store without a host in another way; a name it spells differently costs time, no rows.
        if {re.sub(r"^(\w+):///", r"\1:/", f) for f in table.inputFiles()} <= set(known):
            return 0
        # Filters on file names leave the other files unopened.
        path = F.col("_metadata.file_path")
        fresh = [row.path for row in table.filter(~path.isin(known)).select(path.alias("path")).distinct().collect()]
        if not fresh:
            return 0
        block, bits = _block_and_bits(self.key)
        rows = table.filter(path.isin(fresh)).select(
            *self.partitions, F.xxhash64(path).alias("file"), block.alias("block"), bits.alias("bits")
        )
        blocks = rows.groupBy(*self.partitions, "file", "block").agg(F.bit_or("bits").alias("bits"))
        blocks.write.mode("append").partitionBy(*self.partitions).parquet(self._blocks_path)
        # Last, so that a file only counts as known when its filter is complete. A filter written twice does no harm.
        names = self.spark.createDataFrame([(f,) for f in fresh], "path string")
        names.select(F.xxhash64("path").alias("file"), "path").coalesce(1).write.mode("append").parquet(self._files_path)
        return len(fresh)

    def hits(self, new: DataFrame) -> list[str]:
        """The files that may hold a key of ``new``; names only, as many as the driver lists for any read of the table."""
        own = self._own(new)
        self.refresh(own)
        block, bits = _block_and_bits(self.key)
        probes = new.select(*self.partitions, block.alias("block"), bits.alias("wanted")).distinct()
        blocks = self._read(self._blocks_path, self._blocks_schema).filter(own)
        found = probes.join(blocks, [*self._same(probes, blocks), probes["block"] == blocks["block"]]).filter(
            F.col("bits").bitwiseAND(F.col("wanted")) == F.col("wanted")
        )
        paths = self._read(self._files_path, _FILES)
        chosen = paths.join(found.select("file").distinct(), "file", "left_semi").select("path").distinct().collect()
        return sorted(row.path for row in chosen)

    def _same(self, left: DataFrame, right: DataFrame) -> list[Column]:
        return [left[c].eqNullSafe(right[c]) for c in self.partitions]

    def may_hold(self, new: DataFrame) -> DataFrame | None:
        """The stored rows of the files that may hold a key of ``new``, or None if no file does."""
        files = self.hits(new)
        return self.table.filter(F.col("_metadata.file_path").isin(files)) if files else None
