"""Folders and tables that all executors see, and small frame helpers."""

from __future__ import annotations

import ctypes
import sys
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id inside an operator; ids reach results from the input column itself.
NO_ID = -(1 << 63)


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where that is unset, a folder beside the warehouse on a single machine only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/pagewright-shared"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/pagewright/{uuid.uuid4().hex}/{name}"


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it again."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_KEPT: dict = {}
#: The C library's function that gives free memory back, where it has one.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None


def kept_by_worker(name: str, make):
    """What ``make`` gives, kept by this Python worker under ``name`` until another operator keeps something."""
    if name not in _KEPT:
        release()
        _KEPT[name] = make()
    return _KEPT[name]


def release() -> None:
    """Forget what another operator keeps in this Python worker, and give free memory back: the worker's next task may be of another operator, beside a full JVM."""
    _KEPT.clear()
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


#: The logarithm of the slots of a sieve, a bit each: half a megabyte, whatever the input.
SIEVE_BITS = 22


def sieve(rows: DataFrame, key: str, wanted: DataFrame, inside: bool = True) -> DataFrame:
    """The rows whose ``key`` (a long, not null) is in the one column of ``wanted``, and some others; or else the rest of the rows.

    A table of ``1 << SIEVE_BITS`` slots is put together by partial aggregation and comes to the filter as a scalar subquery, so that
    most rows that a join would drop never reach its shuffle. With more keys than slots more rows pass; which rows the join keeps is not changed.
    """
    slot = F.pmod(F.xxhash64(wanted.columns[0]), F.lit(1 << SIEVE_BITS))
    words = wanted.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")).toArrow()
    table = np.zeros(1 << (SIEVE_BITS - 6), np.int64)
    if words.num_rows:
        table[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    marks = pa.ListArray.from_arrays(pa.array([0, len(table)], pa.int32()), pa.array(table))
    known = rows.sparkSession.createDataFrame(pa.table({"marks": marks})).scalar()
    own = F.pmod(F.xxhash64(named(key)), F.lit(1 << SIEVE_BITS)).cast("int")
    marked = F.bit_get(F.get(known, F.shiftright(own, 6)), own.bitwiseAND(F.lit(63))) == 1
    return rows.where(marked if inside else ~marked)


def without(rows: DataFrame, bad: DataFrame) -> DataFrame:
    """The rows (``_k1``, ``_k2`` and others) whose two keys are not in ``bad``; only rows that may be in it are shuffled."""
    fingers = bad.select("_k2")
    return sieve(rows, "_k2", fingers, inside=False).union(sieve(rows, "_k2", fingers).join(bad, ["_k1", "_k2"], "left_anti").select(*rows.columns))


BATCH_CONF, BATCH_DEFAULT, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"


def small_batches(spark: SparkSession, rows: str = BATCH_ROWS) -> None:
    """Rows are texts here, some of them long: fewer of them go to Python at a time, unless the session says how many."""
    if spark.conf.get(BATCH_CONF) == BATCH_DEFAULT:
        spark.conf.set(BATCH_CONF, rows)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def named(name: str) -> Column:
    return F.col(f"`{name}`")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``_k1`` (the integer id), ``_k2`` (a fingerprint of the text), ``_text`` (null as empty), ``_carry`` (a struct).

    The two keys together name a row even if ids repeat; rows that agree in both are copies of each other
    and get the same decision. Only the named columns are taken, so no other column can clash.
    """
    text = F.coalesce(named(text_col).cast("string"), F.lit(""))
    kept = [named(c) for c in dict.fromkeys([id_col, *(carry or [])])]
    return docs.select(F.coalesce(named(id_col).cast("long"), F.lit(NO_ID)).alias("_k1"), F.xxhash64(text).alias("_k2"), text.alias("_text"), F.struct(*kept).alias("_carry"))


class Masked:
    """A frame whose columns go by position, so that no name of the caller's can clash with an operator's."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
        self.names = docs.columns
        self.columns = [f"_c{i}" for i in range(len(self.names))]
        self.docs = docs.toDF(*self.columns)
        self.id, self.text = (self.columns[self.names.index(c)] for c in (id_col, text_col))

    def back(self, out: DataFrame, **changed: Column) -> DataFrame:
        """The caller's columns again, those in ``changed`` (by the caller's name) replaced."""
        cols = [changed[n].alias(c) if n in changed else F.col(c) for n, c in zip(self.names, self.columns)]
        return out.select(*cols).toDF(*self.names)
