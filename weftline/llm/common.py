"""Helpers that the operators of this package share: shared storage, hashing, Arrow plumbing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

U64 = np.uint64
_M1, _M2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a local folder where that is unset (tests)."""
    return spark.conf.get("spark.checkpoint.dir", None) or _local_dir(spark)


def _local_dir(spark: SparkSession) -> str:
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not hasattr(_local_dir, "path"):
        _local_dir.path = "file://" + tempfile.mkdtemp(prefix="weftline-")
    return _local_dir.path


#: Rows of a stored intermediate result that share a file where a bound of its rows is known, else bytes by the plan's estimate.
FILE_ROWS, FILE_BYTES = 250_000, 2_000_000


def few_files(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df in no more partitions than its size calls for, so that tiny partitions do not become tiny files.

    ``rows`` is a bound of its rows, where the caller has one: then the step before must be an exchange, as its tasks
    become as few. Else the optimiser's estimate counts; where that is far too large (joins), df stays as it is.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    most = -(-size // FILE_BYTES) if rows is None else -(-rows // FILE_ROWS)
    return df.coalesce(max(1, most)) if most < 100_000 else df


def materialise(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: cuts the lineage, survives lost executors. rows: see ``few_files``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weftline-{name}-{uuid.uuid4().hex}"
    few_files(df, rows).write.parquet(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes results of ``materialise`` that no later step reads: what was made from them must be stored by now."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if folder.rsplit("/", 1)[-1].startswith("weftline-"):
                jpath = jvm.org.apache.hadoop.fs.Path(folder)
                jpath.getFileSystem(conf).delete(jpath, True)


def tidy(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of results that are no longer referenced."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def slices(batch: pa.RecordBatch, text: int, most: int = 8_000) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes of the text column, none empty; a longer text is a slice with few others."""
    sizes = pc.binary_length(batch.column(text)).fill_null(0).to_numpy()
    edges = (np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1).tolist()
    for lo, hi in zip([0, *edges], [*edges, batch.num_rows], strict=True):
        if lo < hi:
            yield batch.slice(lo, hi - lo)


def arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.schema([(p.split()[0], kinds[p.split()[1]]) for p in ddl.split(",")])


def text_key(text: str | Column = "text") -> Column:
    """A 64-bit key of a whole text; null counts as empty."""
    return F.xxhash64(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def doc_columns(docs: DataFrame) -> DataFrame:
    """doc_id (long) and text alone, so that other columns of the input cannot clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


class Remembered:
    """Values of the keys met so far, in about ``most`` bytes.

    When it is full, the later half of its keys goes: what was met first is mostly what is frequent. Every eighth
    time all go, so that a change of language or subject is followed. ``make`` gives the values of a list of
    new keys; ``each`` and ``by_char`` say what a key costs.
    """

    def __init__(self, make: Callable[[list[str]], Iterable], most: int, each: int = 200, by_char: int = 2) -> None:
        self.make, self.most, self.each, self.by_char = make, most, each, by_char
        self.known: dict = {}
        self.held = self.turns = 0

    def holding(self, keys: Iterable[str]) -> dict:
        """A dict that holds all of the keys, until the next call."""
        if self.held > self.most:
            self.turns += 1
            self.known = dict(islice(self.known.items(), len(self.known) // 2 if self.turns % 8 else 0))
            self.held = sum(self.each + self.by_char * len(k) for k in self.known)
        new = list(set(keys).difference(self.known))
        if new:
            self.known.update(zip(new, self.make(new), strict=True))
            self.held += self.each * len(new) + self.by_char * sum(map(len, new))
        return self.known


def spare(df: DataFrame, name: str) -> str:
    """The name, or a longer one where df has a column of that name (whatever its case)."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser; arithmetic wraps."""
    x = x ^ (x >> U64(30))
    x = x * _M1
    x = x ^ (x >> U64(27))
    x = x * _M2
    return x ^ (x >> U64(31))


def with_text(docs: DataFrame, text: Column) -> DataFrame:
    """docs with another text, and n_chars (where docs has it) to match; every other column stays."""
    out = docs.withColumn("text", text)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


__all__ = ["F", "Remembered", "T", "U64", "arrow_schema", "discard", "doc_columns", "few_files", "map_arrow", "materialise", "mix", "read", "shared_dir", "slices", "spare", "text_key", "tidy", "with_text"]
