"""What the operators of this subpackage share: stored tables, row identity, words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: A word is a run of anything but the six ASCII white-space characters.
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """A new folder name under ``spark.checkpoint.dir``, which all executors share.

    Only a plain local master without that setting gets a temporary folder, once per session.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="plaudit-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/plaudit-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, survives lost executors."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``withColumn`` for an expensive expression that several others use: as the output of a
    generator it is evaluated once and not copied into each of them."""
    rest = [F.col(f"`{c}`") for c in df.columns if c != name]
    return df.select(*rest, F.explode_outer(F.array(value)).alias(name))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_of(name: str = "text") -> Column:
    """A null text counts as an empty one."""
    return F.coalesce(F.col(name), F.lit(""))


def word_array(text: Column) -> Column:
    """The words of a text, in order; none for an empty or blank text."""
    return F.filter(F.split(text, GAP), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(word_array(text)).cast("bigint")


def held_out(doc_id: Column, folds: int) -> Column:
    """True for documents whose crc32 of the id as text leaves no remainder."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))


def bounded_batches(spark: SparkSession, megabytes: int = 16) -> None:
    """Bound the Arrow batches that Python tasks get by bytes: rows may be long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(megabytes << 20))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")


def one_per_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """A row per key of a stored table whose rows with equal keys are alike. Only if keys repeat
    (counted on the keys alone) do the rows themselves move."""
    if df.groupBy(*keys).count().filter("count > 1").isEmpty():
        return df
    return df.dropDuplicates(keys)


def map_columns(
    df: DataFrame,
    work: Callable[[pa.RecordBatch], tuple[list | None, dict[str, list]]],
    new: dict[str, str],
    drop: tuple[str, ...] = (),
) -> DataFrame:
    """Add or replace columns by Python in Arrow batches; all other columns pass through as they
    are, whatever their types and nulls. ``work`` returns the rows to take (None: each once, as
    they stand) and the values of the ``new`` columns (name, type) for them."""
    parsed = {k: T._parse_datatype_string(v) for k, v in new.items()}
    fields = [T.StructField(f.name, parsed.get(f.name, f.dataType)) for f in df.schema if f.name not in drop]
    fields += [T.StructField(k, v) for k, v in parsed.items() if k not in df.columns]
    schema = T.StructType(fields)
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            take, made = work(batch)
            rest = [n for n in target.names if n not in made]
            rows = batch.select(rest) if take is None else batch.select(rest).take(pa.array(take, pa.int64()))
            arrays = [pa.array(made[f.name], f.type) if f.name in made else rows.column(f.name) for f in target]
            yield pa.RecordBatch.from_arrays(arrays, schema=pa.schema([pa.field(f.name, a.type) for f, a in zip(target, arrays)]))

    return df.mapInArrow(run, schema)
