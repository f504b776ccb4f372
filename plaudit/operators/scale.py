"""Building blocks that keep hot groups spread over the cluster."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plaudit.functions.scoring import spread_hash

#: Session setting that holds the folder of everything stored in it.
RUN_FOLDER = "plaudit.run.folder"
HOT_GROUPS = 1024
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
SALTS = 4096
SAMPLE_BUCKETS = 1024
TOP_SALTS = 64
GROUP_LIMIT = 1000
QUANTILE_BUCKETS = 1024


def shared_folder(spark: SparkSession) -> str:
    """A new folder name below the run's folder in ``spark.checkpoint.dir``, which all executors
    share. Only a plain local master without that setting uses the warehouse. All folders of a
    session lie in one, which ``drop_stored`` removes."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir")
    run = spark.conf.get(RUN_FOLDER, None)
    if run is None or not run.startswith(root.rstrip("/") + "/"):
        run = f"{root.rstrip('/')}/plaudit-{uuid.uuid4().hex}"
        spark.conf.set(RUN_FOLDER, run)
    return f"{run}/{uuid.uuid4().hex}"


def drop_stored(spark: SparkSession) -> None:
    """Delete what the operators stored in this session; tables that read it are gone then."""
    run = spark.conf.get(RUN_FOLDER, None)
    if run is not None:
        path = spark._jvm.org.apache.hadoop.fs.Path(run)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        spark.conf.unset(RUN_FOLDER)


def stored(df: DataFrame) -> tuple[DataFrame, int]:
    """Write once to the shared folder and read back, with the number of rows.

    For an intermediate result that is used several times: it is not computed again, later
    plans stay short and know its size, and it survives lost executors. The count reads only
    the footers.
    """
    copy = stable_copy(df)
    return copy, copy.count()


def stored_bytes(copy: DataFrame) -> int:
    """Size of the files of a stored table."""
    return int(copy._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def stable_copy(df: DataFrame) -> DataFrame:
    """The table that ``stored`` writes, without counting it."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, megabytes: int = 8) -> None:
    """Bound the Arrow batches that Python tasks get by bytes, and not by rows alone: a row may be
    a long text or a chunk of a file. A lower bound that is set already stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(name, None)
    if held is None or not held.isdigit() or int(held) > megabytes << 20:
        spark.conf.set(name, str(megabytes << 20))


def compute_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Like ``withColumn``, but filters on the column stay above it. Spark pushes a filter
    through a projection and then evaluates the expression in both; it cannot push one through
    a generator, and this one yields a single element."""
    rest = [F.col(c) for c in df.columns if c != name]
    order = df.columns if name in df.columns else [*df.columns, name]
    made = df.select(*rest, F.explode_outer(F.array(value)).alias(name))
    return made.select(*order)


def attach_group_values(
    fact: DataFrame,
    groups: DataFrame,
    keys: list[str],
    size: str,
    spread: list[str],
    keep: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Left-join one row per group back to the rows of the group, whatever the skew.

    ``size`` is a column of ``groups`` with the number of fact rows of the group (or a number
    that grows with it). The groups are stored first, which gives their exact number. Up to
    BROADCAST_ROWS of them with files of up to BROADCAST_BYTES (keys may be long) are broadcast,
    and the fact table is not shuffled at all. Beyond
    that, the HOT_GROUPS largest ones are broadcast; their fact rows take a salt into the
    shuffle that joins the others, match nothing there and are spread evenly. A group left for
    the shuffle holds at most 1/HOT_GROUPS of all rows. Keys compare null-safe, as grouping does.

    ``keep`` is an optional filter on the struct of attached values. Rows of broadcast groups
    that fail it are dropped before any shuffle. Rows whose group is missing from ``groups``
    stay, with NULL values.
    """
    values = [c for c in groups.columns if c not in keys]
    kept = [c for c in fact.columns if c not in values]
    groups, rows = stored(groups)
    if rows <= BROADCAST_ROWS and stored_bytes(groups) <= BROADCAST_BYTES:
        found = _left_join(fact, F.broadcast(_packed(groups, keys, values)), keys)
        return _unpacked(found, kept, values, keep)
    largest = groups.filter(F.col(size) > 1).orderBy(F.desc(size), *keys).limit(HOT_GROUPS)
    marked = _left_join(fact, F.broadcast(_packed(largest, keys, values)), keys)
    if keep is not None:
        marked = marked.filter(F.col("__found").isNull() | keep(F.col("__found")))
    salt = F.lit(1) + F.pmod(F.xxhash64(*spread), F.lit(SALTS))
    marked = marked.withColumnRenamed("__found", "__hot").withColumn(
        "__salt", F.when(F.col("__hot").isNull(), F.lit(0)).otherwise(salt)
    )
    rest = _packed(groups.withColumn("__salt", F.lit(0).cast("bigint")), [*keys, "__salt"], values)
    joined = _left_join(marked, rest, [*keys, "__salt"])
    both = joined.withColumn("__found", F.coalesce("__hot", "__found"))
    return _unpacked(both, kept, values, keep)


def _packed(groups: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    return groups.select(
        *[F.col(k).alias(f"__key_{k}") for k in keys], F.struct(*values).alias("__found")
    )


def _left_join(fact: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__key_{k}")) for k in keys])
    return fact.join(groups, same, "left").drop(*[f"__key_{k}" for k in keys])


def _unpacked(found: DataFrame, kept: list[str], values: list[str], keep) -> DataFrame:
    if keep is not None:
        found = found.filter(F.col("__found").isNull() | keep(F.col("__found")))
    return found.select(*kept, *[F.col(f"__found.{v}").alias(v) for v in values])


def top_per_group(
    df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """First ``k`` rows per group; ``order`` must be total. Up to GROUP_LIMIT Spark cuts every
    map task to ``k`` rows per group before the shuffle, so a hot group reaches its task as a
    few rows. Beyond that, salted parts of the groups are cut to ``k`` rows first."""
    if k > GROUP_LIMIT:
        salt = F.pmod(F.xxhash64(*df.columns), F.lit(TOP_SALTS))
        salted = df.withColumn("__top", salt)
        part = F.row_number().over(W.partitionBy(*keys, "__top").orderBy(*order))
        df = salted.withColumn("__cut", part).filter(F.col("__cut") <= k).drop("__top", "__cut")
    ranked = df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col(rank) <= k)


def sample_per_group(
    df: DataFrame, keys: list[str], row_id: str, n: int, seed: int = 0
) -> DataFrame:
    """Exactly ``min(n, size)`` rows per group, chosen by a seeded hash of the row id.

    A histogram of the hash per group finds the bucket in which the n-th row lies; everything
    above it is dropped in the scan, and what is left is ranked.
    """
    width = (1 << 32) // SAMPLE_BUCKETS
    hashed = df.withColumn("__h", spread_hash(F.col(row_id), seed)).withColumn(
        "__bucket", F.floor(F.col("__h") / width).cast("int")
    )
    counts = hashed.groupBy(*keys, "__bucket").agg(F.count(F.lit(1)).alias("__c"))
    running = W.partitionBy(*keys).orderBy("__bucket")
    cut = (
        counts.withColumn("__cum", F.sum("__c").over(running))
        .groupBy(*keys)
        .agg(
            F.sum("__c").alias("__size"),
            F.min(F.when(F.col("__cum") >= n, F.col("__bucket"))).alias("__last"),
        )
        .filter(F.col("__size") > n)
    )
    near = attach_group_values(
        hashed, cut, keys, "__size", [row_id], keep=lambda g: F.col("__bucket") <= g["__last"]
    )
    order = [F.asc("__h"), F.asc(row_id)]
    return top_per_group(near, keys, order, n, "__rank").select(*df.columns)


def running_totals(df: DataFrame, by: str, sums: list[str]) -> DataFrame:
    """Running sums in descending order of ``by``, which must be unique and not null; ``df``
    should be stored, as it is read three times.

    Quantiles of ``by`` cut the rows into buckets of about equal size. Each bucket runs its own
    window, and the totals of the buckets above it (at most QUANTILE_BUCKETS rows) are added.
    Adds ``cum_<name>`` for every summed column.
    """
    quantiles = [i / QUANTILE_BUCKETS for i in range(1, QUANTILE_BUCKETS)]
    edges = df.agg(F.percentile_approx(by, quantiles, 100_000).alias("edges")).scalar()
    above_edges = F.size(F.filter("__edges", lambda e: e < F.col(by)))
    placed = (
        df.withColumn("__edges", F.array_distinct(edges))
        .withColumn("__bucket", above_edges)
        .drop("__edges")
    )
    totals = placed.groupBy("__bucket").agg(*[F.sum(c).alias(f"__t_{c}") for c in sums])
    above = W.orderBy(F.desc("__bucket")).rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        F.col("__bucket").alias("__b"),
        *[F.coalesce(F.sum(f"__t_{c}").over(above), F.lit(0)).alias(f"__o_{c}") for c in sums],
    )
    inside = W.partitionBy("__bucket").orderBy(F.desc(by)).rowsBetween(W.unboundedPreceding, 0)
    return (
        placed.join(F.broadcast(offsets), F.col("__bucket") == F.col("__b"))
        .select(
            *df.columns,
            *[(F.sum(c).over(inside) + F.col(f"__o_{c}")).alias(f"cum_{c}") for c in sums],
        )
    )


def dense_index(df: DataFrame, order: list[str], name: str = "id") -> DataFrame:
    """Ids 0..n-1 in the given total order, without sorting everything in one task.

    A checkpoint freezes the range-partitioned sort; each partition numbers its own rows and
    adds the sizes of the partitions before it (one row per partition).
    """
    parts = stable_copy(df.orderBy(*order).withColumn("__part", F.spark_partition_id()))
    counts = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        F.col("__part").alias("__p"),
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"),
    )
    local = F.row_number().over(W.partitionBy("__part").orderBy(*order)) - 1
    return parts.join(F.broadcast(offsets), F.col("__part") == F.col("__p")).select(
        *df.columns, (local + F.col("__offset")).cast("bigint").alias(name)
    )


def hash_bitmap(df: DataFrame, key: Column, bits: int) -> DataFrame:
    """``word, set_bits``: a bitmap of 2^bits bits over the 64-bit hashes ``key``. However many keys
    there are, it has at most 2^bits / 64 rows, so it may be broadcast; with more keys than bits it
    only drops less."""
    place = F.pmod(key, F.lit(1 << bits))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(place, F.lit(64)).cast("int"))
    words = df.select(F.shiftright(place, 6).alias("word"), bit.alias("bit"))
    return words.groupBy("word").agg(F.bit_or("bit").alias("set_bits"))


def sift(df: DataFrame, key: Column, bitmap: DataFrame, bits: int, invert: bool = False) -> DataFrame:
    """Rows whose ``key`` may be in the bitmap, in the scan and without a shuffle; with ``invert``
    those whose key is not, which are all others. What passes still has to meet its partner in a
    join; what is dropped has none."""
    place = F.pmod(key, F.lit(1 << bits))
    words = F.broadcast(bitmap.withColumnsRenamed({"word": "__word", "set_bits": "__set"}))
    met = df.join(words, F.shiftright(place, 6) == F.col("__word"), "left" if invert else "inner")
    bit = F.getbit("__set", F.pmod(place, F.lit(64)).cast("int"))
    return met.filter(F.coalesce(bit, F.lit(0)) == F.lit(0 if invert else 1)).drop("__word", "__set")
