"""What the training-data operators share: table access, shared scratch space, word patterns.

Words everywhere are maximal runs of characters other than space, tab, line feed, vertical
tab, form feed and carriage return.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java regular expression of what separates words.
GAP = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a temporary folder is made and set on a local master only; elsewhere that's an error.
    """
    sc = spark.sparkContext
    here = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    current = sc._jsc.sc().getCheckpointDir()
    if here:
        if not current.isDefined():
            sc.setCheckpointDir(here)
        return here
    if current.isDefined():
        return current.get()
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    here = tempfile.mkdtemp(prefix="ladderline-")
    sc.setCheckpointDir(here)
    return sc._jsc.sc().getCheckpointDir().get()


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/ladderline-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.

    The shuffle files that the write needed go with its end.
    """
    spark = df.sparkSession
    path, clean = scratch(spark, name), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(clean, None)
    spark.conf.set(clean, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(clean, before) if before is not None else spark.conf.unset(clean)
    return spark.read.schema(df.schema).parquet(path)


def discarded(*tables: DataFrame) -> None:
    """Removes what :func:`stored` wrote, once no table to come is made from it."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            p = spark._jvm.org.apache.hadoop.fs.Path(folder)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 4, is 2. A null id counts as held out: it is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def in_small_batches(df: DataFrame, rows: int = 1024) -> DataFrame:
    """``df``, whose session hands Python at most ``rows`` rows at once: bounds a worker's memory by some
    texts instead of 10,000 of them."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) <= rows:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df


def having(rows: DataFrame, ids: DataFrame, key: str, most: int = 1_000_000) -> DataFrame:
    """The rows whose ``key`` is in ``ids`` (distinct). Up to ``most`` ids are broadcast, so the rows stay
    where they are; beyond that both sides are shuffled."""
    small = ids.limit(most + 1).count() <= most
    return rows.join(F.broadcast(ids) if small else ids, key, "left_semi")


def with_row_ids(docs: DataFrame, also: tuple[str, ...] = (), id_: str = "doc_id") -> DataFrame:
    """(id, row): ``row`` is the whole row as a struct, whatever its columns are called; ``id`` is its
    ``doc_id`` where no other row has that. Rows without one, and rows that share one, get negative ids
    by their doc_id and text (and ``also``), so that only rows equal in these are still alike.
    """
    rows = docs.select(F.struct("*").alias("row"))
    key = F.col("row")[id_].cast("long")
    again = rows.groupBy(key.alias("again")).agg(F.count("*").alias("n")).where("n > 1 or again is null").select("again")
    again = stored(again, "shared-ids")
    own = -1 - F.shiftrightunsigned(F.xxhash64(key, *[F.col("row")[c] for c in ("text", *also)]), 2)
    if again.isEmpty():
        return rows.select(key.alias("id"), "row")
    small = again.limit(1_000_001).count() <= 1_000_000
    both = rows.join(F.broadcast(again) if small else again, key.eqNullSafe(F.col("again")), "left").select(
        F.when(key.isNull() | F.col("again").isNotNull(), own).otherwise(key).alias("id"), "row"
    )
    return both


def one_of_each(rows: DataFrame) -> DataFrame:
    """Of :func:`with_row_ids` one row for each id; only rows that may share one are shuffled."""
    if rows.where("id < 0").isEmpty():
        return rows
    return rows.where("id >= 0").union(rows.where("id < 0").dropDuplicates(["id"]))
