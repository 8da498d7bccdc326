"""Tables as partitions of Spark's own making, named by numbered manifests.

A change writes the partitions that it touches under a new ``written_=`` folder; a manifest lists the
partitions that make up the table from then on, those of older versions among them. What isn't touched
isn't rewritten. An append adds to partitions without reading any.

A manifest is created at the next number, exclusively, and counts once its last line is there: a reader
sees the table before or after, whole, and of two writers that began at the same number the second one
fails. Every manifest tells when it was made, so a table can be read as it was known at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ladderline import schemas
from ladderline.operators.records import merged


def _now() -> datetime:
    return datetime.now(UTC).replace(tzinfo=None)


class Store:
    def __init__(self, spark: SparkSession, root: str, clock: Callable[[], datetime] = _now):
        self.spark, self.root, self.clock = spark, root.rstrip("/"), clock

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def _manifests(self, table: str) -> tuple[list[int], bool]:
        """The numbers of the manifests, and whether there is data."""
        names = self._names(f"{self.root}/{table}")
        return sorted(int(n[9:]) for n in names if n.startswith("manifest-")), any(n.startswith("written_=") for n in names)

    def _place(self, table: str, number: int) -> str:
        return f"{self.root}/{table}/manifest-{number:012d}"

    def _manifest(self, table: str, number: int) -> tuple[datetime, list[str]] | None:
        """When it was made, and its partitions' paths; None where its end is missing."""
        fs, p = self._fs(self._place(table, number))
        stream = fs.open(p)
        try:
            lines = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split("\n")
        finally:
            stream.close()
        if lines[-1] != f"end {len(lines) - 2}":
            return None
        return datetime.fromisoformat(lines[0].removeprefix("at ")), lines[1:-1]

    def _newest(self, table: str, at: datetime | None = None) -> tuple[int, list[str]]:
        """Number and paths of the newest whole manifest (made by ``at``); (0, []) for a table that isn't there."""
        found, data = self._manifests(table)
        if not found and data:  # a lost manifest, or a first load that died before it had one: not an empty table
            raise RuntimeError(f"{self.root}/{table} holds data but no manifest: restore it, or remove the folder")
        lo, hi = 0, len(found)  # manifests are ordered by time: halve what is in question
        while at is not None and lo < hi:
            mid = (lo + hi) // 2
            known = self._manifest(table, found[mid])
            lo, hi = (lo, mid) if known is None or known[0] > at else (mid + 1, hi)
        if at is not None and found and not lo and found[0] > 1:
            raise LookupError(f"{table} isn't kept as far back as {at}")
        for number in reversed(found if at is None else found[:lo]):
            known = self._manifest(table, number)
            if known is not None:
                return number, known[1]
        return 0, []

    def _point_to(self, table: str, base: int, paths: Iterable[str]) -> None:
        paths = sorted(paths)
        fs, p = self._fs(self._place(table, base + 1))
        try:
            out = fs.create(p, False)
        except Exception as e:
            raise RuntimeError(f"another writer moved {self.root}/{table} on") from e
        out.write(bytearray("\n".join([f"at {self.clock().isoformat()}", *paths, f"end {len(paths)}"]).encode()))
        out.close()

    def _part(self, table: str):
        return F.coalesce(F.expr(schemas.LAYOUT.get(table, "'all'")).cast("string"), F.lit("none")).alias("part_")

    def _typed(self, table: str, rows: DataFrame) -> DataFrame:
        want = self.spark.createDataFrame([], schemas.TABLES[table]).schema
        return rows.select(*[rows[f.name].cast(f.dataType) for f in want]).select("*", self._part(table))

    def _publish(self, table: str, rows: DataFrame, replaced: set[str] | None) -> None:
        """Writes ``rows`` (with part_) and puts them in place of the partitions ``replaced`` (None: of all)."""
        base, paths = self._newest(table)
        folder = f"written_={uuid.uuid4().int >> 66}"
        rows.hint("rebalance", "part_").write.partitionBy("part_").parquet(f"{self.root}/{table}/{folder}")
        new = [f"{folder}/{n}" for n in self._names(f"{self.root}/{table}/{folder}") if n.startswith("part_=")]
        kept = [p for p in paths if replaced is not None and p.rpartition("part_=")[2] not in replaced]
        self._point_to(table, base, kept + new)

    def _rows(self, table: str, at: datetime | None = None) -> DataFrame:
        """The table with part_, by which it is pruned."""
        _, paths = self._newest(table, at)
        schema = f"{schemas.TABLES[table]}, part_ string"
        if not paths:
            return self.spark.createDataFrame([], schema)
        top = f"{self.root}/{table}"
        return self.spark.read.schema(f"{schemas.TABLES[table]}, written_ long, part_ string").option("basePath", top).parquet(*[f"{top}/{x}" for x in paths]).drop("written_")

    def read(self, table: str, at: datetime | None = None) -> DataFrame:
        """The table as it is, or as it was known at a time."""
        return self._rows(table, at).drop("part_")

    def parts(self, table: str) -> list[str]:
        return sorted({p.rpartition("part_=")[2] for p in self._newest(table)[1]})

    def read_parts(self, table: str, parts: Iterable[str]) -> DataFrame:
        """Some partitions of the table; the others aren't read."""
        return self._rows(table).where(F.col("part_").isin(*parts)).drop("part_")

    def write(self, table: str, rows: DataFrame) -> None:
        """The whole table anew; readers see the old one until the manifest is there."""
        self._publish(table, self._typed(table, rows), None)

    def replace(self, table: str, rows: DataFrame, parts: Iterable[str]) -> None:
        """``rows`` in place of all rows of the partitions ``parts``."""
        self._publish(table, self._typed(table, rows), set(parts))

    def append(self, table: str, rows: DataFrame) -> None:
        """Adds rows; what is there stays untouched."""
        self._publish(table, self._typed(table, rows), set())

    def merge(self, table: str, batch: DataFrame) -> None:
        """``batch``: one row per key, all columns of the table. Only the partitions that the batch's rows
        fall in, or that its keys are in already, are read in full and written anew."""
        m = schemas.MERGES[table]
        old, new = self._rows(table), self._typed(table, batch).persist()
        try:
            touched = {r[0] for r in new.select("part_").distinct().collect()}  # as many as there are partitions at most
            if table in schemas.LAYOUT and table not in schemas.LAID_OUT_BY_KEY:
                known = old.select(*m.key, "part_").join(new.select(*m.key), m.key, "left_semi")
                touched |= {r[0] for r in known.select("part_").distinct().collect()}
            rows = merged(old.where(F.col("part_").isin(*touched)).drop("part_"), new.drop("part_"), m.key, m.keep_first)
            self._publish(table, self._typed(table, rows), touched)
        finally:
            new.unpersist()

    def tidy(self, table: str, before: datetime) -> int:
        """Removes manifests made before a time (never the newest) and the partitions that none of the others
        names; gives the number of partitions. Don't run it while a reader may still hold an older table."""
        found, _ = self._manifests(table)
        newest, _ = self._newest(table)
        known = {n: self._manifest(table, n) or (datetime.min, []) for n in found}
        stay = [n for n in found if n >= newest or known[n][0] >= before]
        gone = {p for n in found if n not in stay for p in known[n][1]} - {p for n in stay for p in known[n][1]}
        for name in [self._place(table, n) for n in found if n not in stay] + [f"{self.root}/{table}/{g}" for g in sorted(gone)]:
            fs, p = self._fs(name)
            fs.delete(p, True)
        return len(gone)
