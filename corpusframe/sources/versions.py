"""Tables that change as a whole (S7, L3): versions in directories of their own, made current by one small file that comes last.

A version holds one or several tables. Its files are written first, below a name nobody reads; then a mark with the version's
number is moved into place, which either happens or does not. Readers take the greatest mark and hold on to its directory, so
neither a writer that dies between its steps nor one that comes next changes what they see. Two writers from the same version
cannot both win: the mark of a number is there once.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another version came between."""


class Versions:
    """Versions of the named tables below a folder. schemas: what a table looks like as long as there is none."""

    def __init__(self, spark: SparkSession, folder: str, schemas: Mapping[str, str]):
        self.spark, self.folder, self.schemas = spark, folder.rstrip("/"), dict(schemas)
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._files = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._hadoop.Path(name)

    def numbers(self) -> list[int]:
        """Numbers of the versions that are there, rising."""
        marks = self._path(f"{self.folder}/_marks")
        if not self._files.exists(marks):
            return []
        names = [x.getPath().getName() for x in self._files.listStatus(marks)]
        return sorted(int(n) for n in names if n.isdigit())

    def current(self) -> int | None:
        return (self.numbers() or [None])[-1]

    def mark(self, number: int) -> dict:
        """directory, tables and note of a version."""
        stream = self._files.open(self._path(f"{self.folder}/_marks/{number:012d}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self, table: str, number: int | None = None) -> DataFrame:
        """A table of the current or the given version; an empty one where there is none or the version lacks it. What is read stays the
        same when later versions come, as long as drop_old() leaves it."""
        number = self.current() if number is None else number
        known = self.mark(number) if number is not None else {"tables": []}
        if table not in known["tables"]:
            return self.spark.createDataFrame([], self.schemas[table])
        return self.spark.read.schema(self.schemas[table]).parquet(f"{self.folder}/{known['directory']}/{table}")

    def publish(self, tables: Mapping[str, DataFrame], base: int | None = None, note: str = "", key: str | None = None) -> int:
        """Write tables as the version after base, and return its number. Tables of base that are not given are carried over. With a key a
        version that has it already is kept in place of writing it again, so a job that is repeated changes nothing."""
        if key is not None:
            done = [n for n in self.numbers() if self.mark(n).get("key") == key]
            if done:
                return done[-1]
        if base != self.current():
            raise Conflict(f"version {base} is not the current one, {self.current()}")
        directory = f"v-{uuid.uuid4().hex}"
        carried = {t: self.read(t, base) for t in (self.mark(base)["tables"] if base is not None else []) if t not in tables}
        for name, rows in {**tables, **carried}.items():
            want = self.spark.createDataFrame([], self.schemas[name]).schema
            rows.select(*[rows[f.name].cast(f.dataType).alias(f.name) for f in want]).write.parquet(f"{self.folder}/{directory}/{name}")
        self._make_current(0 if base is None else base + 1, {"directory": directory, "tables": sorted({*tables, *carried}), "note": note, "key": key})
        return 0 if base is None else base + 1

    def _make_current(self, number: int, mark: dict) -> None:
        """The last step: a complete mark under another name is moved to its number, unless that is taken."""
        context = self._hadoop.FileContext.getFileContext(self._files.getUri(), self.spark._jsc.hadoopConfiguration())
        draft, place = self._path(f"{self.folder}/_marks/.{uuid.uuid4().hex}"), self._path(f"{self.folder}/_marks/{number:012d}")
        stream = self._files.create(draft, False)
        stream.write(bytearray(json.dumps(mark).encode()))
        stream.close()
        none = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, place, none)
        except Exception as taken:
            self._files.delete(draft, False)
            if self._files.exists(place):
                raise Conflict(f"version {number} is there already") from taken
            raise

    def update(self, change: Callable[[Mapping[str, DataFrame]], Mapping[str, DataFrame]], note: str = "", key: str | None = None, tries: int = 3) -> int:
        """Publish what change makes of the current tables; where another version comes between, it is asked again with that one."""
        for left in reversed(range(tries)):
            base = self.current()
            try:
                return self.publish(change({t: self.read(t, base) for t in self.schemas}), base, note, key)
            except Conflict:
                if not left:
                    raise
        raise Conflict("no try was allowed")

    def drop_old(self, keep: int = 2) -> list[int]:
        """Remove all but the last versions, marks first, and directories that no mark names (of writers that died); the numbers removed."""
        numbers = self.numbers()
        gone = numbers[: max(0, len(numbers) - max(1, keep))]
        for n in gone:
            self._files.delete(self._path(f"{self.folder}/_marks/{n:012d}"), False)
        named = {self.mark(n)["directory"] for n in self.numbers()}
        for x in self._files.listStatus(self._path(self.folder)) if self._files.exists(self._path(self.folder)) else []:
            name = x.getPath().getName()
            if name.startswith("v-") and name not in named:
                self._files.delete(x.getPath(), True)
        return gone


def write_register(register: Versions, table: str, rows: DataFrame, key: str | None = None, order: str | None = None) -> int:
    """Replace a register as a whole. With a key its old rows stay, and of the rows of a key the last by `order` wins, a new one of equal
    order over an old one."""
    from pyspark.sql import Window as W
    from pyspark.sql import functions as F

    def change(have: Mapping[str, DataFrame]) -> Mapping[str, DataFrame]:
        if key is None:
            return {table: rows}
        both = have[table].withColumn("__new", F.lit(0)).unionByName(rows.withColumn("__new", F.lit(1)))
        last = F.row_number().over(W.partitionBy(key).orderBy(F.desc_nulls_last(order or "__new"), F.desc("__new")))
        return {table: both.withColumn("__r", last).where("__r = 1").drop("__r", "__new")}

    return register.update(change, note=f"register {table}")
