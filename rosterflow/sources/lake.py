"""Versioned tables of Parquet files: reading, incremental and clustered writing, swaps, manifests."""

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names that query templates may use.
ABSTRACT_TABLES = ("persons_geocoded", "buildings_geocoded", "doors_geocoded")


class UnknownTableError(KeyError):
    """A table name that templates do not know."""


@dataclass(frozen=True)
class Lake:
    """Tables at root/<slug>_v<n>/<table>; any path that Spark's file systems reach."""

    spark: SparkSession
    root: str

    def path(self, version: str, name: str) -> str:
        """Where the table's files are: the folder that its pointer names."""
        fs, pointer = self._fs(self._pointer(version, name))
        if not fs.exists(pointer):
            return f"{self.root}/{version}/{name}"
        return f"{self.root}/{version}/{name}/{json.loads(self._text(self._pointer(version, name)))['files']}"

    def _pointer(self, version: str, name: str) -> str:
        return f"{self.root}/{version}/{name}.current"

    def _text(self, path: str) -> str:
        fs, p = self._fs(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self, version: str, name: str) -> bool:
        fs, p = self._fs(self.path(version, name))
        return fs.exists(p)

    def read(self, version: str, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(version, name))

    def tables(self, version: str) -> list[str]:
        fs, p = self._fs(f"{self.root}/{version}")
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []

    def columns(self, version: str, name: str) -> list[tuple[str, str]]:
        """(name, type) of the table's columns, in order."""
        return [(f.name, f.dataType.simpleString()) for f in self.read(version, name).schema]

    def rename(self, version: str, name: str, to: str) -> None:
        """The table under another name; its pointer moves last."""
        files = self.path(version, name).rsplit("/", 1)[1]
        fs, old = self._fs(f"{self.root}/{version}/{name}")
        _, new = self._fs(f"{self.root}/{version}/{to}")
        if fs.exists(new) or not fs.rename(old, new):
            raise OSError(f"{name} could not become {to}")
        self._put(f"{version}/{to}.current", {"files": files})
        fs.delete(self._fs(self._pointer(version, name))[1], False)

    def replace(self, version: str, name: str, rows: DataFrame) -> DataFrame:
        """Writes to a fresh folder and then points to it, so ``rows`` may read the table they replace and a failure leaves it as it was.

        The folder before stays for those who still read it, until the next replacement.
        """
        fresh = f"files-{uuid.uuid4().hex}"
        fs, home = self._fs(f"{self.root}/{version}/{name}")
        current = self.path(version, name).rsplit("/", 1)[1]
        rows.write.parquet(f"{self.root}/{version}/{name}/{fresh}")
        self._put(f"{version}/{name}.current", {"files": fresh})
        for s in fs.listStatus(home):
            if s.getPath().getName() not in (fresh, current):
                fs.delete(s.getPath(), True)
        return self.read(version, name)

    def insert_missing(self, version: str, name: str, rows: DataFrame, key: str) -> DataFrame:
        """Appends the rows whose key the table does not have yet."""
        if not self.exists(version, name):
            return self.replace(version, name, rows)
        fresh = rows.join(self.read(version, name).select(key), key, "left_anti")
        fresh.write.mode("append").parquet(self.path(version, name))
        return self.read(version, name)

    def clustered(self, version: str, name: str, rows: DataFrame, by: str) -> DataFrame:
        """A table in ranges of ``by``, sorted inside, so that filters on it skip row groups."""
        return self.replace(version, name, rows.repartitionByRange(by).sortWithinPartitions(by))

    def drop(self, version: str) -> None:
        fs, p = self._fs(f"{self.root}/{version}")
        fs.delete(p, True)

    def finalize(self, version: str, manifest: dict, derived: dict) -> None:
        """Writes the version's facts; it becomes active only if no version is."""
        self._put(f"{version}/manifest.json", manifest)
        self._put(f"{version}/derived.json", derived)
        if self.active() is None:
            self.activate(version)

    def active(self) -> str | None:
        fs, p = self._fs(f"{self.root}/active.json")
        if not fs.exists(p):
            return None
        return json.loads(self._text(str(p)))["version"]

    def activate(self, version: str) -> None:
        self._put("active.json", {"version": version})

    def facts(self, version: str, name: str) -> dict:
        return json.loads(self._text(f"{self.root}/{version}/{name}.json"))

    def _put(self, name: str, value: dict) -> None:
        fs, p = self._fs(f"{self.root}/{name}")
        out = fs.create(p, True)
        out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        out.close()
        self.spark.catalog.refreshByPath(str(p))

    def sql(self, template: str, version: str) -> DataFrame:
        """A query whose {names} are tables of the version; other names are errors."""
        import re

        names = sorted(set(re.findall(r"\{([a-z_]+)\}", template)))
        if unknown := [n for n in names if n not in ABSTRACT_TABLES]:
            raise UnknownTableError(f"unknown tables: {unknown}")
        return self.spark.sql(template, **{n: self.read(version, n) for n in names})


def export(rows: DataFrame, path: str, kind: str = "csv") -> int:
    """Writes CSV with a header, or Parquet; returns the number of rows."""
    writer = rows.write.mode("overwrite")
    if kind == "csv":
        writer.option("header", True).csv(path)
        return rows.sparkSession.read.option("header", True).csv(path).count()
    if kind != "parquet":
        raise ValueError(f"unknown format {kind!r}")
    writer.parquet(path)
    return rows.sparkSession.read.parquet(path).count()


def warm(*tables: DataFrame) -> int:
    """Reads all columns of the tables once."""
    return sum(t.select(*[F.count(c).alias(c) for c in t.columns]).count() for t in tables)
