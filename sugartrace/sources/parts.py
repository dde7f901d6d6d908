"""A Parquet table in parts that is changed part by part, with readers and failures in mind.

Layout under the table's folder: `data/version=V/part=P/` holds the rows of part P as version V left them, and
`pointers/V.json` says which version of each part counts. A change writes new folders only, then its pointer by one
rename, so a reader sees the table before or after it and never a gap; what a failed change wrote is not pointed to and
is overwritten by the next one. Batches of a stream carry their number, which is part of the pointer: a batch that is
replayed after its pointer stands changes nothing. One writer at a time; any number of readers.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PART = "part"
NO_PART = "none"  # rows whose part is null


class PartTable:
    """`part` gives a row's part from its columns. The number of parts must be bounded by days or buckets, not by rows:
    their names pass through the driver."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, part: Column):
        self.spark, self.path, self.part = spark, path.rstrip("/"), part
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # pointers

    def _names(self, folder: str) -> list[str]:
        where = self._path(f"{self.path}/{folder}")
        return [s.getPath().getName() for s in self._fs.listStatus(where)] if self._fs.exists(where) else []

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names("pointers") if n.endswith(".json") and n[:-5].isdigit())

    def _pointer(self, version: int | None = None) -> dict:
        if version is None:
            known = self.versions()
            if not known:
                return {"version": 0, "parts": {}, "batches": {}}
            version = known[-1]
        text = self.spark.read.text(f"{self.path}/pointers/{version}.json", wholetext=True).first()[0]
        return json.loads(text)

    def _point(self, pointer: dict) -> None:
        final = self._path(f"{self.path}/pointers/{pointer['version']}.json")
        draft = self._path(f"{self.path}/pointers/{pointer['version']}.draft")
        if self._fs.exists(final):
            raise OSError(f"{final} exists: another writer changed the table")
        out = self._fs.create(draft, True)
        try:
            out.write(json.dumps(pointer, sort_keys=True).encode())
        finally:
            out.close()
        if not self._fs.rename(draft, final):
            raise OSError(f"{final} could not be written; the table is unchanged")

    # reading

    def read(self, parts: Iterable[str] | None = None, version: int | None = None) -> DataFrame:
        """The whole table, or some parts of it: only their folders are listed and read."""
        current = self._pointer(version)["parts"]
        names = current if parts is None else [p for p in parts if p in current]
        paths = [f"{self.path}/data/version={current[p]}/{PART}={p}" for p in names]
        reader = self.spark.read.schema(self.schema)
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def parts_of(self, rows: DataFrame) -> list[str]:
        """Names of the parts that rows belong to."""
        return sorted(r[0] for r in self._with_part(rows).select(PART).distinct().collect())

    def done(self, source: str, batch: int) -> bool:
        return self._pointer()["batches"].get(source, -1) >= batch

    # writing

    def _with_part(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(PART, F.coalesce(self.part.cast("string"), F.lit(NO_PART)))

    def merge(
        self,
        incoming: DataFrame,
        combine: Callable[[DataFrame, DataFrame], DataFrame],
        source: str | None = None,
        batch: int | None = None,
    ) -> list[str]:
        """Replace the parts that `incoming` touches by `combine(their rows, incoming)`; returns these parts.

        `incoming` is read twice, for its parts and its rows. With a source and a batch number, a batch up to the last one
        of that source is already in the table and left out.
        """
        pointer = self._pointer()
        if source is not None and pointer["batches"].get(source, -1) >= batch:
            return []
        touched = self.parts_of(incoming)
        version = pointer["version"] + 1
        kept = {p: v for p, v in pointer["parts"].items() if p not in touched}
        written = self._write(combine(self.read(touched), incoming), version) if touched else []
        if not set(written) <= set(touched):
            raise ValueError(f"rows moved to parts that were not read: {sorted(set(written) - set(touched))}")
        self._commit(pointer, version, {**kept, **dict.fromkeys(written, version)}, source, batch)
        return touched

    def replace(self, rows: DataFrame) -> None:
        """The whole table anew; `rows` may read the table itself."""
        pointer = self._pointer()
        version = pointer["version"] + 1
        self._commit(pointer, version, dict.fromkeys(self._write(rows, version), version))

    def _write(self, rows: DataFrame, version: int) -> list[str]:
        folder = f"data/version={version}"
        named = self._with_part(rows.select(*self.schema.fieldNames())).hint("rebalance", PART)
        named.write.mode("overwrite").partitionBy(PART).parquet(f"{self.path}/{folder}")
        return [n.split("=", 1)[1] for n in self._names(folder) if n.startswith(f"{PART}=")]

    def _commit(self, pointer: dict, version: int, parts: dict, source: str | None = None, batch: int | None = None) -> None:
        batches = {**pointer["batches"], **({source: batch} if source is not None else {})}
        self._point({"version": version, "parts": parts, "batches": batches})

    def vacuum(self, keep: int = 2) -> list[int]:
        """Delete what only versions before the last `keep` point to. A reader holds a version for as long as that."""
        known = self.versions()
        held = {v for known_version in known[-keep:] for v in self._pointer(known_version)["parts"].values()}
        for version in known[:-keep]:
            self._fs.delete(self._path(f"{self.path}/pointers/{version}.json"), False)
        gone = [v for v in (int(n.split("=")[1]) for n in self._names("data")) if v not in held and v <= known[-1]]
        for version in gone:
            self._fs.delete(self._path(f"{self.path}/data/version={version}"), True)
        return sorted(gone)
