"""Tables of a folder that change together: every state is a version, and a new one takes over at once.

A version is a small file that names, for each table, the folders its rows lie in.  Rows are
written first, to new folders; then the file of the next version is put in place by a rename
that fails if another writer came first.  So a reader sees one version throughout, a job that
dies before the rename leaves the old one, and what it wrote is swept by ``vacuum``.

Tables with a key are dealt into buckets by a hash of it, a folder each, and a change rewrites
only the buckets it touches.  Tables without one only grow: every change adds a folder, and
once there are ``MANY`` the change that finds them so writes them as one.

``done`` goes into the same file: how far a stream or a sliced job has come is committed with
what it wrote, so a repeated batch can be told and a failed run goes on where it stopped.

The driver holds the file alone: at most as many folder names as there are buckets.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Folders of a growing table above which they become one.
MANY = 64
_BUCKET = "_bucket"


class Conflict(RuntimeError):
    """Another writer committed first."""


class Versions:
    """The tables under a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.path).getFileSystem(conf)
        self._rename = lambda a, b: jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf).rename(self._path(a), self._path(b), spark._sc._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))

    # --- versions

    def versions(self) -> list[int]:
        at = self._path(f"{self.path}/versions")
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(at) if s.getPath().getName().isdigit()) if self._fs.exists(at) else []

    def state(self, version: int | None = None) -> dict:
        """version, tables and done of a version, the last one by default; an empty folder has version 0 without tables."""
        if version is None:
            version = (self.versions() or [0])[-1]
        if not version:
            return {"version": 0, "tables": {}, "done": {}}
        stream = self._fs.open(self._path(f"{self.path}/versions/{version:012d}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def done(self, name: str) -> int:
        """How far a stream or job has come; -1 if it has not begun."""
        return self.state()["done"].get(name, -1)

    def read(self, table: str, version: int | None = None) -> DataFrame:
        return self._rows(self.state(version)["tables"][table])

    def has(self, table: str) -> bool:
        return table in self.state()["tables"]

    def _rows(self, of: dict, buckets: list[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(of["schema"])
        folders = of["parts"] if of["key"] is None else [p for b, p in of["parts"].items() if buckets is None or int(b) in set(buckets)]
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{p}" for p in folders]) if folders else self.spark.createDataFrame([], schema)

    # --- changes

    @contextmanager
    def change(self) -> Iterator[Change]:
        """Everything asked of the change within the block becomes the next version, or nothing does."""
        made = Change(self)
        yield made
        made.state["version"] += 1
        draft, final = f"{self.path}/drafts/{uuid.uuid4().hex}", f"{self.path}/versions/{made.state['version']:012d}"
        self._fs.mkdirs(self._path(f"{self.path}/versions"))
        out = self._fs.create(self._path(draft))
        out.write(bytearray(json.dumps(made.state).encode()))
        out.close()
        try:
            self._rename(draft, final)
        except Exception as e:
            if self._fs.exists(self._path(final)):
                raise Conflict(f"version {made.state['version']} of {self.path} is already there") from e
            raise

    def vacuum(self, keep: int = 2) -> int:
        """Deletes folders that none of the last `keep` versions names, and older versions; returns how many went.  No change may be under way."""
        versions = self.versions()
        held = {p for v in versions[-keep:] for t in self.state(v)["tables"].values() for p in (t["parts"] if t["key"] is None else t["parts"].values())}
        gone = [f"versions/{v:012d}" for v in versions[:-keep]]
        for status in self._fs.listStatus(self._path(f"{self.path}/data")) if self._fs.exists(self._path(f"{self.path}/data")) else []:
            own = f"data/{status.getPath().getName()}"
            parts = [p for p in held if p == own or p.startswith(f"{own}/")]
            if not parts:
                gone.append(own)
            elif own not in parts:
                gone += [p for s in self._fs.listStatus(status.getPath()) if s.isDirectory() and (p := f"{own}/{s.getPath().getName()}") not in parts]
        for p in gone:
            self._fs.delete(self._path(f"{self.path}/{p}"), True)
        return len(gone)


class Change:
    """The next version in the making."""

    def __init__(self, versions: Versions):
        self.of, self.state = versions, versions.state()

    def read(self, table: str) -> DataFrame:
        """The table as this change has left it so far."""
        return self.of._rows(self.state["tables"][table])

    def done(self, name: str, upto: int) -> None:
        self.state["done"][name] = upto

    def _write(self, df: DataFrame, *by: str) -> str:
        own = f"data/{uuid.uuid4().hex}"
        (df.write.partitionBy(*by) if by else df.write).parquet(f"{self.of.path}/{own}")
        return own

    def put(self, table: str, df: DataFrame, key: str | None = None, buckets: int = 64) -> None:
        """The whole table anew; with a key, dealt into so many buckets."""
        schema = df.schema
        if key is None:
            self.state["tables"][table] = {"key": None, "schema": schema.jsonValue(), "parts": [self._write(df)]}
            return
        of = {"key": key, "buckets": buckets, "schema": schema.jsonValue(), "parts": {}}
        of["parts"] = self._dealt(df, of)
        self.state["tables"][table] = of

    def append(self, table: str, df: DataFrame) -> None:
        """Rows added to a table without a key, which is made if it is not there."""
        of = self.state["tables"].get(table)
        if of is None:
            self.put(table, df)
            return
        if len(of["parts"]) >= MANY:
            of["parts"] = [self._write(self.of._rows(of).unionByName(df))]
        else:
            of["parts"] = [*of["parts"], self._write(df.select(*StructType.fromJson(of["schema"]).names))]

    def touched(self, table: str, keys: DataFrame) -> list[int]:
        """The buckets that hold these keys; no more numbers than there are buckets."""
        of = self.state["tables"][table]
        return sorted(r[0] for r in keys.select(_bucket(F.col(of["key"]), of["buckets"])).distinct().collect())

    def held(self, table: str, touched: list[int]) -> DataFrame:
        """The rows of these buckets, as this change has left them so far."""
        return self.of._rows(self.state["tables"][table], touched)

    def replace(self, table: str, df: DataFrame, touched: list[int]) -> None:
        """df instead of the rows of these buckets; every row of df must belong to one of them."""
        of = self.state["tables"][table]
        kept = {b: p for b, p in of["parts"].items() if int(b) not in set(touched)}
        of["parts"] = kept | (self._dealt(df.select(*StructType.fromJson(of["schema"]).names), of) if touched else {})

    def _dealt(self, df: DataFrame, of: dict) -> dict[str, str]:
        rows = df.withColumn(_BUCKET, _bucket(F.col(of["key"]), of["buckets"]))
        own = self._write(rows.hint("rebalance", F.col(_BUCKET)), _BUCKET)  # a bucket in one task, a large one in several
        at = self.of._path(f"{self.of.path}/{own}")
        names = [s.getPath().getName() for s in self.of._fs.listStatus(at) if s.isDirectory()]
        return {n.split("=")[1]: f"{own}/{n}" for n in names if n.startswith(f"{_BUCKET}=")}


def _bucket(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
