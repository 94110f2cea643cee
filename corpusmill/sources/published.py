"""Derived tables that are loaded if they are up to date, and built anew if not.

A root folder holds versions, each a folder of its own that is never written again, and
commits: one small JSON folder each, with the version, the state of its sources and
facts about it. A version is there for readers from the moment its commit is, and the
last commit is the one in force; who reads an older version goes on reading it. So a
build that breaks off leaves nothing that anybody reads, builders may run at once (the
later commit holds; of two with one number, that of the greater version name), and no
file is replaced or renamed, which object stores cannot do at once.

The state of sources is the number and size of their files and two sums of hashes over
path, length and time of change, taken by Spark from the listing; contents aren't read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Of commits as they are written here; versions of another format are stale.
FORMAT = 2
COMMIT = "seq bigint, version string, state string, facts map<string,double>, parts map<string,string>, schemas map<string,string>"


def _sums(spark: SparkSession, paths: list[str]) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    seen = F.xxhash64("path", "length", "modificationTime")
    return files.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("size"), F.coalesce(F.bit_xor(seen), F.lit(0)).alias("a"), F.coalesce(F.bit_xor(F.xxhash64(seen, F.lit(1))), F.lit(0)).alias("b"))


def _state(row: Row, schema_version: int) -> str:
    return ":".join(map(str, (FORMAT, schema_version, row["n"], row["size"], row["a"], row["b"])))


def state_of(spark: SparkSession, paths: list[str], schema_version: int = 1) -> str:
    """Changes when a file of ``paths`` (files or folders) is added, removed or replaced, or with ``schema_version``."""
    return _state(_sums(spark, paths).first(), schema_version)


@dataclass(frozen=True)
class Version:
    """One version; ``parts`` names folders of its tables that are elsewhere under the root, by a key."""

    root: str
    version: str
    seq: int
    state: str
    facts: dict[str, float] = field(default_factory=dict)
    parts: dict[str, str] = field(default_factory=dict)
    schemas: dict[str, str] = field(default_factory=dict)

    def path(self, name: str) -> str:
        return f"{self.root}/{self.version}/{name}"

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.schema(StructType.fromJson(json.loads(self.schemas[name]))).parquet(self.path(name))


class Writer:
    """Writes the tables of a version that isn't published yet; ``facts`` go into its commit."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.version = spark, root.rstrip("/"), f"v-{uuid.uuid4().hex}"
        self.facts: dict[str, float] = {}
        self.parts: dict[str, str] = {}
        self.schemas: dict[str, str] = {}

    def write(self, name: str, df: DataFrame, *partition: str) -> DataFrame:
        """Write a table and read it back."""
        path = f"{self.root}/{self.version}/{name}"
        self.schemas[name] = df.schema.json()
        df.write.partitionBy(*partition).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def publish(self, state: str) -> Version:
        last = current(self.spark, self.root)
        seq = last.seq + 1 if last else 0
        row = [(seq, self.version, state, self.facts, self.parts, self.schemas)]
        self.spark.createDataFrame(row, COMMIT).coalesce(1).write.json(f"{self.root}/commits/{self.version}")
        return Version(self.root, self.version, seq, state, dict(self.facts), dict(self.parts), dict(self.schemas))


def _latest(spark: SparkSession, root: str) -> DataFrame | None:
    """One row, the last commit (null if there is none), or None where no folder of commits is."""
    try:
        commits = spark.read.schema(COMMIT).option("mode", "FAILFAST").json(f"{root}/commits/*")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return commits.agg(F.max_by(F.struct("*"), F.struct("seq", "version")).alias("c"))


def _version(root: str, row: Row | None) -> Version | None:
    return row and Version(root, row["version"], row["seq"], row["state"], dict(row["facts"] or {}), dict(row["parts"] or {}), dict(row["schemas"] or {}))


def current(spark: SparkSession, root: str) -> Version | None:
    """The version in force, if there is one."""
    latest = _latest(spark, root.rstrip("/"))
    return None if latest is None else _version(root.rstrip("/"), latest.first()["c"])


def load_or_build(spark: SparkSession, root: str, sources: list[str], build: Callable[[Writer], None], schema_version: int = 1) -> Version:
    """The version in force if it is of the sources as they are now, else a new one that ``build`` has written.

    The state is taken before the build reads: sources that change meanwhile make the new version stale, never wrong for long.
    """
    root = root.rstrip("/")
    latest = _latest(spark, root)
    both = _sums(spark, sources) if latest is None else _sums(spark, sources).crossJoin(latest)  # one row each, in one job
    row = both.first()
    state, last = _state(row, schema_version), None if latest is None else _version(root, row["c"])
    if last and last.state == state:
        return last
    writer = Writer(spark, root)
    build(writer)
    return writer.publish(state)
