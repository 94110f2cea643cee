"""Rows written in a query itself: the same ones as a DataFrame and as a DuckDB table expression, by themselves or dealt over a given table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Types of DuckDB for those of Spark's schema strings.
_TYPES = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "array<string>": "VARCHAR[]", "array<int>": "INTEGER[]"}


def _literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(_literal, value)) + "]"
    if isinstance(value, float):
        return f"{value!r}::DOUBLE"
    if isinstance(value, int):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


@dataclass
class Inline:
    """``schema``: names and types as in Spark, split by commas; no type holds a comma."""

    schema: str
    rows: list[tuple]

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.schema)

    @property
    def sql(self) -> str:
        fields = [x.split() for x in self.schema.split(",")]
        columns = ", ".join(f"c{i}::{_TYPES[t]} AS {n}" for i, (n, t) in enumerate(fields))
        values = ", ".join("(" + ", ".join(map(_literal, row)) + ")" for row in self.rows)
        return f"(SELECT {columns} FROM (VALUES {values}) v({', '.join(f'c{i}' for i in range(len(fields)))}))"


def strings(values: tuple[str, ...] | list[str]) -> str:
    """A DuckDB list of strings."""
    return _literal(list(values))


#: How far the numbers of one round of rows are from those of the next.
ROUND = 1_000


@dataclass
class Spread(Inline):
    """``rows`` dealt over a given table: each of its rows, in rounds of as many as there are ``rows``, has the one that its key names.

    Columns ``ids`` get the number of the round, so that what belongs together in ``rows`` does so in each round; to the columns ``texts`` a piece of the
    table's own text is added, which differs from row to row.
    """

    ids: tuple[str, ...] = ("id",)
    texts: tuple[str, ...] = ()
    table: str = "documents"
    key: str = "doc_id"
    text: str = "text"

    def df(self, spark: SparkSession, d: str) -> DataFrame:  # type: ignore[override]
        n, key = len(self.rows), F.col(self.key).cast("bigint")
        piece = F.substring(F.coalesce(F.col(self.text), F.lit("")), (key % 97 + 1).cast("int"), F.lit(12))
        own = spark.read.parquet(f"{d}/{self.table}.parquet").filter(F.col(self.key).isNotNull()).select((key % n).cast("int").alias("_k"), F.floor(key / n).alias("_round"), piece.alias("_piece"))
        kinds = ", ".join(f"_c{i} {x.split()[1]}" for i, x in enumerate(self.schema.split(",")))
        bank = spark.createDataFrame([(k, *r) for k, r in enumerate(self.rows)], f"_k int, {kinds}")
        names = [x.split()[0] for x in self.schema.split(",")]
        joined = own.join(F.broadcast(bank), "_k")  # the rows above, written in the source
        value = lambda i, c: (F.col("_round") * ROUND + F.col(f"_c{i}")).cast("bigint") if c in self.ids else F.concat(F.col(f"_c{i}"), F.lit(" "), F.col("_piece")) if c in self.texts else F.col(f"_c{i}")
        return joined.select(*(value(i, c).alias(c) for i, c in enumerate(names)))

    @property
    def sql(self) -> str:
        n, names = len(self.rows), [x.split()[0] for x in self.schema.split(",")]
        fields = [x.split()[1] for x in self.schema.split(",")]
        values = ", ".join("(" + ", ".join([str(k), *map(_literal, r)]) + ")" for k, r in enumerate(self.rows))
        bank = f"(SELECT k, {', '.join(f'c{i}::{_TYPES[t]} AS c{i}' for i, t in enumerate(fields))} FROM (VALUES {values}) x(k, {', '.join(f'c{i}' for i in range(len(names)))}))"
        value = lambda i, c: f"(t.round * {ROUND} + v.c{i})::BIGINT" if c in self.ids else f"v.c{i} || ' ' || t.piece" if c in self.texts else f"v.c{i}"
        columns = ", ".join(f'{value(i, c)} AS "{c}"' for i, c in enumerate(names))
        own = f"(SELECT {self.key} % {n} AS k, {self.key} // {n} AS round, substring(coalesce({self.text}, ''), ({self.key} % 97 + 1)::INT, 12) AS piece FROM {self.table} WHERE {self.key} IS NOT NULL)"
        return f"(SELECT {columns} FROM {own} t JOIN {bank} v ON v.k = t.k)"


@dataclass
class Every(Inline):
    """All of ``rows`` for each row of a given table, whose key makes the numbers in columns ``ids`` its own: a group of rows is worked on as often as the table has rows."""

    ids: tuple[str, ...] = ("id",)
    table: str = "supplier"
    key: str = "s_suppkey"

    def df(self, spark: SparkSession, d: str) -> DataFrame:  # type: ignore[override]
        kinds = ", ".join(f"_c{i} {x.split()[1]}" for i, x in enumerate(self.schema.split(",")))
        names = [x.split()[0] for x in self.schema.split(",")]
        own = spark.read.parquet(f"{d}/{self.table}.parquet").filter(F.col(self.key).isNotNull()).select((F.col(self.key).cast("bigint") * ROUND).alias("_at"))
        bank = F.array(*(F.struct(*(F.lit(x).cast(k.split()[1]).alias(k.split()[0]) for x, k in zip(r, kinds.split(", ")))) for r in self.rows))
        # the table may be one small file, the work on its rows is not small
        each = own.repartition(spark.sparkContext.defaultParallelism, "_at").select("_at", F.inline(bank))
        return each.select(*((F.col("_at") + F.col(f"_c{i}")).cast("bigint").alias(c) if c in self.ids else F.col(f"_c{i}").alias(c) for i, c in enumerate(names)))

    def results(self, schema: str, rows: list[tuple]) -> str:
        """What ``rows`` are expected to give, for each row of the table."""
        names = [x.split()[0] for x in schema.split(",")]
        columns = ", ".join(f'({self.key} * {ROUND} + v."{c}")::BIGINT AS "{c}"' if c in self.ids else f'v."{c}"' for c in names)
        quoted = ", ".join(f'{c} AS "{names[i]}"' for i, c in enumerate(f"c{i}::{_TYPES[x.split()[1]]}" for i, x in enumerate(schema.split(","))))
        values = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
        return f"SELECT {columns} FROM {self.table}, (SELECT {quoted} FROM (VALUES {values}) x({', '.join(f'c{i}' for i in range(len(names)))})) v WHERE {self.key} IS NOT NULL"
