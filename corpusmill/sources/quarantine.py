"""JSON Lines of which some are broken: one pass puts each line to the good rows or, with a reason, to the quarantine.

Also sessions of an older layout, with their turns in a table of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .published import Version, Writer

NOT_JSON, NO_KEY, WRONG_TYPE = "not_json", "no_key", "wrong_type"


def _parsed(line: Column, schema: StructType) -> Column:
    whole = StructType(list(schema.fields)).add("_corrupt", "string")
    return F.from_json(line, whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})


def ingest(spark: SparkSession, path: str, schema: str, key: str, root: str) -> Version:
    """Read the lines at ``path`` once and publish them at ``root``: rows of ``schema`` that have a ``key``, and the others as they stand.

    Blank lines are skipped. A line is quarantined if it is no JSON object, lacks the key, or has a value that its field's type cannot take.
    Facts of the version: ``good``, ``bad``.
    """
    kind = StructType.fromDDL(schema)
    lines = spark.read.text(path).filter(F.trim("value") != "").select("value", F.col("_metadata.file_path").alias("file"))
    own = lines.withColumn("row", _parsed(F.col("value"), kind))
    whole = F.trim("value").startswith("{") & F.try_parse_json("value").isNotNull()
    reason = F.when(~whole, NOT_JSON).when(F.col("row._corrupt").isNotNull(), WRONG_TYPE).when(F.col(f"row.{key}").isNull(), NO_KEY)
    routed = own.withColumn("reason", reason).select(F.col("reason").isNotNull().alias("bad"), "reason", F.when(reason.isNotNull(), F.col("value")).alias("line"), "file", F.when(reason.isNull(), F.col("row").dropFields("_corrupt")).alias("row"))
    writer = Writer(spark, root)
    written = writer.write("lines", routed, "bad")
    counts = dict(written.groupBy("bad").count().collect())  # two rows at most
    writer.facts |= {"good": float(counts.get(False, 0)), "bad": float(counts.get(True, 0))}
    return writer.publish(f"{path}")


def good(spark: SparkSession, version: Version) -> DataFrame:
    return version.read(spark, "lines").filter("NOT bad").select("row.*")


def quarantined(spark: SparkSession, version: Version) -> DataFrame:
    """reason, line and file of each line that was put aside."""
    return version.read(spark, "lines").filter("bad").select("reason", "line", "file")


def migrated_sessions(states: DataFrame, turns: DataFrame) -> DataFrame:
    """(user, session, turn_count, last_turn_id, turns): sessions of the older layout in the present one.

    ``states``: user, session, turn_count and the turns (array of struct, each with turn_id) that a state has itself; ``turns``: user, session, seq and turn (such a struct).
    The table's turns count if there are any, else the state's own; turn_count never falls.
    """
    listed = turns.groupBy("user", "session").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "turn"))), lambda x: x["turn"]).alias("listed"))
    own = states.join(listed, ["user", "session"], "left").withColumn("turns", F.coalesce("listed", "turns", F.array().cast(states.schema["turns"].dataType)))
    return own.select("user", "session", F.greatest(F.coalesce("turn_count", F.lit(0)), F.size("turns")).cast("bigint").alias("turn_count"), F.get(F.col("turns"), F.size("turns") - 1)["turn_id"].alias("last_turn_id"), "turns")
