"""A manifest of a store of files by their content, kept up to date without reading files that have not changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .published import Version, Writer, current

#: First bytes (hex) of the kinds of files.
MAGIC = {"504B0304": "zip", "D0CF11E0A1B11AE1": "ole", "25504446": "pdf", "7B5C727466": "rtf", "50415231": "parquet", "1F8B": "gzip"}
#: Files whose names are looked up one by one, at a time.
NAMED = 1_000


def kind_of(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 8))
    found = F.lit("other")
    for start, name in reversed(MAGIC.items()):
        found = F.when(head.startswith(start), name).otherwise(found)
    return found


def _read(files: DataFrame) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("name"), "length", "modificationTime", F.sha2("content", 256).alias("digest"), kind_of(F.col("content")).alias("kind"), F.lit(True).alias("fresh"))


def refresh(spark: SparkSession, source: str, root: str) -> Version:
    """Publish the manifest of all files below ``source`` as they are now: path, name, length, modificationTime, digest, kind, fresh (read in this run).

    Known is what has the path, length and time of the last manifest: it is taken over. The listing reads no contents; files changed since the latest known time
    are read by a filter on the time that the scan itself applies, others that are new under an old time by their names. Files that are gone are left out, and empty ones, which Spark does not list.
    """
    listing = lambda: spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    there = listing().load(source).select("path", "length", "modificationTime")
    last = current(spark, root)
    writer = Writer(spark, root)
    key = ["path", "length", "modificationTime"]
    if last is None:
        rows = _read(listing().load(source))
    else:
        before = last.read(spark, "manifest")
        kept = before.join(there, key, "left_semi").withColumn("fresh", F.lit(False))
        newest = before.agg(F.max("modificationTime")).first()[0]
        recent = listing().load(source).filter(F.col("modificationTime") > F.lit(newest)) if newest else listing().load(source)
        rows = kept.unionByName(_read(recent))
        old = there.filter(F.col("modificationTime") <= F.lit(newest)).join(before.select(key), key, "left_anti").select("path") if newest else None
        names: list[str] = []
        for row in old.toLocalIterator() if old is not None else ():
            names.append(row["path"])
            if len(names) == NAMED:
                rows, names = rows.unionByName(_read(listing().load(names))), []
        if names:
            rows = rows.unionByName(_read(listing().load(names)))
    written = writer.write("manifest", rows)
    counts = written.agg(F.count("*").alias("n"), F.count_if("fresh").alias("fresh"), F.count_distinct("digest").alias("contents")).first()
    writer.facts |= {"files": float(counts["n"]), "read": float(counts["fresh"]), "contents": float(counts["contents"])}
    return writer.publish(source)


def store(manifest: DataFrame) -> DataFrame:
    """Of each name the first file by path, with the number of files of that name; legacy Word files (``ole``) are marked for conversion."""
    first = manifest.groupBy("name").agg(F.min_by(F.struct("path", "digest", "length", "kind"), "path").alias("f"), F.count("*").alias("copies"))
    return first.select("name", "f.*", "copies", (F.col("f.kind") == "ole").alias("legacy"))
