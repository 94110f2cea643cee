"""Administrative regions: a tree's paths, aliases, mentions in texts, relations; effect levels and jurisdictions; catalogues and their documents."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Suffixes of region names in the order they are tried, names that stand for no place of their own, town suffixes.
SUFFIXES = ("特别行政区", "维吾尔自治区", "壮族自治区", "回族自治区", "自治区", "自治州", "自治县", "林区", "地区", "盟", "省", "市", "县", "区")
PLACEHOLDERS = ("市辖区", "县", "自治区直辖县级行政区划", "省直辖县级行政区划")
TOWN_SUFFIXES = ("街道", "镇", "乡", "苏木", "民族乡", "地区办事处", "办事处")
#: Effect levels of categories, ranks of levels and of jurisdictions, local categories, levels by length of a code.
EFFECT = {"宪法": "宪法", "法律": "法律", "法律解释": "法律", "修正案": "法律", "有关法律问题和重大问题的决定（部分）": "法律", "行政法规": "法规", "监察法规": "法规", "地方性法规": "法规", "地方法规": "法规", "法规性决定": "法规", "司法解释": "司法解释"}
EFFECT_RANK = {"宪法": 4, "法律": 3, "法规": 2, "司法解释": 1, "未知": 0}
LOCAL = ("地方性法规", "地方法规", "法规性决定")
JURISDICTION = {"national": 4, "province": 3, "prefecture": 2, "county": 1, "local_unknown": 0, "unknown": 0}
LEVELS = {2: "province", 4: "prefecture", 6: "county"}
#: Titles match where their ratio is at least ALIKE; those below SHORT characters are compared by length alone.
ALIKE, SHORT = 0.92, 40


def _of(x: Column, values: dict, default: object) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(v) for p in values.items() for v in p)), x), F.lit(default))


def effect_level(category: Column) -> Column:
    return _of(F.trim(category), EFFECT, "未知")


def effect_rank(level: Column) -> Column:
    return _of(level, EFFECT_RANK, 0)


def strip_suffix(name: Column) -> Column:
    """The name without the first suffix of the list that leaves two characters or more; null if there is none."""
    cut = lambda s: F.trim(F.left(name, F.length(name) - len(s)))
    return F.coalesce(*(F.when(name.endswith(s) & (F.length(cut(s)) >= 2), cut(s)) for s in SUFFIXES))


def town(detail: Column) -> Column:
    """The town at the start of an address's rest, by the first suffix of the list that fits; null if there is none."""
    found = lambda s: F.regexp_extract(F.trim(detail), f"^(.+?{s})", 1)
    return F.coalesce(*(F.when(F.length(found(s)) >= len(s) + 1, found(s)) for s in TOWN_SUFFIXES))


def compact_path(names: Column) -> Column:
    return F.filter(names, lambda x: ~x.isin(*PLACEHOLDERS))


def flatten(nodes: DataFrame) -> DataFrame:
    """code, name, path_codes, path_names of the regions whose parents lead to a root. A round of joins for each length of code, shortest first."""
    nodes = nodes.filter(F.length("code").isin(*LEVELS) & (F.trim("name") != ""))
    level = nodes.filter("parent IS NULL").select("code", "name", F.array("code").alias("path_codes"), F.array("name").alias("path_names"))
    found = level
    for _ in range(len(LEVELS) - 1):
        up = level.select(F.col("code").alias("parent"), "path_codes", "path_names")
        level = nodes.join(up, "parent").select("code", "name", F.concat("path_codes", F.array("code")).alias("path_codes"), F.concat("path_names", F.array("name")).alias("path_names"))
        found = found.unionByName(level)
    return found


def aliases(regions: DataFrame) -> DataFrame:
    """(alias, code): each region's name, and its name without suffix where that is one region's only."""
    short = regions.select("code", strip_suffix(F.col("name")).alias("alias")).filter("alias IS NOT NULL")
    once = short.groupBy("alias").agg(F.min("code").alias("code"), F.count("*").alias("n")).filter("n = 1").select("alias", "code")
    return regions.select(F.col("name").alias("alias"), "code").unionByName(once).distinct()


def mentions(texts: DataFrame, known: DataFrame, id_: str, text: str) -> DataFrame:
    """(id, code) of the regions whose alias a text holds, whatever their lengths.

    The distinct pairs of characters of a text meet the first two of the aliases; of the candidates, whose text comes by a
    second join, those stay whose alias is in the text. Aliases of one character meet single characters.
    """
    first = lambda c, k: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - k + 1, F.lit(1))), lambda i: F.substring(c, i, k)))
    starts = known.filter(F.length("alias") > 0).select("alias", "code", F.substring("alias", 1, 2).alias("start"))
    heads = texts.select(id_, F.explode(F.array_union(first(F.col(text), 2), first(F.col(text), 1))).alias("start"))
    met = heads.join(starts, "start").select(id_, "alias", "code")
    whole = met.join(texts.select(id_, F.col(text).alias("_text")), id_).filter(F.contains("_text", F.col("alias")))
    return whole.select(id_, "code").distinct()


def deepest(found: DataFrame, regions: DataFrame, id_: str, limit: int = 3) -> DataFrame:
    """Of an id's regions those that are no ancestor of another, the deepest first, ``limit`` at most."""
    own = found.join(regions.select("code", "path_codes"), "code")
    above = own.select(id_, F.explode(F.slice("path_codes", F.lit(1), F.size("path_codes") - 1)).alias("code")).distinct()
    left = own.join(above, [id_, "code"], "left_anti")
    rank = F.row_number().over(Window.partitionBy(id_).orderBy(F.desc(F.size("path_codes")), "code"))
    return left.withColumn("rank", rank).filter(F.col("rank") <= limit).select(id_, "code", "path_codes", "rank")


RELATIONS = ("none", "descendant", "ancestor", "exact")


def relation(region: Column, document: Column) -> Column:
    """How a document's region stands to one asked for, as index of RELATIONS; both are paths of codes. The best is the largest."""
    code, own = F.element_at(region, -1), F.try_element_at(document, F.lit(-1))
    above = F.array_contains(F.slice(region, F.lit(1), F.size(region) - 1), own)
    return F.when(own.isNull(), 0).when(own == code, 3).when(above, 2).when(F.array_contains(document, code), 1).otherwise(0)


def jurisdiction(category: Column, region_code: Column) -> Column:
    """national, the level of a local rule's region, or local_unknown. Without a category a rule whose title names a region is local."""
    category = F.lower(F.trim(F.coalesce(category, F.lit(""))))
    local = category.isin(*LOCAL) | (region_code.isNotNull() & category.isin("", "nan", "none"))
    return F.when(~local, "national").when(region_code.isNull(), "local_unknown").otherwise(_of(F.length(region_code), LEVELS, "unknown"))


def latest_versions(documents: DataFrame) -> DataFrame:
    """Of the documents (title, version, path) of each normalised title the one of the latest version."""
    return documents.groupBy(T.normalize_title(F.col("title")).alias("key")).agg(F.max_by(F.struct("path", "version"), F.struct(F.coalesce("version", F.lit("")), "path")).alias("d")).select("key", "d.path", "d.version")


def _closest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        ratio = [SequenceMatcher(None, a, c).ratio() for a, c in zip(b["key"], b["other"])]
        yield pd.DataFrame({"key": b["key"], "other": b["other"], "ratio": ratio})


def _breaks(n: Column) -> Column:
    """How many characters of a title of length n and an alike one, together, can be unmatched, if the other is as long as it may be."""
    return F.floor((1 - ALIKE) * (n + n * (2 - ALIKE) / ALIKE) + 1e-9).cast("int")


def _cuts(n: Column) -> Column:
    """(piece, start, size): a title of length n cut into one piece more than it can have breaks."""
    p = _breaks(n) + 1
    at = lambda i: F.floor(i * n / p).cast("int")
    return F.transform(F.sequence(F.lit(0), p - 1), lambda i: F.struct(i.alias("piece"), at(i).alias("start"), (at(i + 1) - at(i)).alias("size")))


def alike_titles(left: DataFrame, right: DataFrame) -> DataFrame:
    """(key, other): for keys of ``left`` the most alike of ``right``, by a ratio of ALIKE or more.

    A ratio r of lengths m and n leaves (1 - r)(m + n) characters unmatched, and the lengths fit within r / (2 - r). Each of these
    breaks one piece of the key at most, so if it is cut into one piece more than that, one piece (of about six characters) is whole in the
    other title, shifted by no more than what is unmatched. Titles meet by such pieces with length and number, and only then the ratio is asked.
    """
    share, n = ALIKE / (2 - ALIKE), F.length("key")
    own = left.select("key", n.alias("n"), F.explode(_cuts(n)).alias("c")).select("key", "n", "c.piece", F.substring(F.col("key"), F.col("c.start") + 1, F.col("c.size")).alias("text"))
    sizes = F.sequence(F.ceil(n * share - 1e-9).cast("int"), F.floor(n / share + 1e-9).cast("int"))
    cut = right.select(F.col("key").alias("other"), F.explode(sizes).alias("n")).filter("n > 0").select("other", "n", F.explode(_cuts(F.col("n"))).alias("c"))
    shifts = F.sequence(F.greatest(F.col("c.start") - _breaks(F.col("n")), F.lit(0)), F.least(F.col("c.start") + _breaks(F.col("n")), F.length("other") - F.col("c.size")))
    placed = cut.filter(F.length("other") >= F.greatest(F.col("c.start") - _breaks(F.col("n")), F.lit(0)) + F.col("c.size")).select("other", "n", "c.piece", F.explode(F.array_distinct(F.transform(shifts, lambda i: F.substring(F.col("other"), i + 1, F.col("c.size"))))).alias("text"))
    met = own.join(placed, ["n", "piece", "text"]).select("key", "other").distinct()
    rated = met.mapInPandas(_closest, "key string, other string, ratio double").filter(F.col("ratio") >= ALIKE)
    return rated.groupBy("key").agg(F.max_by("other", F.struct("ratio", "other")).alias("other"))


def manifest(catalog: DataFrame, documents: DataFrame) -> DataFrame:
    """Catalogue rows (title, category) with the latest version of their document, by title or the most alike one; then documents that no catalogue title names."""
    docs = latest_versions(documents)
    own = catalog.select("title", "category", T.normalize_title(F.col("title")).alias("key")).filter("key <> ''")
    level = effect_level(F.col("category"))
    missed = own.join(docs, "key", "left_anti").select("key").distinct()
    fuzzy = alike_titles(missed, docs.select("key"))
    own = own.join(fuzzy, "key", "left").withColumn("doc", F.coalesce("other", "key"))
    rows = own.join(docs.withColumnRenamed("key", "doc"), "doc", "left").select("title", "key", level.alias("effect_level"), effect_rank(level).alias("effect_rank"), F.when(F.col("path").isNull(), "missing_docx").otherwise("matched").alias("status"), "path", "version")
    rest = docs.join(own.select("key"), "key", "left_anti").select(F.col("key").alias("title"), "key", F.lit("未知").alias("effect_level"), F.lit(0).alias("effect_rank"), F.lit("missing_catalog").alias("status"), "path", "version")
    return rows.unionByName(rest)
