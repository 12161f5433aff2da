"""Readers of the Unicode Character Database's files, and what follows from them: scripts, blocks, aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptloom.functions.scripts import SCRIPT_NAMES

#: Blocks whose name has such a word are one block; of several words the last one counts.
MERGED = ["Arabic", "CJK", "Greek", "Latin"]
CJK = ["bopomofo", "hangul", "han", "hiragana", "katakana"]


def code_point_range(text: Column) -> Column:
    """(lo, hi) of "A..B" or of a single point, in hexadecimal digits."""
    ends = F.split(F.trim(text), r"\.\.")
    number = lambda c: F.conv(F.trim(c), 16, 10).cast("int")
    return F.struct(number(ends[0]).alias("lo"), number(F.coalesce(F.get(ends, F.lit(1)), ends[0])).alias("hi"))


def _fields(spark: SparkSession, path: str) -> DataFrame:
    """(value, fields) of the lines that aren't empty, without comments."""
    line = F.trim(F.regexp_replace("value", "#.*", ""))
    return spark.read.text(path).select(line.alias("value")).where("value <> ''").select("value", F.transform(F.split("value", ";"), lambda x: F.trim(x)).alias("fields"))


def read_blocks(spark: SparkSession, path: str, merged: bool = False) -> DataFrame:
    """(block, lo, hi) by rising lo. merged: names that hold one of MERGED become <word>_merged; names keep their case then."""
    name = F.col("fields")[1]
    if merged:
        found = F.lit(None).cast("string")
        for word in MERGED:
            found = F.when(F.contains(name, F.lit(word)), F.lit(f"{word}_merged")).otherwise(found)
        name = F.coalesce(found, name)
    else:
        name = F.lower(name)
    t = _fields(spark, path).where("size(fields) = 2").select(name.alias("block"), code_point_range(F.col("fields")[0]).alias("r"))
    return t.select("block", "r.lo", "r.hi").orderBy("lo")


def read_scripts(spark: SparkSession, path: str) -> DataFrame:
    """(cp, script): a row for each code point."""
    t = _fields(spark, path).where("size(fields) = 2").select(F.lower(F.col("fields")[1]).alias("script"), code_point_range(F.col("fields")[0]).alias("r"))
    return t.select(F.explode(F.sequence("r.lo", "r.hi")).alias("cp"), "script")


def read_script_extensions(spark: SparkSession, path: str) -> DataFrame:
    """(cp, aliases): the short names of the scripts that use each code point."""
    t = _fields(spark, path).where("size(fields) = 2").select(F.split(F.lower(F.col("fields")[1]), r"\s+").alias("aliases"), code_point_range(F.col("fields")[0]).alias("r"))
    return t.select(F.explode(F.sequence("r.lo", "r.hi")).alias("cp"), "aliases")


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """(alias, script) of the property sc: short and long names, in lower case."""
    t = _fields(spark, path).where("size(fields) >= 3 and fields[0] = 'sc'")
    return t.select(F.lower(F.col("fields")[1]).alias("alias"), F.lower(F.col("fields")[2]).alias("script"))


def read_json_aliases(spark: SparkSession, path: str) -> DataFrame:
    """(alias, script) of a JSON object from alias to script."""
    t = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("alias", "script"))
    return t.select(F.lower("alias").alias("alias"), F.lower("script").alias("script"))


def resolved_scripts(names: list[str], aliases: dict[str, str] | None = None) -> list[str]:
    """Full names of scripts given by name or alias in any case. One that is neither is an error."""
    full = {s.lower(): s for s in SCRIPT_NAMES} | {a.lower(): s for a, s in (aliases or {}).items()}
    if unknown := [n for n in names if n.lower() not in full]:
        raise ValueError(f"no script is named {', '.join(unknown)}")
    return list(dict.fromkeys(full[n.lower()] for n in names))


def scripts_of_points(scripts: DataFrame, extensions: DataFrame | None = None, aliases: DataFrame | None = None) -> DataFrame:
    """(cp, script). With extensions, a code point of the scripts common or inherited has those that use it instead."""
    if extensions is None:
        return scripts
    named = extensions.select("cp", F.explode("aliases").alias("alias")).join(F.broadcast(aliases), "alias").select("cp", F.col("script").alias("used"))
    shared = F.col("script").isin("common", "inherited", "zyyy", "zinh")
    return scripts.join(named, "cp", "left").select("cp", F.when(shared, F.coalesce("used", "script")).otherwise(F.col("script")).alias("script")).distinct()


def blocks_and_scripts(scripts: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(block, scripts) and (script, blocks), each list sorted."""
    from scriptloom.operators.classify import block_of_code_points

    pair = block_of_code_points(scripts, blocks).where("block <> 'Unknown'").select("block", "script").distinct()
    return (
        pair.groupBy("block").agg(F.sort_array(F.collect_set("script")).alias("scripts")),
        pair.groupBy("script").agg(F.sort_array(F.collect_set("block")).alias("blocks")),
    )


def ranges_overlap(a: Column, b: Column) -> Column:
    """Whether some range (lo, hi) of one array meets some of the other."""
    return F.coalesce(F.exists(a, lambda r: F.exists(b, lambda p: (r["lo"] <= p["hi"]) & (r["hi"] >= p["lo"]))), F.lit(False))
