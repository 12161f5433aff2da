"""Maps between an original vocabulary and a retrained one, and sequences of ids under such a map."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptloom.operators.ranks import ranked

def vocabulary(docs: DataFrame, text: str = "text", least: int = 1) -> DataFrame:
    """(token, id, n): words by falling count, then by name."""
    w = docs.select(F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"\p{L}+"), F.lit(0))).alias("token")).groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return ranked(w, F.desc("n"), "token", name="id")


def new_tokens(new: DataFrame, old: DataFrame) -> DataFrame:
    return new.join(old.select("token"), "token", "left_anti").select("token", "id")


def common_tokens(new: DataFrame, old: DataFrame) -> DataFrame:
    return new.select("token", F.col("id").alias("new_id")).join(old.select("token", F.col("id").alias("old_id")), "token")


def token_map(new: DataFrame, old: DataFrame, reusable: DataFrame) -> DataFrame:
    """(new_id, old_id): common tokens by name, the others in order with the reusable ids (old_id) that no common token has.

    Fails when it is run if there are fewer such ids than new tokens, rather than leave any without an id.
    """
    common = common_tokens(new, old).select("new_id", "old_id")
    free = ranked(reusable.join(common.select("old_id"), "old_id", "left_anti").select("old_id"), "old_id", name="k")
    fresh = ranked(new_tokens(new, old).select(F.col("id").alias("new_id")), "new_id", name="k")
    # A left join keeps the tokens without an id, and each of them raises the error, whatever columns are read.
    paired = fresh.join(free, "k", "left").where("old_id is not null or raise_error(concat('no reusable id is left for new id ', new_id)) is not null")
    return paired.select("new_id", "old_id").unionByName(common)


def inverse(mapping: DataFrame) -> DataFrame:
    """(old_id, new_id); of several new ids the greatest."""
    return mapping.groupBy("old_id").agg(F.max("new_id").alias("new_id"))


def stats(mapping: DataFrame, common: DataFrame) -> DataFrame:
    n = mapping.agg(F.count("*").alias("new_size"), F.countDistinct("old_id").alias("old_size"))
    return n.crossJoin(common.agg(F.count("*").alias("common")))


def identity_map(spark, n: int) -> DataFrame:
    return spark.range(n).selectExpr("cast(id as int) new_id", "cast(id as int) old_id")


def id_runs(sequences: DataFrame, key: str, is_mapped: Callable[[Column], Column], ids: str = "ids") -> DataFrame:
    """(key, run, mapped, ids, start): runs of ids that are all mapped or all not, of a table with an array of ids a row and a key of its own.

    A row is cut where it stands: nothing is shuffled or sorted.
    """
    mapped = sequences.select(key, F.transform(ids, is_mapped).alias("__m")).where("size(__m) > 0")
    # Where an id's kind isn't that of the one before; the end of the array too, so that a run ends where the next one starts.
    turns = F.filter(F.sequence(F.lit(0), F.size("__m")), lambda p: (p == 0) | (p == F.size("__m")) | (F.get("__m", p) != F.get("__m", p - 1)))
    runs = mapped.select(key, "__m", turns.alias("__t"))
    runs = runs.select(key, F.posexplode(F.expr("transform(sequence(1, size(__t) - 1), k -> struct(__m[__t[k - 1]] mapped, cast(__t[k] - __t[k - 1] as long) ids, __t[k - 1] start))")).alias("run", "r"))
    return runs.select(key, F.col("run").cast("long").alias("run"), "r.mapped", "r.ids", "r.start")


def repaired(ids: list[int], pieces: dict[int, bytes], new_pieces: dict[int, bytes], suspicious: set[int], longest: int = 4) -> str:
    """Text of a sequence whose parts come from two vocabularies, characters split across tokens rejoined.

    pieces: bytes of ids under the original vocabulary; new_pieces: those of mapped ids under the new one.
    A suspicious id opens a window of up to four ids that is tried at the end of the current run, first with the
    original vocabulary, then with the new one; the first window that decodes whole is taken.
    """
    whole = lambda run, table: b"".join(table.get(i, b"") for i in run).decode("utf-8", "replace")
    is_mapped = lambda i: i in new_pieces
    parts: list[tuple[list[int], bool]] = []
    run: list[int] = []
    kind: bool | None = None
    at = 0
    while at < len(ids):
        found = None
        if ids[at] in suspicious:
            for w in range(1, min(longest, len(ids) - at) + 1):
                window = ids[at : at + w]
                if (kind is False or not all(map(is_mapped, window))) and "�" not in whole(run + window, pieces):
                    found = (w, False)
                elif all(map(is_mapped, run + window)) and "�" not in whole(run + window, new_pieces):
                    found = (w, True)
                if found:
                    break
        if found:
            w, k = found
            if kind is None:
                parts.append((ids[at : at + w], k))
            elif k == kind:
                run += ids[at : at + w]
            else:
                parts.append((run, kind))
                run, kind = ids[at : at + w], k
            at += w
            continue
        k = is_mapped(ids[at])
        if kind is None or k == kind:
            run, kind = [*run, ids[at]], k
        else:
            parts.append((run, kind))
            run, kind = [ids[at]], k
        at += 1
    if run:
        parts.append((run, bool(kind)))
    return "".join(whole(r, new_pieces if k else pieces) for r, k in parts)
