"""Model inputs from arrays of token ids: truncation, pairs, padding, masks; and rendering of chats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DATE_PREAMBLE = "Cutting Knowledge Date: December 2023\nToday Date: 26 Jul 2024\n\n"


def truncated(ids: Column, most: int) -> Column:
    return F.slice(ids, 1, most)


def with_specials(ids: Column, most: int, bos: int, eos: int) -> Column:
    """bos, at most most - 2 ids (one at least), eos."""
    return F.concat(F.array(F.lit(bos)), F.slice(ids, 1, max(most - 2, 1)), F.array(F.lit(eos)))


def paired(a: Column, b: Column, eos: int) -> Column:
    return F.concat(a, F.array(F.lit(eos)), b, F.array(F.lit(eos)))


def padded(ids: Column, to: Column, pad: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(pad), F.greatest(F.lit(0), to - F.size(ids)).cast("int")))


def attention_mask(ids: Column, to: Column) -> Column:
    return F.concat(F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), F.greatest(F.lit(0), to - F.size(ids)).cast("int")))


def up_to_multiple(n: Column, of: int) -> Column:
    return (F.ceil(n / of) * of).cast("int")


def mapped(ids: Column, table: dict[int, int], strict: bool = False) -> Column:
    """Ids through a map; ids without an entry are dropped, or raise an error if strict."""
    if not table:
        return F.filter(ids, lambda i: F.lit(False)) if not strict else ids
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    found = F.transform(ids, lambda i: F.try_element_at(m, i))
    if strict:
        return F.when(F.exists(found, lambda x: x.isNull()), F.raise_error(F.lit("an id has no entry in the map"))).otherwise(found)
    return F.filter(found, lambda x: x.isNotNull())


def without(ids: Column, dropped: list[int]) -> Column:
    """Ids in order, without some; nulls stay."""
    return F.filter(ids, lambda i: ~F.coalesce(i.isin(dropped), F.lit(False)))


def rendered_chats(turns: DataFrame, generation_prompt: bool = False) -> DataFrame:
    """(conv_id, rendered) of a table conv_id, turn, role, text: date preamble in a system turn, then every message."""
    head = lambda role: F.concat(F.lit("<|start_header_id|>"), role, F.lit("<|end_header_id|>\n\n"))
    trim = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    c = turns.groupBy("conv_id").agg(ordered.alias("m"))
    leads = F.col("m")[0]["role"] == "system"
    system = F.when(leads, trim(F.col("m")[0]["text"])).otherwise("")
    rest = F.when(leads, F.slice("m", 2, F.greatest(F.size("m") - 1, F.lit(0)))).otherwise(F.col("m"))
    body = F.array_join(F.transform(rest, lambda x: F.concat(head(x["role"]), trim(x["text"]), F.lit("<|eot_id|>"))), "")
    tail = head(F.lit("assistant")) if generation_prompt else F.lit("")
    return c.select("conv_id", F.concat(F.lit("<|begin_of_text|>"), head(F.lit("system")), F.lit(DATE_PREAMBLE), system, F.lit("<|eot_id|>"), body, tail).alias("rendered"))
