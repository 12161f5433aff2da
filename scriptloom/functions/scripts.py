"""Unicode ranges and what follows from them as Column expressions: predicates, segments, normalization.

Range classes are written so that both Java and RE2 read them alike. White space is one fixed class, since
engines differ on what \\s holds.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
RANGES = {
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x870, 0x89F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF), (0x1EE00, 0x1EEFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "hiragana": [(0x3040, 0x309F)],
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x1E00, 0x1EFF)],
}
_DATA = Path(__file__).with_name("data")
#: (block, lo, hi) of Unicode.
BLOCKS = [(m[3].lower(), int(m[1], 16), int(m[2], 16)) for m in re.finditer(r"^([0-9A-F]+)\.\.([0-9A-F]+);\s*(.+?)\s*$", (_DATA / "Blocks.txt").read_text(), re.M)]
#: The blocks that have characters of a script; and the names of all scripts, two of which have no block.
SCRIPT_BLOCKS: dict[str, list[str]] = json.loads((_DATA / "script_to_blocks.json").read_text())
SCRIPT_NAMES = list(json.loads((_DATA / "script_name_to_alias.json").read_text()))


def read_rules(path: str | Path) -> dict[int, list[int]]:
    """Rules of normalized() in a JSON file: code points as keys, lists of code points as values."""
    return {int(k): v for k, v in json.loads(Path(path).read_text()).items()}


#: A presentation form or variant letter, and the letters that stand for it: 296 rules.
ARABIC_RULES = read_rules(_DATA / "arabic_normalization_map.json")


def char_class(ranges: list[tuple[int, int]]) -> str:
    """The inside of a regular expression's brackets."""
    return "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in ranges)


def ranges_of(points: Iterable[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for p in sorted(points):
        out.append((out.pop()[0] if out and out[-1][1] == p - 1 else p, p))
    return out


def segment_pattern(script: str, ranges: dict[str, list[tuple[int, int]]] = RANGES) -> str:
    """Runs of a script and runs without it; blanks join the run they follow, leading blanks the first run."""
    t = char_class(ranges[script])
    return rf"(?:\A[{WHITE}]*)?[{t}][{t}{WHITE}]*|(?:\A[{WHITE}]*)?[^{t}{WHITE}][^{t}]*|\A[{WHITE}]+\z"


def contains_script(text: Column, script: str) -> Column:
    return text.rlike(f"[{char_class(RANGES[script])}]")


def segments(text: Column, script: str) -> Column:
    """Array of (text, is_target); an empty text has none, one of blanks alone has one that isn't target."""
    hit = f"[{char_class(RANGES[script])}]"
    return F.transform(F.regexp_extract_all(text, F.lit(segment_pattern(script)), F.lit(0)), lambda s: F.struct(s.alias("text"), s.rlike(hit).alias("is_target")))


def detected_scripts(text: Column, scripts: list[str]) -> Column:
    """The scripts of which the text has a character, in the given order; one regular expression for each."""
    return F.array_compact(F.array(*[F.when(contains_script(text, s), F.lit(s)) for s in scripts]))


def normalized(text: Column, rules: dict[int, list[int]]) -> Column:
    """Replaces characters by rules, all at once, inside runs of two or more characters without blanks."""
    if not rules:
        return text
    text_of = lambda points: "".join(map(chr, points))
    class_of = lambda points: f"[{char_class(ranges_of(points))}]"
    one, more = ({k: v for k, v in rules.items() if (len(v) == 1) == single} for single in (True, False))
    runs = F.regexp_extract_all(text, F.lit(rf"[{WHITE}]+|[^{WHITE}]+"), F.lit(0))
    # A map is searched entry by entry, so only the characters that become none or several look theirs up.
    letters = lambda x: F.translate(x, text_of(one), text_of(v[0] for v in one.values())) if one else x
    if more:
        table = F.create_map(*[F.lit(x) for k, v in more.items() for x in (chr(k), text_of(v))])
        letter = lambda c: F.when(c.isin([chr(k) for k in more]), F.element_at(table, c)).otherwise(letters(c))
        changed = lambda r: F.when(r.rlike(class_of(more)), F.array_join(F.transform(F.split(r, ""), letter), "")).otherwise(letters(r))
    else:
        changed = letters
    return F.when(~text.rlike(class_of(rules)), text).otherwise(F.array_join(F.transform(runs, lambda r: F.when(F.length(r) <= 1, r).otherwise(changed(r))), ""))


def special_split(text: Column, specials: list[str]) -> Column:
    """The text cut at special tokens, longest first, the tokens kept and empty pieces dropped."""
    specials = [s for s in specials if s]
    if not specials:
        return F.filter(F.when(text.isNotNull(), F.array(text)), lambda p: p != "")
    some = "|".join(re.escape(s) for s in sorted(specials, key=len, reverse=True))
    return F.regexp_extract_all(text, F.lit(rf"(?s){some}|(?:(?!{some}).)+"), F.lit(0))


def pretokenized(text: Column, specials: list[str], script: str) -> Column:
    """Array of (text, is_target, is_special): special tokens first, then the scripts of what is between them."""
    return F.flatten(
        F.transform(
            special_split(text, specials),
            lambda p: F.when(p.isin(specials), F.array(F.struct(p.alias("text"), F.lit(False).alias("is_target"), F.lit(True).alias("is_special")))).otherwise(
                F.transform(segments(p, script), lambda s: F.struct(s["text"].alias("text"), s["is_target"].alias("is_target"), F.lit(False).alias("is_special")))
            ),
        )
    )


#: The split of byte-level vocabularies.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: A split by case, numbers of three digits at most, and lines; for vocabularies that ask for it.
PRETOKEN_CASED = r"[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]*[\p{Ll}\p{Lm}\p{Lo}\p{M}]+|[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"


def pretokens(text: Column, pattern: str = PRETOKEN) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def code_points(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), F.ascii)
