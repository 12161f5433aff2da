"""What scripts.py cuts and normalizes as Columns, for one text at a time in Python workers: the same patterns, with the JVM's classes of letters and numbers."""

from __future__ import annotations

import re
from itertools import chain

from pyspark.sql import SparkSession

from scriptloom.functions import scripts as S

_CLASSES: dict[str, dict[str, list[tuple[int, int]]]] = {}


def python_pattern(pattern: str) -> str:
    """A pattern of scripts.py as Python reads it."""
    return re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: f"\\U{int(m[1], 16):08X}", pattern).replace(r"\z", r"\Z")


def letters_and_numbers(spark: SparkSession) -> dict[str, list[tuple[int, int]]]:
    r"""The ranges of \p{L} and \p{N} in the JVM, whose version of Unicode isn't Python's. Two calls of the JVM in a process."""
    jvm = spark._jvm
    version = jvm.java.lang.System.getProperty("java.version")
    if version not in _CLASSES:
        whole = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
        found = lambda c: jvm.java.util.regex.Pattern.compile(rf"\P{{{c}}}+").matcher(whole).replaceAll("|")
        _CLASSES[version] = {c: S.ranges_of({ord(x) for x in found(c)} - {ord("|")}) for c in "LN"}
    return _CLASSES[version]


def pretoken_pattern(classes: dict[str, list[tuple[int, int]]], last: int = 0x10FFFF) -> str:
    """scripts.PRETOKEN with its classes spelled out, as far as the code point last."""
    inside = lambda c: python_pattern(S.char_class([(a, min(b, last)) for a, b in classes[c] if a <= last]))
    white, pattern = r"\t-\r ", S.PRETOKEN  # Java's \s is these alone
    pattern = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{white}{inside('L')}{inside('N')}]")
    return pattern.replace(r"\p{L}", f"[{inside('L')}]").replace(r"\p{N}", f"[{inside('N')}]").replace(r"\S", f"[^{white}]").replace(r"\s", f"[{white}]")


class Cutter:
    """Words of a text in order, by the vocabulary that encodes them: "0" the old one, "1" the new one, "2" special tokens."""

    def __init__(self, classes: dict[str, list[tuple[int, int]]], script: str, rules: dict[int, list[int]], specials: list[str], normalize_first: bool):
        # Ranges beyond U+FFFF are searched one by one for each character, so texts without such characters have a pattern without them.
        self.pre = [re.compile(pretoken_pattern(classes, last)) for last in (0xFFFF, 0x10FFFF)]
        self.far = re.compile("[\U00010000-\U0010FFFF]")
        white = python_pattern(S.WHITE)
        self.target = re.compile(f"[{python_pattern(S.char_class(S.RANGES[script]))}]")
        self.segment = re.compile(python_pattern(S.segment_pattern(script)))
        self.table = {k: "".join(map(chr, v)) for k, v in rules.items()}
        rule = python_pattern(S.char_class(S.ranges_of(rules)))
        self.rule = re.compile(f"[{rule}]") if rules else None
        self.alone = re.compile(rf"(?<![^{white}])[{rule}](?![^{white}])|(?=[{rule}])[{white}]") if rules else None
        self.run = re.compile(f"[{white}]+|[^{white}]+")
        some = sorted((s for s in specials if s), key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, some)) + ")") if some else None
        self.normalize_first = normalize_first

    def normalized(self, text: str) -> str:
        if self.rule is None or not self.rule.search(text):
            return text
        if not self.alone.search(text):
            return text.translate(self.table)
        return self.run.sub(lambda m: m[0] if len(m[0]) <= 1 else m[0].translate(self.table), text)

    def cut(self, text: str) -> list[tuple[str, list[str]]]:
        if self.normalize_first:
            text = self.normalized(text)
        change = not self.normalize_first and self.rule is not None and self.rule.search(text) is not None
        mixed = change or self.target.search(text) is not None
        words = self.pre[change or self.far.search(text) is not None].findall
        out: list[tuple[str, list[str]]] = []
        for k, part in enumerate(self.special.split(text) if self.special else [text]):
            if k & 1:
                out.append(("2", [part]))
            elif not mixed:
                out.append(("0", words(part)))
            else:
                part = self.normalized(part) if change else part
                for s in self.segment.findall(part):
                    out.append(("1" if self.target.search(s) else "0", words(s)))
        return out


def rejoined(pieces: list[tuple[str, list[str]]]) -> str:
    return "".join(chain.from_iterable(words for _, words in pieces))
