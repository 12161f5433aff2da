"""Configuration, artifacts on disk, and the build that makes them: classify, choose, clean, train, map, save."""

from __future__ import annotations

import json
import logging
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptloom.functions import scripts as S
from scriptloom.operators import bpe, classify, vocabulary
from scriptloom.operators.dual import DualModel, token_map
from scriptloom.operators.vocabulary import ByteVocabulary
from scriptloom.sources import corpora
from scriptloom.sources.unicode_tables import resolved_scripts


def logger(name: str, folder: str | None = None, console: int = logging.INFO) -> logging.Logger:
    """A logger with a console, and with files of everything and of warnings where a folder is given; set up once."""
    log = logging.getLogger(name)
    if not log.handlers:
        log.setLevel(logging.DEBUG)
        out: list[tuple[logging.Handler, int]] = [(logging.StreamHandler(), console)]
        if folder:
            Path(folder).mkdir(parents=True, exist_ok=True)
            out += [(logging.FileHandler(Path(folder) / f"{name}.log"), logging.DEBUG), (logging.FileHandler(Path(folder) / f"{name}.warnings.log"), logging.WARNING)]
        for handler, level in out:
            handler.setLevel(level)
            handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
            log.addHandler(handler)
    return log


@dataclass
class Config:
    """What a build needs. Wrong values are errors when it is made."""

    output_dir: str
    training_data_dir: str
    vocab_size: int = 16_000
    min_reusable_count: int = 20_000
    target_scripts: list[str] = field(default_factory=lambda: ["arabic"])
    preserved_scripts: list[str] = field(default_factory=lambda: ["latin", "greek"])
    special_tokens: list = field(default_factory=list)
    apply_threshold: bool = False
    apply_normalization: bool = True
    first_reusable_id: int = 264

    def __post_init__(self) -> None:
        for name in ("output_dir", "training_data_dir"):
            if not isinstance(getattr(self, name), str) or not getattr(self, name):
                raise ValueError(f"{name} must be a path")
        for name in ("vocab_size", "min_reusable_count"):
            if not isinstance(getattr(self, name), int) or isinstance(getattr(self, name), bool) or getattr(self, name) <= 0:
                raise ValueError(f"{name} must be a whole number above 0")
        for name in ("target_scripts", "preserved_scripts", "special_tokens"):
            if not isinstance(getattr(self, name), list):
                raise ValueError(f"{name} must be a list")
        if not self.target_scripts:
            raise ValueError("target_scripts is empty")
        self.target_scripts, self.preserved_scripts = resolved_scripts(self.target_scripts), resolved_scripts(self.preserved_scripts)
        self.special_tokens = vocabulary.real_specials(self.special_tokens)

    @classmethod
    def from_file(cls, path: str) -> Config:
        """From JSON, or from the plain part of YAML: keys with numbers, words, true or false, and lists."""
        text = Path(path).read_text()
        values = json.loads(text) if text.lstrip().startswith("{") else _plain_yaml(text)
        known = set(cls.__dataclass_fields__)
        if unknown := sorted(set(values) - known):
            raise ValueError(f"no setting is named {', '.join(unknown)}")
        return cls(**values)


def _plain_yaml(text: str) -> dict:
    def value(s: str):
        s = s.strip()
        if len(s) > 1 and s[0] == s[-1] and s[0] in "\"'":
            return s[1:-1]
        if s.startswith("[") and s.endswith("]"):
            return [value(x) for x in s[1:-1].split(",") if x.strip()]
        if s.lower() in ("true", "false", "null", "~", ""):
            return {"true": True, "false": False}.get(s.lower())
        try:
            return int(s)
        except ValueError:
            return s

    out: dict = {}
    key = None
    for line in text.splitlines():
        line = line.split(" #")[0].rstrip()
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        if line.lstrip().startswith("- "):
            if key is None:
                raise ValueError(f"a list entry without a key: {line}")
            out[key] = [*(out[key] or []), value(line.lstrip()[2:])]
            continue
        if line[0] in " \t" or ":" not in line:
            raise ValueError(f"this line is no setting: {line}")
        key, _, rest = line.partition(":")
        out[key] = value(rest)
    return out


def read_json_map(spark: SparkSession, path: str, value: str = "int", strict: bool = False) -> DataFrame:
    """(key, value) of a JSON object with whole numbers as keys; other keys are dropped, or raise an error if strict."""
    t = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("k", "value"))
    key = F.expr("try_cast(k as int)")
    if strict:
        key = F.when(key.isNull(), F.raise_error(F.concat(F.lit("no whole number: "), F.col("k"))).cast("int")).otherwise(key)
    return t.select(key.alias("key"), "value").where("key is not null")


def write_group_counts(counts: DataFrame, path: str) -> None:
    """Lines of a group and its count with a tab between, by rising count. There is one row for each group."""
    counts.select("grp", "n").orderBy("n", "grp").coalesce(1).write.mode("overwrite").option("sep", "\t").csv(path)


def read_group_counts(spark: SparkSession, path: str) -> DataFrame:
    """(grp, n); lines that don't have just two fields, the second a number, are skipped."""
    f = F.split("value", "\t")
    t = spark.read.text(path).where(F.size(f) == 2).select(f[0].alias("grp"), F.expr("try_cast(split(value, '\t')[1] as bigint)").alias("n"))
    return t.where("n is not null")


MANIFEST = "manifest.json"


def save_model(model: DualModel, folder: str, config: Config | None = None, counts: dict[str, int] | None = None) -> dict:
    """One folder with a manifest: vocabularies as merges, both id maps, rules, ranges, specials. Sizes are those of vocabularies, so the driver writes it."""
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    for name, v in (("old", model.old), ("new", model.new)):
        (out / f"{name}_vocabulary.json").write_text(json.dumps({"specials": v.specials, "merges": [[a.hex(), b.hex()] for a, b in v.merges]}))
    (out / "new_to_old.json").write_text(json.dumps({str(k): v for k, v in sorted(model.new_to_old.items())}))
    (out / "old_to_new.json").write_text(json.dumps({str(k): v for k, v in sorted(model.old_to_new.items())}))
    bad = {str(i): model.old.id_to_token(i) for i in range(len(model.old)) if model.has_replacement_char(i)}
    (out / "replacement_characters.json").write_text(json.dumps(bad, ensure_ascii=False))
    (out / "normalization.json").write_text(json.dumps({str(k): v for k, v in model.rules.items()}))
    old_target, mapped_target = model.target_ids()
    (out / "target_ids.json").write_text(json.dumps({"old": old_target, "mapped": mapped_target}))
    if counts:
        (out / "group_counts.tsv").write_text("".join(f"{g}\t{n}\n" for g, n in sorted(counts.items(), key=lambda x: (x[1], x[0]))))
    manifest = {
        "script": model.script, "ranges": S.RANGES[model.script], "specials": model.specials, "special_route": model.special_route, "on_unmapped": model.on_unmapped,
        "normalize_first": model.normalize_first, "sizes": {"old": len(model.old), "new": len(model.new)}, "stats": model.stats(), "config": asdict(config) if config else None,
    }
    (out / MANIFEST).write_text(json.dumps(manifest, ensure_ascii=False, indent=1))
    return manifest


def load_model(spark: SparkSession, folder: str) -> DualModel:
    at = Path(folder)
    manifest = json.loads((at / MANIFEST).read_text())

    def vocab(name: str) -> ByteVocabulary:
        v = json.loads((at / f"{name}_vocabulary.json").read_text())
        return ByteVocabulary(v["specials"], [(bytes.fromhex(a), bytes.fromhex(b)) for a, b in v["merges"]])

    ints = lambda name: {int(k): v for k, v in json.loads((at / name).read_text()).items()}
    keep = {k: manifest[k] for k in ("special_route", "on_unmapped", "normalize_first")}
    return DualModel(spark, vocab("old"), vocab("new"), ints("new_to_old.json"), manifest["script"], S.read_rules(at / "normalization.json"), manifest["specials"], old_to_new=ints("old_to_new.json"), **keep)


def copy_model(folder: str, to: str, prefix: str = "") -> list[str]:
    """Copies an artifact folder's files; returns the paths."""
    out = []
    Path(to).mkdir(parents=True, exist_ok=True)
    for f in sorted(Path(folder).iterdir()):
        if f.is_file():
            target = Path(to) / f"{prefix}{f.name}"
            target.write_bytes(f.read_bytes())
            out.append(str(target))
    return out


def identity_model(spark: SparkSession, vocab: ByteVocabulary, script: str = "arabic") -> DualModel:
    """A model whose two vocabularies are one."""
    return DualModel(spark, vocab, vocab, {i: i for i in range(len(vocab))}, script)


class ModelBuilder:
    """Collects a model's parts one by one."""

    def __init__(self, spark: SparkSession):
        self.spark, self._parts, self._more = spark, {}, {}

    def old(self, v: ByteVocabulary) -> ModelBuilder:
        self._parts["old"] = v
        return self

    def new(self, v: ByteVocabulary) -> ModelBuilder:
        self._parts["new"] = v
        return self

    def mapping(self, new_to_old: dict[int, int], old_to_new: dict[int, int] | None = None) -> ModelBuilder:
        self._parts["new_to_old"], self._more["old_to_new"] = new_to_old, old_to_new
        return self

    def target(self, script: str) -> ModelBuilder:
        self._more["script"] = script
        return self

    def normalization(self, rules: dict[int, list[int]]) -> ModelBuilder:
        self._more["rules"] = rules
        return self

    def options(self, **options) -> ModelBuilder:
        self._more |= options
        return self

    def build(self) -> DualModel:
        if missing := [k for k in ("old", "new", "new_to_old") if k not in self._parts]:
            raise ValueError(f"the model lacks {', '.join(missing)}")
        return DualModel(self.spark, **self._parts, **self._more)


def classified(spark: SparkSession, vocab: ByteVocabulary) -> DataFrame:
    """(token, id, grp) of the tokens that are text, by their visible form."""
    t = vocab.table(spark).where(F.col("id") >= vocab.first_byte).select(vocabulary.stripped(F.col("visible")).alias("token"), "id")
    return classify.token_groups(t, classify.blocks(spark, merged=True))


def reusable_ids(spark: SparkSession, groups: DataFrame, chosen: DataFrame, least: int) -> list[int]:
    """The ids, from least on, of the tokens of chosen groups, by group and id."""
    return [r["id"] for r in groups.join(F.broadcast(chosen.select("grp")), "grp").where(F.col("id") >= least).orderBy("grp", "id").select("id").collect()]


def build(spark: SparkSession, config: Config, old: ByteVocabulary) -> DualModel:
    """The whole build: groups of the old vocabulary's tokens, those to reuse, the corpus without their scripts, a new
    vocabulary of it, the map between both; written to output_dir."""
    log = logger("scriptloom")
    groups = classified(spark, old).cache()
    counts = classify.group_counts(groups)
    chosen = classify.reusable(counts, classify.preserved_scripts(config.preserved_scripts, config.target_scripts))
    if config.apply_threshold:
        chosen = classify.cumulative(chosen, config.min_reusable_count).select("grp", "n")
    total = chosen.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    log.info("%d tokens can be reused, %d are wanted", total, config.min_reusable_count)
    used = classify.grouped_tokens(groups, classify.blocks(spark, merged=True)).join(F.broadcast(chosen.select("grp")), "grp")
    ranges = sorted({(r["lo"], r["hi"]) for row in used.select("ranges").collect() for r in row["ranges"]})
    docs = corpora.read_corpus(spark, config.training_data_dir)
    if ranges:
        pattern = f"[{S.char_class(ranges)}]"
        docs, rejected = corpora.clean_messages(docs, pattern) if corpora.is_conversational(docs) else classify.clean(docs, pattern)
        rejected.write.mode("overwrite").parquet(f"{config.output_dir}/rejected")
    corpora.write_cleaned(docs, f"{config.output_dir}/cleaned")
    text = corpora.texts(docs)
    if config.apply_normalization:
        text = text.select(S.normalized(F.col("text"), S.ARABIC_RULES).alias("text"))
    words = bpe.word_counts(text)
    new = vocabulary.train(words, config.vocab_size, config.special_tokens)
    mapping = token_map(old, new, reusable_ids(spark, groups, chosen, config.first_reusable_id))
    model = DualModel(spark, old, new, mapping, config.target_scripts[0], S.ARABIC_RULES if config.apply_normalization else {})
    save_model(model, f"{config.output_dir}/model", config, {r["grp"]: r["n"] for r in counts.collect()})
    return model
