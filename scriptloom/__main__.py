"""Commands: create-tokenizer builds a model by a configuration; classify-tokens counts a vocabulary's tokens by group."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession


def _names(text: str) -> list[str]:
    return [x.strip() for part in text.split(",") for x in part.split() if x.strip()]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="scriptloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("create-tokenizer", help="build a model")
    c.add_argument("--config")
    c.add_argument("--old-vocabulary", required=True, help="JSON with specials and merges")
    c.add_argument("--output_dir")
    c.add_argument("--training_data_dir")
    c.add_argument("--vocab_size", type=int)
    c.add_argument("--min_reusable_count", type=int)
    c.add_argument("--first_reusable_id", type=int)
    c.add_argument("--target_scripts", type=_names)
    c.add_argument("--preserved_scripts", type=_names)
    c.add_argument("--special_tokens", type=_names)
    c.add_argument("--apply_threshold", action="store_true", default=None)
    c.add_argument("--no_normalization", dest="apply_normalization", action="store_false", default=None)
    k = sub.add_parser("classify-tokens", help="write counts of tokens by group as JSON")
    k.add_argument("--old-vocabulary", required=True)
    k.add_argument("--output")
    return p


def main(argv: list[str] | None = None) -> int:
    from scriptloom.operators import classify
    from scriptloom.operators.vocabulary import ByteVocabulary
    from scriptloom.sources import artifacts

    args = parser().parse_args(argv)
    with open(args.old_vocabulary) as f:
        v = json.load(f)
    old = ByteVocabulary(v["specials"], [(bytes.fromhex(a), bytes.fromhex(b)) for a, b in v["merges"]])
    spark = SparkSession.builder.getOrCreate()
    if args.command == "classify-tokens":
        rows = classify.group_counts(artifacts.classified(spark, old)).orderBy("n", "grp").collect()
        text = json.dumps({r["grp"]: r["n"] for r in rows}, ensure_ascii=False, indent=1)
        if args.output:
            with open(args.output, "w") as f:
                f.write(text)
        else:
            sys.stdout.write(text + "\n")
        return 0
    names = artifacts.Config.__dataclass_fields__
    given = {k: x for k, x in vars(args).items() if k in names and x is not None}
    base = vars(artifacts.Config.from_file(args.config)) if args.config else {}
    artifacts.build(spark, artifacts.Config(**(base | given)), old)
    return 0


if __name__ == "__main__":
    sys.exit(main())
