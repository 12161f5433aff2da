"""The operators as queries over the given tables, each with the SQL that says the same in DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptloom.functions import scripts as S
from scriptloom.functions import shaping as H
from scriptloom.operators import bpe, classify, idmap
from scriptloom.operators.ranks import ranked
from scriptloom.plans import given

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

LETTERS = "abcdefghijklmnopqrstuvwxyz"
ALPHABETS = {
    0: "ابتثجحخدذرزسشصضطظعغفقکلمنه",
    1: "абвгдежзийклмнопрстуфхцчшщ",
    2: "αβγδεζηθικλμνξοπρστυφχψωάέ",
    3: "あいうえおかきくけこさしすせそたちつてとなにぬねのは",
}
TARGET = f"[{S.char_class(given.RANGES['arabic'])}]"
UNWANTED = f"[{S.char_class(S.RANGES['cyrillic'] + S.RANGES['hiragana'])}]"
SPECIALS = ["the", "of", "<|sep|>"]
MERGES = [("t", "h"), ("e", "r"), ("o", "n"), ("e", "n"), ("th", "e"), ("i", "n"), ("a", "n"), ("r", "e")]


def docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def mixed(spark: SparkSession, d: str) -> DataFrame:
    """Documents in five scripts: most letters are written in another alphabet, by doc_id."""
    case = F.expr("CASE doc_id % 5 " + " ".join(f"WHEN {k} THEN translate(text, '{LETTERS}', '{a}')" for k, a in ALPHABETS.items()) + " ELSE text END")
    return docs(spark, d).withColumn("text", case)


MIXED = "mixed AS (SELECT * REPLACE (CASE doc_id % 5 " + " ".join(f"WHEN {k} THEN translate(text, '{LETTERS}', '{a}')" for k, a in ALPHABETS.items()) + " ELSE text END AS text) FROM documents)"


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


# Scripts and segments

_SEG = S.segment_pattern("arabic", given.RANGES)


@query(f"WITH {MIXED}, g AS (SELECT doc_id, regexp_extract_all(text, '{_SEG}') g FROM mixed), n AS (SELECT doc_id, g, unnest(range(1, len(g) + 1)) k FROM g) SELECT doc_id, k::INT seg_no, g[k] segment, regexp_matches(g[k], '{TARGET}') is_target FROM n")
def script_segments(spark: SparkSession, d: str) -> DataFrame:
    s = mixed(spark, d).select("doc_id", F.posexplode(S.segments(F.col("text"), "arabic")).alias("p", "s"))
    return s.select("doc_id", (F.col("p") + 1).alias("seg_no"), F.col("s.text").alias("segment"), F.col("s.is_target").alias("is_target"))


@query(f"WITH {MIXED}, g AS (SELECT lang, unnest(regexp_extract_all(text, '{_SEG}')) s FROM mixed) SELECT lang, regexp_matches(s, '{TARGET}') is_target, count(*) segments, sum(length(s))::BIGINT chars FROM g GROUP BY ALL")
def segment_counts(spark: SparkSession, d: str) -> DataFrame:
    s = mixed(spark, d).select("lang", F.explode(S.segments(F.col("text"), "arabic")).alias("s"))
    return s.groupBy("lang", F.col("s.is_target").alias("is_target")).agg(F.count("*").alias("segments"), F.sum(F.length("s.text")).alias("chars"))


@query(f"WITH {MIXED} SELECT doc_id, regexp_matches(text, '{TARGET}') has_target FROM mixed")
def contains_target(spark: SparkSession, d: str) -> DataFrame:
    return mixed(spark, d).select("doc_id", S.contains_script(F.col("text"), "arabic").alias("has_target"))


@query(f"WITH {MIXED} SELECT doc_id, concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(text, '[{S.char_class(r)}]') THEN '{n}' END" for n, r in given.RANGES.items()) + ") scripts FROM mixed")
def detect_scripts(spark: SparkSession, d: str) -> DataFrame:
    return mixed(spark, d).select("doc_id", F.array_join(S.detected_scripts(F.col("text"), list(S.RANGES)), ",").alias("scripts"))


@query(f"WITH {MIXED}, p AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '(the|of|<\\|sep\\|>)', chr(31) || '\\1' || chr(31), 'g'), chr(31)), lambda x: x <> '') p FROM mixed) SELECT doc_id, array_to_string(p, '¦') pieces FROM p")
def special_split(spark: SparkSession, d: str) -> DataFrame:
    return mixed(spark, d).select("doc_id", F.array_join(S.special_split(F.col("text"), SPECIALS), "¦").alias("pieces"))


@query(
    f"WITH {MIXED}, p AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '(the|of|<\\|sep\\|>)', chr(31) || '\\1' || chr(31), 'g'), chr(31)), lambda x: x <> '') p FROM mixed), "
    f"s AS (SELECT doc_id, flatten(list_transform(p, lambda x: CASE WHEN x IN ('the', 'of', '<|sep|>') THEN ['S' || x] ELSE list_transform(regexp_extract_all(x, '{_SEG}'), lambda y: CASE WHEN regexp_matches(y, '{TARGET}') THEN 'T' || y ELSE 'N' || y END) END)) s FROM p) SELECT doc_id, array_to_string(s, '¦') pieces FROM s"
)
def pretokenize(spark: SparkSession, d: str) -> DataFrame:
    kind = lambda s: F.when(s["is_special"], "S").when(s["is_target"], "T").otherwise("N")
    return mixed(spark, d).select("doc_id", F.array_join(F.transform(S.pretokenized(F.col("text"), SPECIALS, "arabic"), lambda s: F.concat(kind(s), s["text"])), "¦").alias("pieces"))


_RULES = "MAP {" + ", ".join(f"'{chr(k)}': '{''.join(map(chr, v))}'" for k, v in given.ARABIC_RULES.items()) + "}"


@query(
    f"WITH {MIXED}, t AS (SELECT doc_id, translate(text, 'بتث', '{chr(0x677)}{chr(0xFEFB)}{chr(0x6CC)}') text FROM mixed) SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '[{S.WHITE}]+|[^{S.WHITE}]+'), "
    f"lambda r: CASE WHEN length(r) <= 1 THEN r ELSE array_to_string(list_transform(string_split(r, ''), lambda c: coalesce({_RULES}[c], c)), '') END), '') normalized FROM t"
)
def normalize_arabic(spark: SparkSession, d: str) -> DataFrame:
    t = F.translate("text", "بتث", chr(0x677) + chr(0xFEFB) + chr(0x6CC))
    return mixed(spark, d).withColumn("text", t).select("doc_id", S.normalized(F.col("text"), S.ARABIC_RULES).alias("normalized"))


# Corpus cleaning


@query(f"WITH {MIXED} SELECT doc_id, text FROM mixed WHERE NOT regexp_matches(text, '{UNWANTED}')")
def clean_kept(spark: SparkSession, d: str) -> DataFrame:
    return classify.clean(mixed(spark, d), UNWANTED)[0].select("doc_id", "text")


@query(f"WITH {MIXED} SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx, source FROM mixed QUALIFY regexp_matches(text, '{UNWANTED}')")
def clean_rejects(spark: SparkSession, d: str) -> DataFrame:
    # Places among all rows less the source's first one: a source may hold a third of them.
    t = ranked(mixed(spark, d).select("doc_id", "source", F.col("text").rlike(UNWANTED).alias("hit")), "source", "doc_id")
    first = t.groupBy("source").agg(F.min("rank").alias("first"))
    return t.where("hit").join(first, "source").select("doc_id", (F.col("rank") - F.col("first")).alias("idx"), "source")


@query(f"WITH {MIXED} SELECT source, count(*) original, count(*) FILTER (regexp_matches(text, '{UNWANTED}')) rejected, count(*) FILTER (NOT regexp_matches(text, '{UNWANTED}')) remaining FROM mixed GROUP BY ROLLUP (source)")
def clean_stats(spark: SparkSession, d: str) -> DataFrame:
    t = mixed(spark, d).select("source", F.col("text").rlike(UNWANTED).alias("hit"))
    return t.rollup("source").agg(F.count("*").alias("original"), F.count_if("hit").alias("rejected"), F.count_if(~F.col("hit")).alias("remaining"))


@query("SELECT conv_id, turn, role FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE regexp_matches(text, '[\\x{E0}-\\x{E9}]'))")
def clean_conversations(spark: SparkSession, d: str) -> DataFrame:
    return classify.clean_conversations(spark.read.parquet(f"{d}/conversations.parquet"), r"[\x{E0}-\x{E9}]").select("conv_id", "turn", "role")


# Characters, blocks and vocabulary groups

_BLOCKS = "blocks(block, lo, hi) AS (VALUES " + ", ".join(f"('{b}', {x}, {y})" for b, x, y in given.BLOCKS) + ")"
_CHARS = "chars AS (SELECT unicode(c) cp, count(*) n FROM (SELECT unnest(string_split(text, '')) c FROM mixed) GROUP BY 1)"
_VOCAB = "old_vocab AS (SELECT token, n, row_number() OVER (ORDER BY n DESC, token) - 1 id FROM (SELECT token, count(*) n FROM (SELECT unnest(regexp_extract_all(lower(text), '\\p{L}+')) token FROM documents) GROUP BY 1)), new_vocab AS (SELECT token, n, row_number() OVER (ORDER BY n DESC, token) - 1 id FROM (SELECT token, count(*) n FROM (SELECT unnest(regexp_extract_all(lower(text), '\\p{L}+')) token FROM benchmark) GROUP BY 1))"
_WORDS = "w AS (SELECT token, row_number() OVER (ORDER BY token) id FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[^ \\n]+')) token FROM mixed))"
_GROUPS = "grouped AS (SELECT token, id, array_to_string(list_sort(list_distinct(list(coalesce(block, 'Unknown')))), '_') grp FROM (SELECT token, id, unnest(list_distinct(string_split(token, ''))) c FROM w) LEFT JOIN blocks ON unicode(c) BETWEEN lo AND hi WHERE coalesce(block, '') <> 'general punctuation' AND unicode(c) <> 9601 GROUP BY token, id)"
_ALL_GROUPS = f"{MIXED}, {_BLOCKS}, {_WORDS}, {_GROUPS}"


def _groups(spark: SparkSession, d: str) -> DataFrame:
    words = mixed(spark, d).select(F.explode(F.regexp_extract_all("text", F.lit(r"[^ \n]+"), F.lit(0))).alias("token")).distinct()
    return classify.token_groups(words.withColumn("id", F.lit(0)), classify.blocks(spark))


@query(f"WITH {MIXED}, {_CHARS} SELECT cp, n FROM chars")
def char_counts(spark: SparkSession, d: str) -> DataFrame:
    return classify.char_counts(mixed(spark, d))


@query(f"WITH {MIXED}, {_CHARS}, {_BLOCKS} SELECT coalesce(block, 'Unknown') AS block, count(*) points, sum(n)::BIGINT chars FROM chars LEFT JOIN blocks ON cp BETWEEN lo AND hi GROUP BY 1")
def block_coverage(spark: SparkSession, d: str) -> DataFrame:
    c = classify.block_of_code_points(classify.char_counts(mixed(spark, d)), classify.blocks(spark))
    return c.groupBy("block").agg(F.count("*").alias("points"), F.sum("n").alias("chars"))


@query(f"WITH {_ALL_GROUPS} SELECT token, grp FROM grouped")
def token_groups(spark: SparkSession, d: str) -> DataFrame:
    return _groups(spark, d).select("token", "grp")


@query(f"WITH {_ALL_GROUPS} SELECT grp, count(*) n FROM grouped GROUP BY 1")
def group_counts(spark: SparkSession, d: str) -> DataFrame:
    return classify.group_counts(_groups(spark, d))


@query(f"WITH {_ALL_GROUPS}, c AS (SELECT grp, count(*) n FROM grouped GROUP BY 1), r AS (SELECT grp, n, sum(n) OVER (ORDER BY n, grp ROWS UNBOUNDED PRECEDING)::BIGINT run FROM c) SELECT * FROM r WHERE run - n < 500")
def group_cumulative(spark: SparkSession, d: str) -> DataFrame:
    return classify.cumulative(classify.group_counts(_groups(spark, d)), 500)


_KEPT = [*classify.preserved_scripts(["latin", "greek"], ["arabic"]), *(b for s in ("latin", "greek", "arabic") for b in given.SCRIPT_BLOCKS[s])]


@query(
    f"WITH {_ALL_GROUPS}, c AS (SELECT grp, count(*) n FROM grouped GROUP BY 1) SELECT * FROM c WHERE list_has_any(string_split(replace(grp, '_', ' '), ' '), ['cjk', 'dingbats', {', '.join(repr(s) for s in given.SCRIPT_BLOCKS if s != 'common')}])"
    f" AND NOT ({' OR '.join(f'contains(grp, {k!r})' for k in _KEPT)})"
)
def reusable_groups(spark: SparkSession, d: str) -> DataFrame:
    return classify.reusable(classify.group_counts(_groups(spark, d)), classify.preserved_scripts(["latin", "greek"], ["arabic"]))


def _bridge(scripts: dict[str, list[str]]) -> str:
    return "bridge(script, block) AS (VALUES " + ", ".join(f"('{s}', '{b}')" for s, bs in scripts.items() for b in bs) + ")"


_BRIDGE = _bridge(given.SCRIPT_BLOCKS)
_BRIDGE_ALL = _bridge(S.SCRIPT_BLOCKS)
_BLOCKS_ALL = "blocks(block, lo, hi) AS (VALUES " + ", ".join(f"('{b}', {x}, {y})" for b, x, y in S.BLOCKS) + ")"


def _block_scripts(bridge: DataFrame) -> DataFrame:
    return bridge.groupBy("block").agg(F.array_join(F.sort_array(F.collect_set("script")), ",").alias("scripts"))


# block_scripts and script_ranges are over the part that their SQL spells out; all_ has the whole tables.


@query(f"WITH {_BRIDGE} SELECT block, string_agg(script, ',' ORDER BY script) scripts FROM bridge GROUP BY 1")
def block_scripts(spark: SparkSession, d: str) -> DataFrame:
    return _block_scripts(classify.script_blocks(spark, given.SCRIPT_BLOCKS))


@query(f"WITH {_BRIDGE}, {_BLOCKS} SELECT script, lo, hi FROM bridge JOIN blocks USING (block)")
def script_ranges(spark: SparkSession, d: str) -> DataFrame:
    return classify.script_blocks(spark, given.SCRIPT_BLOCKS).join(classify.blocks(spark), "block").select("script", "lo", "hi")


@query(f"WITH {_BRIDGE_ALL} SELECT block, string_agg(script, ',' ORDER BY script) scripts FROM bridge GROUP BY 1")
def all_block_scripts(spark: SparkSession, d: str) -> DataFrame:
    return _block_scripts(classify.script_blocks(spark))


@query(f"WITH {_BRIDGE_ALL}, {_BLOCKS_ALL} SELECT script, lo, hi FROM bridge JOIN blocks USING (block)")
def all_script_ranges(spark: SparkSession, d: str) -> DataFrame:
    return classify.script_blocks(spark).join(classify.blocks(spark), "block").select("script", "lo", "hi")


# Byte-pair merges

# RE2 has no lookahead: a mark goes between white space and its last blank before a word.
_PRE = "regexp_extract_all(regexp_replace(text, '(\\s+)(\\s)(\\S)', '\\1' || chr(30) || '\\2\\3', 'g'), '''s|''t|''re|''ve|''m|''ll|''d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}\\x1e]+|\\s+')"
_COUNTS = f"wc AS MATERIALIZED (SELECT word, count(*) n FROM (SELECT unnest({_PRE}) word FROM documents) GROUP BY 1)"


@query(f"WITH {_COUNTS} SELECT word, n FROM wc")
def word_counts(spark: SparkSession, d: str) -> DataFrame:
    return bpe.word_counts(docs(spark, d))


@query(f"SELECT doc_id, len(p)::INT n_pretokens, array_to_string(p, '¦') pretokens FROM (SELECT doc_id, {_PRE} p FROM documents)")
def pretokens(spark: SparkSession, d: str) -> DataFrame:
    p = docs(spark, d).select("doc_id", S.pretokens(F.col("text")).alias("p"))
    return p.select("doc_id", F.size("p").alias("n_pretokens"), F.array_join("p", "¦").alias("pretokens"))


_PAIRS = "SELECT s[i] l, s[i + 1] r, sum(n)::BIGINT n FROM (SELECT s, n, unnest(range(1, len(s))) i FROM (SELECT string_split(word, '') s, n FROM wc)) GROUP BY 1, 2"


@query(f"WITH {_COUNTS} {_PAIRS}")
def pair_counts(spark: SparkSession, d: str) -> DataFrame:
    return bpe.pair_counts(bpe.word_counts(docs(spark, d)))


@query(f"WITH {_COUNTS}, p AS ({_PAIRS}) SELECT l, r, n FROM p ORDER BY n DESC, l, r LIMIT 20")
def top_pairs(spark: SparkSession, d: str) -> DataFrame:
    return bpe.pair_counts(bpe.word_counts(docs(spark, d))).orderBy(F.desc("n"), "l", "r").limit(20)


def _train_sql(merges: int) -> str:
    out = [_COUNTS, "s0 AS MATERIALIZED (SELECT chr(30) || array_to_string(string_split(word, ''), chr(31) || chr(30)) || chr(31) w, n FROM wc)"]
    for k in range(merges):
        split = "string_split(substr(w, 2, length(w) - 2), chr(31) || chr(30))"
        out.append(f"p{k} AS MATERIALIZED (SELECT s[i] l, s[i + 1] r, sum(n)::BIGINT n FROM (SELECT s, n, unnest(range(1, len(s))) i FROM (SELECT {split} s, n FROM s{k})) GROUP BY 1, 2 ORDER BY n DESC, l, r LIMIT 1)")
        out.append(f"s{k + 1} AS MATERIALIZED (SELECT replace(w, chr(30) || l || chr(31) || chr(30) || r || chr(31), chr(30) || l || r || chr(31)) w, s{k}.n FROM s{k}, p{k})")
    return "WITH " + ", ".join(out) + " " + " UNION ALL ".join(f"SELECT {k}::INT AS rank, l, r, n FROM p{k}" for k in range(merges))


@query(_train_sql(8))
def bpe_train(spark: SparkSession, d: str) -> DataFrame:
    return bpe.train(bpe.word_counts(docs(spark, d)), 8)


def _fold(word: str) -> str:
    e = f"chr(30) || array_to_string(string_split({word}, ''), chr(31) || chr(30)) || chr(31)"
    for l, r in MERGES:
        e = f"replace({e}, chr(30) || '{l}' || chr(31) || chr(30) || '{r}' || chr(31), chr(30) || '{l}{r}' || chr(31))"
    return f"string_split(substr({e}, 2, length({e}) - 2), chr(31) || chr(30))"


_ENCODED = f"enc AS MATERIALIZED (SELECT word, n, string_split(substr(e, 2, length(e) - 2), chr(31) || chr(30)) s FROM (SELECT word, n, {_fold('word').split('substr(', 1)[1].rsplit(', 2, length(', 1)[0]} e FROM wc))"


@query(f"WITH {_COUNTS}, {_ENCODED} SELECT word, n, array_to_string(s, '¦') symbols FROM enc")
def bpe_encode_words(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_words(bpe.word_counts(docs(spark, d)), MERGES).select("word", "n", F.array_join("symbols", "¦").alias("symbols"))


_DOC_WORDS = f"dw AS (SELECT doc_id, lang, unnest({_PRE}) word FROM documents)"


@query(f"WITH {_COUNTS}, {_ENCODED}, {_DOC_WORDS} SELECT doc_id, count(*) words, sum(len(s))::BIGINT tokens FROM dw JOIN enc USING (word) GROUP BY 1")
def bpe_encode_docs(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encoded_sizes(docs(spark, d), MERGES)


@query(f"WITH {_COUNTS}, {_ENCODED}, {_DOC_WORDS} SELECT lang, count(*) words, sum(len(s))::BIGINT tokens, round(sum(len(s)) / count(*), 6) fertility FROM dw JOIN enc USING (word) GROUP BY 1")
def fertility(spark: SparkSession, d: str) -> DataFrame:
    e = bpe.encoded_sizes(docs(spark, d), MERGES, key="lang")
    return e.select("lang", "words", "tokens", F.round(F.col("tokens") / F.col("words"), 6).alias("fertility"))


# Id maps


def _vocabularies(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return idmap.vocabulary(spark.read.parquet(f"{d}/benchmark.parquet")), idmap.vocabulary(docs(spark, d))


_MAP = f"{_VOCAB}, common AS (SELECT token, n.id new_id, o.id old_id FROM new_vocab n JOIN old_vocab o USING (token)), fresh AS (SELECT id new_id, row_number() OVER (ORDER BY id) k FROM new_vocab WHERE token NOT IN (SELECT token FROM old_vocab)), free AS (SELECT id old_id, row_number() OVER (ORDER BY id) k FROM old_vocab WHERE id > 263 AND id NOT IN (SELECT old_id FROM common)), map AS (SELECT new_id, old_id FROM fresh JOIN free USING (k) UNION ALL SELECT new_id, old_id FROM common)"


@query(f"WITH {_VOCAB} SELECT token, id FROM new_vocab WHERE token NOT IN (SELECT token FROM old_vocab)")
def new_tokens(spark: SparkSession, d: str) -> DataFrame:
    return idmap.new_tokens(*_vocabularies(spark, d)).select("token", F.col("id").cast("long"))


@query(f"WITH {_MAP} SELECT token, new_id, old_id FROM common")
def common_tokens(spark: SparkSession, d: str) -> DataFrame:
    return idmap.common_tokens(*_vocabularies(spark, d)).select("token", F.col("new_id").cast("long"), F.col("old_id").cast("long"))


def _map(spark: SparkSession, d: str) -> DataFrame:
    new, old = _vocabularies(spark, d)
    return idmap.token_map(new, old, old.where("id > 263").select(F.col("id").alias("old_id"))).select(F.col("new_id").cast("long"), F.col("old_id").cast("long"))


@query(f"WITH {_MAP} SELECT new_id, old_id FROM map")
def map_new_to_old(spark: SparkSession, d: str) -> DataFrame:
    return _map(spark, d)


@query(f"WITH {_MAP} SELECT old_id, max(new_id) new_id FROM map GROUP BY 1")
def map_old_to_new(spark: SparkSession, d: str) -> DataFrame:
    return idmap.inverse(_map(spark, d))


@query(f"WITH {_MAP} SELECT (SELECT count(*) FROM map) new_size, (SELECT count(DISTINCT old_id) FROM map) old_size, (SELECT count(*) FROM common) common")
def map_stats(spark: SparkSession, d: str) -> DataFrame:
    return idmap.stats(_map(spark, d), idmap.common_tokens(*_vocabularies(spark, d)))


@query("SELECT range::INT new_id, range::INT old_id FROM range(1000)")
def identity_map(spark: SparkSession, d: str) -> DataFrame:
    return idmap.identity_map(spark, 1000)


# Sequences of ids. Ids are code points of the conversations' texts.

_IDS = "ids AS (SELECT conv_id, turn, list_transform(string_split(text, ''), lambda c: unicode(c)) ids FROM conversations)"


def ids(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", S.code_points(F.col("text")).alias("ids"))


def joined(c: Column) -> Column:
    return F.array_join(c.cast("array<string>"), ",")


@query(f"WITH {_IDS}, p AS (SELECT conv_id, turn, ids[i] id, i - 1 pos FROM (SELECT *, unnest(range(1, len(ids) + 1)) i FROM ids)), t AS (SELECT *, id >= 97 mapped, coalesce(((id >= 97) <> lag(id >= 97) OVER (PARTITION BY conv_id, turn ORDER BY pos))::INT, 0) turn_ FROM p), r AS (SELECT *, sum(turn_) OVER (PARTITION BY conv_id, turn ORDER BY pos)::BIGINT run FROM t) SELECT conv_id || '-' || turn AS seq, run, mapped, count(*) ids, min(pos)::INT start FROM r GROUP BY ALL")
def id_runs(spark: SparkSession, d: str) -> DataFrame:
    return idmap.id_runs(ids(spark, d).select(F.concat_ws("-", "conv_id", "turn").alias("seq"), "ids"), "seq", lambda i: i >= 97)


@query(f"WITH {_IDS} SELECT conv_id, turn, array_to_string(ids[1:32], ',') ids FROM ids")
def truncate(spark: SparkSession, d: str) -> DataFrame:
    return ids(spark, d).select("conv_id", "turn", joined(H.truncated(F.col("ids"), 32)).alias("ids"))


@query(f"WITH {_IDS} SELECT conv_id, turn, array_to_string([1] || ids[1:30] || [2], ',') ids FROM ids")
def truncate_specials(spark: SparkSession, d: str) -> DataFrame:
    return ids(spark, d).select("conv_id", "turn", joined(H.with_specials(F.col("ids"), 32, 1, 2)).alias("ids"))


@query(f"WITH {_IDS}, m AS (SELECT *, max(len(ids)) OVER (PARTITION BY conv_id)::INT k FROM ids) SELECT conv_id, turn, array_to_string(ids || list_transform(range(k - len(ids)), lambda x: 0), ',') ids, array_to_string(list_transform(range(k), lambda x: CASE WHEN x < len(ids) THEN 1 ELSE 0 END), ',') mask FROM m")
def pad_longest(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    t = ids(spark, d).withColumn("k", F.max(F.size("ids")).over(Window.partitionBy("conv_id")))
    return t.select("conv_id", "turn", joined(H.padded(F.col("ids"), F.col("k"), 0)).alias("ids"), joined(H.attention_mask(F.col("ids"), F.col("k"))).alias("mask"))


@query(f"WITH {_IDS}, m AS (SELECT conv_id, turn, ids[1:64] ids FROM ids) SELECT conv_id, turn, array_to_string(ids || list_transform(range(64 - len(ids)), lambda x: 0), ',') ids FROM m")
def pad_max_length(spark: SparkSession, d: str) -> DataFrame:
    return ids(spark, d).select("conv_id", "turn", joined(H.padded(H.truncated(F.col("ids"), 64), F.lit(64), 0)).alias("ids"))


@query(f"WITH {_IDS} SELECT conv_id, turn, (ceil(len(ids) / 8) * 8)::INT n, array_to_string(ids || list_transform(range((ceil(len(ids) / 8) * 8)::INT - len(ids)), lambda x: 0), ',') ids FROM ids")
def pad_to_multiple(spark: SparkSession, d: str) -> DataFrame:
    n = H.up_to_multiple(F.size("ids"), 8)
    return ids(spark, d).select("conv_id", "turn", n.alias("n"), joined(H.padded(F.col("ids"), n, 0)).alias("ids"))


@query(f"WITH {_IDS} SELECT a.conv_id, a.turn, array_to_string(a.ids || [2] || b.ids || [2], ',') ids FROM ids a JOIN ids b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1")
def pair_encode(spark: SparkSession, d: str) -> DataFrame:
    a, b = ids(spark, d).alias("a"), ids(spark, d).alias("b")
    j = a.join(b, (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("b.turn") == F.col("a.turn") + 1))
    return j.select("a.conv_id", "a.turn", joined(H.paired(F.col("a.ids"), F.col("b.ids"), 2)).alias("ids"))


@query(f"WITH {_IDS} SELECT conv_id, turn, array_to_string(list_transform(list_filter(ids, lambda i: i BETWEEN 97 AND 122), lambda i: i + 1000), ',') ids FROM ids")
def map_ids(spark: SparkSession, d: str) -> DataFrame:
    return ids(spark, d).select("conv_id", "turn", joined(H.mapped(F.col("ids"), {k: k + 1000 for k in range(97, 123)})).alias("ids"))


@query(f"WITH {_IDS} SELECT conv_id, turn, array_to_string(list_transform(ids, lambda i: chr(i::INT)), '') decoded FROM ids")
def decode_ids(spark: SparkSession, d: str) -> DataFrame:
    # Bytes of each id, end to end, then one decoding that puts U+FFFD where bytes don't fit.
    char = "decode(unhex(concat('000', hex(i div 65536), lpad(hex(i % 65536), 4, '0'))), 'UTF-32')"
    return ids(spark, d).select("conv_id", "turn", F.expr(f"make_valid_utf8(array_join(transform(ids, i -> {char}), ''))").alias("decoded"))


_HEAD = "'<|start_header_id|>' || {0} || '<|end_header_id|>' || chr(10) || chr(10)"
_TRIM = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"


def _chat_sql(prompt: bool) -> str:
    preamble = "'" + H.DATE_PREAMBLE.strip().replace("\n", "' || chr(10) || '") + "' || chr(10) || chr(10)"
    message = f"{_HEAD.format('role')} || {_TRIM.format('text')} || '<|eot_id|>'"
    tail = " || " + _HEAD.format("'assistant'") if prompt else ""
    return (
        "WITH n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) k FROM conversations) "
        f"SELECT conv_id, '<|begin_of_text|>' || {_HEAD.format(chr(39) + 'system' + chr(39))} || {preamble} || coalesce(max({_TRIM.format('text')}) FILTER (k = 1 AND role = 'system'), '') || '<|eot_id|>' || "
        f"coalesce(string_agg({message}, '' ORDER BY k) FILTER (NOT (k = 1 AND role = 'system')), ''){tail} rendered FROM n GROUP BY conv_id"
    )


@query(_chat_sql(False))
def chat_render(spark: SparkSession, d: str) -> DataFrame:
    return H.rendered_chats(spark.read.parquet(f"{d}/conversations.parquet"))


@query(_chat_sql(True))
def chat_prompt(spark: SparkSession, d: str) -> DataFrame:
    return H.rendered_chats(spark.read.parquet(f"{d}/conversations.parquet"), generation_prompt=True)
