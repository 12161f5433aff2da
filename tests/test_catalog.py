"""Every query of the catalog against its SQL, on the small tables; and literal cases of the column functions."""

import glob
import os
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from scriptloom.functions import scripts as S
from scriptloom.functions import shaping as H
from scriptloom.operators import bpe, classify, idmap
from scriptloom.plans import catalog, tokens  # noqa: F401 (tokens adds its queries)

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def _rows(rows):
    return sorted(tuple((x is None, str(x)) for x in r) for r in rows)


@pytest.mark.parametrize("name", list(catalog.ORACLES))
def test_query_is_its_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = df.select(*columns).collect()
    cur = duck.execute(catalog.ORACLES[name])
    at = [[c[0] for c in cur.description].index(c) for c in columns]
    assert _rows(got) == _rows([[r[k] for k in at] for r in cur.fetchall()])


def _one(spark, column, text):
    return spark.createDataFrame([(text,)], "text string").select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, want",
    [
        ("مرحبا", [("مرحبا", True)]), ("Hello World", [("Hello World", False)]), ("Hello مرحبا World", [("Hello ", False), ("مرحبا ", True), ("World", False)]),
        ("  مرحبا", [("  مرحبا", True)]), ("", []), ("   \t\n  ", [("   \t\n  ", False)]), ("كتاب book مجلة magazine", [("كتاب ", True), ("book ", False), ("مجلة ", True), ("magazine", False)]), (None, None),
    ],
)
def test_segments(spark, text, want):
    found = _one(spark, S.segments(F.col("text"), "arabic"), text)
    assert (None if found is None else [tuple(s) for s in found]) == want


def test_special_tokens_longest_first(spark):
    got = _one(spark, S.special_split(F.col("text"), ["<extra_id_1>", "<extra_id_10>"]), "Hello <extra_id_10> World")
    assert got == ["Hello ", "<extra_id_10>", " World"]


def test_normalization(spark):
    text = "ک کک " + chr(0x677) + chr(0x677)
    want = "ک " + chr(0x643) * 2 + " " + (chr(0x624) + chr(0x64F)) * 2
    assert _one(spark, S.normalized(F.col("text"), S.ARABIC_RULES), text) == want


def test_maps_drop_or_raise(spark):
    ids = F.array(*map(F.lit, (1, 999, 2)))
    assert spark.range(1).select(H.mapped(ids, {0: 0, 1: 100, 2: 200, 3: 3}).alias("x")).first()["x"] == [100, 200]
    with pytest.raises(Exception, match="no entry"):
        spark.range(1).select(H.mapped(ids, {1: 100}, strict=True).alias("x")).collect()


def test_merges_meet_the_recount():
    words = [("abab", 3), ("aab", 2), ("bbb", 1), ("ba", 5)]
    got = bpe.merges_of(words, 4)
    seqs = [(list(w), n) for w, n in words]
    for l, r, n in got:
        count = {}
        for s, k in seqs:
            for p in zip(s, s[1:]):
                count[p] = count.get(p, 0) + k
        assert (-n, (l, r)) == min((-c, p) for p, c in count.items())
        seqs = [(bpe.apply_merges("".join(s), {}) and _merge(s, l, r), k) for s, k in seqs]


def _merge(s, l, r):
    out, k = [], 0
    while k < len(s):
        if s[k : k + 2] == [l, r]:
            out.append(l + r)
            k += 2
        else:
            out.append(s[k])
            k += 1
    return out


def test_repair_joins_split_characters():
    b = "é".encode()
    pieces = {1: b"a", 2: b[:1], 3: b[1:], 4: b"z"}
    assert idmap.repaired([1, 2, 3, 4], pieces, {}, {2, 3}) == "aéz"
    assert idmap.repaired([2, 1], pieces, {}, {2, 3}).startswith("�")


def test_tables_of_unicode_are_whole(spark):
    assert len(S.BLOCKS) == 346 and len(S.SCRIPT_NAMES) == 176 and len(S.SCRIPT_BLOCKS) == 174
    assert not {b for bs in S.SCRIPT_BLOCKS.values() for b in bs} - {b for b, *_ in S.BLOCKS}
    vocab = spark.createDataFrame([("\u1200", 0), ("\u0e01", 1), ("\U0001f600", 2)], "token string, id int")
    assert [r.grp for r in classify.token_groups(vocab, classify.blocks(spark)).orderBy("id").collect()] == ["ethiopic", "thai", "emoticons"]


def test_reusable_groups_of_a_shipped_vocabulary(spark):
    lines = [x.split("\t") for x in (Path(__file__).parent / "vocabulary_languages.txt").read_text().splitlines()]
    counts = spark.createDataFrame([(g, int(n)) for g, n in lines], "grp string, n long")
    got = {r.grp: r.n for r in classify.reusable(counts, classify.preserved_scripts(["latin", "greek"], ["arabic"])).collect()}
    assert len(got) == 35 and sum(got.values()) == 16_632
    assert {"hangul syllables", "thai", "devanagari", "hebrew", "armenian", "halfwidth and fullwidth forms_katakana"} <= set(got)
    kept = {r.grp for r in classify.reusable(counts, classify.preserved_scripts(["latin"], ["katakana"])).collect()}
    assert not kept & {"cjk_merged", "hangul syllables", "hiragana", "latin_merged"} and "cyrillic" in kept


def test_arabic_rules_and_ranges_are_whole(spark):
    rules = S.ARABIC_RULES
    assert len(rules) == 296 and sum(0xFB50 <= k <= 0xFDFF or 0xFE70 <= k <= 0xFEFF for k in rules) == 260
    assert not {0x649, 0x671, 0xFDFA} & set(rules)
    got = spark.createDataFrame([(k, "x" + chr(k) + "y " + chr(k)) for k in rules], "k int, text string").select("k", S.normalized(F.col("text"), rules).alias("x")).collect()
    assert {r.k: r.x for r in got} == {k: "x" + "".join(map(chr, v)) + "y " + chr(k) for k, v in rules.items()}
    whole = "".join(map(chr, rules))
    assert _one(spark, S.normalized(F.col("text"), rules), whole) == "".join(chr(x) for v in rules.values() for x in v)
    # All at once: what a rule gives isn't changed by another.
    assert _one(spark, S.normalized(F.col("text"), {97: [98], 98: [99], 99: [97, 98], 100: []}), "abcd b") == "bcab b"
    assert _one(spark, S.normalized(F.col("text"), {97: [98], 98: [99]}), "ab") == "bc"
    assert [tuple(x) for x in _one(spark, S.segments(F.col("text"), "arabic"), "a" + chr(0x870) + chr(0x89F))] == [("a", False), (chr(0x870) + chr(0x89F), True)]


def test_too_few_reusable_ids_raise(spark):
    old = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "token string, id int")
    new = spark.createDataFrame([("a", 0), ("x", 1), ("y", 2)], "token string, id int")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "old_id int")
    assert sorted(map(tuple, idmap.token_map(new, old, ids(0, 1, 2)).collect())) == [(0, 0), (1, 1), (2, 2)]
    for few in (ids(0, 2), ids(0), ids(0).where("false")):
        m = idmap.token_map(new, old, few)
        for run in (m.collect, m.count, idmap.inverse(m).collect, idmap.stats(m, idmap.common_tokens(new, old)).collect):
            with pytest.raises(Exception, match="no reusable id is left"):
                run()


def test_runs_of_ids_need_no_shuffle(spark):
    rows = [("a", [100, 200, 5, 10, 100]), ("b", [1]), ("c", []), ("d", None), ("e", [97] * 3)]
    df = idmap.id_runs(spark.createDataFrame(rows, "seq string, ids array<int>"), "seq", lambda i: i >= 97)
    assert sorted(map(tuple, df.collect())) == [("a", 0, True, 2, 0), ("a", 1, False, 2, 2), ("a", 2, True, 1, 4), ("b", 0, False, 1, 0), ("e", 0, True, 3, 0)]
    plan = catalog.id_runs(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan and "Window" not in plan


def test_empty_texts_count_as_in_the_sql(spark, tmp_path):
    spark.createDataFrame([(0, "abé"), (5, ""), (6, ""), (7, None), (4, "\0é")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("char_counts", "block_coverage"):
        df = catalog.QUERIES[name](spark, str(tmp_path))
        cur = c.execute(catalog.ORACLES[name])
        at = [[x[0] for x in cur.description].index(k) for k in df.columns]
        assert _rows(df.collect()) == _rows([[r[k] for k in at] for r in cur.fetchall()]), name
