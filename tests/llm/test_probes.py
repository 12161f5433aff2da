"""Cases that once went wrong: clashing columns, whole ranges of ids, letters that change size, other folders."""

import os
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest

from scriptloom.llm import binary_fuse, exact_dedup, near_dedup, quality_qda, sentencepiece_nbest, sharding, suffix_dedup
from scriptloom.llm.binary_fuse import screening, split_by_keys

REPO = str(Path(__file__).resolve().parents[2])
LONG = " ".join(f"w{i}" for i in range(70))


def clashing(spark):
    rows = [(1, LONG, "u", 5, "x", [1], 7, "k"), (2, LONG, "v", None, "y", None, 8, "k"), (3, "other text here now", "w", 6, None, [2], 9, "k"), (None, None, None, None, None, None, None, "k")]
    return spark.createDataFrame(rows, "doc_id long, text string, `a.b` string, __digest int, __h string, __spans array<int>, __n long, row string")


@pytest.mark.parametrize("keep", [exact_dedup.keep_first, near_dedup.keep_one, suffix_dedup.remove_repeats])
def test_user_columns_come_back(spark, keep):
    docs = clashing(spark)
    back = keep(docs)
    assert back.columns == docs.columns
    want = {r.doc_id: r for r in docs.collect()}
    got = back.collect()
    assert {r.doc_id for r in got} == ({1, 2, 3, None} if keep is suffix_dedup.remove_repeats else {1, 3, None})
    for r in got:
        assert [v for c, v in zip(docs.columns, r) if c != "text"] == [v for c, v in zip(docs.columns, want[r.doc_id]) if c != "text"]


def test_ids_over_all_longs(spark):
    docs = spark.createDataFrame([(-(1 << 63), "a"), ((1 << 63) - 1, "a"), (0, "b")], "doc_id long, text string")
    assert [tuple(r) for r in exact_dedup.later_copies(docs).collect()] == [((1 << 63) - 1, -(1 << 63))]


def test_cut_where_lower_case_changes_sizes():
    assert suffix_dedup._cut("Ⱥé é one two ẞ three", [(1, 3)]) == "Ⱥé  two ẞ three"
    assert suffix_dedup._cut("İ ẞ Ⱥ x y", [(3, 5)]) == "İ ẞ Ⱥ "


def test_clashing_shard_columns_are_errors(spark):
    df = spark.range(3).withColumnRenamed("id", "doc_id")
    for name in ("shard", "Shard", "next_shard", "moves"):
        with pytest.raises(ValueError):
            sharding.plan_growth(df.selectExpr("*", f"1 as {name}"))


def test_written_shards_hold_every_row(spark, tmp_path):
    rows = [(i % 40, f"t{i}") for i in range(400)] + [(7, "same")] * 200
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sharding.write(df, f"{tmp_path}/s", shards=8, file_rows=20)
    back = spark.read.parquet(f"{tmp_path}/s")
    assert sorted((r.doc_id, r.text) for r in back.collect()) == sorted(rows)
    want = {r.doc_id: r.shard for r in sharding.assign(df, shards=8).collect()}
    assert all(r.shard == want[r.doc_id] for r in back.collect())


def test_filters_of_buckets_screen_keys(spark, monkeypatch):
    monkeypatch.setattr(binary_fuse, "BUCKET_KEYS", 100)
    keys = spark.range(0, 4000, 2).selectExpr("xxhash64(id) k")
    rows = spark.range(4000).selectExpr("id", "xxhash64(id) k").unionByName(spark.range(1).selectExpr("-1L id", "cast(null as long) k"))
    want = {r.k for r in keys.collect()}
    sure, maybe = split_by_keys(rows, "k", keys)
    held = {r.k for r in maybe.collect()}
    assert want <= held and len(held) < 2100 and sure.count() + maybe.count() == 4001 and sure.where("id = -1").count() == 1
    found = screening(keys, "k")()
    assert found.contains(np.array(sorted(want), np.int64)).all()
    assert split_by_keys(rows, "k", keys.where("false"))[1].count() == 0


@pytest.mark.parametrize("most", [64_000_000, 0], ids=["screened", "unscreened"])
def test_both_sides_of_the_filter_bound(spark, monkeypatch, most):
    monkeypatch.setattr(binary_fuse, "BROADCAST_KEYS", most)
    docs = clashing(spark)
    assert {r.doc_id for r in exact_dedup.keep_first(docs).collect()} == {1, 3, None}
    assert {r.doc_id for r in near_dedup.keep_one(docs).collect()} == {1, 3, None}
    assert [tuple(r) for r in suffix_dedup.repeats(docs).collect()] == [(2, 0, 70, 1)]


def test_executors_need_no_package_of_ours(tmp_path):
    code = f"""
import sys; sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()
from scriptloom.llm import exact_dedup, toxicity, quality_qda, decontaminate
docs = spark.createDataFrame([(i, 'a b c d e f g h i ' + str(i % 3)) for i in range(20)], 'doc_id long, text string')
labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(20)], 'doc_id long, quality int, toxic int')
print('ROWS', exact_dedup.keep_first(docs).count(), toxicity.score(docs, toxicity.fit(docs, labels)).count(), quality_qda.classify(docs, labels).count(), decontaminate.leaks(docs, spark.createDataFrame([(1, 'a b c d e f')], 'item_id long, text string')).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS 3 20 20 20" in out.stdout, out.stderr[-2000:]


def test_forward_substitution():
    rng = np.random.default_rng(1)
    low = np.linalg.cholesky(np.cov(rng.normal(size=(6, 40))))
    y = rng.normal(size=(6, 9))
    assert np.allclose(quality_qda.forward_substituted(low, y), np.linalg.solve(low, y))


def test_decoding_of_null_and_empty_lists(spark):
    df = spark.createDataFrame([(1, [])], "doc_id long, ids array<int>").unionByName(spark.createDataFrame([(2, None)], "doc_id long, ids array<int>"))
    assert {r.doc_id: r.decoded for r in sentencepiece_nbest.decode(df).collect()} == {1: "", 2: None}


def test_warc_shards_of_wide_ids_and_nulls(spark, tmp_path):
    from scriptloom.llm import warc

    rows = [((1 << 62) + i if i % 5 else None, None if i % 7 == 0 else f"http://h/{i % 3}", None if i % 11 == 0 else "x" * (i % 90)) for i in range(400)]
    pages = spark.createDataFrame([(*r, "s") for r in rows], "page_id long, url string, html string, shard string")
    sets = []
    for name, parts in (("a", 1), ("b", 7)):
        index = warc.write(pages.repartition(parts), f"{tmp_path}/{name}", shard_bytes=30_000, roll_bytes=6_000)
        assert index.count() == 400
        sets.append({f: (tmp_path / name / f).read_bytes() for f in os.listdir(tmp_path / name) if f.endswith(".gz")})
    assert sets[0] == sets[1] and len({f[:12] for f in sets[0]}) > 3
    back = [(r.page_id, r.url, r.html) for r in warc.read(spark, f"{tmp_path}/a").collect()]
    assert sorted(map(str, back)) == sorted(str((i, u, h or "")) for i, u, h in rows)
    nulls = spark.createDataFrame([(None, None, None)] * 5, "page_id long, url string, html string")
    assert warc.write(nulls, f"{tmp_path}/n", shard_bytes=1000).count() == 5


def near_plain(rows):
    """Groups by comparing all pairs of documents that share a band."""
    import itertools

    import pyarrow as pa

    h, to = near_dedup.sets_of(pa.array([t for _, t in rows]))
    sets = [np.unique(h[a:b]) for a, b in zip(to[:-1], to[1:])]
    bands = near_dedup.band_hashes(near_dedup.signatures(h, to))
    root = list(range(len(rows)))

    def find(x):
        return x if root[x] == x else find(root[x])

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (bands[i] == bands[j]).any() and near_dedup.jaccard(sets[i], sets[j]) >= near_dedup.THRESHOLD:
            root[max(find(i), find(j))] = min(find(i), find(j))
    size = [sum(find(k) == find(i) for k in range(len(rows))) for i in range(len(rows))]
    return {(rows[i][0], rows[find(i)][0], size[i]) for i in range(len(rows)) if size[i] > 1}


def test_near_copies_of_one_family_and_of_two_that_share_bands(spark, monkeypatch):
    import random

    monkeypatch.setattr(near_dedup, "LEADER_ROWS", 8)
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(3000)}"
    base = [word() for _ in range(90)]
    rows = []
    for family in range(3):  # families that agree in some two thirds of their runs of words
        own = base[: 60 + 5 * family] + [word() for _ in range(30)]
        for _ in range(40):
            rows.append((len(rows), " ".join(word() if rng.random() < 0.02 else w for w in own)))
    for _ in range(30):
        rows.append((len(rows), " ".join(word() for _ in range(40))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {tuple(r) for r in near_dedup.near_duplicates(docs).collect()}
    want = near_plain(rows)
    assert got == want and len({g for _, g, _ in want}) >= 2


def shuffled_mb(spark):
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    return sc.statusStore().executorList(True).apply(0).totalShuffleWrite() / 1e6


def test_near_copies_send_texts_of_alike_signatures_alone(spark):
    import random

    rng = random.Random(4)
    word = lambda: f"{rng.getrandbits(48):x}"
    rows = []
    for _ in range(60):  # families that share a band with others of their family, but are less alike than THRESHOLD
        base = [word() for _ in range(150)]
        rows += [(len(rows) + k, " ".join(base + [word() for _ in range(150)])) for k in range(10)]
    rows += [(len(rows) + k, rows[k * 7][1] + " tail") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    before = shuffled_mb(spark)
    got = {tuple(r) for r in near_dedup.near_duplicates(docs.select("doc_id", "text")).collect()}
    assert got == near_plain(rows) and len(got) >= 40
    assert shuffled_mb(spark) - before < 4 * sum(len(t) for _, t in rows) / 1e6


def test_repeated_keys_of_bands(spark):
    rng = np.random.default_rng(3)
    lists = rng.integers(-(1 << 63), 1 << 63, (500, near_dedup.BANDS))
    lists[1::5, 7] = lists[::5, 7]
    lists[2:500:50, 0] = lists[0, 39]
    df = spark.createDataFrame([(x.tolist(),) for x in lists], "bands array<long>").repartition(6)
    for parts in (1, 7):
        got = {r.key for r in near_dedup.repeated_keys(df, parts).collect()}
        key = df.selectExpr("explode(bands) band").select(near_dedup.band_key(near_dedup.F.col("band"), parts).alias("key"))
        want = {r.key for r in key.groupBy("key").count().where("count > 1").collect()}
        assert got == want and len(want) >= 101
    assert near_dedup.repeated_keys(df.where("false"), 3).count() == 0
