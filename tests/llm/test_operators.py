"""The operators against brute force, round trips and held-out labels."""

import itertools
import math
import os
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from scriptloom.llm import decontaminate, exact_dedup, html_wrappers, near_dedup, quality_qda, sentencepiece_nbest, sharding, suffix_dedup, toxicity, warc
from scriptloom.llm.binary_fuse import BinaryFuse8

DOC = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARY = [f"word{i}" for i in range(4000)]


def prose(rng, n):
    return [rng.choice(VOCABULARY) for _ in range(n)]


def docs_of(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOC).repartition(parts)


EDGE = [(1, "a b c d e f g"), (2, None), (None, "a b c d e f g"), (3, ""), (4, ""), (1, "a b c d e f g"), (5, " ".join(f"t{i % 977}" for i in range(60_000))), (6, "…!?"), (7, "ß İ 中文 \U0001f600 x")]


def test_exact_copies(spark):
    rows = [*EDGE, (9, "x"), (8, "x"), (10, "X")]
    got = sorted(exact_dedup.later_copies(docs_of(spark, rows)).collect(), key=str)
    assert sorted((r.doc_id, r.duplicate_of) for r in got if r.doc_id is not None) == [(1, 1), (4, 3), (9, 8)]
    assert [(r.doc_id, r.duplicate_of) for r in got if r.doc_id is None] == [(None, 1)]
    assert exact_dedup.keep_first(docs_of(spark, rows)).count() == len(rows) - 4


def test_fuse_filter_holds_its_keys():
    keys = np.random.default_rng(0).integers(0, 1 << 63, 20_000, dtype=np.uint64)
    f = BinaryFuse8.of(keys)
    assert f.contains(keys).all()
    other = np.random.default_rng(1).integers(0, 1 << 63, 50_000, dtype=np.uint64)
    assert f.contains(other).mean() < 0.01


def test_near_copies_meet_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for g in range(40):
        base = prose(rng, rng.randint(40, 200))
        for _ in range(rng.randint(1, 4)):
            copy = [rng.choice(VOCABULARY) if rng.random() < rng.choice((0, 0.02, 0.05)) else w for w in base]
            rows.append((len(rows), " ".join(copy)))
    sets = [set(zip(*(t.split()[k:] for k in range(near_dedup.SHINGLE)))) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        return x if root[x] == x else find(root[x])

    for i, j in itertools.combinations(range(len(rows)), 2):
        if len(sets[i] & sets[j]) >= near_dedup.THRESHOLD * len(sets[i] | sets[j]):
            root[max(find(i), find(j))] = min(find(i), find(j))
    want = {(i, find(i)) for i in range(len(rows)) if sum(find(k) == find(i) for k in range(len(rows))) > 1}
    got = {(r.doc_id, r.group_id) for r in near_dedup.near_duplicates(docs_of(spark, rows)).collect()}
    assert len(got & want) >= 0.9 * len(want) and not got - want
    assert near_dedup.keep_one(docs_of(spark, rows)).count() == len(rows) - len(want) + len({g for _, g in want})


def test_bayesian_bounds():
    for n, m in near_dedup.least_matches():
        tail = sum(math.comb(n + 1, k) * 0.5 ** (n + 1) for k in range(m + 1))
        assert tail >= near_dedup.MISS and (m == 0 or tail - math.comb(n + 1, m) * 0.5 ** (n + 1) < near_dedup.MISS)


def test_leaks_meet_brute_force(spark):
    rng = random.Random(2)
    items = [(k, " ".join(prose(rng, rng.randint(4, 25)))) for k in range(12)] + [(20, None), (21, "")]
    rows = []
    for i in range(60):
        w = prose(rng, rng.randint(0, 80))
        if i % 3 == 0:
            x = items[i % 12][1].split()
            if i % 2:
                x[rng.randrange(len(x))] = "changed"
            w[len(w) // 2 : len(w) // 2] = x
        rows.append((i, " ".join(w)))
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (round(r.similarity, 9), r.place) for r in decontaminate.leaks(docs_of(spark, rows), b).collect()}

    def runs(w):
        n = decontaminate.SHINGLE
        parts = [tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))] if w else []
        return parts

    want = {}
    for (i, t), (k, x) in itertools.product(rows, items):
        item = (x or "").split()
        if len(item) < decontaminate.MIN_WORDS:
            continue
        w = t.split()
        for a in range(max(1, len(w) - len(item) + 1)):
            p, q = runs(w[a : a + len(item)]), runs(item)
            every = set(p) | set(q)
            size = lambda r: sum(map(len, r))
            s = sum(min(p.count(r), q.count(r)) * size(r) for r in every) / max(1, sum(max(p.count(r), q.count(r)) * size(r) for r in every))
            if s >= decontaminate.THRESHOLD and s > want.get((i, k), (0, 0))[0] + 1e-12:
                want[i, k] = (s, a)
    want = {k: (round(s, 9), a) for k, (s, a) in want.items()}
    assert len(set(got.items()) & set(want.items())) >= 0.9 * len(want) and not set(got) - set(want) and len(want) > 15
    clean = {r.doc_id for r in decontaminate.keep_clean(docs_of(spark, rows), b).collect()}
    assert clean == {i for i, _ in rows} - {i for i, _ in got}


def test_longest_previous_factors():
    rng = np.random.default_rng(3)
    for _ in range(60):
        s = rng.integers(0, rng.integers(1, 4), rng.integers(0, 40))
        want = [max([next((k for k in range(len(s) - i) if s[i + k] != s[j + k]), len(s) - i) for j in range(i)], default=0) for i in range(len(s))]
        assert suffix_dedup.longest_previous_factors(s).tolist() == want


def test_repeats_meet_brute_force(spark):
    rng = random.Random(4)
    passages = [prose(rng, rng.randint(45, 130)) for _ in range(5)]
    rows = []
    for i in range(50):
        w = []
        for _ in range(rng.randint(0, 3)):
            w += prose(rng, rng.randint(0, 50))
            p = rng.choice(passages)
            w += p[rng.choice((0, 3, 12)) : len(p) - rng.choice((0, 7))]
        rows.append((i, " ".join(w + ["x", "y"] * (90 if i % 16 == 1 else 0))))
    rows += [(50, rows[7][1]), (51, rows[7][1])]
    seen, want = set(), []
    for i, t in rows:
        w = t.split()
        cover = [False] * len(w)
        for a in range(len(w) - suffix_dedup.MIN_WORDS + 1):
            k = tuple(w[a : a + suffix_dedup.MIN_WORDS])
            if k in seen:
                cover[a : a + len(k)] = [True] * len(k)
            seen.add(k)
        edges = np.flatnonzero(np.diff(np.concatenate(([0], cover, [0]))))
        want += [(i, int(a), int(b)) for a, b in zip(edges[::2], edges[1::2])]
    got = sorted((r.doc_id, r.start, r.stop) for r in suffix_dedup.repeats(docs_of(spark, rows)).collect())
    assert got == sorted(want)
    text = {r.doc_id: r.text.split() for r in suffix_dedup.remove_repeats(docs_of(spark, rows)).collect()}
    assert all(len(text[i]) == len(t.split()) - sum(b - a for k, a, b in want if k == i) for i, t in rows)


def test_warc_round_trip_is_deterministic(spark, tmp_path):
    rows = [(i, f"http://h{i % 7}.example/{i}", f"<p>{'é' * (i % 50)} {i}</p>") for i in range(300)]
    rows += [(1, None, "<p>x"), (None, "http://a b/\n", None), (3, "http://h3.example/3", rows[3][2])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    index = warc.write(pages.repartition(5), f"{tmp_path}/a", shard_bytes=40_000, roll_bytes=4_000)
    warc.write(pages.repartition(3), f"{tmp_path}/b", shard_bytes=40_000, roll_bytes=4_000)
    files = sorted(f for f in os.listdir(tmp_path / "a") if f.endswith(".gz"))
    assert len(files) > 4 and all((tmp_path / "a" / f).read_bytes() == (tmp_path / "b" / f).read_bytes() for f in files)
    assert not [f for f in os.listdir(tmp_path / "a") if f.startswith("_temporary")]
    assert index.count() == len(rows)
    r = index.where("page_id = 42").first()
    data = (tmp_path / "a" / r.file).read_bytes()[r.offset : r.offset + r.length]
    assert warc.parse(next(warc.members(data)))["payload"].decode() == rows[42][2]
    back = warc.read(spark, f"{tmp_path}/a").collect()
    assert sorted((r.page_id or -1, r.html) for r in back) == sorted((i or -1, h or "") for i, _, h in rows)
    assert warc.write(pages.where("false"), f"{tmp_path}/c").count() == 0 and warc.read(spark, f"{tmp_path}/c").count() == 0


def test_wrappers(spark):
    page = lambda title, items, extra="": f"<html><!-- c --><h1>{title}</h1><i>Site</i><ul>{''.join(f'<li><a href=x>{x}</a></li>' for x in items)}</ul>{extra}<script>var x = '<p>'</script></html>"
    rows = [(1, "http://a.example/1", page("One", "pq")), (2, "http://a.example/2", page("Two", "xyz")), (3, "https://A.example:80/3", page("T&amp;3", "u", "<b>more</b>")), (4, "http://b.example/", "<p>alone</p>"), (5, None, None), (6, "http://a.example/4", "")]
    got = {r.page_id: r for r in html_wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].text == "One\np\nq" and got[2].text == "Two\nx\ny\nz" and got[3].text == "T&3\nu\nmore" and got[4].text == "alone"
    assert got[5].text == got[6].text == "" and got[3].host == "a.example"


def test_wrapper_matches_its_pages():
    import re

    t = pq.read_table("/root/testdata/sf0.001/pages.parquet")
    folded = [html_wrappers.fold(html_wrappers.tokens(h)) for h in t["html"].to_pylist()]
    samples = [(s, [html_wrappers._text_hash(x) for x in texts], 1) for s, texts in folded]
    wrapper, where = html_wrappers.infer(samples)
    pattern = re.sub(r"<[^>]*>", lambda m: re.escape(m[0]), re.sub(r"[#=]", "T", html_wrappers.shown(wrapper)))
    for (_, texts), places in zip(folded, where):
        assert len(texts) == len(places)
    assert "(" in pattern


def test_wrapper_places_every_text():
    def held(pages):
        merger = html_wrappers._Merger()
        for page in pages:
            stream, texts = html_wrappers.fold(html_wrappers.tokens(page))
            merger.add(("", stream), np.array([html_wrappers._text_hash(t) for t in texts], np.int64), 1)
        every = sorted(((-n, stream, t.tolist()) for (_, stream), (t, n) in merger.of.items()), key=lambda x: x[:2])
        wrapper, where = html_wrappers.infer([(s, t, -n) for n, s, t in every])

        def leaves(nodes):
            return [y for n in nodes for y in ([n] if n.kind == "text" else leaves(n.body))]

        # Each text of each stream is in one text of the wrapper, and is that text if it is fixed.
        flat = [(v, slot) for (_, _, t), slots in zip(every, where) for v, slot in zip(t, slots, strict=True)]
        assert sorted(k for n in leaves(wrapper) for k in n.seen) == list(range(len(flat)))
        for n in leaves(wrapper):
            assert all(flat[k][1] == n.slot and (n.slot >= 0 or flat[k][0] == n.value != 0) for k in n.seen)

    li = lambda *x: f"<ul>{''.join(f'<li>{t}</li>' for t in x)}</ul>"
    held([li("a"), li("b"), li("c"), li("d", "e"), li("f", "g"), li("", "h", "i")])
    rng = random.Random(3)
    for _ in range(200):
        held("".join(rng.choice(("<b>", "</b>", "<i>", "</i>", "x", "y", str(rng.random()))) for _ in range(rng.randint(0, 14))) for _ in range(rng.randint(1, 12)))


def test_wrappers_give_texts_beside_optional_groups(spark):
    pages = [f"<ul><li>{x}</li></ul>" for x in "abc"] + [f"<ul><li>{x}</li><li>{y}</li></ul>" for x, y in ("de", "fg")] + ["<ul><li></li><li>h</li><li>i</li></ul>"]
    df = spark.createDataFrame([(k, "http://a.example/", p) for k, p in enumerate(pages)], "page_id long, url string, html string")
    assert sorted(r.text for r in html_wrappers.extract(df).collect()) == ["a", "b", "c", "d\ne", "f\ng", "h\ni"]


def test_n_best_meets_enumeration():
    model = sentencepiece_nbest.PieceModel(open(sentencepiece_nbest.MODEL_PATH, "rb").read())

    def every(unit):
        if not unit:
            return [(0.0, [])]
        out = []
        for k in range(1, len(unit) + 1):
            i = model.usable.get(unit[:k])
            if i is None and k > 1:
                continue
            score, own = (model.scores[i], [i]) if i is not None else (model.unknown_score, model.unknown(unit[:1]))
            out += [(score + s, own + rest) for s, rest in every(unit[k:])]
        return out

    cache = sentencepiece_nbest.UnitCache(model)
    for text in ("the cat", "ab  cd", "naïve 中", "a", " x", "éé"):
        want = sorted((round(-s, 6) for s, _ in every(model.escape(text))))[:4]
        got = sentencepiece_nbest.encode_chunk(model, cache, pa.array([text]), 4)[0]
        assert [round(-s, 6) for s, _ in got] == want
        assert all(model.decode(i.tolist()) == text for _, i in got)


def test_sentencepiece_edges(spark):
    df = sentencepiece_nbest.encode(docs_of(spark, EDGE))
    got = {r.doc_id: r for r in df.collect()}
    assert got[2].segmentations is None and got[3].n_tokens == 0 and got[5].round_trip and got[7].round_trip
    flat = df.selectExpr("doc_id", "segmentations[0].ids ids")
    assert {r.doc_id: r.decoded for r in sentencepiece_nbest.decode(flat).collect()}[1] == EDGE[0][1]


def test_jump_hash():
    def one(key, n):
        b, j = -1, 0
        while j < n:
            b = j
            key = (key * 2862933555777941757 + 1) % (1 << 64)
            j = int((b + 1) * (2147483648.0 / ((key >> 33) + 1)))
        return b

    keys = np.random.default_rng(5).integers(0, 1 << 63, 3000, dtype=np.uint64)
    now, later = sharding.jump(keys, 64), sharding.jump(keys, 80)
    assert now.tolist() == [one(int(k), 64) for k in keys]
    assert (later[later != now] >= 64).all() and abs((later != now).mean() - 0.2) < 0.03


def test_ordinal_model_on_held_out_labels():
    d = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["doc_id", "text"]).to_pandas()
    x = d.merge(pq.read_table("/root/testdata/sf0.1/labels.parquet").to_pandas(), on="doc_id")
    train, test = x[x.doc_id % 2 == 0], x[x.doc_id % 2 == 1]
    model = toxicity.fit_texts(train["text"].tolist(), train["toxic"].to_numpy() > 0, float((train["toxic"] > 0).mean()))
    p, _ = toxicity.score_batch(pa.record_batch([pa.array(test["text"])], ["text"]), model, toxicity._place(model))
    said, true = p[:, 0] >= toxicity.REJECT_AT, test["toxic"].to_numpy() > 0
    assert said[true].mean() > 0.9 and said[~true].mean() < 0.02
    assert (np.diff(p, axis=1) <= 0).all() and (np.diff(model.thresholds) > 0).all()


def test_quadratic_scores_are_log_densities():
    rng = np.random.default_rng(6)
    x = [rng.normal(size=(50, 3)) @ rng.normal(size=(3, 3)) + k for k in (0, 1)]
    model = quality_qda.model_of(np.array([50.0, 50.0]), np.array([a.sum(axis=0) for a in x]), np.array([a.T @ a for a in x]), 0.3, 0.02)
    cov = [f @ f.T for f in model.factors]
    at = rng.normal(size=(9, 3))
    density = [-0.5 * np.einsum("ij,jk,ik->i", at - m, np.linalg.inv(c), at - m) - 0.5 * np.log(np.linalg.det(c)) for m, c in zip(model.means, cov)]
    assert np.allclose(model.score(at), density[1] - density[0])


def test_quality_on_held_out_labels(spark):
    d = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"]).to_pandas()
    x = d.merge(pq.read_table("/root/testdata/sf0.01/labels.parquet").to_pandas(), on="doc_id")
    docs, labels = spark.createDataFrame(x[["doc_id", "text"]]), spark.createDataFrame(x[x.doc_id % 2 == 0][["doc_id", "quality"]])
    got = quality_qda.classify(docs, labels).toPandas().merge(x, on="doc_id")
    held = got[got.doc_id % 2 == 1]
    assert (held["good"] == (held["quality"] > 0)).mean() > 0.8


EMPTY = "empty"


@pytest.mark.parametrize("rows", [EDGE, [], [(None, None)], [(1, "")] * 3], ids=["edge", EMPTY, "nulls", "ties"])
def test_odd_tables(spark, rows):
    docs = docs_of(spark, rows).selectExpr("*", "1 text_hash", "'x' group_id", "2 digest", "3 anchor", "4 score", "5 bucket") if rows else docs_of(spark, []).selectExpr("*", "1 text_hash")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (3, 0, 1), (None, 1, 1), (99, 0, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "a b c d e f g"), (None, "a b c d e f g"), (2, None), (3, "")], "item_id long, text string")
    n = len(rows)
    assert sentencepiece_nbest.encode(docs).count() == n
    model = toxicity.fit(docs, labels)
    assert toxicity.score(docs, model).count() == n and toxicity.keep_clean(docs, model).columns == docs.columns
    assert sharding.plan_growth(docs).count() == n
    assert near_dedup.keep_one(docs).columns == docs.columns and near_dedup.keep_one(docs).count() <= n
    found = decontaminate.leaks(docs, bench).count()
    assert found == 2 * sum(t == "a b c d e f g" for _, t in rows)
    assert decontaminate.keep_clean(docs, bench).count() == n - found // 2
    assert exact_dedup.keep_first(docs).columns == docs.columns
    assert suffix_dedup.remove_repeats(docs).count() == n and suffix_dedup.repeats(docs).count() >= 0
    assert quality_qda.classify(docs, labels).count() == n
