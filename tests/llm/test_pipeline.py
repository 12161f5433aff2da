"""The pipeline against its operators' plain definitions on a small table."""

import random

import pytest

pipeline = pytest.importorskip("corpus_pipeline")


def test_run_meets_brute_force(spark, tmp_path):
    rng = random.Random(7)
    words = [f"word{i}" for i in range(3000)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows, gone = [(i, text(80)) for i in range(120)], set()
    rows += [(200 + i, t) for i, t in rows[:10]]
    gone |= {200 + i for i in range(10)}
    rows += [(300 + i, t + " tail") for i, t in rows[20:26]]
    gone |= {300 + i + 0 for i, _ in rows[20:26]}
    item = text(20)
    rows += [(400 + i, text(30) + " " + item + " " + text(30)) for i in range(5)]
    gone |= {400 + i for i in range(5)}
    toxic = "vile grubby slander hateful insult scum"
    rows += [(500 + i, f"{text(20)} {toxic} {text(10)} {toxic}") for i in range(40)]
    gone |= {500 + i for i in range(40)}
    rows.append((600, None))
    df = lambda r, s: spark.createDataFrame(r, s)
    df([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    df([(i, 1, int(500 <= i < 600)) for i, _ in rows if i % 2 == 0], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    df([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = [r.doc_id for r in pipeline.run(spark, str(tmp_path)).select("doc_id").collect()]
    assert sorted(got) == sorted(i for i, _ in rows if i not in gone)
    assert 3 < len(pipeline.STAGES) < 6
