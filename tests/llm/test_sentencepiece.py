"""N-best segmentation against A* over whole lattices."""

import random
import time

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from scriptloom.llm import sentencepiece_nbest as S
from scriptloom.llm.textbatch import span_hashes


@pytest.fixture(scope="module")
def model():
    with open(S.MODEL_PATH, "rb") as f:
        return S.PieceModel(f.read())


def held(model, texts, n):
    cache = S.UnitCache(model)
    for text, got in zip(texts, S.encode_chunk(model, cache, pa.array(texts), n)):
        want = model.encode(text, n)
        assert np.allclose([s for s, _ in got], [s for s, _ in want])
        for score, ids in got:
            assert model.decode(ids.tolist()) == text
            known = sum(model.scores[i] for i in ids if model.kinds[i] != S._BYTE)
            assert model.kinds.count(S._BYTE) and (any(model.kinds[i] == S._BYTE for i in ids) or np.isclose(score, known))
        assert len({tuple(i.tolist()) for _, i in got}) == len(got)


def test_units_meet_whole_lattices_on_table_texts(model):
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()
    held(model, [t for t in texts if len(t) < 4000], S.N_BEST)


def test_units_meet_whole_lattices_on_odd_texts(model):
    rng = random.Random(11)
    letters = "aeéthn  .,12中文\U0001f600_=\n"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(150)]
    held(model, [t for t in texts if S.SPACE not in t] + ["    ", " a ", "=" * 50, "the" * 60, "̄" * 30], 4)


def test_both_sides_of_the_longest_unit(model, monkeypatch):
    texts = ["thequickbrownfox" * 5, "internationalization of thermodynamics", "onlyoneunit" * 9]
    one = S.encode_chunk(model, S.UnitCache(model), pa.array(texts), 3)
    monkeypatch.setattr(S, "LONGEST_AT_ONCE", 0)
    other = S.encode_chunk(model, S.UnitCache(model), pa.array(texts), 3)
    for a, b in zip(one, other):
        assert np.allclose([s for s, _ in a], [s for s, _ in b]) and sorted(i.tolist() for _, i in a) == sorted(i.tolist() for _, i in b)


def test_long_units_that_differ_far_from_their_start(model):
    rng = random.Random(12)
    a = "".join(rng.choice("abcdefgh") for _ in range(4)) + "x" + "".join(rng.choice("abcdefgh") for _ in range(4095)) + "y" + "abc" * 900
    b = a[:4] + a[4100] + a[5:4100] + a[4] + a[4101:]
    assert a != b
    data = np.frombuffer((a + b).encode(), np.uint8)
    h = span_hashes(data, np.array([0, len(a)]), np.array([len(a), 2 * len(a)]))
    assert h[0] != h[1]
    cache = S.UnitCache(model)
    for text in (a, b):
        best = S.encode_chunk(model, cache, pa.array([text]), 2)[0][0][1]
        assert model.decode(best.tolist()) == text


def test_cache_that_is_emptied(model):
    texts = [f"word{i} and other{i % 7}" for i in range(300)]
    cache = S.UnitCache(model, most=50)
    for k in range(0, 300, 30):
        part = texts[k : k + 30]
        assert [model.decode(r[0][1].tolist()) for r in S.encode_chunk(model, cache, pa.array(part), 3)] == part


def test_time_of_a_long_text_is_linear(model):
    text = "中文字" * 4000
    began = time.time()
    got = S.encode_chunk(model, S.UnitCache(model), pa.array([text]), 3)[0]
    assert model.decode(got[0][1].tolist()) == text and time.time() - began < 20
