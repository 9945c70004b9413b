import os
import random
import tracemalloc
from functools import reduce

import numpy as np
import pyarrow as pa
import pytest

from graphloom.llm import pieces

pytestmark = pytest.mark.skipif(not os.path.exists(pieces.MODEL_PATH), reason="needs the piece model")
DOCS = "doc_id long, text string"


def texts():
    r = random.Random(1)
    alphabet = "abcdefghij  éß漢字🙂\n\t.,<>0123456789"
    yield from ["", " ", "  a", "a ", "Hello world", "naïve café 漢字🙂", "▁x ▁", "a\nb\tc", "<s> </s> <unk>", "x" * 300, " " * 50]
    for n in (10, 100, 700):
        for _ in range(6):
            yield "".join(r.choice(alphabet) for _ in range(n))


def test_ids_are_the_librarys(spark):
    sp = pieces.model(pieces.MODEL_PATH).sp
    want = dict(enumerate(texts()))
    for giant in (1 << 15, 5):  # the second sends nearly all texts through the parallel scan
        got = {r["doc_id"]: r for r in pieces.encode(spark.createDataFrame(list(want.items()), DOCS), giant_chars=giant, chunk_chars=64).collect()}
        assert len(got) == len(want)
        for i, t in want.items():
            assert got[i]["ids"] == sp.encode(t), (giant, t)
            assert got[i]["n_tokens"] == len(got[i]["ids"]) and got[i]["round_trip"] == (sp.decode(got[i]["ids"]) == t)


def test_a_giant_document(spark):
    r = random.Random(2)
    text = " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(1, 12))) for _ in range(40_000)) + "y" * 3000
    got = pieces.encode(spark.createDataFrame([(1, text)], DOCS)).first()
    assert got["ids"] == pieces.model(pieces.MODEL_PATH).sp.encode(text) and got["round_trip"]


def test_decoding(spark):
    ok = [t for t in texts() if "▁" not in t]
    enc = pieces.encode(spark.createDataFrame(list(enumerate(ok)), DOCS))
    back = {r["doc_id"]: r["text"] for r in pieces.decode(enc).collect()}
    assert back == dict(enumerate(ok))


def test_edges(spark, rows):
    df = spark.createDataFrame([(None, "a b"), (1, None), (2, ""), (3, "same"), (3, "same")], DOCS).selectExpr("*", "1 AS ids", "2 AS digest", "3 AS k")
    got = pieces.encode(df)
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in got.collect()) == [("1", None), ("2", 0), ("3", 1), ("3", 1), ("None", 2)]
    assert pieces.encode(df.limit(0)).count() == 0
    assert rows(pieces.decode(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>"))) == [(1, None), (2, "")]
    giant = pieces.encode(spark.createDataFrame([(None, "a b " * 20), (None, "a b " * 20), (7, "a b " * 20), (7, "a b " * 20)], DOCS), giant_chars=10, chunk_chars=64)
    assert len({tuple(r["ids"]) for r in giant.collect()}) == 1 and giant.count() == 4


def test_combination_is_associative():
    rng = np.random.default_rng(0)
    a, b, c = (np.where(rng.random((4, 4)) < 0.4, -np.inf, rng.integers(-9, 0, (4, 4))) for _ in range(3))
    assert np.array_equal(pieces.combine(pieces.combine(a, b), c), pieces.combine(a, pieces.combine(b, c)))


def test_states_are_those_of_the_best_path():
    rng = np.random.default_rng(1)
    for _ in range(50):
        sizes = [1, *rng.integers(1, 5, rng.integers(1, 6)), 3]
        found = [np.where(rng.random((a, b)) < 0.2, -np.inf, rng.random((a, b))) for a, b in zip(sizes, sizes[1:])]
        whole = reduce(pieces.combine, found)
        if np.isinf(whole.max()):
            continue
        states = pieces.resolve(found)
        assert states[0][0] == 0 and all(x[1] == y[0] for x, y in zip(states, states[1:]))
        assert abs(sum(m[s] for m, s in zip(found, states)) - whole.max()) < 1e-12


def reworked(change, tmp_path):
    """The model file with its trainer's or normaliser's bytes changed; nothing is trained."""
    raw = pieces.model(pieces.MODEL_PATH).sp.serialized_model_proto()
    spec = dict(x for x in pieces.fields(raw) if x[0] in (2, 3))
    path = tmp_path / "other.model"
    out = raw
    for k in (2, 3):
        new = change(k, spec[k])
        assert len(new) == len(spec[k]) and raw.count(spec[k]) == 1
        out = out.replace(spec[k], new)
    path.write_bytes(out)
    return str(path)


def test_a_unigram_model(spark, tmp_path):
    """The public vocabulary read as a unigram model: the best sum of scores wins, as in the library."""
    path = reworked(lambda k, x: x.replace(b"\x18\x02", b"\x18\x01", 1) if k == 2 else x, tmp_path)
    m = pieces.model(path)
    assert m.kind == pieces.UNIGRAM
    want = dict(enumerate(texts()))
    assert sum(m.sp.encode(t) != pieces.model(pieces.MODEL_PATH).sp.encode(t) for t in want.values()) > 5
    for giant in (1 << 15, 5):
        got = {r["doc_id"]: r for r in pieces.encode(spark.createDataFrame(list(want.items()), DOCS), path, giant_chars=giant, chunk_chars=64).collect()}
        assert {i: r["ids"] for i, r in got.items()} == {i: m.sp.encode(t) for i, t in want.items()}


def test_more_chunks_than_one_level_combines(spark, monkeypatch):
    r = random.Random(3)
    text = "".join(r.choice("etaoin shrdlu漢") for _ in range(9000))
    monkeypatch.setattr(pieces, "FAN", 3)
    got = pieces.encode(spark.createDataFrame([(1, text), (2, text[:700]), (None, text[::-1])], DOCS), giant_chars=100, chunk_chars=64).collect()
    assert {r["doc_id"]: r["ids"] for r in got} == {i: pieces.model(pieces.MODEL_PATH).sp.encode(t) for i, t in ((1, text), (2, text[:700]), (None, text[::-1]))}


@pytest.mark.parametrize("change", [(2, b"\x18\x02", b"\x18\x03"), (2, b"\x98\x02\x01", b"\x98\x02\x00"), (3, b"\x20\x00", b"\x20\x01"), (3, b"\x18\x01", b"\x18\x00")])
def test_other_models_are_refused(tmp_path, change):
    which, old, new = change
    path = reworked(lambda k, x: x.replace(old, new, 1) if k == which else x, tmp_path)
    with pytest.raises((ValueError, RuntimeError)):
        pieces.Model(path)


def test_a_worker_keeps_few_units():
    """Texts of ever new units: what is kept for later batches is bounded, and the ids are the library's all the same."""
    m = pieces.Model(pieces.MODEL_PATH)
    for k in range(20):
        texts = [" ".join(f"u{k}x{i}x{j}" for j in range(100)) for i in range(100)]
        ids, offsets = pieces.encode_column(m, pa.array(texts))
        assert len(m.known) <= 1 << 17
        assert [ids[a:b].tolist() for a, b in zip(offsets[:3], offsets[1:4])] == [m.sp.encode(t) for t in texts[:3]]


def test_decoding_holds_few_bytes_a_byte():
    m = pieces.model(pieces.MODEL_PATH)
    text = "the quick brown fox jumps over the lazy dog " * 1000
    ids = np.array(m.sp.encode(text) * 100, dtype=np.int32)
    tracemalloc.start()
    try:
        raw, bounds = pieces.decode_flat(m, ids, np.array([0, len(ids)]))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert bounds[-1] == len(raw) > 4_000_000
    assert peak < 14 * len(raw)
