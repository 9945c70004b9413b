import math
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.operators import chunking as C

DOCS = "doc_id long, text string"


def test_windows_are_closed_form(spark):
    texts = [" ".join(f"w{i}" for i in range(n)) for n in (0, 1, 9, 10, 11, 25, 40)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None)], DOCS)
    for overlap in (0.0, 0.3, 0.9):
        step = 10 - int(10 * overlap)
        got = {}
        for r in C.token_chunks(docs, 10, overlap).orderBy("doc_id", "sequence_index").collect():
            got.setdefault(r["doc_id"], []).append(r)
        assert 99 not in got
        for i, t in enumerate(texts):
            n = len(t.split())
            assert len(got[i]) == (1 if n <= 10 else 1 + math.ceil((n - 10) / step))
            assert [r["text"].split() for r in got[i]] == ([t.split()] if n <= 10 else [t.split()[k * step : k * step + 10] for k in range(len(got[i]))])
            assert [r["token_count"] for r in got[i]] == [len(r["text"].split()) for r in got[i]]


def test_bad_arguments():
    with pytest.raises(ValueError):
        C.token_chunks(None, 10, 1.0)
    with pytest.raises(ValueError):
        C.create_chunker(preset="huge")
    with pytest.raises(ValueError):
        C.create_chunker("magic")
    assert C.create_chunker("token", 1, 0.5, preset="rag") == C.Chunker("token", 512, 0.2)


@settings(max_examples=200, deadline=None)
@given(st.text("ab.\n !", max_size=300), st.integers(1, 20), st.sampled_from([0.0, 0.15, 0.5, 1.0]))
def test_aligned_always_advances_and_covers(text, size, overlap):
    got = C.aligned(text, size, overlap)
    words = text.split()
    assert got and all(n >= 0 for _, n in got)
    if len(C._TOKEN.findall(text)) > size:
        at = 0
        for t, _ in got:  # windows in order, without gaps
            w = t.split()
            start = next(k for k in range(at, -1, -1) if words[k : k + len(w)] == w)
            at = max(at, start + len(w))
        assert at == len(words)


def test_aligned_moves_to_a_sentence_end():
    text = " ".join(["one two three four."] * 20)
    got = C.aligned(text, 10, 0.0)
    assert got[0][1] == 10 and all(t.endswith(".") for t, _ in got[1:])


def test_sentences_fill_and_overlap():
    got = C.by_sentences("A b. C d. E f. G h. I j.", 4, 1)
    assert [t for t, _ in got] == ["A b. C d. ", "C d. E f. ", "E f. G h. ", "G h. I j."]
    assert C.by_sentences("", 4, 1) == [] and C.by_sentences("   ", 4, 1) == []
    assert [n for _, n in C.by_sentences("a b c d e f g. h i.", 4, 2)] == [7, 2]


def test_sample_keeps_ends():
    text = "".join(chr(97 + i % 26) for i in range(50_000))
    s = C.sampled(text, 5, 1000, 3000)
    assert s.startswith(text[:1000]) and s.endswith(text[-1000:]) and s.count("truncated") == 2
    assert C.sampled("short") == "short"


def test_python_chunks_edges(spark, rows):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "One. Two.")], DOCS)
    assert rows(C.python_chunks(docs, "aligned", 4, 0.5), "doc_id", "text") == [(2, ""), (3, "One. Two.")]
    assert rows(C.python_chunks(docs, "sentence", 1, 0), "doc_id", "text") == [(3, "One. "), (3, "Two.")]
    assert rows(C.python_chunks(docs.limit(0), "sentence", 1, 0)) == []


def test_issues(spark, rows):
    schema = "origin string, position int, chunk_id string, sequence_index int, text string, token_count int"
    c = spark.createDataFrame([("a", 0, "x", 0, "t", 1), ("a", 1, "x", 0, " ", 0), ("a", 2, "y", -1, "t", 1)], schema)
    assert rows(C.chunk_issues(c)) == sorted([("x", "empty text"), ("x", "zero tokens"), ("x", "out of order"), ("y", "out of order"), ("y", "negative index"), ("x", "duplicate id")], key=repr)
    assert rows(C.chunk_issues(c.limit(0))) == [(None, "no chunks")]


def test_paragraphs(spark, rows):
    d = spark.createDataFrame([(1, "A.\n\nB! \n \nC?"), (2, "")], DOCS)
    assert rows(C.sentence_marks(d), "doc_id", "sentence_ends", "paragraph_ends") == [(1, 2, 2), (2, 0, 0)]


BPE = C.BpeTokenizer()


@pytest.mark.skipif(not os.path.exists(BPE.path), reason="needs the public vocabulary")
def test_bpe_ids_and_chunks(spark):
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(BPE.path.replace(".tiktoken", ".json"))
    other.encode_special_tokens = True
    texts = {0: "", 1: "Hello world, it's 2024!", 2: "naïve café 漢字🙂 " * 40, 3: "a  b\n\nc " * 200, 4: "🙂" * 90}
    for t in texts.values():
        ids = BPE.encode(t)
        assert ids == other.encode(t, add_special_tokens=False).ids and BPE.decode(ids) == t
        spans = BPE.spans(t)
        assert len(spans) == len(ids) and all(a <= b for a, b in spans) and (not spans or (spans[0][0], spans[-1][1]) == (0, len(t)))
    rows = spark.createDataFrame([*texts.items(), (9, None)], "doc_id long, text string")
    got = {}
    for r in C.create_chunker("token", 20, 0.25, tokenizer=BPE)(rows).orderBy("doc_id", "sequence_index").collect():
        got.setdefault(r["doc_id"], []).append((r["text"], r["token_count"]))
    assert set(got) == set(texts)
    for i, t in texts.items():
        n, step = len(BPE.encode(t)), 15
        count = 1 if n <= 20 else 1 + -(-(n - 20) // step)
        assert len(got[i]) == count and [c for _, c in got[i]] == [min(20, n - k * step) if n > 20 else n for k in range(count)]
        starts = [a for a, _ in BPE.spans(t)]
        for k, (x, c) in enumerate(got[i]):
            assert t[starts[k * step] if n else 0 :].startswith(x)
            if "🙂" not in t and "漢" not in t and n > 20:
                assert x == BPE.decode(BPE.encode(t)[k * step : k * step + c])
        assert got[i][-1][0] == (t if n <= 20 else t[starts[(count - 1) * step] :])


def test_presets_take_a_tokenizer(spark):
    rows = spark.createDataFrame([(1, "one two three " * 300)], "doc_id long, text string")
    native, given_one = (C.create_chunker(preset="graphrag", tokenizer=t)(rows).orderBy("sequence_index").select("sequence_index", "text", "token_count").collect() for t in (None, C.SpaceTokenizer()))
    assert [r["token_count"] for r in native] == [r["token_count"] for r in given_one] and [r["text"].rstrip() for r in native] == [r["text"].rstrip() for r in given_one]
