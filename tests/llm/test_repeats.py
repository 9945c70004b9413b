"""Operators 1 and 4 against a brute-force search for repeated windows."""

import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from graphloom.llm import bwt, repeats, rlz

DOCS = "doc_id long, text string"
SPAN, GRAM = 6, 3


def words(text):
    return re.findall(r"[^\t\n\x0b\f\r ]+", text)


def brute(docs, span):
    """Maximal runs of words in windows that occur earlier, in order of (doc_id, position)."""
    first, dup = {}, {}
    texts = sorted({(i, t) for i, t in docs if i is not None and t is not None})
    for i, t in texts:
        w = words(t)
        for s in range(len(w) - span + 1):
            k = tuple(w[s : s + span])
            first[k] = min(first.get(k, (i, s)), (i, s))
    for i, t in texts:
        w = words(t)
        for s in range(len(w) - span + 1):
            if first[tuple(w[s : s + span])] != (i, s):
                dup.setdefault(i, set()).add(s)
    out = []
    for i, starts in dup.items():
        run = None
        for s in sorted(starts):
            if run and s <= run[1]:
                run[1] = s + span
            else:
                run = [s, s + span]
                out.append((i, run))
    return sorted((i, a, b) for i, (a, b) in out)


def corpora():
    r = random.Random(11)
    for letters, size in (("ab", 40), ("abcdefgh", 60), ("abcdefghijklmnopqrstuvw", 200)):
        docs = [(i, " ".join(r.choice(letters) for _ in range(r.randint(0, size)))) for i in range(25)]
        passage = " ".join(r.choice(letters) for _ in range(9))
        docs += [(100 + i, f"{' '.join(r.choice(letters) for _ in range(i))}\n{passage}\t{' '.join(r.choice(letters) for _ in range(7 - i))}") for i in range(7)]
        docs += [(200 + i, docs[3][1]) for i in range(4)]
        yield docs


@pytest.mark.parametrize("module", [rlz, bwt])
def test_spans_are_those_of_brute_force(spark, rows, module):
    for docs in corpora():
        got = rows(module.duplicate_spans(spark.createDataFrame(docs, DOCS).repartition(3), span=SPAN, gram=GRAM), "doc_id", "start_word", "end_word")
        assert sorted(got) == brute(docs, SPAN)


@pytest.mark.parametrize("module", [rlz, bwt])
def test_edges(spark, rows, module):
    p = " ".join(f"w{i}" for i in range(8))
    docs = [(None, p), (1, None), (2, ""), (3, " \n "), (4, "one two"), (5, p), (5, p), (6, p), (6, p), (7, f"x {p} y {p}")]
    df = spark.createDataFrame(docs, DOCS)
    want = [(6, 0, 8), (7, 1, 9), (7, 10, 18)]
    assert sorted(rows(module.duplicate_spans(df, span=SPAN, gram=GRAM), "doc_id", "start_word", "end_word")) == want == brute(docs, SPAN)
    assert module.duplicate_spans(df.limit(0), span=SPAN, gram=GRAM).count() == 0
    odd = df.selectExpr("doc_id", "text", "1 AS anchor", "2 AS lo", "3 AS words", "4 AS `ref_doc`", "5 AS `a.b`")
    assert sorted(rows(module.duplicate_spans(odd, span=SPAN, gram=GRAM), "doc_id", "start_word", "end_word")) == want


@pytest.mark.parametrize("module", [rlz, bwt])
def test_one_giant_text(spark, rows, module):
    r = random.Random(5)
    body = [f"t{r.randrange(10**6)}" for _ in range(60_000)]
    text = " ".join(body + body[100:160] + ["end"])
    got = rows(module.duplicate_spans(spark.createDataFrame([(1, text), (2, " ".join(body[5000:5050]))], DOCS)), "doc_id", "start_word", "end_word")
    assert sorted(got) == [(1, 60_000, 60_060), (2, 0, 50)]


def test_references_hold_the_same_words(spark):
    docs = next(corpora())
    text = {i: words(t) for i, t in docs}
    for r in rlz.duplicate_spans(spark.createDataFrame(docs, DOCS), span=SPAN, gram=GRAM).collect():
        a, b = text[r["doc_id"]][r["start_word"] : r["start_word"] + SPAN], text[r["ref_doc_id"]][r["ref_start_word"] : r["ref_start_word"] + SPAN]
        assert len(b) == SPAN and r["n_factors"] >= 1 and (r["n_factors"] > 1 or a == b)


def test_removal_keeps_the_rest(spark):
    p = " ".join(f"w{i}" for i in range(50))
    docs = [(1, f"a {p} b", "x", 9), (2, f"c\n{p} d", "y", 9), (3, p, "z", 9), (4, None, "n", None), (None, p, "m", 1), (5, "  short  ", "s", 9)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, n_chars long")
    got = {r["doc_id"]: r for r in rlz.remove_spans(df).collect()}
    assert set(got) == {1, 2, 4, None, 5}
    assert got[2]["text"] == "c d" and got[2]["n_chars"] == 3 and got[1]["text"] == docs[0][1] and got[5]["text"] == "  short  " and got[4]["text"] is None
    assert rlz.remove_spans(df).columns == df.columns


def test_merged_order_is_the_suffix_order():
    r = random.Random(7)
    for _ in range(20):
        segs = [np.array([r.randrange(3) for _ in range(r.randint(3, 30))], dtype=np.uint64) for _ in range(r.randint(1, 12))]
        group, seg, off = bwt.repeated_windows(segs, 4, shard_words=25)
        got = {}
        for g, s, o in zip(group.tolist(), seg.tolist(), off.tolist()):
            got.setdefault(g, set()).add((s, o))
        want = {}
        for s, x in enumerate(segs):
            for o in range(len(x) - 3):
                want.setdefault(tuple(x[o : o + 4].tolist()), set()).add((s, o))
        assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


@pytest.mark.parametrize("module", [rlz, bwt])
@pytest.mark.parametrize(("salt_rows", "block_regions"), [(3, 10**6), (10**6, 2), (3, 2), (1, 0)])
def test_heavy_anchors_are_split_without_a_change(spark, rows, module, salt_rows, block_regions):
    docs = [d for c in corpora() for d in c]
    docs = [(i + 1000 * k, t) for k, (i, t) in enumerate(docs)] + [(10**6, docs[-1][1])] * 9 + [(10**6 + 1 + i, f"{docs[-1][1]} x{i}") for i in range(9)]
    df = spark.createDataFrame(docs, DOCS).repartition(5)
    assert sorted(rows(module.duplicate_spans(df, span=SPAN, gram=GRAM, salt_rows=salt_rows, block_regions=block_regions), "doc_id", "start_word", "end_word")) == brute(docs, SPAN)


def blocks(r):
    """Random regions around anchors, as a block, and what they are: (anchor, doc, words, place of the anchor)."""
    out = []
    for k in range(r.randint(1, 25)):
        anchor = r.randrange(3)
        left, right = ([r.randrange(2) + 10 for _ in range(r.randint(0, SPAN - GRAM))] for _ in range(2))
        out.append((anchor, k, [*left, *(100 * anchor + i for i in range(GRAM)), *right], len(left)))
    raw = [np.array(w, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) for _, _, w, _ in out]
    table = pa.table({"anchor": pa.array([x[0] for x in out], pa.int64()), "doc_id": pa.array([x[1] for x in out], pa.int64()), "digest": pa.array([0] * len(out), pa.int64()), "pos": pa.array([x[3] for x in out], pa.int32()), "lo": pa.array([0] * len(out), pa.int32()), "words": pa.array([x.tobytes() for x in raw], pa.binary())})
    return repeats.Block(table, GRAM), sorted(out, key=lambda x: x[:2])


def test_factors_are_the_longest_matches():
    r = random.Random(4)
    seen = 0
    for _ in range(200):
        block, segs = blocks(r)
        want = []
        for k, (anchor, _, w, at) in enumerate(segs):
            top = -1
            for c in range(len(w)):
                if c > at or c + SPAN < at + GRAM:
                    continue
                best = 0
                for a2, _, v, at2 in segs[:k]:
                    d = c - at + at2
                    if a2 == anchor and d >= 0:
                        n = 0
                        while c + n < len(w) and d + n < len(v) and w[c + n] == v[d + n]:
                            n += 1
                        best = max(best, n)
                if best >= SPAN and c + best > top:
                    top = c + best
                    want.append((k, c, best))
        seg, start, length, ref, ref_start = rlz.factors(block, SPAN, GRAM)
        assert list(zip(seg.tolist(), start.tolist(), length.tolist())) == want
        for k, c, n, j, d in zip(*(x.tolist() for x in (seg, start, length, ref, ref_start))):
            assert j < k and segs[j][2][d : d + n] == segs[k][2][c : c + n]
        seen += len(want)
    assert seen > 200


def test_texts_of_one_id_are_told_apart(spark):
    p = " ".join(f"w{i}" for i in range(55))
    other = " ".join(f"u{i}" for i in range(80))
    docs = [(1, p), (2, f"a {p} b"), (2, other), (2, other)]
    df = spark.createDataFrame(docs, DOCS)
    got = sorted((r["doc_id"], r["text"]) for r in rlz.remove_spans(df).collect())
    assert got == [(1, p), (2, "a b"), (2, other), (2, other)]
    for module in (rlz, bwt):
        assert [(r["doc_id"], r["start_word"], r["end_word"]) for r in module.duplicate_spans(df).collect()] == [(2, 1, 56)]
    short, long = " ".join(f"s{i}" for i in range(60)), " ".join(f"s{i}" for i in range(200))  # one id, one a prefix of the other
    (r,) = rlz.duplicate_spans(spark.createDataFrame([(5, short), (5, long)], DOCS)).collect()
    assert (r["doc_id"], r["start_word"], r["end_word"]) == (5, 0, 60)


def test_a_third_of_all_rows_is_one_text(spark):
    p = " ".join(f"w{i}" for i in range(70))
    docs = [(7, p)] * 400 + [(8 + i, f"{p} {i}") for i in range(400)] + [(1000 + i, " ".join(f"{i}-{j}" for j in range(60))) for i in range(400)]
    for module in (rlz, bwt):
        got = module.duplicate_spans(spark.createDataFrame(docs, DOCS).repartition(6), salt_rows=100, block_regions=50).collect()
        assert sorted((r["doc_id"], r["start_word"], r["end_word"]) for r in got) == [(8 + i, 0, 70) for i in range(400)]


def test_a_merge_holds_few_bytes_a_word():
    rng = np.random.default_rng(3)
    pool = rng.integers(1, 2**63, 5000, dtype=np.uint64)
    segs = [pool[(np.arange(84) + k) % 5000] for k in rng.integers(0, 5000, 4000)]
    tracemalloc.start()
    try:
        bwt.repeated_windows(segs, 50, shard_words=100_000)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 70 * 84 * len(segs)


def test_blocks_are_not_larger_than_asked(spark):
    """Arrow's batches hold 10,000 rows; a block of several anchors ends within them."""
    words, asked = 80, 50_000
    rows = [(k, k, 0, 0, 0, bytes(8 * words)) for k in range(20_000)]
    segs = spark.createDataFrame(rows, "anchor long, doc_id long, digest long, pos int, lo int, words binary")

    def sizes(block):
        return pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([0], pa.int64()), pa.array([len(block)], pa.int32()), pa.array([len(block.words)], pa.int32()), pa.array([0], pa.int64()), pa.array([0], pa.int32())], names=["doc_id", "digest", "lo", "hi", "ref_doc", "ref_lo"])

    got = [(r["lo"], r["hi"]) for r in repeats.in_blocks(segs, sizes, 1, asked).collect()]
    assert sum(n for n, _ in got) == len(rows)
    assert max(n for _, n in got) <= asked + 2 * 500 * words


def test_windows_along_one_reference_are_one_match():
    w = np.arange(1, 31, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    table = pa.table({"anchor": pa.array([1, 1], pa.int64()), "doc_id": pa.array([1, 2], pa.int64()), "digest": pa.array([0, 0], pa.int64()), "pos": pa.array([9, 9], pa.int32()), "lo": pa.array([0, 0], pa.int32()), "words": pa.array([w.tobytes(), w[:20].tobytes()], pa.binary())})
    got = bwt.block_matches(repeats.Block(table, GRAM), SPAN).to_pylist()
    assert got == [{"doc_id": 2, "digest": 0, "lo": 0, "hi": 20, "ref_doc": 1, "ref_lo": 0}]


def test_regions_that_overlap_are_compared_once():
    """A text of one word has an anchor everywhere; each of its windows is given once."""
    w = np.full(40, 7, dtype=np.uint64)
    at = np.arange(40 - GRAM + 1)
    lo, hi = np.maximum(0, at - (SPAN - GRAM)), np.minimum(40, at + SPAN)
    table = pa.table({"anchor": pa.array([1] * len(at), pa.int64()), "doc_id": pa.array([1] * len(at), pa.int64()), "digest": pa.array([0] * len(at), pa.int64()), "pos": pa.array(at, pa.int32()), "lo": pa.array(lo, pa.int32()), "words": pa.array([w[a:b].tobytes() for a, b in zip(lo, hi)], pa.binary())})
    got = bwt.block_matches(repeats.Block(table, GRAM), SPAN).to_pylist()
    assert sorted((r["lo"], r["hi"], r["ref_lo"]) for r in got) == [(s, s + SPAN, 0) for s in range(1, 40 - SPAN + 1)]


def test_each_text_is_cut_once(spark):
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, text), (2, "a " + text), (3, text), (None, None)], DOCS)
    got = rlz.remove_spans(df)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1  # two hold twice the Python workers
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got.collect()) == [(0, None), (1, text), (2, "a")]
