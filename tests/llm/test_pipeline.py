"""The whole pipeline on the smallest tables, stage by stage against brute force."""

import os
import random

import pytest

import corpus_pipeline
from graphloom.llm import near, quality, secrets
from tests.llm.test_near import groups, jp, shingles
from tests.llm.test_packing import check
from tests.llm.test_repeats import brute, words

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{D}/documents.parquet"), []
    columns = docs.columns
    for i, (_, f) in enumerate(corpus_pipeline.STAGES):
        got = f(spark, docs, D)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert got.columns == columns
        rows = [r.asDict() for r in got.collect()]
        out.append(rows)
        if i < len(corpus_pipeline.STAGES) - 1:
            docs = spark.createDataFrame([tuple(r[c] for c in columns) for r in rows], docs.schema)
    return out


def test_quality(spark, stages):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{D}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in stages[0]}
    assert all(i in kept for i, q in labels.items() if q == 1)
    assert sum(i in kept for i, q in labels.items() if q == 0) <= 2
    assert quality.STATISTICS


def test_near(stages):
    s = {r["doc_id"]: shingles(r["text"]) for r in stages[0]}
    ids = sorted(s)
    true = [(i, j) for i in ids for j in ids if i < j and s[i] and s[j] and len(s[i].keys() & s[j].keys()) and jp(s[i], s[j]) >= near.THRESHOLD]
    whole = groups(true, ids)
    kept = {r["doc_id"] for r in stages[1]}
    assert {i for i in ids if whole[i] == i} <= kept
    gone = {i for i in ids if whole[i] != i}
    assert len(gone - kept) >= 0.9 * len(gone)


def test_substring(stages):
    before = {r["doc_id"]: r["text"] for r in stages[1]}
    cut = {}
    for i, a, b in brute(list(before.items()), 50):
        cut.setdefault(i, set()).update(range(a, b))
    want = {i: [w for k, w in enumerate(words(t)) if k not in cut.get(i, ())] for i, t in before.items()}
    got = {r["doc_id"]: words(r["text"]) for r in stages[2]}
    assert got == {i: w for i, w in want.items() if w or i not in cut}
    assert all(r["n_chars"] == len(r["text"]) for r in stages[2] if r["doc_id"] in cut)


def test_secrets(stages):
    before = {r["doc_id"]: r["text"] for r in stages[2]}
    for r in stages[3]:
        values = [f[4] for f in secrets.scan(before[r["doc_id"]])]
        assert not any(v in r["text"] for v in values)
        assert values or r["text"] == before[r["doc_id"]]
    assert len(stages[3]) == len(stages[2])


def test_packing(stages):
    check(stages[4], {r["doc_id"]: [len(words(r["text"]))] for r in stages[3] if words(r["text"])}, 2048)


def test_run_gives_the_last_stage(spark, stages):
    got = corpus_pipeline.run(spark, D).collect()
    assert sorted(map(repr, (r.asDict() for r in got))) == sorted(map(repr, stages[4]))


def tables(spark, folder, docs, labels):
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_odd_rows_and_extra_columns(spark, tmp_path):
    r = random.Random(9)
    vocabulary = ["".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 9))) for _ in range(3000)]
    prose = lambda: " ".join(" ".join(r.choice(vocabulary) for _ in range(12)).capitalize() + "." for _ in range(8))
    passage = " ".join(f"{r.choice(vocabulary)}{r.choice(vocabulary)}" for _ in range(55))
    docs = [(i, prose(), "en", "s", 1) for i in range(40)]
    docs += [(100, docs[0][1], None, None, None), (100, docs[0][1], None, None, None), (101, f"{prose()} {passage}", "en", "s", 1), (102, f"{prose()} {passage} {prose()}", "en", "s", 1)]
    docs += [(None, docs[5][1], "en", "s", 1), (200, None, "en", "s", None), (201, "", "en", "s", 0), (202, " \n\t ", "en", "s", 4), (203, prose() + '\npassword = "9f8aQ2xLmN4pR7tVw1Yz"', "en", "s", 1), (204, " ".join(prose() for _ in range(700)), "en", "s", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 AS quality_score", "2 AS keeper_id", "3 AS pack", "4 AS copy", "'x' AS leader", "5 AS `a.b`")
    labels = spark.createDataFrame([(i, 1, None) for i in range(30)] + [(None, 0, 0), (9999, 0, 0)], "doc_id long, quality int, toxic int")
    now = df
    for name, f in corpus_pipeline.STAGES[:-1]:
        now = f(spark, now, tables(spark, tmp_path / name, df, labels))
        assert now.columns == df.columns, name
    rows = now.collect()
    ids = [r["doc_id"] for r in rows]
    assert {*range(40), 101, 102, 203, 204} <= set(ids) and 100 not in ids and not {200, 201, 202} & set(ids) and None in ids
    assert sum(passage in (r["text"] or "") for r in rows) == 1
    assert not any("9f8aQ2xLmN4pR7tVw1Yz" in (r["text"] or "") for r in rows)
    packed = corpus_pipeline.run(spark, tables(spark, tmp_path / "run", df, labels))
    assert {r["doc_id"] for r in packed.collect()} == {i for i in ids if i is not None}


def test_empty_tables(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = corpus_pipeline.run(spark, tables(spark, tmp_path / "none", df, labels))
    assert got.count() == 0
