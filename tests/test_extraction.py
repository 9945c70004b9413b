import itertools
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import extraction as X
from graphloom.operators import relations as R


def spec_resolve(names, threshold):
    """Straight from the description: no bounds, no shortcuts."""
    ratio = lambda a, b: 1.0 if a.lower().strip() == b.lower().strip() else SequenceMatcher(None, a.lower().strip(), b.lower().strip()).ratio()
    if len(names) < 2:
        return {}
    out, heads = {}, []
    for i, n in enumerate(names):
        if n in out:
            continue
        hit = [h for h in heads if ratio(n, h) >= threshold]
        if hit:
            out[n] = hit[0]
            continue
        group = [n] + [m for m in names[i + 1 :] if m not in out and ratio(n, m) >= threshold]
        head = sorted(group, key=lambda g: -len(g))[0]
        heads.append(head)
        for g in group:
            out[g] = head
    return out


def test_resolution_as_described():
    r = random.Random(3)
    for _ in range(60):
        names = list(dict.fromkeys("".join(r.choice("abAB ") for _ in range(r.randint(1, 6))) for _ in range(r.randint(0, 12))))
        for t in (0.5, 0.7, 0.85):
            assert X.resolve_names(names, t) == spec_resolve(names, t)
    assert X.resolve_names(["Apple"]) == {}
    assert X.resolve_names(["Apple Inc", "Apple Inc.", "Tesla"]) == {"Apple Inc": "Apple Inc.", "Apple Inc.": "Apple Inc.", "Tesla": "Tesla"}


def test_resolve_table(spark, rows):
    e = spark.createDataFrame([(1, "Co", "Acme Corp", 0), (1, "Co", "Acme Corp.", 1), (1, "Co", "Acme Corp", 2), (1, "Pe", "Ann", 3), (2, "Co", "Acme Corp", 4)], "doc_id long, type string, name string, idx long")
    assert rows(X.resolve(e)) == [(1, "Co", "Acme Corp", "Acme Corp."), (1, "Co", "Acme Corp.", "Acme Corp.")]
    assert rows(X.resolve(e.limit(0))) == []


def test_map_relations(spark, rows):
    t = spark.createDataFrame([(1, 0, "a", "r", "b"), (1, 1, "A", "r", "b"), (1, 2, "a", "r", "A"), (2, 3, "a", "r", "b")], "doc_id long, idx long, source string, relation string, target string")
    m = spark.createDataFrame([(1, "a", "A")], "doc_id long, name string, canonical string")
    assert rows(X.map_relations(t, m), "doc_id", "source", "target", "idx") == [(1, "A", "b", 0), (2, "a", "b", 3)]


def test_gate_takes_the_first_type(spark, rows):
    m = spark.createDataFrame([(1, "Bob", "Thing", 0), (1, "Bob", "Person", 1), (1, "Bob", "Location", 2), (1, "Rome", "Location", 3)], "doc_id long, name string, type string, idx long")
    types = spark.createDataFrame([("Person",), ("Location",)], "type string")
    typed = X.first_types(m, types)
    assert rows(typed) == [(1, "Bob", "Person"), (1, "Rome", "Location")]
    t = spark.createDataFrame([(1, 0, "Bob", "in", "Rome"), (1, 1, "Rome", "in", "Bob"), (1, 2, "Bob", "in", "Nowhere")], "doc_id long, idx long, source string, relation string, target string")
    rel = spark.createDataFrame([("in", "Person", "Location")], "name string, src string, dst string")
    assert rows(X.gate(t, typed, rel), "idx") == [(0,)]


@pytest.mark.parametrize(
    ("text", "a", "b", "want"),
    [
        ("Us in business. Us met Them!", "us", "them", "Us met Them!"),
        ("Ann. Bob left", "ann", "bob", "Ann."),
        ("nothing here", "ann", "bob", ""),
        ("", "a", "b", ""),
        (None, "a", "b", ""),
    ],
)
def test_evidence(text, a, b, want):
    assert T.evidence(text, a, b) == want


def test_evidence_is_the_closest_pair():
    r = random.Random(5)
    for _ in range(100):
        text = " ".join(r.choice(["ann", "bob", "x", "yy"]) for _ in range(20))
        a, b = [[i for i in range(len(text)) if text.startswith(n, i)] for n in ("ann", "bob")]
        if a and b:
            assert T.evidence(text, "ann", "bob") == text.strip()
            assert min(abs(x - y) for x, y in itertools.product(a, b)) > 0


def test_negation_and_years(spark):
    cases = [("It never produced cars", "produces_x", True), ("It never sold cars", "produces", False), ("It makes no longer", "makes", True), ("it owns", "owns", False), (None, "owns", False), ("did not own a thing", "own", False)]
    df = spark.createDataFrame(cases, "w string, r string, want boolean")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", T.negated(F.col("w"), F.col("r"))).collect())
    years = [("from 1999 to 2005", "1999-01-01", "2005-12-31"), ("2005-1999", "1999-01-01", "2005-12-31"), ("in 2001 and 1990", "1990-01-01", None), ("12001 or 1899", None, None), ("none", None, None), ("2001 UNTIL 2003", "2001-01-01", "2003-12-31")]
    df = spark.createDataFrame(years, "w string, a string, b string").withColumn("s", T.year_span(F.col("w")))
    for r in df.collect():
        assert (r["s"] and r["s"]["start"], r["s"] and r["s"]["end"]) == (r["a"] or None, r["b"] or None), r["w"]


def test_metadata_abstains_for_other_languages(spark):
    df = spark.createDataFrame([("en", "owns", "never owns since 1999"), ("de", "owns", "never owns since 1999")], "lang string, relation string, evidence string")
    got = {r["lang"]: (r["is_negated"], r["start_time"]) for r in X.with_metadata(df).collect()}
    assert got == {"en": (True, "1999-01-01"), "de": (None, None)}


def test_antecedent(spark):
    df = spark.createDataFrame([("Bob and Ann met. Then she left", ["Ann", "Bob"], "She", "Ann"), ("It rained. Bob", ["Bob"], "it", "it"), ("Bob", ["Bob"], "Carl", "Carl"), ("Bob saw it", [], "it", "it")], "t string, n array<string>, w string, want string")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", X.antecedent(F.col("t"), F.col("n"), F.col("w"))).collect())


def test_json_outputs(spark):
    raw = ['{"k": 1}', '```json\n{"k": 1}\n```', "```\n{\"k\": 1}```", "not json", None, ""]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in raw], "raw string").select(T.parse_json_output(F.col("raw"), "k int")["k"]).collect()]
    assert got == [1, 1, 1, None, None, None]


def test_snippets_rank_and_budget():
    texts = {0: "Acme and Bolt", 1: "Bolt", 2: "x" * 500 + " Acme Bolt " + "y" * 500, 3: "Acme"}
    index = {"acme": {0, 2, 3}, "bolt": {0, 1, 2}}
    got = list(X.snippets_of(texts, {0: ["Acme", "Bolt"]}, index))
    assert [j for _, j, _ in got] == [2, 1, 3]
    assert "Acme Bolt" in got[0][2] and len(got[0][2]) <= 350 + len("Chunk 3 excerpt: ")
    assert [j for _, j, _ in X.snippets_of(texts, {0: ["Acme", "Bolt"]}, index, budget=370)] == [2]
    assert list(X.snippets_of(texts, {0: []}, index)) == []


def test_normalize(spark):
    got = spark.createDataFrame([(" Dr.Elena   Vasquez ",), ("ACME",)], "n string").select(T.normalize_name(F.col("n"))).collect()
    assert [r[0] for r in got] == ["dr elena vasquez", "acme"]


def test_classifier(spark):
    cases = [("it causes fire", "A", "B", ["causes"]), ("met", "Person", "Person", ["related_to", "knows"]), ("met", "A", "B", ["related_to"]), (None, "Person", "Location", ["located_at", "visits"])]
    df = spark.createDataFrame([c[:3] for c in cases], "t string, a string, b string").withColumn("f", R.by_rules(F.col("t"), F.col("a"), F.col("b")))
    assert [[x["type"] for x in r["f"]] for r in df.collect()] == [c[3] for c in cases]
    best = df.select(R.classified(F.col("f")).alias("b")).collect()
    assert [[x["type"] for x in r["b"]] for r in best][1] == ["related_to", "knows"]
    assert len(R.TYPES) == 47 and len({t for t, _ in R.TYPES}) == 47


def test_similarity_column(spark):
    pairs = [("Apple Inc", " apple inc"), ("abcd", "bcde"), ("", ""), (None, "a"), ("x", "y")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r[0] for r in df.select(T.name_similarity("a", "b")).collect()]
    assert got == [1.0, SequenceMatcher(None, "abcd", "bcde").ratio(), 1.0, 0.0, 0.0]


def test_ids_of_any_size_and_type(spark):
    for kind, ids in (("long", (10**12, 9 * 10**18)), ("string", ("x", "y"))):
        docs = spark.createDataFrame([(i, "en", "s", "Anna meets Peter in Weimar. Peter thanks Anna.") for i in ids], f"doc_id {kind}, lang string, source string, text string")
        from graphloom.operators.chunking import token_chunks
        from graphloom.sources import textgraph as G

        m = G.mentions_and_next(token_chunks(docs))
        assert m.count() == 2 * m.where(F.col("doc_id") == ids[0]).count() > 0
        t = X.distinct_triples(G.triples_of(m), order=("doc_id", "idx"))
        assert {r["doc_id"] for r in t.collect()} == {min(ids)}


def test_output_in_all_forms(spark):
    forms = [('[{"k": 1}]', [1], None), ("```json\n[{\"k\": 2}]\n```", [2], None), ("[{'k': 3, 'x': None}]", [3], None), ("({'k': 4},)", [4], None), ('{"k": 5}', None, "not an array"), ("[{'k': 6", None, "not parsed"), ("", None, "no text"), (None, None, "no text"), ("__import__('os')", None, "not parsed"), ("[]", [], None)]
    df = spark.createDataFrame([(i, f[0]) for i, f in enumerate(forms)], "i int, raw string")
    got = {r["i"]: r["p"] for r in df.select("i", T.parsed_output(F.col("raw"), "array<struct<k: long>>").alias("p")).collect()}
    for i, (_, value, problem) in enumerate(forms):
        assert got[i]["problem"] == problem and (got[i]["value"] is None if value is None else [x["k"] for x in got[i]["value"]] == value)
    one = df.limit(1).select(T.parsed_output(F.lit('{"k": 5}'), "k long", "object").alias("p")).first()["p"]
    assert one["problem"] is None and one["value"]["k"] == 5


def test_look_back():
    assert T.look_back("Anna Berg met Tom. She smiled at him.", ["Anna Berg", "Tom"])["She"] == "Tom"
    far = "Acme grew. " + "word " * 30 + "until it closed."
    assert T.look_back(far, ["Acme"])["it"] == "Acme"  # 20 tokens back there is none, but the sentence before names it
    assert T.look_back("It rains. He left.", ["Acme"]) == {} and T.look_back(None, ["Acme"]) == {}
    assert T.look_back("Acme sold its plant.", ["Acme"]) == {"its": "Acme", "it": "Acme"}


class Odd:
    """A model that knows one word, and fails on another."""

    def classify(self, rows):
        if any("boom" in t for t, _, _ in rows):
            raise RuntimeError
        return [[("owns", 1.7), ("", 0.2)] if "owns" in t else [] for t, _, _ in rows]


def test_a_model_in_place_of_the_rules(spark):
    df = spark.createDataFrame([(1, "x owns y", "Person", "Person"), (2, "x y", "Person", "Person")], "id int, text string, src string, dst string")
    rules = {r["id"]: r["f"] for r in df.select("id", R.by_rules(F.col("text"), F.col("src"), F.col("dst")).alias("f")).collect()}
    got = {r["id"]: r["found"] for r in R.classified_by(df, Odd(), ["id"]).collect()}
    assert [tuple(x) for x in got[1]] == [("owns", 1.0)] and got[2] == rules[2]
    failed = R.classified_by(df.withColumn("text", F.concat("text", F.lit(" boom"))), Odd(), ["id"]).collect()
    assert all(r["found"] for r in failed)
