"""The queries that have no SQL, each against a plain Python version of it on the smallest tables."""

import json
import math
import os
import re
from collections import Counter, defaultdict
from difflib import SequenceMatcher

import numpy as np
import pyarrow.parquet as pq
import pytest

from graphloom.functions import text as T
from graphloom.operators import chunking as C
from graphloom.plans import catalog, cluster_queries, export_queries, extraction_queries, graph_queries, retrieval_queries, text_queries  # noqa: F401
from graphloom.plans.extraction_queries import SCHEMA_RELATIONS, SCHEMA_TYPES
from graphloom.sources import textgraph as G

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="needs the driver's tables")


def table(name):
    return pq.read_table(f"{D}/{name}.parquet").to_pylist()


def run(spark, name):
    return catalog.QUERIES[name](spark, D).collect()


def grouped(rows, *keys, order=None):
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: r[order]) if order else rows:
        out[tuple(r[k] for k in keys)].append(r)
    return out


@pytest.fixture(scope="module")
def chunks():
    """(doc_id, sequence_index) -> text, lang, mentions, by hand."""
    out = {}
    step = G.SIZE - int(G.SIZE * G.OVERLAP)
    for d in table("documents"):
        toks = re.findall(r"\s*\S+", d["text"])
        n = len(toks)
        for i in range(1 if n <= G.SIZE else 1 + math.ceil((n - G.SIZE) / step)):
            text = d["text"] if n <= G.SIZE else "".join(toks[i * step : i * step + G.SIZE])
            found = []
            for w in re.findall(r"\S+", text):
                m = re.match(G.NAME, w)
                if m:
                    found.append((m[1], next(t for p, t in G.TYPES if re.search(p, w))))
            out[d["doc_id"], i] = text, d["lang"], found
    return out


def graph():
    """Ids and edges of the star-schema tables: (edge_idx, source, target)."""
    ids = [f"{t}:{r[k]}" for t, k in (("customer", "c_custkey"), ("nation", "n_nationkey"), ("part", "p_partkey"), ("region", "r_regionkey"), ("supplier", "s_suppkey")) for r in table(t)]
    e = [(r["c_custkey"] * 10**9 + r["c_nationkey"], f"customer:{r['c_custkey']}", f"nation:{r['c_nationkey']}") for r in table("customer")]
    e += [(10**18 + r["s_suppkey"] * 10**9 + r["s_nationkey"], f"supplier:{r['s_suppkey']}", f"nation:{r['s_nationkey']}") for r in table("supplier")]
    e += [(2 * 10**18 + r["n_nationkey"] * 10**9 + r["n_regionkey"], f"nation:{r['n_nationkey']}", f"region:{r['n_regionkey']}") for r in table("nation")]
    e += [(3 * 10**18 + a * 10**9 + b, f"supplier:{a}", f"part:{b}") for a, b in sorted({(r["l_suppkey"], r["l_partkey"]) for r in table("lineitem")})]
    return ids, sorted(e)


def test_chunks_cover_their_texts(spark):
    texts = {d["doc_id"]: d["text"] for d in table("documents")}
    for name, size in (("c3_aligned_chunks", None), ("c5_sentence_chunks", 512), ("c2_bpe_chunks", 512)):
        got = grouped(run(spark, name), "doc_id", order="sequence_index")
        assert {k for (k,) in got} == {i for i, t in texts.items() if t.strip() or name != "c5_sentence_chunks"}
        count = (lambda x: len(C.BpeTokenizer().encode(x))) if name == "c2_bpe_chunks" else (lambda x: len(re.findall(r"\s*\S+", x)))
        for (i,), rows in got.items():
            assert [r["sequence_index"] for r in rows] == list(range(len(rows)))
            at = end = 0
            for r in rows:
                begin = texts[i].find(r["text"], at)
                assert begin >= 0 and not texts[i][end:begin].strip()  # nothing between two chunks is left out
                assert r["char_count"] == len(r["text"]) and (name == "c2_bpe_chunks" or r["token_count"] == count(r["text"]))
                assert size is None or r["token_count"] <= size or len(re.findall(r"[.!?]\s+", r["text"])) <= 1
                at, end = begin, max(end, begin + len(r["text"]))
            assert texts[i].rstrip().endswith(rows[-1]["text"].rstrip())


def test_samples(spark):
    texts = {d["doc_id"]: d["text"] for d in table("documents")}
    for r in run(spark, "c14_budget_sample"):
        t = texts[r["doc_id"]]
        parts = r["sample"].split(T.TRUNCATED)
        assert (len(t) <= 12_000 and parts == [t]) or (all(p in t for p in parts) and parts[0] == t[:1500] and parts[-1] == t[-1500:] and sum(map(len, parts)) <= 12_000)


def test_resolution(spark, chunks):
    from tests.test_extraction import spec_resolve

    names = defaultdict(dict)
    for (doc, _), (_, _, found) in sorted(chunks.items()):
        for n, t in found:
            names[doc, t].setdefault(n.lower(), n)
    want = {(d, t, n, c) for (d, t), x in names.items() for n, c in spec_resolve(list(dict.fromkeys(x.values())), 0.85).items()}
    assert {tuple(r[c] for c in ("doc_id", "type", "name", "canonical")) for r in run(spark, "x9_entity_resolution")} == want


def test_name_similarity(spark):
    got = run(spark, "x10_similarity")
    assert len(got) == len(table("part")) - 1
    for r in got:
        a, b = r["p_name"].lower().strip(), r["next_name"].lower().strip()
        assert r["ratio"] == pytest.approx(1.0 if a == b else SequenceMatcher(None, a, b).ratio())


def test_pronouns(spark, chunks):
    got = {(r["doc_id"], r["sequence_index"], r["pronoun"]): r["name"] for r in run(spark, "x13_pronoun_names")}
    for (doc, i), (text, _, found) in chunks.items():
        names = list(dict.fromkeys(n for n, _ in found))
        near = {k[2]: v for k, v in got.items() if k[:2] == (doc, i)}
        assert set(near.values()) <= set(names)
        pronouns = {w for w in re.findall(r"\w+", text) if w.lower() in {p for s in T.PRONOUN_SETS for p in s}}
        assert {p for p in near if p[0].isupper()} <= pronouns
    assert got


def closest(text, a, b):
    at = [[m.start() for m in re.finditer(rf"(?i)(?<!\w){re.escape(x)}(?!\w)", text)] for x in (a, b)]
    return min(((abs(p - q), p, q) for p in at[0] for q in at[1]), default=None)


def test_evidence_negation_and_years(spark, chunks):
    meta = {(r["doc_id"], r["sequence_index"], r["pos"]): r for r in run(spark, "x17_relation_metadata")}
    got = run(spark, "x14_evidence_windows")
    assert len(got) == len(meta) == sum(max(0, len(f) - 1) for _, _, f in chunks.values())
    for r in got:
        text, lang, found = chunks[r["doc_id"], r["sequence_index"]]
        assert (r["source"], r["target"]) == (found[r["pos"]][0], found[r["pos"] + 1][0])
        best = closest(text, r["source"], r["target"])
        middle = (best[1] + best[2]) // 2
        ends = [i for i, c in enumerate(text) if c in ".?!"]
        start, stop = max((i + 1 for i in ends if i < middle), default=0), min((i + 1 for i in ends if i >= middle), default=len(text))
        assert r["evidence"] == (text[start:stop].strip() or text[max(0, min(best[1:]) - 220) : max(best[1:]) + 220])
        m = meta[r["doc_id"], r["sequence_index"], r["pos"]]
        if lang != "en":
            assert m["is_negated"] is None and m["start_time"] is None
            continue
        w, stem = r["evidence"].lower(), r["relation"].split("_")[0]
        assert m["is_negated"] == (any(c in w for c in T.NEGATION_CUES) and len(stem) >= 4 and stem in w)
        years = re.findall(r"(?<!\w)((?:19|20)\d{2})(?!\w)", r["evidence"])
        assert (m["start_time"] is None) == (not years) and (not years or m["start_time"][:4] in years)


def test_snippets(spark, chunks):
    anchors = grouped(run(spark, "x19_anchors"), "doc_id", "sequence_index")
    got = run(spark, "x20_cross_chunk_snippets")
    assert got
    for (doc, i), rows in grouped(got, "doc_id", "sequence_index").items():
        assert len(rows) <= 3 and len({r["other"] for r in rows}) == len(rows) and sum(len(r["snippet"]) for r in rows) <= 1200
        own = [r["name"] for r in anchors[doc, i]]
        for r in rows:
            other = chunks[doc, r["other"]][0]
            excerpt = r["snippet"].removeprefix(f"Chunk {r['other'] + 1} excerpt: ")
            assert r["other"] != i and excerpt in other and any(re.search(rf"(?i)(?<!\w){re.escape(n)}(?!\w)", other) for n in own)


def test_extraction(spark, chunks):
    """Gated triples between resolved names: each goes back to two neighbouring mentions whose types the schema joins."""
    from tests.test_extraction import spec_resolve

    types, order = defaultdict(dict), defaultdict(dict)
    for (doc, _), (_, _, found) in sorted(chunks.items()):
        for n, t in found:
            if t in SCHEMA_TYPES:
                types[doc].setdefault(n, t)
            order[doc].setdefault(n, len(order[doc]))
    want = set()
    for doc in order:
        canonical = {}
        for t in SCHEMA_TYPES:
            canonical |= spec_resolve([n for n in sorted(order[doc], key=order[doc].get) if types[doc].get(n) == t], 0.85)
        for (d, _), (_, _, found) in chunks.items():
            if d == doc:
                for (a, _), (b, t) in zip(found, found[1:]):
                    rel = G.RELATION_OF[t]
                    if (rel, types[doc].get(a), types[doc].get(b)) in SCHEMA_RELATIONS:
                        x, y = canonical.get(a, a), canonical.get(b, b)
                        if x != y:
                            want.add((doc, x, rel, y))
    assert {tuple(r[c] for c in ("doc_id", "source", "relation", "target")) for r in run(spark, "x4_extract_typed")} == want and want


def test_mock_embeddings(spark):
    got = {r["id"]: r["embedding"] for r in run(spark, "g18_mock_embeddings")}
    assert set(got) == set(graph()[0]) and len({len(v) for v in got.values()}) == 1 and len({tuple(v) for v in got.values()}) == len(got)
    assert got == {r["id"]: r["embedding"] for r in run(spark, "g18_mock_embeddings")}


def quality(edges, part):
    m = len(edges)
    degree = Counter(x for e in edges for x in e)
    total = Counter()
    for x, d in degree.items():
        total[part[x]] += d
    return sum(part[a] == part[b] for a, b in edges) / m - sum((d / (2 * m)) ** 2 for d in total.values())


def test_communities(spark):
    ids, e = graph()
    pairs = [(a, b) for _, a, b in e]
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    by_nation = {}
    for a, b in pairs:
        if b.startswith("nation:"):
            by_nation[a] = b
    for x in near:
        by_nation.setdefault(x, x if x.startswith("nation:") else next((by_nation[y] for y in sorted(near[x]) if y in by_nation), x))
    for name in ("k4_louvain", "k5_leiden"):
        part = {r["node_id"]: r["community"] for r in run(spark, name)}
        assert set(part) == set(near)
        assert quality(pairs, part) >= quality(pairs, by_nation) - 0.02
        if name == "k5_leiden":  # each community hangs together
            for c in set(part.values()):
                members = {x for x, y in part.items() if y == c}
                todo = [next(iter(members))]
                seen = set(todo)
                while todo:
                    for y in near[todo.pop()] & members - seen:
                        seen.add(y)
                        todo.append(y)
                assert seen == members
    part = {r["node_id"]: r["community"] for r in run(spark, "k6_spectral")}
    assert set(part) == set(near) and len(set(part.values())) <= 5


def test_approximate_search(spark):
    v = table("embeddings")
    x = np.array([r["embedding"] for r in v], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.array([r["vec_id"] for r in v])
    got = defaultdict(set)
    for r in run(spark, "v4_ivf_search"):
        got[r["query_id"]].add(r["vec_id"])
    hits = []
    for q in ids[ids % 100 == 0]:
        s = x @ x[ids == q][0]
        s[ids == q] = -2
        hits.append(len(got[q] & set(ids[np.argsort(-s)[:5]].tolist())) / 5)
    assert len(got) == len(hits) and np.mean(hits) >= 0.9


def test_depth_first(spark):
    _, e = graph()
    near = defaultdict(list)
    for _, a, b in e:
        for x, y in ((a, b), (b, a)):
            if y not in near[x]:
                near[x].append(y)
    want, seen = [], set()

    def walk(x, depth):
        if x in seen or depth > 2 or len(want) >= 50:
            return
        seen.add(x)
        want.append((x, depth))
        for y in near[x]:
            walk(y, depth + 1)

    walk("nation:3", 0)
    assert [(r["id"], r["depth"]) for r in sorted(run(spark, "r5_dfs"), key=lambda r: r["position"])] == want


def test_json_rows(spark):
    rows = run(spark, "e2_json_rows")
    ids, e = graph()
    text = [json.loads(next(v for v in r if isinstance(v, str) and v.startswith("{"))) for r in rows]
    assert sum("source" in x for x in text) == len(e) and {x["id"] for x in text if "id" in x and "node_ids" not in x} >= set(ids)
