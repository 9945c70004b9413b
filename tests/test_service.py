import json

import pytest

from graphloom.operators import schema as H
from graphloom.plans import service as S
from graphloom.sources import files

TEXT = "Winter met Foster in London. Then Foster saw Winter and Station near London."


def test_schema_checks():
    with pytest.raises(ValueError):
        H.Schema([H.EntityType("A"), H.EntityType("A")])
    with pytest.raises(ValueError):
        H.Schema([H.EntityType("A")], [H.Relation("r", "A", "B")])
    with pytest.raises(ValueError):
        H.Schema([H.EntityType("A")], [], {"g": []})
    s = H.Schema([H.EntityType("A", "an A", ["x"])], [H.Relation("r", "A", "A", "rr")], {"g": ["A"]})
    assert s.is_valid("r", "A", "A") and not s.is_valid("r", "A", "B")
    assert s.summary()["n_relations"] == 1 and s.legacy()["relations"][0]["source"] == "A" and "- r(A, A): rr" in s.prompt()


def test_schema_files(tmp_path):
    p = tmp_path / "s.json"
    with pytest.raises(FileNotFoundError):
        H.Schema.load(str(p))
    p.write_text("{")
    with pytest.raises(ValueError):
        H.Schema.load(str(p))
    p.write_text(json.dumps({"entities": [{"name": "A"}, {"name": "B"}], "relations": [{"name": "r", "source": "A", "target": "B"}]}))
    assert H.Schema.load(str(p)).is_valid("r", "A", "B")
    p.write_text(json.dumps({"entity_types": [{"name": "A"}], "relation_groups": [{"name": "g", "relations": [{"name": "r", "src": "A", "dst": "A"}]}]}))
    assert H.Schema.load(str(p)).relations[0].group == "g"


def test_class_schema(tmp_path):
    c = H.ClassSchema()
    c.add_class("Ship", "floats")
    c.add_property("Ship", H.Property("name", "its name", "Argo"))
    for bad in (lambda: c.add_class("Ship"), lambda: c.remove_class("Person"), lambda: c.add_property("Ship", H.Property("name")), lambda: c.remove_property("Ship", "x")):
        with pytest.raises(ValueError):
            bad()
    c.save(str(tmp_path / "d" / "c.json"))
    assert H.ClassSchema.load(str(tmp_path / "d" / "c.json")).to_dict() == c.to_dict()


@pytest.fixture
def service(spark):
    n = spark.createDataFrame([(0, "Ann", "Person"), (1, "Bob", "Person"), (2, "Acme", "Company"), (3, "Lone", None)], "node_idx long, id string, type string")
    e = spark.createDataFrame([(0, "Ann", "works_at", "Acme"), (1, "Bob", "works_at", "Acme"), (2, "Ann", "knows", "Bob")], "edge_idx long, source string, relationship_type string, target string")
    return S.GraphService(n, e)


def test_graph_service(service, tmp_path, spark):
    a = service.query("ann (works_at)")
    assert a["seeds"] == ["Ann"] and [x["edge_idx"] for x in a["edges"]] == [0] and a["entities"] == ["Acme", "Ann"]
    assert service.provenance(a["id"])[0].count() == 4
    assert len(service.query("zzz")["seeds"]) == 4
    with pytest.raises(ValueError):
        service.query("  ")
    assert {"kind": "total", "label": "edges", "n": 3} in service.stats()
    first = service.communities().first()["cluster_id"]
    assert service.community(first)["cluster_id"] == first
    with pytest.raises(KeyError):
        service.community("none")
    for shape in ("cytoscape", "vis", "d3"):
        n, e = service.visualization(shape)
        assert n.count() == 3 and e.count() == 3
    with pytest.raises(ValueError):
        service.visualization("magic")
    service.sync(str(tmp_path / "g"), True)
    assert spark.read.parquet(str(tmp_path / "g" / "edges")).count() == 3


def test_tools(spark):
    t = S.ToolServer(spark)
    call = lambda m, **p: t.handle({"id": 1, "method": m, "params": p})
    assert len(call("list_tools")["result"]) == 7
    assert call("define_schema", name="s", entities=["Person", "Location"], relations=[{"name": "located_at", "src": "Person", "dst": "Location"}])["result"]["n_relations"] == 1
    got = call("extract", text=TEXT, schema="s")["result"]
    assert ("Foster", "Person") in got["entities"]
    assert call("build_kg", name="g", entities=[["a", "X"], ["b", "Y"]], relations=[["a", "flies_to", "b"]])["result"] == {"nodes": 2, "edges": 1}
    edge = [r for r in call("export_kg", name="g", format="graphrag")["result"] if "source" in r][0]
    assert edge["relationship_type"] == "related_to" and edge["relationship_detail"].startswith("flies_to:")
    assert call("build_kg", name="g", entities=[["a", "X"]], relations=[["a", "r", "b"]])["error"]["code"] == -32602
    assert call("export_kg", name="g", format="xml")["error"]["code"] == -32602
    assert call("get_schema", name="none")["error"]["code"] == -32602 and call("fly")["error"]["code"] == -32601
    assert call("list_schemas")["result"] == ["s"] and call("get_kg", name="g")["result"]


def test_cli(tmp_path, capsys):
    (tmp_path / "t.txt").write_text(TEXT)
    (tmp_path / "s.json").write_text(json.dumps({"entities": ["Person", "Location"], "relations": [{"name": "located_at", "src": "Person", "dst": "Location"}]}))
    assert S.main([str(tmp_path / "t.txt"), "-s", str(tmp_path / "s.json"), "-o", str(tmp_path / "o" / "g.json")]) == 0
    assert {"id": "Foster", "type": "Person"} in json.loads((tmp_path / "o" / "g.json").read_text())["nodes"]


def test_throttle_and_config(monkeypatch):
    t, slept, clock = S.Throttle(2.0), [], iter([10.0, 10.5, 12.5])
    now = lambda: next(clock)
    assert t.wait(slept.append, now) == 0.0
    assert t.wait(slept.append, now) == 1.5 and slept == [1.5]
    monkeypatch.setenv("GRAPHLOOM_MODEL", "gemini-x")
    assert S.ModelConfig.from_env().model == "gemini/gemini-x" and S.ModelConfig.from_env().key_name() == "GEMINI_API_KEY"


def test_graph_files(spark, tmp_path, rows):
    p = tmp_path / "kg.json"
    p.write_text(json.dumps({"nodes": [{"id": "a", "type": "X"}], "edges": [{"source": "a", "target": "b", "relationship_type": "r"}], "clusters": [{"id": "c", "node_ids": ["a"]}]}))
    n, e, c = files.read_graph(spark, str(p))
    assert rows(n) == [("a", "X"), ("b", None)] and rows(e, "relationship_detail") == [("a r b",)] and c.count() == 1
    p.write_text("{}")
    assert [x.count() for x in files.read_graph(spark, str(p))] == [0, 0, 0]
    (tmp_path / "t.txt").write_text("one\ntwo")
    assert files.read_texts(spark, str(tmp_path / "t.txt")).first()["text"] == "one\ntwo"


def test_streaming(spark, tmp_path):
    from graphloom.streaming import ingest

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    docs = spark.createDataFrame([(1, "a b c", "en", "s", 5), (2, "d " * 300, "en", "s", 600)], ingest.SCHEMA)
    docs.write.parquet(src)
    for more in (False, True):
        if more:
            docs.where("doc_id = 1").withColumn("doc_id", docs["doc_id"] + 2).write.mode("append").parquet(src)
        ingest.write_chunks(ingest.read_documents(spark, src), out, str(tmp_path / "cp")).awaitTermination(60)
    assert sorted((r["doc_id"], r["sequence_index"]) for r in spark.read.parquet(out).collect()) == [(1, 0), (2, 0), (2, 1), (3, 0)]
    stream = spark.readStream.format("rate").load().selectExpr("timestamp", "'Winter came.' AS text")
    assert ingest.windowed_mentions(stream, "timestamp").isStreaming
