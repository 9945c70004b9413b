import re

from graphloom.operators import plugins as P
from graphloom.operators.schema import EntityType, Relation, Schema


class Capitals:
    """A model for tests: capitalised words are people; neighbours know each other."""

    def entities(self, text, instructions):
        assert "Person" in instructions
        return [(w, "Person") for w in re.findall(r"[A-Z]\w+", text)] + [("  ", "Person"), ("X", "Alien")]

    def relations(self, text, instructions, entities):
        names = [n for n, _ in entities]
        return [(a, "knows", b) for a, b in zip(names, names[1:])] + [("Nobody", "knows", names[0]), (names[0], "knows", names[0])]


SCHEMA = Schema([EntityType("Person")], [Relation("knows", "Person", "Person")])


def test_two_passes_and_accumulation(spark, rows):
    c = spark.createDataFrame([(1, 0, "Ann met Bob"), (1, 1, "then Carl came"), (2, 0, "Dora"), (3, 0, None), (4, 0, " ")], "doc_id long, sequence_index int, text string")
    e = P.extract_entities(c, Capitals(), SCHEMA)
    assert rows(e, "doc_id", "sequence_index", "name") == [(1, 0, "Ann"), (1, 0, "Bob"), (1, 1, "Carl"), (2, 0, "Dora")]
    both = rows(P.extract_triples(c, e, Capitals(), SCHEMA), "doc_id", "sequence_index", "source", "target")
    assert both == [(1, 0, "Ann", "Bob"), (1, 0, "Bob", "Carl"), (1, 1, "Ann", "Bob"), (1, 1, "Bob", "Carl")]
    growing = rows(P.extract_triples(c, e, Capitals(), SCHEMA, accumulate=True), "doc_id", "sequence_index", "source", "target")
    assert growing == [(1, 0, "Ann", "Bob"), (1, 1, "Ann", "Bob"), (1, 1, "Bob", "Carl")]
    assert P.extract_entities(c.limit(0), Capitals(), SCHEMA).count() == 0
