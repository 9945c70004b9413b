"""The extraction schema: declared types and relations as dimension tables, their checks, and class generation."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class EntityType:
    name: str
    description: str = ""
    examples: list[str] = field(default_factory=list)
    properties: dict[str, str] = field(default_factory=dict)


@dataclass
class Relation:
    name: str
    src: str
    dst: str
    description: str = ""
    detail: str = ""
    group: str | None = None


@dataclass
class Schema:
    """Entity types and relations, with groups of types; raises ValueError where it contradicts itself (H1)."""

    entity_types: list[EntityType]
    relations: list[Relation] = field(default_factory=list)
    entity_groups: dict[str, list[str]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        names = [t.name for t in self.entity_types]
        if any(not n.strip() for n in names) or len(set(names)) < len(names):
            raise ValueError("entity types need names of their own")
        for r in self.relations:
            if not r.name.strip() or not {r.src, r.dst} <= set(names):
                raise ValueError(f"the relation {r.name!r} has no name or an endpoint that isn't declared")
        for g, members in self.entity_groups.items():
            if not members or not set(members) <= set(names):
                raise ValueError(f"the group {g!r} is empty or has members that aren't declared")

    @classmethod
    def load(cls, path: str) -> Schema:
        """From a file of either form."""
        from graphloom.sources.files import read_schema

        raw = read_schema(path)
        return cls([EntityType(**t) for t in raw["entity_types"]], [Relation(**r) for r in raw["relations"]])

    def summary(self) -> dict:
        """H5"""
        groups: dict = {}
        for r in self.relations:
            groups.setdefault(r.group, []).append(f"{r.src} -{r.name}-> {r.dst}")
        return {"entity_types": [asdict(t) for t in self.entity_types], "relation_groups": groups, "entity_groups": self.entity_groups, "n_relations": len(self.relations)}

    def legacy(self) -> dict:
        """H4"""
        return {"entities": [{"name": t.name} for t in self.entity_types], "relations": [dict(zip(("name", "source", "target"), (r.name, r.src, r.dst))) for r in self.relations]}

    def is_valid(self, name: str, src: str, dst: str) -> bool:
        """H2"""
        return any((r.name, r.src, r.dst) == (name, src, dst) for r in self.relations)

    def tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        types = [(t.name, t.description, t.examples, t.properties) for t in self.entity_types]
        relations = [(i, r.group, r.name, r.src, r.dst, r.description, r.detail) for i, r in enumerate(self.relations)]
        return spark.createDataFrame(types, "type string, description string, examples array<string>, properties map<string,string>"), spark.createDataFrame(relations, "idx int, group string, name string, src string, dst string, description string, detail string")

    def prompt(self) -> str:
        """The schema as instructions for a model."""
        types = "\n".join(f"- {t.name}: {t.description}" + (f" (such as {', '.join(t.examples)})" if t.examples else "") for t in self.entity_types)
        relations = "\n".join(f"- {r.name}({r.src}, {r.dst})" + (f": {r.description}" if r.description else "") for r in self.relations)
        return f"Entity types:\n{types}\nRelations:\n{relations}\nAnswer with JSON: entities as [name, type], relations as [source, relation, target]."


#: X24
DEFAULT = Schema([EntityType("Person"), EntityType("Location"), EntityType("Event")], [Relation("related_to", "Person", "Person"), Relation("located_in", "Person", "Location"), Relation("participated_in", "Person", "Event")])
CLI_DEFAULT = Schema([EntityType("Company"), EntityType("Product")], [Relation("produces", *("Company Product".split()))])


def violations(types: DataFrame, relations: DataFrame, groups: DataFrame) -> DataFrame:
    """H1 over tables: (item, problem) of types (type), relations (name, src, dst) and groups (group, member)."""
    blank = types.where("type IS NULL OR trim(type) = ''").select(F.lit("").alias("item"), F.lit("blank type").alias("problem"))
    twice = types.groupBy("type").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("type").alias("item"), F.lit("repeated type").alias("problem"))
    known = types.select("type").distinct()
    ends = relations.select("name", F.explode(F.array("src", "dst")).alias("type")).join(known, "type", "left_anti").select(F.concat_ws(":", "name", "type").alias("item"), F.lit("unknown endpoint").alias("problem")).distinct()
    members = groups.withColumnRenamed("member", "type").join(known, "type", "left_anti").select(F.concat_ws(":", "group", "type").alias("item"), F.lit("unknown member").alias("problem"))
    return blank.unionByName(twice).unionByName(ends).unionByName(members)


def relations_of(relations: DataFrame) -> DataFrame:
    """H3: (type, role, name, other), a relation once for each end; a self-typed one twice."""
    a = relations.select(F.col("src").alias("type"), F.lit("src").alias("role"), "name", F.col("dst").alias("other"))
    return a.unionByName(relations.select(F.col("dst").alias("type"), F.lit("dst").alias("role"), "name", F.col("src").alias("other")))


def valid_triples(triples: DataFrame, relations: DataFrame) -> DataFrame:
    """H2 over a table (relation, src, dst)."""
    return triples.join(F.broadcast(relations.select(F.col("name").alias("relation"), "src", "dst").distinct()), ["relation", "src", "dst"], "left_semi")


@dataclass
class Property:
    name: str
    description: str = ""
    example_value: object = None


class ClassSchema:
    """Entity classes with properties, whatever the data set; default classes can't be removed."""

    DEFAULTS = ("Person", "Organization", "Location", "Event")

    def __init__(self) -> None:
        self.classes: dict[str, dict[str, Property]] = {n: {} for n in self.DEFAULTS}
        self.descriptions: dict[str, str] = {}

    def add_class(self, name: str, description: str = "") -> None:
        if not name or name in self.classes:
            raise ValueError(f"the class {name!r} exists or has no name")
        self.classes[name], self.descriptions[name] = {}, description

    def remove_class(self, name: str) -> None:
        if name in self.DEFAULTS or name not in self.classes:
            raise ValueError(f"the class {name!r} is protected or unknown")
        del self.classes[name]

    def add_property(self, cls: str, prop: Property) -> None:
        if cls not in self.classes or prop.name in self.classes[cls]:
            raise ValueError(f"unknown class or repeated property: {cls}.{prop.name}")
        self.classes[cls][prop.name] = prop

    def remove_property(self, cls: str, name: str) -> None:
        if name not in self.classes.get(cls, {}):
            raise ValueError(f"unknown property: {cls}.{name}")
        del self.classes[cls][name]

    def to_dict(self) -> dict:
        return {"classes": [{"name": c, "description": self.descriptions.get(c, ""), "properties": [asdict(p) for p in ps.values()]} for c, ps in self.classes.items()]}

    def save(self, path: str) -> None:
        """JSON, or YAML where the name says so and PyYAML is there."""
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        if path.endswith((".yaml", ".yml")):
            import yaml

            Path(path).write_text(yaml.safe_dump(self.to_dict(), allow_unicode=True), encoding="utf-8")
        else:
            Path(path).write_text(json.dumps(self.to_dict(), ensure_ascii=False, indent=2), encoding="utf-8")

    @classmethod
    def load(cls, path: str) -> ClassSchema:
        text = Path(path).read_text(encoding="utf-8")
        if path.endswith((".yaml", ".yml")):
            import yaml

            raw = yaml.safe_load(text)
        else:
            raw = json.loads(text)
        out = cls()
        for c in raw["classes"]:
            if c["name"] not in out.classes:
                out.add_class(c["name"], c.get("description", ""))
            for p in c.get("properties", []):
                out.add_property(c["name"], Property(**p))
        return out
