"""Queries over mentions and triples (X1-X23) and the relation classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import extraction as X
from graphloom.operators import relations as R
from graphloom.plans.catalog import query
from graphloom.sources.session import cut
from graphloom.sources.tables import table
from graphloom.sources.textgraph import MENTIONS, TRIPLES, chunks, found_names, mentions, mentions_and_next, relation_of, triples, triples_of




@query("x1_entities", f"WITH {MENTIONS} SELECT doc_id, sequence_index, pos, idx, name, type FROM mentions")
def x1_entities(s: SparkSession, d: str) -> DataFrame:
    return mentions(chunks(s, d))


@query("x1_triples", f"WITH {TRIPLES} SELECT doc_id, sequence_index, pos, idx, source, relation, target FROM triples")
def x1_triples(s: SparkSession, d: str) -> DataFrame:
    return triples(chunks(s, d))


@query("x3_parse_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def x3_parse_json(s: SparkSession, d: str) -> DataFrame:
    """Model output as it comes: JSON in a code fence."""
    raw = F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))
    return table(s, d, "events").select("event_id", T.parse_json_output(raw, "k long")["k"].alias("k"))


SCHEMA_TYPES = ("Person", "Location", "Concept", "Event")
SCHEMA_RELATIONS = (("works_with", "Person", "Person"), ("located_at", "Person", "Location"), ("located_at", "Concept", "Location"), ("influences", "Person", "Concept"), ("participated_in", "Person", "Event"), ("influences", "Event", "Concept"))
_SQL_TYPES = "(VALUES " + ", ".join(f"('{t}')" for t in SCHEMA_TYPES) + ") st(type)"
_SQL_RELATIONS = "(VALUES " + ", ".join(f"('{n}', '{a}', '{b}')" for n, a, b in SCHEMA_RELATIONS) + ") sr(relation, src, dst)"


def gate_schema(s: SparkSession) -> tuple[DataFrame, DataFrame]:
    return s.createDataFrame([(t,) for t in SCHEMA_TYPES], "type string"), s.createDataFrame(list(SCHEMA_RELATIONS), "name string, src string, dst string")


@query("x4_extract_typed")
def x4_extract_typed(s: SparkSession, d: str) -> DataFrame:
    """Documents to gated triples between resolved entities."""
    m = cut(mentions_and_next(chunks(s, d)))  # one pass over the texts
    types, relations = gate_schema(s)
    typed = X.first_types(m, types)
    kept = X.gate(triples_of(m), typed, relations)
    names = m.groupBy("doc_id", "name").agg(F.min("idx").alias("idx")).join(typed, ["doc_id", "name"])
    return X.map_relations(kept.select("doc_id", "idx", "source", "relation", "target"), X.resolve(names).select("doc_id", "name", "canonical"))


@query("x5_entity_dedup", f"WITH {MENTIONS} SELECT doc_id, type, min_by(name, idx) AS name, min(idx) AS idx FROM mentions GROUP BY doc_id, lower(name), type")
def x5_entity_dedup(s: SparkSession, d: str) -> DataFrame:
    return X.distinct_entities(mentions(chunks(s, d)), ("doc_id",))


@query("x6_context_sizes", f"""WITH {MENTIONS}, f AS (SELECT doc_id, min(sequence_index) AS i FROM mentions GROUP BY doc_id, lower(name)), n AS (SELECT doc_id, i, count(*) AS n FROM f GROUP BY ALL)
SELECT doc_id, sequence_index, CAST(COALESCE((SELECT sum(n.n) FROM n WHERE n.doc_id = c.doc_id AND n.i < c.sequence_index), 0) AS BIGINT) AS n_context FROM chunks c""")
def x6_context_sizes(s: SparkSession, d: str) -> DataFrame:
    c = chunks(s, d)
    return X.context_sizes(mentions(c), c)


@query("x7_distinct_triples", f"WITH {TRIPLES} SELECT source, relation, target, min({{'d': doc_id, 'i': idx}}).d AS doc_id, min({{'d': doc_id, 'i': idx}}).i AS idx FROM triples GROUP BY source, relation, target")
def x7_distinct_triples(s: SparkSession, d: str) -> DataFrame:
    return X.distinct_triples(triples(chunks(s, d)), order=("doc_id", "idx"))


@query("x8_schema_gate", f"""WITH {TRIPLES}, typed AS (SELECT doc_id, name, min_by(type, idx) AS type FROM mentions SEMI JOIN {_SQL_TYPES} USING (type) GROUP BY doc_id, name)
SELECT t.doc_id, t.idx, t.source, t.relation, t.target, a.type AS src, b.type AS dst FROM triples t JOIN typed a ON a.doc_id = t.doc_id AND a.name = t.source JOIN typed b ON b.doc_id = t.doc_id AND b.name = t.target
SEMI JOIN {_SQL_RELATIONS} ON sr.relation = t.relation AND sr.src = a.type AND sr.dst = b.type""")
def x8_schema_gate(s: SparkSession, d: str) -> DataFrame:
    m = cut(mentions_and_next(chunks(s, d)))
    types, relations = gate_schema(s)
    return X.gate(triples_of(m), X.first_types(m, types), relations).select("doc_id", "idx", "source", "relation", "target", "src", "dst")


@query("x9_entity_resolution")
def x9_entity_resolution(s: SparkSession, d: str) -> DataFrame:
    return X.resolve(X.distinct_entities(mentions(chunks(s, d)), ("doc_id",)))


@query("x10_normalize_names", "SELECT p_partkey, trim(regexp_replace(replace(lower(n), 'dr.', 'dr '), '\\s+', ' ', 'g')) AS normalized FROM (SELECT p_partkey, ' Dr.' || p_name || '   ' || p_brand AS n FROM part)")
def x10_normalize_names(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select("p_partkey", T.normalize_name(F.concat(F.lit(" Dr."), "p_name", F.lit("   "), "p_brand")).alias("normalized"))


@query("x10_similarity")
def x10_similarity(s: SparkSession, d: str) -> DataFrame:
    """Similarity of each part's name with the next part's."""
    p = table(s, d, "part").select("p_partkey", "p_name")
    after = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("next_name"))
    return p.join(after, "p_partkey").select("p_partkey", "p_name", "next_name", T.name_similarity("p_name", "next_name").alias("ratio"))


@query("x11_resolve_relations", f"""WITH {TRIPLES}, map AS (SELECT DISTINCT doc_id, name, first_value(name) OVER (PARTITION BY doc_id, lower(left(name, 4)) ORDER BY name) AS canonical FROM mentions),
m AS (SELECT t.doc_id, t.idx, t.relation, COALESCE(a.canonical, source) AS source, COALESCE(b.canonical, target) AS target FROM triples t LEFT JOIN map a ON a.doc_id = t.doc_id AND a.name = source LEFT JOIN map b ON b.doc_id = t.doc_id AND b.name = target)
SELECT doc_id, source, relation, target, min(idx) AS idx FROM m WHERE source <> target GROUP BY doc_id, source, relation, target""")
def x11_resolve_relations(s: SparkSession, d: str) -> DataFrame:
    """Names that begin alike are taken as one, under the least of them."""
    m = cut(mentions_and_next(chunks(s, d)))
    names = m.select("doc_id", "name").distinct()
    canonical = names.groupBy("doc_id", F.lower(F.left("name", F.lit(4))).alias("stem")).agg(F.min("name").alias("canonical"), F.collect_list("name").alias("names"))
    return X.map_relations(triples_of(m), canonical.select("doc_id", F.explode("names").alias("name"), "canonical"))


_PRONOUNS = "[" + ", ".join(f"'{p}'" for p in T.PRONOUNS) + "]"


@query("x12_coreference", f"""WITH {MENTIONS}, n AS (SELECT doc_id, sequence_index, list(name ORDER BY pos) AS names FROM mentions GROUP BY ALL),
p AS (SELECT doc_id, sequence_index, lower(text) AS low, names, unnest(list_distinct(list_filter(list_transform(regexp_extract_all(text, '\\S+'), lambda w: lower(w)), lambda w: list_contains({_PRONOUNS}, w)))) AS pronoun FROM chunks JOIN n USING (doc_id, sequence_index))
SELECT doc_id, sequence_index, pronoun, names[1] AS target, COALESCE(list_filter(names, lambda n: instr(low, lower(n)) > 0 AND instr(low, lower(n)) < instr(low, pronoun))[1], pronoun) AS source FROM p""")
def x12_coreference(s: SparkSession, d: str) -> DataFrame:
    """Each pronoun of a chunk, as the source of a relation to the chunk's first name."""
    names = F.transform(found_names(F.col("text")), lambda m: m["name"])
    words = F.transform(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)), F.lower)
    p = chunks(s, d).select("doc_id", "sequence_index", "text", names.alias("names"), F.array_distinct(F.filter(words, lambda w: w.isin(*T.PRONOUNS))).alias("pronouns")).where("size(names) > 0")
    p = p.select("doc_id", "sequence_index", "text", "names", F.explode("pronouns").alias("pronoun"))
    return p.select("doc_id", "sequence_index", "pronoun", F.get("names", F.lit(0)).alias("target"), X.antecedent(F.col("text"), F.col("names"), F.col("pronoun")).alias("source"))


@query("x13_pronoun_names")
def x13_pronoun_names(s: SparkSession, d: str) -> DataFrame:
    """The name that each pronoun of a chunk stands for by proximity."""
    c = named(chunks(s, d)).where("size(names) > 0").select("doc_id", "sequence_index", T.pronoun_names(F.col("text"), F.array_distinct("names")).alias("m"))
    return c.select("doc_id", "sequence_index", F.explode("m").alias("pronoun", "name"))


@query("x3_parse_output", "SELECT event_id, CASE WHEN event_id % 5 < 4 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k, CASE event_id % 5 WHEN 4 THEN 'not parsed' END AS problem FROM events")
def x3_parse_output(s: SparkSession, d: str) -> DataFrame:
    """Model output in its usual forms: bare, fenced, as a Python literal, with None in it, and cut short."""
    k = F.get_json_object("props", "$.k")
    forms = (F.concat(F.lit("["), "props", F.lit("]")), F.concat(F.lit("```json\n["), "props", F.lit("]\n```")), F.concat(F.lit("[{'k': "), k, F.lit(", 'x': None}]")), F.concat(F.lit("```\n({'k': "), k, F.lit(", 'y': True},)\n```")), F.concat(F.lit("[{'k': "), k))
    raw = F.element_at(F.array(*forms), (F.col("event_id") % 5 + 1).cast("int"))
    p = table(s, d, "events").select("event_id", T.parsed_output(raw, "array<struct<k: long>>").alias("p"))
    return p.select("event_id", F.get("p.value", F.lit(0))["k"].alias("k"), F.col("p.problem").alias("problem"))


def _windows(s: SparkSession, d: str) -> DataFrame:
    m = chunks(s, d).select("doc_id", "sequence_index", "lang", "text", found_names(F.col("text")).alias("m"))
    rest = F.greatest(F.size("m") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("m", 1, rest), F.slice("m", 2, rest), lambda a, b: F.struct(a["name"].alias("a"), b["name"].alias("b"), relation_of(b["type"]).alias("relation")))
    m = m.withColumn("pairs", pairs).withColumn("windows", X.evidence_windows("text", F.transform("pairs", lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b")))))
    return m.select("doc_id", "sequence_index", "lang", F.posexplode(F.arrays_zip("pairs", "windows")).alias("pos", "x")).select("doc_id", "sequence_index", "pos", "lang", F.col("x.pairs.a").alias("source"), F.col("x.pairs.relation").alias("relation"), F.col("x.pairs.b").alias("target"), F.col("x.windows").alias("evidence"))


@query("x14_evidence_windows")
def x14_evidence_windows(s: SparkSession, d: str) -> DataFrame:
    return _windows(s, d)


_WINDOW = "'The plant ' || CASE WHEN l_returnflag = 'R' THEN 'no longer ' WHEN l_returnflag = 'A' THEN 'never ' ELSE '' END || CASE WHEN l_linestatus = 'O' THEN 'produced' ELSE 'supplies' END || ' it in ' || year(l_shipdate) || CASE WHEN l_linenumber = 1 THEN ' until ' || (year(l_shipdate) - l_linenumber) ELSE '' END"


def _lines(s: SparkSession, d: str) -> DataFrame:
    year = F.year("l_shipdate")
    w = F.concat(
        F.lit("The plant "), F.when(F.col("l_returnflag") == "R", "no longer ").when(F.col("l_returnflag") == "A", "never ").otherwise(""), F.when(F.col("l_linestatus") == "O", "produced").otherwise("supplies"),
        F.lit(" it in "), year.cast("string"), F.when(F.col("l_linenumber") == 1, F.concat(F.lit(" until "), (year - F.col("l_linenumber")).cast("string"))).otherwise(""),
    )
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", w.alias("evidence"), F.when(F.col("l_quantity") > 25, "produces_part").otherwise("makes").alias("relation"))


@query("x15_negation", f"""WITH w AS (SELECT l_orderkey, l_linenumber, l_partkey, lower({_WINDOW}) AS w, CASE WHEN l_quantity > 25 THEN 'produces' ELSE 'makes' END AS stem FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, (contains(w, 'no longer') OR contains(w, 'never')) AND ((length(stem) >= 4 AND contains(w, stem)) OR ((contains(w, 'produc') OR contains(w, 'manufactur') OR contains(w, 'mak')) AND stem IN ('produces', 'makes'))) AS is_negated FROM w""")
def x15_negation(s: SparkSession, d: str) -> DataFrame:
    return _lines(s, d).select("l_orderkey", "l_linenumber", "l_partkey", T.negated(F.col("evidence"), F.col("relation")).alias("is_negated"))


@query("x16_year_span", """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber = 1 THEN (y - 1) || '-01-01' ELSE y || '-01-01' END AS start_time, CASE WHEN l_linenumber = 1 THEN y || '-12-31' END AS end_time
FROM (SELECT *, year(l_shipdate) AS y FROM lineitem)""")
def x16_year_span(s: SparkSession, d: str) -> DataFrame:
    span = T.year_span(F.col("evidence"))
    return _lines(s, d).select("l_orderkey", "l_linenumber", "l_partkey", span["start"].alias("start_time"), span["end"].alias("end_time"))


@query("x17_relation_metadata")
def x17_relation_metadata(s: SparkSession, d: str) -> DataFrame:
    return X.with_metadata(_windows(s, d)).drop("evidence")


@query("x18_inverted_index", f"WITH {MENTIONS} SELECT doc_id, lower(name) AS name, list(DISTINCT sequence_index ORDER BY sequence_index) AS chunks FROM mentions GROUP BY doc_id, lower(name)")
def x18_inverted_index(s: SparkSession, d: str) -> DataFrame:
    return X.inverted_index(mentions(chunks(s, d)))


def named(c: DataFrame) -> DataFrame:
    return c.withColumn("names", F.transform(found_names(F.col("text")), lambda m: m["name"]))


@query("x19_anchors", f"""WITH {MENTIONS}, n AS (SELECT DISTINCT doc_id, sequence_index, name FROM mentions), df AS (SELECT doc_id, name, count(*) AS df FROM n GROUP BY ALL),
w AS (SELECT doc_id, sequence_index, word, count(*) AS tf FROM (SELECT doc_id, sequence_index, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}_]+')) AS word FROM chunks) GROUP BY ALL),
s AS (SELECT n.doc_id, n.sequence_index, n.name, round(tf * (ln((n_chunks + 1) / (df + 1)) + 1) * (1 + least(length(n.name) / 20, 1) * 0.1), 9) AS score
  FROM n JOIN df USING (doc_id, name) JOIN w ON w.doc_id = n.doc_id AND w.sequence_index = n.sequence_index AND w.word = lower(n.name) JOIN chunks c ON c.doc_id = n.doc_id AND c.sequence_index = n.sequence_index
  WHERE lower(n.name) NOT IN ({", ".join(f"'{p}'" for p in T.PRONOUN_LIKE)}))
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id, sequence_index ORDER BY score DESC, lower(name)) AS INTEGER) AS rank FROM s) WHERE rank <= 8""")
def x19_anchors(s: SparkSession, d: str) -> DataFrame:
    return X.anchors(named(chunks(s, d)))


@query("x20_cross_chunk_snippets")
def x20_cross_chunk_snippets(s: SparkSession, d: str) -> DataFrame:
    c = chunks(s, d)
    m = mentions(c)
    return X.snippets(c, m, X.anchors(named(c)))


@query("x22_schema_from_output", "SELECT r_name, a.n_name AS src, b.n_name AS dst FROM region JOIN nation a ON a.n_regionkey = r_regionkey JOIN nation b ON a.n_nationkey = (b.n_nationkey - CASE WHEN b.n_nationkey % 2 = 0 THEN 5 ELSE 1 END + 25) % 25 WHERE b.n_regionkey = r_regionkey")
def x22_schema_from_output(s: SparkSession, d: str) -> DataFrame:
    """A schema as JSON text for each region, parsed again; relations to types that it doesn't declare are dropped."""
    n = table(s, d, "nation")
    after = n.select(F.pmod(F.col("n_nationkey") - F.when(F.col("n_nationkey") % 2 == 0, 5).otherwise(1), F.lit(25)).alias("n_nationkey"), F.col("n_name").alias("dst"))
    raw = n.join(after, "n_nationkey").groupBy("n_regionkey").agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("n_name").alias("name"))).alias("entity_types"), F.collect_list(F.struct(F.lit("next_to").alias("name"), F.col("n_name").alias("source"), F.col("dst").alias("target"))).alias("relations"))).alias("raw"))
    p = raw.withColumn("p", T.parse_json_output(F.concat(F.lit("```\n"), "raw", F.lit("\n```")), "entity_types array<struct<name:string>>, relations array<struct<name:string,source:string,target:string>>"))
    known = F.transform("p.entity_types", lambda e: e["name"])
    good = p.select("n_regionkey", F.explode(F.filter("p.relations", lambda r: F.array_contains(known, r["source"]) & F.array_contains(known, r["target"]))).alias("r"))
    return good.join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", F.col("r.source").alias("src"), F.col("r.target").alias("dst"))


@query("x23_cross_entity_ratio", "SELECT relations, other, other / relations AS ratio, CASE WHEN other / relations < 0.4 THEN 'poor' WHEN other / relations >= 0.6 THEN 'good' ELSE 'fair' END AS grade FROM (SELECT count(*) AS relations, CAST(sum(CASE WHEN p_type <> (SELECT arg_min(p_type, p_partkey) FROM part) THEN 1 ELSE 0 END) AS BIGINT) AS other FROM part)")
def x23_cross_entity_ratio(s: SparkSession, d: str) -> DataFrame:
    """Parts as relations that start at their type."""
    return X.cross_entity_ratio(table(s, d, "part").select(F.col("p_partkey").alias("idx"), F.col("p_type").alias("src")))


def _sql_items(items) -> str:  # noqa: ANN001
    return "[" + ", ".join(f"{{'type': '{t}', 'confidence': CAST({c} AS DOUBLE)}}" for t, c in items) + "]"


_RULES = ", ".join(f"CASE WHEN {' OR '.join(f'contains(low, {chr(39)}{p}{chr(39)})' for p in ps.split('|'))} THEN {{'type': '{t}', 'confidence': CAST({c} AS DOUBLE)}} END" for t, c, ps in R.RULES)
_FOUND = f"""turns AS (SELECT conv_id, turn, lower(text) AS low, CASE role WHEN 'user' THEN 'Person' ELSE 'Event' END AS src, 'Person' AS dst FROM conversations WHERE text IS NOT NULL),
hits AS (SELECT *, list_filter([{_RULES}], lambda x: x IS NOT NULL) AS h FROM turns),
found AS (SELECT conv_id, turn, src, dst, CASE WHEN len(h) > 0 THEN h """ + " ".join(f"WHEN src = '{a}' AND dst = '{b}' THEN {_sql_items(x)}" for (a, b), x in R.BY_TYPES.items()) + f" ELSE {_sql_items(R.FALLBACK)} END AS found FROM hits)"


def _found(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "conversations").where("text IS NOT NULL").select("conv_id", "turn", "text", F.when(F.col("role") == "user", "Person").otherwise("Event").alias("src"), F.lit("Person").alias("dst"))
    return t.select("conv_id", "turn", "src", "dst", R.by_rules(F.col("text"), F.col("src"), F.col("dst")).alias("found"))


@query("g7_rule_classifier", f"WITH {_FOUND} SELECT conv_id, turn, src, dst, CAST(i AS INTEGER) AS ordinal, found[i + 1].type AS type, found[i + 1].confidence AS confidence FROM (SELECT *, unnest(range(len(found))) AS i FROM found)")
def g7_rule_classifier(s: SparkSession, d: str) -> DataFrame:
    return _found(s, d).select("conv_id", "turn", "src", "dst", F.posexplode("found").alias("ordinal", "f")).select("conv_id", "turn", "src", "dst", "ordinal", "f.*")


_VALID = (("located_at", "Person", "Person"), ("influences_all", "Event", "Person"), ("child_of", "Event", "Person"))


@query("g8_schema_constraint", f"""WITH {_FOUND}, c AS (SELECT conv_id, turn, src, dst, CAST(i AS INTEGER) AS ordinal, found[i + 1].type AS type, found[i + 1].confidence AS confidence FROM (SELECT *, unnest(range(len(found))) AS i FROM found)),
v AS (SELECT src, dst, list(name) AS names FROM (VALUES {", ".join(str(v) for v in _VALID)}) t(name, src, dst) GROUP BY ALL),
w AS (SELECT c.*, names, CASE WHEN list_contains(names, type) THEN confidence WHEN len(list_filter(names, lambda n: contains(n, type) OR contains(type, n))) > 0 THEN confidence * 0.8 END AS w FROM c LEFT JOIN v USING (src, dst)),
x AS (SELECT *, max(w) OVER (PARTITION BY conv_id, turn) AS top FROM w)
SELECT conv_id, turn, src, dst, ordinal, type, COALESCE(w, confidence) AS confidence FROM x WHERE names IS NULL OR top IS NULL OR w IS NOT NULL""")
def g8_schema_constraint(s: SparkSession, d: str) -> DataFrame:
    c = _found(s, d).select("conv_id", "turn", "src", "dst", F.posexplode("found").alias("ordinal", "f")).select("conv_id", "turn", "src", "dst", "ordinal", "f.*")
    return R.constrained(c, s.createDataFrame(list(_VALID), "name string, src string, dst string"), ["conv_id", "turn"])


@query("g9_classify", f"""WITH {_FOUND}, b AS (SELECT conv_id, turn, CASE WHEN found[1].confidence >= 0.8 THEN found[1:3] ELSE list_transform(list_sort(list_transform(found, lambda x, i: {{'c': -x.confidence, 'i': i, 'type': x.type}}))[1:5], lambda x: {{'type': x.type, 'confidence': -x.c}}) END AS best FROM found)
SELECT conv_id, turn, CAST(i AS INTEGER) AS rank, best[i + 1].type AS type, best[i + 1].confidence AS confidence FROM (SELECT *, unnest(range(len(best))) AS i FROM b)""")
def g9_classify(s: SparkSession, d: str) -> DataFrame:
    return _found(s, d).select("conv_id", "turn", F.posexplode(R.classified(F.col("found"))).alias("rank", "f")).select("conv_id", "turn", "rank", "f.*")


@query("g11_relation_categories", f"WITH {TRIPLES}, dim AS (SELECT * FROM (VALUES {', '.join('(' + repr(t) + ', ' + (repr(c) if c else 'NULL') + ')' for t, c in R.TYPES)}) t(relation, category)) SELECT relation, category, count(*) AS n FROM triples LEFT JOIN dim USING (relation) GROUP BY ALL")
def g11_relation_categories(s: SparkSession, d: str) -> DataFrame:
    dim = R.relationship_types(s).withColumnRenamed("type", "relation")
    return triples(chunks(s, d)).groupBy("relation").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(dim), "relation", "left").select("relation", "category", "n")


