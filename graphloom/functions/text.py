"""Text expressions: native columns where Catalyst can express them, Arrow-backed functions elsewhere."""

from __future__ import annotations

import ast
import json
import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, MapType, StringType

#: Negation cues, found anywhere in a lower-cased window.
NEGATION_CUES = tuple("are not|can't|cannot|ceased to|did not|discontinue|discontinued|do not|does not|is not|never|no longer|stopped|was not|were not|won't".split("|"))
MAKING = ("manufactur", "mak", "produc")
MAKING_STEMS = ("make", "makes", "manufacture", "manufactures", "produce", "produced", "produces")
PRONOUNS = ("he", "her", "him", "it", "she", "them", "they")
#: What stands between the parts of a sample.
TRUNCATED = "[... truncated ...]".join(["\n" * 2] * 2)
#: What no anchor may be.
PRONOUN_LIKE = tuple(sorted({*PRONOUNS, *"bu her hers his its o ona onlar onların onu onun that their theirs this şu".split()}))


def tokens(text: Column) -> Column:
    """Lossless white-space tokens, each with the space before it."""
    return F.regexp_extract_all(text, F.lit(r"\s*\S+"), F.lit(0))


def normalize_name(name: Column) -> Column:
    """Lower case, "dr." as a word of its own, runs of space as one."""
    return F.trim(F.regexp_replace(F.replace(F.lower(name), F.lit("dr."), F.lit("dr ")), r"\s+", " "))


def normalize_query(text: Column) -> Column:
    """Lower case, trimmed, runs of space as one."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def negated(window: Column, relation: Column) -> Column:
    """A cue in the window, and the relation's stem there too (or a word of making, for relations of making)."""
    w = F.lower(F.coalesce(window, F.lit("")))
    stem = F.lower(F.substring_index(F.coalesce(relation, F.lit("")), "_", 1))
    cue = F.lit(False)
    for c in NEGATION_CUES:
        cue = cue | w.contains(c)
    making = F.lit(False)
    for m in MAKING:
        making = making | w.contains(m)
    return cue & (((F.length(stem) >= 4) & w.contains(stem)) | (making & stem.isin(*MAKING_STEMS)))


_Y = "((?:19|20)[0-9]{2})"
_YEAR = rf"(?:^|[^0-9A-Za-z_]){_Y}(?=$|[^0-9A-Za-z_])"
_RANGE = rf"(?i)(?:^|[^0-9A-Za-z_]){_Y}\s*(?:through|until|to|-)\s*{_Y}(?:$|[^0-9A-Za-z_])"


def year_span(window: Column) -> Column:
    """struct<start, end> of ISO dates: a range of years as it stands, else the least year with an open end; null without years."""
    years = F.regexp_extract_all(window, F.lit(_YEAR), F.lit(1))
    a, b = F.regexp_extract(window, _RANGE, 1), F.regexp_extract(window, _RANGE, 2)
    span = F.when(a != "", F.struct(F.concat(F.least(a, b), F.lit("-01-01")).alias("start"), F.concat(F.greatest(a, b), F.lit("-12-31")).alias("end")))
    return span.when(F.size(years) > 0, F.struct(F.concat(F.array_min(years), F.lit("-01-01")).alias("start"), F.lit(None).cast("string").alias("end")))


def _unfenced(raw: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(raw), r"^```[A-Za-z]*\s*", ""), r"\s*```$", "")


@F.pandas_udf(StringType())
def _literal_as_json(raw: pd.Series) -> pd.Series:
    """A Python literal (None, True, single quotes, tuples) as JSON; null for what is none. Nothing is executed."""

    def one(x: str | None) -> str | None:
        if x is None:
            return None
        try:
            return json.dumps(ast.literal_eval(x))
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            return None

    return pd.Series([one(x) for x in raw], index=raw.index, dtype=object)


def parse_json_output(raw: Column, schema: str) -> Column:
    """JSON with or without a code fence; text that isn't JSON gives null."""
    return F.from_json(_unfenced(raw), schema)


def parsed_output(raw: Column, schema: str, expected: str = "array") -> Column:
    """X3 in full: struct<value, problem>: JSON with or without a code fence, else a Python literal, of the expected shape.

    problem is null, "no text", "not parsed" or "not an array" ("not an object"); value is null where there is one. Only
    what isn't JSON is tried as a literal.
    """
    bare = _unfenced(raw)
    text = F.coalesce(F.get_json_object(bare, "$"), _literal_as_json(F.when(F.get_json_object(bare, "$").isNull(), bare)))
    first = F.substring(F.ltrim(text), 1, 1)
    problem = (
        F.when(raw.isNull() | (F.trim(raw) == ""), "no text").when(text.isNull(), "not parsed")
        .when(first != ("[" if expected == "array" else "{"), "not an array" if expected == "array" else "not an object")
    )
    return F.struct(F.when(problem.isNull(), F.from_json(text, schema)).alias("value"), problem.alias("problem"))


def schema_sample(text: Column) -> Column:
    """Whole texts to 8,000 characters; longer ones as two, three or four parts around truncation marks."""
    n, gap = F.length(text), F.lit(TRUNCATED)
    part = lambda at, size: F.substring(text, at + F.lit(1), F.lit(size))
    third, quarter = F.floor(n / 3).cast("int"), F.floor(n / 4).cast("int")
    return (
        F.when(n > 15_000, F.concat(part(F.lit(0), 3500), gap, part(quarter, 3500), gap, part(quarter * 2, 3500), gap, part(n - 3500, 3500)))
        .when(n > 12_000, F.concat(part(F.lit(0), 4000), gap, part(third, 4000), gap, part(n - 4000, 4000)))
        .when(n > 8_000, F.concat(part(F.lit(0), 4000), gap, part(n - 4000, 4000)))
        .otherwise(text)
    )


def ratio(a: str | None, b: str | None) -> float:
    """1 for names equal but for case and outer space, else the matching blocks' share of both."""
    x, y = (a or "").lower().strip(), (b or "").lower().strip()
    return 1.0 if x == y else SequenceMatcher(None, x, y).ratio()


@F.pandas_udf(DoubleType())
def name_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) for x, y in zip(a, b)], index=a.index)


def whole_word(term: str) -> re.Pattern[str]:
    not_before, not_after = r"(?<!\w)", r"(?!\w)"
    return re.compile(not_before + re.escape(term) + not_after, re.IGNORECASE)


def evidence(text: str | None, a: str | None, b: str | None, reach: int = 220) -> str:
    """The sentence around the closest pair of whole-word mentions of a and b, else a stretch around them, else nothing."""
    at = [[m.start() for m in whole_word(x).finditer(text or "")] if x else [] for x in (a, b)]
    if not all(at):
        return ""
    best, i, j = None, 0, 0
    while i < len(at[0]) and j < len(at[1]):  # both ascending: one pass finds the closest pair
        pair = (abs(at[0][i] - at[1][j]), at[0][i], at[1][j])
        best = pair if best is None or pair < best else best
        if at[0][i] < at[1][j]:
            i += 1
        else:
            j += 1
    _, p, q = best
    middle = (p + q) // 2
    start = max(text.rfind(c, 0, middle) for c in ".?!") + 1
    stops = [k for k in (text.find(c, middle) for c in ".?!") if k >= 0]
    sentence = text[start : min(stops) + 1 if stops else len(text)].strip()
    return sentence or text[max(0, min(p, q) - reach) : max(p, q) + reach]


@F.pandas_udf(StringType())
def evidence_window(text: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([evidence(*x) for x in zip(text, a, b)], index=text.index)


def cosine(a: Column, b: Column) -> Column:
    """In doubles; 0 where lengths differ or a norm is 0."""
    x, y = a.cast("array<double>"), b.cast("array<double>")
    add = lambda s, v: s + v
    dot = F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), add)
    norm = lambda v: F.sqrt(F.aggregate(F.transform(v, lambda p: p * p), F.lit(0.0), add))
    return F.when((F.size(x) != F.size(y)) | (norm(x) == 0) | (norm(y) == 0), 0.0).otherwise(dot / (norm(x) * norm(y)))


_SENTENCE_END = re.compile(r"(?<=[.!?])\s+")
_TOKEN = re.compile(r"\w+|[^\w\s]")
#: Pronouns that stand for one another.
PRONOUN_SETS = (("he", "him", "his"), ("she", "her", "hers"), ("it", "its"), ("they", "them", "their", "theirs"))
LOOK_BACK = 20


def look_back(text: str | None, names: list[str]) -> dict[str, str]:
    """Pronoun -> name by proximity, without a language model.

    A pronoun stands for the name of which a word lies in the nearest of the 20 tokens before it; failing that, for the first
    name with a word in the sentence before. Other forms of the pronoun in its sentence stand for the same, unless they
    stand for something already; where a pronoun occurs again, its last place counts.
    """
    words = [(n, n.lower().split()) for n in names if n and n.strip()]
    out: dict[str, str] = {}
    tokens: list[str] = []
    before = ""
    for sentence in _SENTENCE_END.split(text or ""):
        low = sentence.lower()
        for token in _TOKEN.findall(sentence):
            forms = next((f for f in PRONOUN_SETS if token.lower() in f), None)
            if forms:
                near = next((n for t in reversed(tokens[-LOOK_BACK:]) for n, ws in words if any(w in t for w in ws)), None)
                name = near or next((n for n, ws in words if any(w in before for w in ws)), None)
                if name:
                    out[token] = name
                    for f in forms:
                        if f in low:
                            out.setdefault(f, name)
            tokens.append(token.lower())
        before = low
    return out


@F.pandas_udf(MapType(StringType(), StringType()))
def pronoun_names(text: pd.Series, names: pd.Series) -> pd.Series:
    """X13 for each text with its names."""
    return pd.Series([look_back(t, list(n)) if n is not None else {} for t, n in zip(text, names)], index=text.index)
