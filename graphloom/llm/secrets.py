"""Operator 8, secret scans: assignment-aware lexing of source and configuration syntax.

A text is lexed into assignments: a target name (identifiers, dotted and indexed names, quoted keys, command-line
flags), an operator (=, :=, =>, :) and a right-hand side of string literals, bare values and names joined by + or `.`.
Constants are propagated in order of appearance: a name on a right-hand side stands for the literal it was last given,
so a secret that is put together from parts, or handed on under another name, is scored under its sensitive target; the
literals that it came from, and literals of the same value elsewhere, are reported, each by its own bounds, and redacted
as well. Where a bare value is itself a
target, as in `env: KEY=x` or `a = b = "x"`, the value at the end of the chain counts for every name of it. A
finding's score is the product of how sensitive the target's words are and how much its value looks like a credential
(length, variety and mixture of characters; placeholders and plain words score low). A literal that begins with a
published credential prefix names its own target, so it is scored under that name wherever it stands, in prose too.
String literals may have a prefix (f, r, b, u) and triple quotes; in f-strings, names in braces stand for their literals.
Other syntax that pairs a name with a literal is read as well: XML elements, entries with a name and a value, calls with
one literal (under the function's name) or with a name and a literal, YAML block scalars, private keys in PEM blocks and
passwords in URLs. Findings that overlap are one, under the better score.

Results, case by case: a null or empty text has no findings; a null doc_id is carried as null; repeated rows are scanned
each for itself; ties cannot arise (findings do not overlap); long texts are lexed whole, in one pass; extra columns are
ignored by the scan and kept by the redaction; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.session import documents
from graphloom.llm.text import string_buffers

MIN_SCORE = 0.5

_QUOTED = r"""[fFrRbBuU]{0,2}(?:\"{3}(?:[^"\\]|\\[\s\S]|"(?!""))*+\"{3}|'{3}(?:[^'\\]|\\[\s\S]|'(?!''))*+'{3}|"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+')"""
_ATOM = rf"""(?:{_QUOTED}|`[^`\n]*`|[^\s"'`,;|()\[\]{{}}<>+]+)"""
_HEAD = (
    r"""(?P<name>(?:"[A-Za-z_$][\w$.\- ]*+"|'[A-Za-z_$][\w$.\- ]*+'|(?<![\w$.\-])(?:[.\-]|[^\W_A-Za-z][\w$]*+)*+[A-Za-z_$][\w$.\-]*+)(?:\[\s*["'][^"'\n]+["']\s*\])?)"""
    r"""[ \t]*(?P<op>:=|=>|(?<![=!<>])=(?![=~])|:(?![:/=]))[ \t]*"""
)
_VALUE = rf"""(?P<value>{_ATOM}(?:[ \t]*(?:\+|\.(?=[ \t]*["'])|\\\n)[ \t]*{_ATOM})*)"""
ASSIGN = re.compile(_HEAD + _VALUE)
HEAD = re.compile(_HEAD)
_LEAD = re.compile(r"^(?:[.\-]|[^\W_A-Za-z][\w$]*+)*+")  # what stands before a bare name: it begins where its run of characters does, so that long ones are read once
VALUE = re.compile(_VALUE)
_PART = re.compile(_ATOM)
_WORD = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|\d+")

#: Literals that name their own target.
NAMED = re.compile(
    r"(?<![A-Za-z0-9_/+])(?:(?P<aws_access_key>(?:AKIA|ASIA)[0-9A-Z]{16})|(?P<github_token>gh[opsur]_[A-Za-z0-9]{36,255})"
    r"|(?P<slack_token>xox[abprs]-[A-Za-z0-9-]{10,200})|(?P<secret_key>sk-[A-Za-z0-9_-]{32,200}))(?![A-Za-z0-9_/+])"
)
_REFERENCE = re.compile(r"[A-Za-z]+(?:[_.][a-z]+)+")  # a bare value that names another thing, such as settings.db_password

_HINT = r"""AKIA|ASIA|gh[opsur]_|xox[abprs]-|sk-|</|\(\s*[fFrRbBuU]{0,2}["']|-----BEGIN"""

#: Other syntax that pairs a name with a literal.
ELEMENT = re.compile(r"<(?P<name>[A-Za-z_][\w.:\-]*+)(?:\s[^<>]*+)?>(?:<!\[CDATA\[)?\s*(?P<value>[^<>]*[^<>\s\]])\s*(?:\]\]>)?\s*</(?P=name)\s*>")
ENTRY = re.compile(rf"""\b(?:name|key)["']?\s*[:=]\s*["']?(?P<name>[\w.\-]++)["']?\s*,?\s*["']?value["']?\s*[:=]\s*(?P<value>{_QUOTED}|[^\s"'<>,;{{}}]+)""")
CALL = re.compile(rf"""(?<![\w$.\-])(?P<name>[A-Za-z_$][\w$.\-]*+)\(\s*(?P<value>{_QUOTED})\s*\)""")
COUPLE = re.compile(rf"""\(\s*["'](?P<name>[\w.\- ]++)["']\s*,\s*(?P<value>{_QUOTED})\s*\)""")
BLOCK = re.compile(r"""^(?P<indent>[ \t]*+)(?:-[ \t]+)?(?P<name>[\w.\-"']++)[ \t]*:[ \t]*[|>][+\-\d]*[ \t]*\n(?P<value>(?:(?P=indent)[ \t]+\S[^\n]*(?:\n|\Z)|[ \t]*\n)+)""", re.M)
URL = re.compile(r"""://[^\s:/@"'<>]*+:(?P<value>[^\s/@"'<>]++)@""")
PEM = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY[A-Z0-9 ]*-----")
_PEM_BODY = re.compile(r"(?:\\[rn]|[\sA-Za-z0-9+/=])*+")

#: How sensitive a target is, by the words of its name, the most telling first.
SENSITIVE = (
    (1.0, ("password", "passwd", "passphrase", "pwd", "secret", "apikey", "accesskey", "privatekey", "secretkey", "authtoken", "accesstoken")),
    (0.95, ("api key", "access key", "private key", "secret key", "signing key", "encryption key", "auth key", "account key", "client secret", "connection string", "pass")),
    (0.9, ("token", "credential", "credentials", "bearer", "authorization", "auth")),
    (0.55, ("key", "salt", "signature", "dsn", "cookie", "session")),
)
#: Words that turn a sensitive name into an ordinary one.
ORDINARY = frozenset("count max min limit length len size type name id public expiry expires ttl url uri path file field label hint policy regex pattern index num number per budget usage".split())
_PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|-+|_+|<.*>|\$\{?.*\}?|%.*%|\{\{.*\}\}|(?:your|example|sample|dummy)(?:[a-z_\-. ]*|[_\-. ]?\d{1,4})|my.?(?:password|secret|token|key)|changeme|change.me|placeholder|redacted.*|\[redacted.*|todo|none|null|nil|true|false|undefined|password|secret|token|test|string|0+|1234\d*)$")


def sensitivity(name: str) -> float:
    words = [x.lower() for x in _WORD.findall(name)]
    if not words:
        return 0.0
    padded, joined = f" {' '.join(words)} ", "".join(words)
    score = 0.0
    for value, names in SENSITIVE:
        if any(f" {x} " in padded or (" " not in x and len(x) > 5 and x in joined) for x in names):
            score = value
            break
    return score * 0.3 if score and (words[-1] in ORDINARY or words[0] in ("max", "min", "num", "public", "is", "has")) else score


def plausibility(value: str) -> float:
    """How much a literal looks like a credential."""
    n = len(value)
    if n < 6 or _PLACEHOLDER.match(value) or " " in value.strip() and n < 40:
        return 0.0
    bits = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    kinds = sum(bool(re.search(k, value)) for k in (r"[a-z]", r"[A-Z]", r"\d", r"[^\w\s]"))
    if value.isalpha() and (value.islower() or value.istitle()):
        return 0.2
    return min(1.0, 0.25 + 0.2 * min(bits, 3.5) / 3.5 + 0.15 * min(n, 20) / 20 + 0.15 * min(kinds, 3) + (0.15 if n >= 16 and bits > 3 else 0.0))


_IS_QUOTED = re.compile(r"""([fFrRbBuU]{0,2})(\"{3}|'{3}|"|'|`)(?s:(.*))\2$""")


def is_quoted(atom: str) -> bool:
    return bool(_IS_QUOTED.match(atom))


def literal(atom: str, known: dict | None = None) -> str:
    """What a literal stands for; in an f-string, names in braces stand for what is known of them."""
    m = _IS_QUOTED.match(atom)
    if not m:
        return atom
    text = m[3] if "r" in m[1].lower() else re.sub(r"\\([\s\S])", r"\1", m[3])
    return re.sub(r"\{(\w+)\}", lambda x: known[x[1]][0] if x[1] in known else x[0], text) if known and "f" in m[1].lower() else text


def others(text: str, min_score: float) -> Iterator[tuple[int, int, str, float, str, tuple]]:
    """Findings in syntax other than assignments."""

    def rated(start: int, end: int, name: str, value: str) -> Iterator[tuple[int, int, str, float, str, tuple]]:
        if (much := sensitivity(name)) >= min_score and (score := much * plausibility(value)) >= min_score:
            yield start, end, name, round(score, 6), value, ()

    for pattern in (ELEMENT, ENTRY, CALL, COUPLE):
        for m in pattern.finditer(text):
            yield from rated(m.start("value"), m.end("value"), m["name"].strip(), literal(m["value"]))
    for m in BLOCK.finditer(text):
        raw = m["value"]
        yield from rated(m.start("value") + len(raw) - len(raw.lstrip()), m.start("value") + len(raw.rstrip()), m["name"].strip("\"'"), "".join(map(str.strip, raw.split("\n"))))
    for m in URL.finditer(text):
        yield from rated(m.start("value"), m.end("value"), "url_password", m["value"])
    stop, closed = 0, True
    for m in PEM.finditer(text):
        if m.start() < stop:
            continue
        end = text.find("-----END ", m.end()) if closed else -1
        closed = end >= 0
        body = _PEM_BODY.match(text, m.end()).end()
        tail = text.find("-----", end + 9) if closed else -1
        stop = tail + 5 if tail >= 0 and tail - end < 80 else body
        yield from rated(m.start(), stop, "private_key", text[m.end() : stop])


def joined(found: list[tuple]) -> list[tuple]:
    """Findings in order, those that overlap as one under the better score."""
    out: list[tuple] = []
    for f in sorted(found, key=lambda f: (f[0], -f[1])):
        if out and f[0] < out[-1][1]:
            had = out[-1]
            best = f if f[3] > had[3] else had
            out[-1] = (had[0], max(had[1], f[1]), *best[2:5], *(tuple(dict.fromkeys(had[5] + f[5])) for _ in had[5:]))
        else:
            out.append(f)
    return out


def scan(text: str, min_score: float = MIN_SCORE) -> list[tuple[int, int, str, float, str, tuple[tuple[int, int], ...]]]:
    """(start, end, name, score, value, sources) of each finding; start and end bound the right-hand side that holds the
    value, and sources the literals elsewhere that it was propagated from, each once."""
    found, known, spent, seen = [], {}, set(), defaultdict(list)

    def target(m: re.Match) -> str:
        name = _LEAD.sub("", m["name"]).strip("-")
        index = re.search(r"\[\s*[\"']([^\"']+)[\"']\s*\]$", name)
        return index[1] if index else name.strip("\"'")

    def score(heads: list[re.Match], m: re.Match) -> tuple[tuple | None, list[tuple[int, int]]]:
        """The finding of the first head that has one for the value m, and the spans of its literals."""
        raw, at = m["value"], m.start("value")
        bare = not any(q in raw for q in " \t\"'`")  # a + inside a bare value belongs to it
        parts = [(raw, at)] if bare else [(p.group(), at + p.start()) for p in _PART.finditer(raw)]
        resolved, via, spans = [], False, []
        for p, start in parts:
            if not is_quoted(p) and p.rstrip(".") in known:
                literals, sources = known[p.rstrip(".")]
                resolved.append(literals)
                spans += sources
                via = True
            else:
                resolved.append(literal(p, known))
                if is_quoted(p):
                    spans.append((start, start + len(p)))
                    seen[resolved[-1]].append(spans[-1])
                    if p[:2].lower().startswith(("f", "rf")):
                        spans += [x for n in re.findall(r"\{(\w+)\}", p) if n in known for x in known[n][1]]
        value = "".join(resolved)
        spans = list(dict.fromkeys(spans))
        quoted = any(is_quoted(p) for p, _ in parts)
        finding, likely = None, None
        for head in heads:
            name = target(head)
            if finding is None and (much := sensitivity(name)):
                if head["op"] == ":" and not quoted and not via:
                    much *= 0.8
                if likely is None:
                    likely = 0.0 if bare and not via and _REFERENCE.fullmatch(value) else plausibility(value)
                if much * likely >= min_score:
                    finding = at, m.end("value"), name, round(much * likely, 6), value
            if quoted or via:
                known[name] = value, spans
        return finding, spans

    pos = 0
    while m := ASSIGN.search(text, pos):
        heads, at = [m], m.start("value")
        while text[at] not in "\"'`" and (head := HEAD.match(text, at)):
            heads.append(head)
            at = head.end()
            if at == len(text):
                break
        pos = max(m.end(), at)
        finding, spans = score([m], m)
        if len(heads) > 1 and (last := VALUE.match(text, at)):
            inner, their = score(heads[::-1], last)
            if inner and (not finding or inner[1] > finding[1]):  # else it lies within the outer one
                finding, spans = inner, their
            pos = max(pos, last.end())
        if finding:
            found.append((*finding, tuple(x for x in spans if x not in spent and not finding[0] <= x[0] < finding[1])))
            spent.update(spans)
    taken = sorted(x for a, b, *_, sources in found for x in ((a, b), *sources))
    for m in NAMED.finditer(text):
        k = bisect.bisect_right(taken, (m.end(), 0)) - 1
        if k < 0 or taken[k][1] <= m.start():
            score = sensitivity(m.lastgroup) * plausibility(m[0])
            if score >= min_score:
                found.append((m.start(), m.end(), m.lastgroup, round(score, 6), m[0], ()))
    found += [f for f in others(text, min_score) if (k := bisect.bisect_right(taken, (f[0], math.inf)) - 1) < 0 or taken[k][1] < f[1]]
    again = [(*x, *f[2:5], ()) for f in {f[4]: f for f in found}.values() for x in seen[f[4]] if (k := bisect.bisect_right(taken, (x[0], math.inf)) - 1) < 0 or taken[k][1] < x[1]]
    found = joined(found)
    starts = [f[0] for f in found]
    for a in sorted(set(again)):  # the same value, given to other names as well
        k = bisect.bisect_right(starts, a[0]) - 1
        if k < 0 or found[k][1] < a[1]:
            near = max(k, 0)
            found[near] = (*found[near][:5], tuple(dict.fromkeys((*found[near][5], a[:2]))))
    return found


def bounds(text: str, min_score: float = MIN_SCORE) -> list[tuple[int, int, str, float, str]]:
    """(start, end, name, score, value) of each finding and of each of its sources, in order; none overlap."""
    return joined([(a, b, *x) for start, end, *x, sources in scan(text, min_score) for a, b in ((start, end), *sources)])


def candidates(col: pa.Array) -> np.ndarray:
    """Rows that hold an assignment operator, a credential prefix or the beginning of other syntax at all."""
    data, offsets = string_buffers(col)
    c = np.concatenate([[0], np.cumsum((data == 61) | (data == 58))])
    named = pc.fill_null(pc.match_substring_regex(col, _HINT), False) if len(col) else pa.array([], pa.bool_())
    return np.flatnonzero((c[offsets[1:]] > c[offsets[:-1]]) | np.asarray(named))


def find_secrets(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """(doc_id, start, end, name, score, secret_sha256): code-point bounds in the text; the secret itself is not given."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = candidates(batch.column("text"))
            out = [(r, *f) for r, t in zip(rows.tolist(), batch.column("text").take(pa.array(rows)).to_pylist()) for f in bounds(t, min_score)]
            if out:
                r, start, end, name, score, value = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(r, pa.int64())), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(name), pa.array(score), pa.array([hashlib.sha256(v.encode()).hexdigest() for v in value])],
                    names=["doc_id", "start", "end", "name", "score", "secret_sha256"],
                )

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {id_type}, start int, end int, name string, score double, secret_sha256 string")


def redact(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """docs, all columns, with each finding's value replaced by "[REDACTED]"; n_chars, if there is one, follows."""

    @F.pandas_udf("string")
    def without(text: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in text:
            out = part.copy()
            for i in candidates(pa.array(part, pa.string(), from_pandas=True)).tolist():
                t = part.iloc[i]
                for start, end, *_ in reversed(bounds(t, min_score)):
                    t = t[:start] + '"[REDACTED]"' + t[end:]
                out.iloc[i] = t
            yield out

    out = docs.withColumn("text", without("text"))
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))) if "n_chars" in docs.columns else out


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(documents(spark, sf_dir))
