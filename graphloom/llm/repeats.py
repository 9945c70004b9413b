"""Candidate routing for repeated passages, shared by the substring and the suffix-array operators.

Each row's text is read as words; a *window* is `span` consecutive words (50 unless said otherwise).  A window is
repeated if the same words occur earlier, in order of (doc_id, digest of the text, position).  Winnowing puts at least
one anchor (a `gram`-word phrase) in every window, the same one in equal windows, so only windows around anchors that
occur more than once need a closer look.  An anchor's *region* holds all windows that contain it.

`marks` sorts anchors once, by anchor and region hash (128 bits together), and gives three kinds of rows:

* kind 1: the whole region occurs earlier, at (ref_doc, ref_lo): all its windows are repeated;
* kind 0: the region is the first with these words, but the anchor occurs in other regions too: its windows have to be
  compared, which the two operators do in their own ways, in blocks of whole anchors (`in_blocks`);
* kind 2: as kind 0, but the anchor is in more than `block_regions` regions, too many for a block: its windows are
  compared by hash, each in its own place (`window_matches`).

Anchors of one region only are dropped; they are the bulk of a clean corpus.  Nothing is capped. Anchors and windows that
hold a large share of all rows are salted (see `skew`).  Rows of one id and one text are one text; rows of one id and
different texts are different texts, told apart by the digest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm import skew
from graphloom.llm.session import cut
from graphloom.llm.text import Words, mix, pieces, winnow

SPAN = 50
GRAM = 16
BLOCK_REGIONS = 50_000
SLICE_ROWS = 500


def texts(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id and text alone: extra columns, whatever their names, and rows without id or text fall away."""
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def regions(w: Words, at: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Word bounds, within the batch, of the union of the windows of a row that contain the anchor at `at`."""
    row = w.row[at]
    return np.maximum(w.first[row], at - (span - gram)), np.minimum(w.first[row + 1], at + span)


def keyed(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, digest and text; id and digest together name a text."""
    return texts(docs, text_col, id_col).select("doc_id", F.xxhash64("text").alias("digest"), "text")


def once(batch: pa.RecordBatch, seen: set) -> pa.RecordBatch:
    """The rows whose (doc_id, digest) this task hasn't met: repeated rows are one text, however many there are."""
    at = []
    for i, x in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("digest").to_pylist())):
        if x not in seen:
            seen.add(x)
            at.append(i)
    return batch if len(at) == batch.num_rows else batch.take(pa.array(at, pa.int64()))


def place(at: np.ndarray, lo: np.ndarray, hi: np.ndarray, first: np.ndarray) -> pa.Array:
    """Position, and words of the region before and from there on, in one number whose order is that of the position."""
    return pa.array(((at - first) << 24) | ((at - lo) << 12) | (hi - at))


def bounds(column: str = "place") -> tuple[Column, Column]:
    """First and last word, exclusive, of the region at a place."""
    p = F.col(column)
    pos = F.shiftright(p, 24)
    return (pos - F.shiftright(p, 12).bitwiseAND(4095)).cast("int").alias("lo"), (pos + p.bitwiseAND(4095)).cast("int").alias("hi")


def marks(docs: DataFrame, span: int = SPAN, gram: int = GRAM, salt_rows: int = skew.SALT_ROWS, block_regions: int = BLOCK_REGIONS) -> DataFrame:
    """(kind, doc_id, digest, place, ref_doc, ref_lo); see the module's docstring. docs: doc_id, digest, text."""
    if span > 4095:
        raise ValueError("spans are of 4,095 words at most")
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for big in batches:
            for batch in pieces(once(big, seen)):
                w = Words(batch.column("text"))
                at, a = winnow(w, span, gram)
                if not len(at):
                    continue
                lo, hi = regions(w, at, span, gram)
                row = pa.array(w.row[at])
                region = w.span_hash(lo, hi) + (at - lo).astype(np.uint64)
                yield pa.RecordBatch.from_arrays([signed(a), signed(region), batch.column("doc_id").take(row), batch.column("digest").take(row), place(at, lo, hi, w.first[w.row[at]])], names=["anchor", "region", "doc_id", "digest", "place"])

    anchors = docs.mapInArrow(scan, f"anchor long, region long, doc_id {id_type}, digest long, place long")
    top = skew.heavy(anchors.select("anchor"), ["anchor"], salt_rows)
    order = ["doc_id", "digest", "place"]
    first = F.struct(*order) == F.struct("ref_doc", "ref_digest", "ref_place")

    def with_first(rows: DataFrame, keys: list[str]) -> DataFrame:
        same = Window.partitionBy(*keys, "region").orderBy(*order)
        return rows.withColumns({f"ref_{n}": F.first(c).over(same) for n, c in (("doc", "doc_id"), ("digest", "digest"), ("place", "place"))})

    keys = ["anchor"] if top is None else ["anchor", "salt"]  # a salt that is constant would be folded out of the windows' keys, and cost a second exchange
    wide = (anchors if top is None else skew.salted(anchors, ["anchor"], ["doc_id", "digest"], top)).repartition(*keys)
    found = with_first(wide, keys).withColumn("others", F.sum(F.when(first, 1).otherwise(0)).over(Window.partitionBy(*keys)))
    large = F.lit(False) if top is None else F.col("large")
    if top is not None:
        found = found.join(F.broadcast(top.select("anchor", F.lit(True).alias("large"))), "anchor", "left").withColumn("large", F.coalesce("large", F.lit(False)))
    kind = F.when(~first, 1).when(large, 3).when(F.col("others") > block_regions, 2).otherwise(0).alias("kind")
    waits = first & large  # the first within its salt of a heavy anchor: compared once more, region by region
    out = ["doc_id", "digest", "place"]
    marked = cut(found.where(~first | large | (F.col("others") > 1)).select(kind, *out, "ref_doc", F.when(waits, F.col("anchor")).otherwise(bounds("ref_place")[0]).alias("a"), F.when(waits, F.col("region")).alias("region")))
    done = marked.where("kind < 3").select("kind", *out, "ref_doc", F.col("a").cast("int").alias("ref_lo"))
    if top is None:
        return done
    leads = cut(with_first(marked.where("kind = 3").select(*out, F.col("a").alias("anchor"), "region"), ["anchor"]))
    many = leads.where(first).groupBy("anchor").agg(F.count(F.lit(1)).alias("others"))  # one row for each heavy anchor
    leads = leads.join(F.broadcast(many), "anchor").where(~first | (F.col("others") > 1))
    return done.unionByName(cut(leads.select(F.when(~first, 1).when(F.col("others") > block_regions, 2).otherwise(0).alias("kind"), *out, "ref_doc", bounds("ref_place")[0].alias("ref_lo"))))


def with_positions(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """The texts that hold regions of kinds 0 and 2, with their anchors' positions; those of kind 2 as -1 less their position."""
    pos = F.shiftright("place", 24).cast("int")
    at = marked.where("kind <> 1").groupBy("doc_id", "digest").agg(F.collect_set(F.when(F.col("kind") == 0, pos).otherwise(-1 - pos)).alias("at"))
    return docs.join(at, ["doc_id", "digest"]).select("doc_id", "digest", "text", "at")


def positions(batch: pa.RecordBatch, w: Words, kind: int) -> np.ndarray:
    """The anchors of a kind in column `at` as word positions of the batch."""
    col = batch.column("at")
    flat = np.asarray(col.flatten(), dtype=np.int64)
    row = np.repeat(np.arange(batch.num_rows), np.asarray(col.value_lengths(), dtype=np.int64))
    own = (flat < 0) == (kind == 2)
    return np.sort(w.first[row[own]] + np.where(flat[own] < 0, -1 - flat[own], flat[own]))


def holding(batch: pa.RecordBatch, kind: int) -> pa.RecordBatch:
    """The rows with anchors of a kind."""
    col = batch.column("at")
    row = np.repeat(np.arange(batch.num_rows), np.asarray(col.value_lengths(), dtype=np.int64))
    some = np.unique(row[(np.asarray(col.flatten()) < 0) == (kind == 2)])
    return batch if len(some) == batch.num_rows else batch.take(pa.array(some))


def segments(held: DataFrame, span: int, gram: int) -> DataFrame:
    """(anchor, doc_id, digest, pos, lo, words) of the regions of kind 0: their words' hashes, 8 bytes each. held: see with_positions."""
    id_type = held.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for big in batches:
            for batch in pieces(once(holding(big, 0), seen)):
                w = Words(batch.column("text"))
                at = positions(batch, w, 0)
                lo, hi = regions(w, at, span, gram)
                raw, row = w.hash, w.row[at]
                first = w.first[row]
                yield pa.RecordBatch.from_arrays(
                    [signed(w.span_hash(at, at + gram)), *(batch.column(c).take(pa.array(row)) for c in ("doc_id", "digest")), *(pa.array((x - first).astype(np.int32)) for x in (at, lo)), pa.array([raw[a:b].tobytes() for a, b in zip(lo, hi)], pa.binary())],
                    names=["anchor", "doc_id", "digest", "pos", "lo", "words"],
                )

    return held.mapInArrow(run, f"anchor long, doc_id {id_type}, digest long, pos int, lo int, words binary")


class Block:
    """The regions of some whole anchors, in order of anchor, doc_id, digest and position, each once."""

    def __init__(self, table: pa.Table, gram: int) -> None:
        self.ids = table.column("doc_id").combine_chunks()
        anchor, digest, pos, lo = (np.asarray(table.column(c), dtype=np.int64) for c in ("anchor", "digest", "pos", "lo"))
        rank = np.unique(np.asarray(self.ids), return_inverse=True)[1]
        order = np.lexsort((pos, digest, rank, anchor))
        same = np.zeros(len(order), dtype=bool)
        same[1:] = (np.diff(anchor[order]) == 0) & (np.diff(rank[order]) == 0) & (np.diff(digest[order]) == 0) & (np.diff(pos[order]) == 0)
        self.row = order[~same]
        by_text = np.lexsort((digest, rank))
        new = (np.diff(rank[by_text]) != 0) | (np.diff(digest[by_text]) != 0)
        text = np.empty(len(by_text), dtype=np.int64)
        text[by_text] = np.concatenate([[0], np.cumsum(new)])
        self.text = text[self.row]  # the number of the segment's text, in order of (doc_id, digest)
        self.anchor, self.digest, self.lo = anchor[self.row], digest[self.row], lo[self.row]
        words = table.column("words").combine_chunks().take(pa.array(self.row))
        cuts = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        self.words = np.frombuffer(words.buffers()[2], dtype=np.uint8)[cuts[0] : cuts[-1]].view(np.uint64)
        self.begin = (cuts - cuts[0]) // 8
        self.at = self.begin[:-1] + (pos - lo)[self.row]  # the anchors

    def __len__(self) -> int:
        return len(self.row)

    def matches(self, segment: np.ndarray, start: np.ndarray, length: np.ndarray, ref: np.ndarray, ref_start: np.ndarray) -> pa.RecordBatch:
        """Words start .. start + length of a segment (counted within it) as a match with those of another from ref_start on."""
        take = lambda i: self.ids.take(pa.array(self.row[i]))
        lo = self.lo[segment] + start
        return pa.RecordBatch.from_arrays(
            [take(segment), pa.array(self.digest[segment]), *(pa.array(x.astype(np.int32)) for x in (lo, lo + length)), take(ref), pa.array((self.lo[ref] + ref_start).astype(np.int32))],
            names=["doc_id", "digest", "lo", "hi", "ref_doc", "ref_lo"],
        )


def match_schema(id_type: str) -> str:
    return f"doc_id {id_type}, digest long, lo int, hi int, ref_doc {id_type}, ref_lo int"


def in_blocks(segs: DataFrame, solve: Callable[[Block], pa.RecordBatch | None], gram: int, block_words: int) -> DataFrame:
    """The matches that solve finds in blocks of whole anchors of about block_words words."""
    id_type = segs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks() -> Iterator[Block]:
            held: list[pa.RecordBatch] = []
            size, last = 0, None
            for batch in (big.slice(k, SLICE_ROWS) for big in batches for k in range(0, big.num_rows, SLICE_ROWS)):
                a = np.asarray(batch.column("anchor"))
                if size >= block_words:  # ends before the last anchor that begins in this batch
                    stop = int(np.searchsorted(a, a[-1], "left")) if a[-1] != a[0] else 0
                    if stop or a[0] != last:
                        table = pa.Table.from_batches([*held, batch.slice(0, stop)])
                        held, size, batch = [], 0, batch.slice(stop)
                        block = Block(table, gram)
                        del table  # the block has its own words
                        yield block
                        del block
                held.append(batch)
                size += batch.column("words").nbytes // 8
                last = a[-1]
            if held:
                yield Block(pa.Table.from_batches(held), gram)

        for block in blocks():
            found = solve(block)
            del block  # before the next one is made
            if found is not None and found.num_rows:
                yield found

    return segs.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, match_schema(id_type))


def window_matches(held: DataFrame, span: int, gram: int, salt_rows: int = skew.SALT_ROWS) -> DataFrame:
    """Windows of the regions of kind 2 that occur earlier, each with its first occurrence.

    An anchor in very many different regions can't be compared in one task. Its windows are spread by their own hash (two
    of 64 bits), and heavy windows are salted, their first found by an aggregate that begins before the shuffle.
    """
    id_type = held.schema["doc_id"].dataType.simpleString()

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for big in batches:
            for batch in pieces(once(holding(big, 2), seen)):
                w = Words(batch.column("text"))
                at = positions(batch, w, 2)
                lo, hi = regions(w, at, span, gram)
                change = np.zeros(len(w) + 1, dtype=np.int64)  # +1 at the first, -1 after the last window of each region
                ok = hi - lo >= span
                np.add.at(change, lo[ok], 1)
                np.add.at(change, hi[ok] - span + 1, -1)
                s = np.flatnonzero(np.cumsum(change) > 0)
                row = pa.array(w.row[s])
                half = span // 2
                second = mix(w.span_hash(s, s + half) * np.uint64(0x9E3779B97F4A7C15) + w.span_hash(s + half, s + span))
                yield pa.RecordBatch.from_arrays([signed(w.span_hash(s, s + span)), signed(second), batch.column("doc_id").take(row), batch.column("digest").take(row), pa.array((s - w.first[w.row[s]]).astype(np.int32))], names=["window", "second", "doc_id", "digest", "lo"])

    rows = held.mapInArrow(windows, f"window long, second long, doc_id {id_type}, digest long, lo int")
    keys = ["window", "second"]
    top = skew.heavy(rows.select(*keys), keys, salt_rows)
    found = skew.over_keys(rows, keys, ["doc_id", "digest"], top, first=F.min(F.struct("doc_id", "digest", "lo")))
    return found.where(F.struct("doc_id", "digest", "lo") != F.col("first")).select("doc_id", "digest", "lo", (F.col("lo") + span).alias("hi"), F.col("first.doc_id").alias("ref_doc"), F.col("first.lo").alias("ref_lo"))


def spans_of(docs: DataFrame, solve: Callable[[Block], pa.RecordBatch | None], span: int, gram: int, block_words: int, salt_rows: int = skew.SALT_ROWS, block_regions: int = BLOCK_REGIONS) -> DataFrame:
    """The spans of docs (doc_id, digest, text): regions that repeat as a whole, and what solve finds in the other ones."""
    marked = marks(docs, span, gram, salt_rows, block_regions)
    found = marked.where("kind = 1").select("doc_id", "digest", *bounds(), "ref_doc", "ref_lo")
    held = with_positions(docs, marked)
    found = found.unionByName(in_blocks(segments(held, span, gram), solve, gram, block_words))
    if not marked.where("kind = 2").isEmpty():
        found = found.unionByName(window_matches(held, span, gram, salt_rows))
    return parse(found)


def spans_schema(id_type: str) -> str:
    return f"doc_id {id_type}, digest bigint, start_word int, end_word int, n_factors int, ref_doc_id {id_type}, ref_start_word int"


def parse(matches: DataFrame) -> DataFrame:
    """Greedy parse of each text from its matches (doc_id, digest, lo, hi, ref_doc, ref_lo), as spans.

    Matches that go on along one reference form a phrase. From the left, the longest phrase at the cursor becomes a
    factor and the cursor moves to its end. At each factor's boundary, phrases that begin before it and reach beyond it
    are looked at too, so that a span ends only where no phrase crosses. The partition is sorted and read in a stream.
    """
    id_type = matches.schema["doc_id"].dataType.simpleString()
    schema = spans_schema(id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, phrases = None, []  # of the document so far: [lo, hi, ref_doc, ref_lo]
        out: list[tuple] = []

        def flush() -> None:
            i, n = 0, len(phrases)
            while i < n:
                start = cursor = phrases[i][0]
                factors, lead, best = 0, phrases[i], None
                while True:
                    while i < n and phrases[i][0] <= cursor:  # also those that cross the boundary
                        if best is None or phrases[i][1] > best[1]:
                            best = phrases[i]
                        i += 1
                    if best is None or best[1] <= cursor:
                        break
                    factors, cursor = factors + 1, best[1]
                    if best[1] - best[0] > lead[1] - lead[0]:
                        lead = best
                out.append((*doc, start, cursor, factors, lead[2], lead[3]))

        for batch in batches:
            ids, refs = batch.column("doc_id"), batch.column("ref_doc")
            lo, hi, rlo = (np.asarray(batch.column(c), dtype=np.int64) for c in ("lo", "hi", "ref_lo"))
            if not len(lo):
                continue
            digest = np.asarray(batch.column("digest"))
            code = np.zeros(len(lo), dtype=np.int64)  # the number of the text within the batch
            ids_code = np.asarray(ids.dictionary_encode().indices)
            code[1:] = np.cumsum((ids_code[1:] != ids_code[:-1]) | (digest[1:] != digest[:-1]))
            rcode = np.asarray(refs.dictionary_encode().indices)
            new = np.ones(len(lo), dtype=bool)  # where another phrase begins
            new[1:] = (code[1:] != code[:-1]) | (rcode[1:] != rcode[:-1]) | (rlo[1:] - lo[1:] != rlo[:-1] - lo[:-1]) | (lo[1:] > np.maximum.accumulate(hi + code * (1 << 40))[:-1] - code[1:] * (1 << 40))
            head = np.flatnonzero(new)
            top = np.maximum.reduceat(hi, head)
            for d, a, b, r, ra in zip(zip(ids.take(pa.array(head)).to_pylist(), digest[head].tolist()), lo[head].tolist(), top.tolist(), refs.take(pa.array(head)).to_pylist(), rlo[head].tolist()):
                if d != doc:
                    flush()
                    doc, phrases = d, []
                if phrases and phrases[-1][2] == r and phrases[-1][3] - phrases[-1][0] == ra - a and a <= phrases[-1][1]:
                    phrases[-1][1] = max(phrases[-1][1], b)
                else:
                    phrases.append([a, b, r, ra])
            if len(out) > 20_000:
                yield to_batch(out, schema)
                out.clear()
        flush()
        if out:
            yield to_batch(out, schema)

    return matches.repartition("doc_id", "digest").sortWithinPartitions("doc_id", "digest", "lo", F.desc("hi"), "ref_doc", "ref_lo").mapInArrow(run, schema)


def to_batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    arrow = _arrow(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)


_KINDS = {"int": pa.int32(), "bigint": pa.int64(), "long": pa.int64(), "string": pa.string(), "double": pa.float64(), "smallint": pa.int16(), "boolean": pa.bool_()}


def _arrow(schema: str) -> pa.Schema:
    return pa.schema([(n, _KINDS[k]) for n, k in (x.split() for x in schema.split(", "))])


def cut_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs without the words of the spans (of the text with the span's id and digest): text and, if there is one, n_chars change; documents left without a word go.

    The white space before a removed word goes with it. Rows without spans come back unchanged, nulls included.
    """
    marked = spans.groupBy(F.col("doc_id").alias("__gl_id"), F.col("digest").alias("__gl_digest")).agg(F.collect_list(F.struct("start_word", "end_word")).alias("__gl_spans"))
    joined = docs.join(marked, (docs["doc_id"] == F.col("__gl_id")) & (F.xxhash64(docs["text"].cast("string")) == F.col("__gl_digest")), "left").drop("__gl_id", "__gl_digest")

    @F.pandas_udf("string")
    def cut_text(text, spans):  # noqa: ANN001, ANN202
        out = text.copy()
        for i, (t, found) in enumerate(zip(text, spans)):
            if found is None or t is None:
                continue
            w = Words(pa.array([t]))
            raw, gone = w.data, np.zeros(len(w.data), dtype=bool)
            for s in found:
                a, b = s["start_word"], min(s["end_word"], len(w))
                if a < b:
                    gone[w.ends[a - 1] if a else 0 : w.ends[b - 1]] = True
            out.iloc[i] = raw[~gone].tobytes().decode("utf-8")
        return out

    # else the filter below is moved before it, and each text is cut twice, by twice as many Python workers, which stay
    without = cut_text.asNondeterministic()
    changed = F.col("__gl_spans").isNotNull()
    out = joined.withColumn("__gl_text", F.when(changed, without("text", "__gl_spans")).otherwise(F.col("text")))
    cols = [F.col("__gl_text").alias("text") if c == "text" else F.when(changed, F.length("__gl_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")).alias("n_chars") if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return out.where(~changed | (F.trim(F.regexp_replace("__gl_text", r"[\t-\r ]+", " ")) != "")).select(*cols)


#: The spans in DuckDB's SQL: words covered by a window that occurs earlier, as maximal runs. Texts of one id are in order
#: of the text here, not of its digest; ids are unique in the tables.
SPANS_SQL = f"""
WITH words AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\\t\\n\\x0B\\f\\r ]+') AS w FROM (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)
), wins AS (
  SELECT doc_id, text, s, array_to_string(list_slice(w, s + 1, s + {SPAN}), ' ') AS win
  FROM (SELECT doc_id, text, w, unnest(range(0, len(w) - {SPAN - 1})) AS s FROM words WHERE len(w) >= {SPAN})
), dups AS (
  SELECT DISTINCT doc_id, text, s FROM (SELECT doc_id, text, s, rank() OVER (PARTITION BY win ORDER BY doc_id, text, s) AS nth FROM wins) WHERE nth > 1
), heads AS (
  SELECT doc_id, text, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id, text ORDER BY s) + {SPAN} THEN 0 ELSE 1 END AS head FROM dups
), runs AS (SELECT doc_id, text, s, sum(head) OVER (PARTITION BY doc_id, text ORDER BY s) AS run FROM heads)
SELECT doc_id, CAST(min(s) AS INTEGER) AS start_word, CAST(max(s) + {SPAN} AS INTEGER) AS end_word FROM runs GROUP BY doc_id, text, run
"""
