"""Operator 6, SentencePiece encoding and decoding, with a max-plus parallel scan for giant documents.

The model (its path is a parameter) is a byte-fallback piece model, of unigram or BPE kind. Encoding is the best path
through a lattice of pieces, and paths can be composed in the max-plus semiring. In a unigram model a step weighs its
piece's score. In a BPE model a segmentation is BPE's own exactly if each piece encodes to itself and each two
neighbours, put together, encode to just these two: a step weighs 0 where neighbours agree and minus infinity where not.

* a document over `giant_chars` characters is split into chunks of `chunk_chars`, which go to different tasks;
* a chunk's boundary states are the pieces that may cover its first and its last boundary, and its transfer matrix
  holds, for each pair of them, the best weight of a path between. Where white space pins a boundary inside, only the
  stretches before the first and after the last pin depend on the states; runs without white space are done in full;
* matrices are combined associatively, `FAN` neighbours at a time, level by level up to one for the whole document; the
  states are then resolved level by level down again, and each chunk is traced back on its own.

A model that this can't be done for (another kind, no byte fallback, a normaliser that changes texts, user-defined
pieces, pieces across white space) raises an error.

Shorter documents are split into units of a run of spaces and what follows it, which no piece of the model crosses;
each distinct unit of a batch is encoded once by the library, and a worker keeps the ids of `KNOWN` units at most between
batches. Whatever Arrow's batches hold, about a megabyte of text is worked on at a time. Both ways give the ids that the
library gives.

Results, case by case: a null text has null ids; an empty text has none; null doc_ids are carried; repeated rows are
encoded each; an empty table gives no rows; extra columns are ignored; texts of any length are encoded whole.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.session import cut, documents
from graphloom.llm.text import _BYTE, _MUL, _powers, mix, pieces, string_buffers

MODEL_PATH = os.environ.get("GRAPHLOOM_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
GIANT_CHARS = 1 << 15
CHUNK_CHARS = 1 << 14
MARK = "▁"
NEVER = -np.inf
FAN = 32
KNOWN = 1 << 17  # units whose ids a worker keeps
STEP_UNITS = 10_000
STEP_IDS = 1 << 17
UNIGRAM, BPE = 1, 2


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            out |= (raw[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if raw[at - 1] < 128:
                return out

    while at < len(raw):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        else:
            size = number() if kind == 2 else 8 if kind == 1 else 4
            yield key >> 3, raw[at : at + size]
            at += size


class Model:
    """A piece model, loaded once per process."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        plain = [not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(names) if plain[i]}
        spec = dict(x for x in fields(sp.serialized_model_proto()) if x[0] in (2, 3))
        trained, normal = dict(fields(spec.get(2, b""))), dict(fields(spec.get(3, b"")))
        self.kind = trained.get(3, UNIGRAM)
        if self.kind not in (UNIGRAM, BPE) or not trained.get(35):
            raise ValueError("the model is neither unigram nor BPE with byte fallback")
        if normal.get(2) or not normal.get(3, 1) or normal.get(4, 1) or not normal.get(5, 1) or trained.get(24):
            raise ValueError("the model's normaliser changes texts in another way than by a mark before them and for spaces")
        if any(dict(fields(v)).get(3, 1) == 4 for k, v in fields(sp.serialized_model_proto()) if k == 1):
            raise ValueError("the model has user-defined pieces")
        self.score = {p: sp.get_score(i) for p, i in self.ids.items()}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("pieces of this model cross white space")
        self.longest = max(map(len, self.ids))
        self.unknown = min(self.score.values()) - 10  # of a character that is no piece
        self.bytes_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        raw = [p.replace(MARK, " ").encode() if ok else b"" for p, ok in zip(names, plain)]
        for b, i in enumerate(self.bytes_ids):
            if sp.is_byte(i):
                raw[i] = bytes([b])
        self.raw = np.frombuffer(b"".join(raw), dtype=np.uint8)
        self.raw_at = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
        self.known: dict[int, bytes] = {}  # of a unit's hash: its ids, 4 bytes each

    def fallback(self, char: str) -> list[int]:
        return [self.bytes_ids[b] for b in char.encode()]

    def emit(self, piece: str) -> list[int]:
        i = self.ids.get(piece)
        return [i] if i is not None else self.fallback(piece)

    @lru_cache(maxsize=200_000)
    def bpe(self, s: str) -> tuple[str, ...]:
        """Merge neighbours, the best-scored piece first, the leftmost of equals."""
        parts = list(s)
        while len(parts) > 1:
            best, at = NEVER, -1
            for i in range(len(parts) - 1):
                sc = self.score.get(parts[i] + parts[i + 1])
                if sc is not None and sc > best:
                    best, at = sc, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return tuple(parts)

    def sound(self, piece: str) -> bool:
        return len(piece) == 1 or piece in self.ids and (self.kind == UNIGRAM or self.bpe(piece) == (piece,))

    def agree(self, a: str, b: str) -> bool:
        return self.kind == UNIGRAM or self.bpe(a + b) == (a, b)

    def weight(self, piece: str) -> float:
        return self.score.get(piece, self.unknown) if self.kind == UNIGRAM else 0.0


@lru_cache(maxsize=4)
def model(path: str) -> Model:
    return Model(path)


def encode_column(m: Model, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids, and n+1 offsets of the rows, for texts of ordinary length."""
    data, offsets = string_buffers(col)
    n, rows = len(data), len(offsets) - 1
    if not n:
        return np.zeros(0, np.int32), np.zeros(rows + 1, np.int64)
    space = data == 32
    begin = space.copy()
    begin[1:] &= ~space[:-1]
    heads = np.unique(offsets[:-1][np.diff(offsets) > 0])
    begin[heads] = True
    starts = np.flatnonzero(begin)
    at_head = np.zeros(n, dtype=bool)
    at_head[heads] = True
    ends = np.append(starts[1:], n)
    keys = starts + (space[starts] & ~at_head[starts])  # the space that the library adds by itself is left out
    size = ends - keys
    within = np.arange(n) - np.repeat(keys, ends - starts)
    weight = _powers("byte", _MUL, int(size.max()) + 1)
    v = np.where(within >= 0, _BYTE[data], np.uint64(0)) * weight[np.maximum(within, 0)]
    h = mix(np.add.reduceat(v, starts) + size.astype(np.uint64))
    distinct, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    labels = distinct.tolist()
    new = [i for i, x in enumerate(labels) if x not in m.known]
    raw = data.tobytes()
    texts = [raw[keys[first[i]] : ends[first[i]]].decode() for i in new]
    lone = [m.sp.piece_to_id(MARK)]
    for k in range(0, len(new), STEP_UNITS):
        for i, t, ids in zip(new[k : k + STEP_UNITS], texts[k : k + STEP_UNITS], m.sp.encode(texts[k : k + STEP_UNITS], num_threads=1)):
            m.known[labels[i]] = array("i", ids if t else lone).tobytes()
    lists = [m.known[x] for x in labels]
    if len(m.known) > KNOWN:
        m.known.clear()
    sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists)) // 4
    flat = np.frombuffer(b"".join(lists), dtype=np.int32)
    base = np.concatenate([[0], np.cumsum(sizes)])
    count = sizes[inverse]
    total = np.concatenate([[0], np.cumsum(count)])
    ids = flat[np.repeat(base[inverse] - total[:-1], count) + np.arange(total[-1])]
    return ids, total[np.searchsorted(starts, offsets)]


def decode_flat(m: Model, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows, and their offsets; the space before the first piece of a row is dropped."""
    size = (m.raw_at[1:] - m.raw_at[:-1])[ids]
    total = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(int(total[-1]), dtype=np.uint8)
    for k in range(0, len(ids), STEP_IDS):  # places in m.raw take 8 bytes for each byte of text
        e = min(len(ids), k + STEP_IDS)
        out[total[k] : total[e]] = m.raw[np.repeat(m.raw_at[ids[k:e]] - total[k:e], size[k:e]) + np.arange(total[k], total[e])]
    bounds = total[offsets]
    some = np.flatnonzero(np.diff(bounds) > 0)
    gone = bounds[:-1][some][out[bounds[:-1][some]] == 32]
    keep = np.ones(len(out), dtype=bool)
    keep[gone] = False
    return out[keep], bounds - np.searchsorted(gone, bounds)


# Giant documents


class Chunk:
    """Characters a..b of the marked text, seen with some context: `text` begins at `at`, the whole text ends at `end`."""

    def __init__(self, m: Model, text: str, at: int, a: int, b: int, end: int) -> None:
        self.m, self.text, self.at, self.a, self.b, self.end = m, text, at, a, b, end

    def piece(self, s: int, e: int) -> str:
        return self.text[s - self.at : e - self.at]

    def states(self, p: int) -> list[tuple[int, int]]:
        """Pieces (s, e) with s < p <= e, in order; at 0 the one state before the text."""
        if p == 0:
            return [(0, 0)]
        lo, hi = max(0, p - self.m.longest), min(self.end, p + self.m.longest - 1)
        return [(s, e) for s in range(lo, p) for e in range(p, min(hi, s + self.m.longest) + 1) if self.m.sound(self.piece(s, e)) and (p < self.end or e == p)]

    def pins(self) -> tuple[int, int] | None:
        """First and last boundary that white space fixes, far enough from the chunk's own boundaries."""
        mark = lambda p: self.text[p - self.at] == MARK and self.text[p - self.at - 1] != MARK
        lo, hi = self.a + self.m.longest, self.b - 1
        first = next((p for p in range(lo, hi + 1) if mark(p)), None)
        if first is None:
            return None
        return first, next(p for p in range(hi, first - 1, -1) if mark(p))

    def next_pieces(self, last: tuple[int, int]) -> Iterator[tuple[int, int]]:
        s, e = last
        before = self.piece(s, e)
        for f in range(e + 1, min(self.end, e + self.m.longest) + 1):
            p = self.piece(e, f)
            if self.m.sound(p) and (not before or self.m.agree(before, p)):
                yield e, f

    def reach(self, starts: list[tuple[int, int]], stop: int, over: bool) -> dict[tuple[int, int], np.ndarray]:
        """Best weights, by start, of the pieces that end at stop or, if over, are the first to reach it."""
        todo: dict[int, dict[tuple[int, int], np.ndarray]] = {}
        out: dict[tuple[int, int], np.ndarray] = {}

        def put(x: tuple[int, int], w: np.ndarray) -> None:
            if x[1] >= stop:
                if over or x[1] == stop:
                    out[x] = np.maximum(out[x], w) if x in out else w
                return
            level = todo.setdefault(x[1], {})
            level[x] = np.maximum(level[x], w) if x in level else w

        for i, x in enumerate(starts):
            w = np.full(len(starts), NEVER)
            w[i] = 0.0
            put(x, w)
        while todo:
            p = min(todo)
            for x, w in todo.pop(p).items():
                for y in self.next_pieces(x):
                    put(y, w + self.m.weight(self.piece(*y)))
        return out

    def transfer(self) -> np.ndarray:
        """Weights from each state at a to each state at b."""
        into, out = self.states(self.a), self.states(self.b)
        index = {x: i for i, x in enumerate(out)}
        got = np.full((len(into), len(out)), NEVER)
        pins = self.pins()
        if pins is None:
            for x, w in self.reach(into, self.b, True).items():
                if x in index:
                    got[:, index[x]] = w
            return got
        head = np.full(len(into), NEVER)
        for w in self.reach(into, pins[0], False).values():
            head = np.maximum(head, w)
        tail = np.full(len(out), NEVER)
        for x, w in self.reach([(pins[1], pins[1])], self.b, True).items():
            if x in index:
                tail[index[x]] = w[0]
        return head[:, None] + tail[None, :]

    def path(self, start: tuple[int, int], stop: int, goal: tuple[int, int] | None) -> list[tuple[int, int]]:
        """The best pieces after start up to goal, or up to any piece that ends at stop; of equals those that begin first."""
        if goal == start or goal is None and start[1] == stop:
            return []
        best: dict[tuple[int, int], float] = {start: 0.0}
        back: dict[tuple[int, int], tuple[int, int]] = {}
        todo, last = {start[1]: [start]}, None
        while todo:
            p = min(todo)
            for x in todo.pop(p):
                for y in self.next_pieces(x):
                    w = best[x] + self.m.weight(self.piece(*y))
                    if y in best and w <= best[y]:
                        continue
                    if y not in best and y[1] < stop:
                        todo.setdefault(y[1], []).append(y)
                    best[y], back[y] = w, x
                    if y == goal or goal is None and y[1] == stop and (last is None or y == last or w > best[last]):
                        last = y
        if last is None:
            raise ValueError("no path between the states")
        out = [last]
        while back[out[-1]] != start:
            out.append(back[out[-1]])
        return out[::-1]

    def ids(self, start: int, goal: int) -> list[int]:
        """The ids of the pieces after the start state, goal state included."""
        into, out = self.states(self.a)[start], self.states(self.b)[goal]
        pins = self.pins()
        emit = lambda xs: [i for x in xs for i in self.m.emit(self.piece(*x))]
        if pins is None:
            return emit(self.path(into, self.b, out))
        middle = self.piece(*pins)[1:].replace(MARK, " ")
        return emit(self.path(into, pins[0], None)) + (self.m.sp.encode(middle) if pins[0] < pins[1] else []) + emit(self.path((pins[1], pins[1]), self.b, out))


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def resolve(matrices: list[np.ndarray], start: int = 0, goal: int | None = None) -> list[tuple[int, int]]:
    """The state before and after each of some neighbours on the best path from start to goal (the best, if it isn't given)."""
    prefix = [matrices[0][start]]
    for x in matrices[1:]:
        prefix.append((prefix[-1][:, None] + x).max(axis=0))
    goal = int(np.argmax(prefix[-1])) if goal is None else goal
    out = []
    for k in range(len(matrices) - 1, -1, -1):
        before = int(np.argmax(prefix[k - 1] + matrices[k][:, goal])) if k else start
        out.append((before, goal))
        goal = before
    return out[::-1]


def split(m: Model, text: str, chunk_chars: int) -> list[Chunk]:
    marked = MARK + text.replace(" ", MARK)
    n, pad = len(marked), 3 * m.longest
    size = max(chunk_chars, 4 * m.longest)
    cuts = list(range(0, n, size)) + [n]
    if len(cuts) > 2 and cuts[-1] - cuts[-2] < 2 * m.longest:
        del cuts[-2]
    return [Chunk(m, marked[max(0, a - pad) : b + pad], max(0, a - pad), a, b, n) for a, b in zip(cuts[:-1], cuts[1:])]


def encode_giant(docs: DataFrame, path: str, chunk_chars: int) -> DataFrame:
    """(doc_id, digest, ids) of the distinct giant documents. docs: doc_id, digest, text."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            for i in range(batch.num_rows):
                cs = split(m, batch.column("text")[i].as_py(), chunk_chars)
                k = pa.array(range(len(cs)), pa.int32())
                again = pa.array([i] * len(cs))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(again), batch.column("digest").take(again), k, pa.array([c.text for c in cs]), *(pa.array([getattr(c, x) for c in cs], pa.int64()) for x in ("at", "a", "b", "end"))], names=["doc_id", "digest", "k", "text", "at", "a", "b", "end"])

    def rows(batch: pa.RecordBatch) -> Iterator[Chunk]:
        for t, *x in zip(*(batch.column(c).to_pylist() for c in ("text", "at", "a", "b", "end"))):
            yield Chunk(model(path), t, *x)

    def transfer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for big in batches for part in pieces(big)):
            got = [c.transfer() for c in rows(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), batch.column("k"), pa.array([x.shape[1] for x in got], pa.int32()), pa.array([x.astype(np.float64).ravel().tolist() for x in got], pa.list_(pa.float64()))], names=["doc_id", "digest", "k", "width", "weights"])

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for big in batches for part in pieces(big)):
            got = [np.array(c.ids(s, g), dtype=np.int32) for c, s, g in zip(rows(batch), batch.column("start").to_pylist(), batch.column("goal").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), batch.column("k"), pa.array(got, pa.list_(pa.int32()))], names=["doc_id", "digest", "k", "part"])

    chunks = cut(docs.mapInArrow(spread, f"doc_id {id_type}, digest long, k int, text string, at long, a long, b long, end long").repartition("doc_id", "digest", "k"))
    weights = f"doc_id {id_type}, digest long, k int, width int, weights array<double>"
    levels = [cut(chunks.mapInArrow(transfer, weights))]
    widest = (levels[0].agg(F.max("k")).first()[0] or 0) + 1
    parent = F.floor(F.col("k") / FAN).cast("int").alias("parent")

    def read(table: pa.Table) -> tuple[pa.Table, list[np.ndarray]]:
        table = table.sort_by("k")
        return table, [np.array(x).reshape(-1, w) for x, w in zip(table.column("weights").to_pylist(), table.column("width").to_pylist())]

    def product(table: pa.Table) -> pa.Table:
        table, found = read(table)
        whole = reduce(combine, found)
        head = table.slice(0, 1)
        return pa.table({"doc_id": head.column("doc_id"), "digest": head.column("digest"), "k": pa.array([head.column("k")[0].as_py() // FAN], pa.int32()), "width": pa.array([whole.shape[1]], pa.int32()), "weights": pa.array([whole.ravel().tolist()], pa.list_(pa.float64()))})

    def solve(table: pa.Table) -> pa.Table:
        table, found = read(table)
        states = resolve(found, table.column("start")[0].as_py(), table.column("goal")[0].as_py())
        return pa.table({"d": table.column("doc_id"), "g": table.column("digest"), "n": table.column("k"), **{x: pa.array([s[i] for s in states], pa.int32()) for i, x in enumerate(("start", "goal"))}})

    while widest > FAN:
        levels.append(cut(levels[-1].groupBy("doc_id", "digest", parent).applyInArrow(product, weights)))
        widest = -(-widest // FAN)
    states: DataFrame | None = None
    for level in reversed(levels):
        rows_of = level.select("*", parent)
        if states is None:
            rows_of = rows_of.withColumns({"start": F.lit(0), "goal": F.lit(None).cast("int")})
        else:
            rows_of = rows_of.join(states, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("digest") == F.col("g")) & (F.col("parent") == F.col("n"))).drop("d", "g", "n")
        states = rows_of.groupBy("doc_id", "digest", "parent").applyInArrow(solve, f"d {id_type}, g long, n int, start int, goal int")
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("digest") == F.col("g")) & (F.col("k") == F.col("n"))
    traced = chunks.join(states, same).drop("d", "g", "n").mapInArrow(trace, f"doc_id {id_type}, digest long, k int, part array<int>")
    return traced.groupBy("doc_id", "digest").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "part"))), lambda x: x["part"])).alias("ids"))


def encode(docs: DataFrame, path: str = MODEL_PATH, giant_chars: int = GIANT_CHARS, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """(doc_id, n_tokens, ids, round_trip): the ids of each text, and whether they decode to it."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = f"doc_id {id_type}, n_tokens int, ids array<int>, round_trip boolean"
    giant = (F.length("text") > giant_chars) & F.col("text").isNotNull()

    def finish(m: Model, batch: pa.RecordBatch, ids: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        col = batch.column("text")
        raw, bounds = decode_flat(m, ids, offsets)
        data, own = string_buffers(col)
        if np.array_equal(own, bounds) and np.array_equal(data, raw):
            fine = np.ones(len(col), dtype=bool)
        else:
            fine = np.array([np.array_equal(data[own[i] : own[i + 1]], raw[bounds[i] : bounds[i + 1]]) for i in range(len(col))], dtype=bool)
        null = np.asarray(col.is_null())
        lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32), mask=np.append(null, False)), pa.array(ids, pa.int32()))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets).astype(np.int32), mask=null), lists, pa.array(fine, mask=null)], names=["doc_id", "n_tokens", "ids", "round_trip"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for big in batches:
            for batch in pieces(big):
                yield finish(m, batch, *encode_column(m, batch.column("text")))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in (part for big in batches for part in pieces(big)):
            col = batch.column("ids")
            yield finish(m, batch, np.asarray(col.flatten(), dtype=np.int32), np.concatenate([[0], np.cumsum(np.asarray(col.value_lengths(), dtype=np.int64))]))

    keyed = docs.where(giant).withColumn("digest", F.xxhash64("text"))
    distinct = keyed.dropDuplicates(["doc_id", "digest"]) if giant_chars else keyed
    found = encode_giant(distinct, path, chunk_chars).withColumnsRenamed({"doc_id": "d", "digest": "g"})
    whole = keyed.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("digest") == F.col("g"))).select("doc_id", "text", "ids").mapInArrow(close, schema)
    return docs.where(~giant | F.col("text").isNull()).mapInArrow(run, schema).unionByName(whole)


def decode(encoded: DataFrame, path: str = MODEL_PATH) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); ids that are no valid UTF-8 together give replacement characters."""
    id_type = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            col = batch.column("ids")
            ids = np.asarray(col.flatten(), dtype=np.int64)
            offsets = np.concatenate([[0], np.cumsum(np.asarray(col.value_lengths().fill_null(0), dtype=np.int64))])
            raw, bounds = decode_flat(m, ids, offsets)
            data = raw.tobytes()
            out = [None if null else data[a:b].decode("utf-8", "replace") for a, b, null in zip(bounds[:-1].tolist(), bounds[1:].tolist(), np.asarray(col.is_null()).tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, f"doc_id {id_type}, text string")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(documents(spark, sf_dir))
