"""Operator 4, suffix-array dedup: shard Burrows-Wheeler transforms merged by iterative interleave refinement.

Text that can repeat is routed by its winnowed anchors, so that all occurrences of a repeated window meet in one block
(see `repeats`). A block's regions, as stretches of text in which no word is taken twice, are segments, which form
shards. Each shard sorts its own suffixes once, by prefix doubling, and keeps its transform. The shards are then merged
by interleave refinement: an array that says which shard each merged row comes from is refined by one stable counting
sort a round, keyed by the transform's symbols; after h rounds rows are in order of their first h words, and rows where
two h-word groups first part have common prefix h-1. No suffix is compared or sorted again. The groups left after `span`
rounds are the intervals with common prefix of span or more: the repeated windows, of which all but the first in
(doc_id, position) are duplicates.

Results, case by case: as for operator 1 (nulls, empty and short texts: no spans; a repeated row is one document; of
equal passages the first in (doc_id, position) stays; an empty table: no rows; extra columns are ignored).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import repeats
from graphloom.llm.session import documents
from graphloom.llm.text import span_weights

SHARD_WORDS = 300_000
BLOCK_SHARDS = 4


def suffix_array(symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Suffix order of a shard: segments end with terminators (at `ends`) that differ and come before all symbols."""
    n = len(symbols)
    rank = symbols.astype(np.int64) + len(ends)
    rank[ends] = np.arange(len(ends))
    step = 1
    while True:
        after = np.full(n, 0, dtype=np.int64)
        if step < n:
            after[:-step] = rank[step:] + 1
        key = rank * (np.int64(rank.max()) + 2) + after
        order = np.argsort(key, kind="stable")
        key = key[order]
        fresh = np.empty(n, dtype=np.int64)
        fresh[order] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        rank, step = fresh, step * 2
        if rank[order[-1]] == n - 1:
            return order


def transform(symbols: np.ndarray, ends: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """The symbol before each suffix in order; 0 before a segment's first word."""
    before = np.zeros(len(symbols), dtype=symbols.dtype)
    before[1:] = symbols[:-1]
    before[ends[:-1] + 1] = 0
    before[0] = 0
    return before[sa]


def merge(bwts: list[np.ndarray], n_ends: list[int], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave the shards' transforms.

    Gives, for each merged row, its row in the shards' concatenation, and its common prefix with the row before, where
    that is under depth (depth otherwise). Symbols are uint16 of 1 and more; 0 stands for the terminators, which sort
    first and differ.
    """
    b = np.concatenate(bwts)
    n, sizes = len(b), np.array([len(x) for x in bwts])
    base = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    q = int(sum(n_ends))
    # where each row's suffix goes when the symbol before it is put in front: fixed for each shard, whatever the interleave
    ahead = np.zeros(n, dtype=np.int32)
    for t, start, k in zip(bwts, base, n_ends):
        ahead[start + np.argsort(t, kind="stable")[k:]] = np.arange(start + k, start + len(t), dtype=np.int32)
    heads = np.concatenate([np.arange(s, s + k, dtype=np.int32) for s, k in zip(base, n_ends)])  # the terminators' rows, the same in each round
    rows = np.concatenate([heads, *(np.arange(s + k, s + m, dtype=np.int32) for s, k, m in zip(base, n_ends, sizes))])
    lcp = np.full(n, depth, dtype=np.int16)
    lcp[: q + 1] = 0
    bound = np.zeros(n, dtype=bool)
    bound[0] = True  # before the first round all rows, terminators too, are one group
    tally = np.bincount(b)
    edge = np.zeros(n, dtype=bool)  # where the sorted symbols change, the same in each round
    edge[: q + 1] = True
    edge[np.cumsum(tally[tally > 0])[:-1]] = True
    for h in range(1, depth + 1):
        order = np.argsort(b[rows], kind="stable")[q:]  # radix sort of 16 bits; the terminators' places are known
        both = rows.astype(np.int64)  # row and group in one number, made in place: this is where most memory is held
        both <<= 32
        both |= np.cumsum(bound, dtype=np.int32)
        both = both[order]
        del order
        block = both.astype(np.int32)
        fresh = bound | edge
        fresh[q + 1 :] |= block[1:] != block[:-1]
        del block
        parted = np.flatnonzero(fresh != bound)
        lcp[parted] = h - 1
        both >>= 32
        new = np.concatenate([heads, ahead[both]])
        del both
        if not len(parted) and np.array_equal(new, rows):
            break  # all intervals are final
        rows, bound = new, fresh
    return rows, lcp


def repeated_windows(segments: list[np.ndarray], span: int, shard_words: int = SHARD_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Groups of equal span-word windows of the segments (arrays of word hashes): (group, segment, offset) arrays."""
    bwts, ends_of, where, at, done = [], [], [], 0, 0
    while at < len(segments):
        stop, size = at, 0
        while stop < len(segments) and (size == 0 or size + len(segments[stop]) < shard_words):
            size += len(segments[stop]) + 1
            stop += 1
        part = segments[at:stop]
        lengths = np.array([len(x) + 1 for x in part])
        ends = np.cumsum(lengths) - 1
        sym = np.zeros(size, dtype=np.uint16)
        inside = np.ones(size, dtype=bool)
        inside[ends] = False
        sym[inside] = (np.concatenate(part).astype(np.uint64) % np.uint64(65_521) + np.uint64(1)).astype(np.uint16)
        sa = suffix_array(sym, ends)
        bwts.append(transform(sym, ends, sa))
        ends_of.append(len(part))
        where.append((sa + done).astype(np.int32))
        at, done = stop, done + size
    if not bwts:
        none = np.zeros(0, np.int64)
        return none, none, none
    rows, lcp = merge(bwts, ends_of, span)
    head = lcp < span
    some = np.flatnonzero(~(head & np.append(head[1:], True)))  # rows that share their group with another
    group = np.cumsum(head, dtype=np.int32)[some]
    place = np.concatenate(where)[rows[some]].astype(np.int64)
    begin = np.concatenate([[0], np.cumsum([len(x) + 1 for x in segments])])
    seg = np.searchsorted(begin, place, "right") - 1
    return group, seg, place - begin[seg]


def stretches(block: repeats.Block) -> tuple[np.ndarray, list[np.ndarray]]:
    """The words of each stretch of text that a block's regions cover without a gap, and its first region.

    Anchors that stand close together have regions that overlap; their words are taken once. Windows of a stretch that
    hold no anchor are compared as well: what is equal to an earlier one is repeated, whatever it was found by.
    """
    hi = block.lo + np.diff(block.begin)
    order = np.lexsort((hi, block.lo, block.text))
    text, lo, hi = block.text[order], block.lo[order], hi[order]
    joined = np.append(False, (text[1:] == text[:-1]) & (lo[1:] <= hi[:-1]))
    begin = block.begin[:-1][order]
    begin[joined] += hi[:-1][joined[1:]] - lo[joined]  # without the words that the region before holds
    parts = [block.words[a:b] for a, b in zip(begin, block.begin[1:][order])]
    at = np.flatnonzero(~joined)
    return order[at], [np.concatenate(parts[a:b]) for a, b in zip(at, np.append(at[1:], len(parts)))]


def block_matches(block: repeats.Block, span: int) -> pa.RecordBatch | None:
    """The windows of a block that occur earlier."""
    first, parts = stretches(block)
    group, seg, off = repeated_windows(parts, span)
    if not len(group):
        return None
    # 16-bit symbols can agree by chance: groups are told apart by the whole words too
    words = np.concatenate(parts)
    i, check = np.concatenate([[0], np.cumsum([len(x) for x in parts])])[seg] + off, np.zeros(len(group), dtype=np.uint64)
    for k, weight in enumerate(span_weights(span)[0]):
        check += words[i + k] * weight
    seg = first[seg]
    text = block.text[seg]
    lo = block.lo[seg] + off
    order = np.lexsort((lo, text, check, group))
    group, check, text, lo, seg, off, i = (x[order] for x in (group, check, text, lo, seg, off, i))
    new = np.ones(len(group), dtype=bool)
    new[1:] = (group[1:] != group[:-1]) | (check[1:] != check[:-1])
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    later = np.flatnonzero((text != text[head]) | (lo != lo[head]))
    # windows that go on along one reference are one match; the next stretch's first window is span words further at least
    later = later[np.argsort(i[later])]
    ref = head[later]
    new = np.ones(len(later) + 1, dtype=bool)
    new[1:-1] = (np.diff(i[later]) != 1) | (np.diff(i[ref]) != 1)
    at = np.flatnonzero(new)
    later, ref = later[at[:-1]], ref[at[:-1]]
    return block.matches(seg[later], off[later], np.diff(at) + (span - 1), seg[ref], off[ref])


def duplicate_spans(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", span: int = repeats.SPAN, gram: int = repeats.GRAM, **options) -> DataFrame:  # noqa: ANN003
    """(doc_id, digest, start_word, end_word, n_factors, ref_doc_id, ref_start_word): repeated intervals as spans of words."""

    def solve(block: repeats.Block) -> pa.RecordBatch | None:
        return block_matches(block, span)

    return repeats.spans_of(repeats.keyed(docs, text_col, id_col), solve, span, gram, SHARD_WORDS * BLOCK_SHARDS, **options)


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_spans(documents(spark, sf_dir)).select("doc_id", "start_word", "end_word")


ORACLE = repeats.SPANS_SQL
