"""Operator 1, substring dedup: Relative Lempel-Ziv parsing against every indexed reference block.

The reference is the corpus itself, in order of (doc_id, digest, word position): each text is factored against all text
before it. Reference blocks are sets of whole anchors (see `repeats`): a block indexes the regions around its anchors,
and a document is factored against every block that one of its anchors is in; in other blocks it can't have a factor of
50 words. Within a block, each cursor looks up the 50 words behind it in the index, confirms them word by word, and
goes on word by word along the references that still agree, until the last of them parts: the longest match that
begins at the cursor is its factor. Cursors go from left to right; at each factor's boundary those before it are asked
too, and a factor that begins before the boundary and reaches beyond it counts. Factors of at least 50 words become
duplicate spans, shorter ones are literals; factors of neighbouring blocks that go on along one reference are one.

Results, case by case:

* a null doc_id or text, an empty text, a text of fewer than 50 words: no spans;
* a repeated row (same id, same text) is one document; two rows with one id are two texts of one document, told apart
  by `digest`, a hash of the text;
* ties: of equal passages the one with the least (doc_id, digest, position) is the source and stays;
* an empty table: no rows; extra columns, whatever their names, are ignored; very long texts are read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import repeats
from graphloom.llm.session import documents
from graphloom.llm.text import mix, span_weights

BLOCK_WORDS = 1_000_000


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry the first one with an equal key, and how many have it."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    head = np.ones(len(k), dtype=bool)
    head[1:] = k[1:] != k[:-1]
    at = np.flatnonzero(head)
    size = np.diff(np.append(at, len(k)))
    first, many = np.empty(len(k), np.int64), np.empty(len(k), np.int64)
    first[order] = np.repeat(order[at], size)
    many[order] = np.repeat(size, size)
    return first, many


def factors(block: repeats.Block, span: int, gram: int) -> tuple[np.ndarray, ...]:
    """(segment, start, length, reference segment, its start): the longest earlier match of span words or more at each
    cursor, without those that end no later than one further left."""
    words, begin = block.words, block.begin
    end = begin[1:]
    first_cursor = np.maximum(begin[:-1], block.at + gram - span)
    n_cursors = np.maximum(0, np.minimum(block.at, end - span) - first_cursor + 1)
    seg = np.repeat(np.arange(len(block)), n_cursors)  # in order of the segments: the first of equal keys is the earliest
    cursor = np.arange(len(seg)) - np.repeat(np.cumsum(n_cursors) - n_cursors, n_cursors) + first_cursor[seg]
    weight, inverse = span_weights(len(words) + 1)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * weight[: len(words)], dtype=np.uint64)])
    key = mix((prefix[cursor + span] - prefix[cursor]) * inverse[cursor] + (block.at[seg] - cursor).astype(np.uint64))
    first, many = _groups(mix(key ^ (block.anchor[seg].view(np.uint64) * np.uint64(0xD1342543DE82EF95))))
    live = np.flatnonzero(many > 1)
    first = first[live]
    equal = np.ones(len(live), dtype=bool)  # the index's answer, confirmed word by word
    for i in range(span):
        equal &= words[cursor[live] + i] == words[cursor[first] + i]
    if not equal.all():  # equal hashes of different words: told apart by the words
        where: dict[bytes, int] = {}
        for i in range(len(live)):
            c = cursor[live[i]]
            first[i] = where.setdefault(words[c : c + span].tobytes() + int(block.anchor[seg[live[i]]]).to_bytes(8, "little", signed=True) + int(block.at[seg[live[i]]] - c).to_bytes(2, "little"), live[i])
    length, ref = np.zeros(len(seg), dtype=np.int64), np.full(len(seg), -1, dtype=np.int64)
    reach = span
    while len(live):
        later = live != first
        length[live[later]], ref[live[later]] = reach, first[later]
        go = cursor[live] + reach < end[seg[live]]
        live, group = live[go], first[go]
        if not len(live):
            break
        nxt = words[cursor[live] + reach]
        order = np.lexsort((nxt, group))  # stable: within equal words the segments stay in order
        g, x, l = group[order], nxt[order], live[order]  # noqa: E741
        head = np.ones(len(l), dtype=bool)
        head[1:] = (g[1:] != g[:-1]) | (x[1:] != x[:-1])
        at = np.flatnonzero(head)
        size = np.diff(np.append(at, len(l)))
        keep = np.repeat(size, size) > 1
        live, first = l[keep], np.repeat(l[at], size)[keep]
        order = np.argsort(live)
        live, first = live[order], first[order]
        reach += 1
    found = np.flatnonzero(length)
    top = cursor[found] + length[found]
    base = seg[found] * np.int64(1 << 40)
    best = np.maximum.accumulate(np.concatenate([[-1], (top + base)[:-1]]))
    found = found[top + base > best] if len(found) else found
    s, r = seg[found], ref[found]
    return s, cursor[found] - begin[s], length[found], seg[r], cursor[r] - begin[seg[r]]


def duplicate_spans(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", span: int = repeats.SPAN, gram: int = repeats.GRAM, **options) -> DataFrame:  # noqa: ANN003
    """(doc_id, digest, start_word, end_word, n_factors, ref_doc_id, ref_start_word): passages of span or more words seen earlier.

    digest is xxhash64 of the text. The reference columns name the source of the span's longest factor. options:
    salt_rows and block_regions of `repeats.marks`.
    """

    def solve(block: repeats.Block) -> pa.RecordBatch:
        return block.matches(*factors(block, span, gram))

    return repeats.spans_of(repeats.keyed(docs, text_col, id_col), solve, span, gram, BLOCK_WORDS, **options)


def remove_spans(docs: DataFrame, span: int = repeats.SPAN) -> DataFrame:
    """docs, all columns, with each repeated passage kept only where it first occurs."""
    return repeats.cut_spans(docs, duplicate_spans(docs, span=span))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_spans(documents(spark, sf_dir)).select("doc_id", "start_word", "end_word")


ORACLE = repeats.SPANS_SQL
