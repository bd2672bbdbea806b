"""Repeated passages by sparse suffix arrays.

A passage counts as repeated if its words, at least ``min_words`` of them in a row, occur twice or
more anywhere in the corpus.

* Suffixes are retained only at content-selected positions: the minimiser of each ``window``
  neighbouring word grams.  A repeated passage selects the same positions in each of its copies, and
  the first of them leaves at least ``min_words - window + 1`` of its words to the right.
* Retained suffixes go by the digest of those words, where copies combine before the shuffle; those
  with an equal neighbour are the candidates.
* Candidates are extended left and right: every stretch of ``min_words`` words that holds one is
  sorted among all others by a digest of 128 bits and compared with its neighbours, and neighbouring
  stretches that match are joined, which gives the passages to the word.  Stretches travel in blocks
  of documents, each digest once for a block, as packed columns; what comes back to a block is two
  bits for each digest.

Comparing only neighbours in the order of the retained suffixes themselves would lose passages: of
three texts x, y, z, the suffix of y may sort between those of x and z, agreeing longer with each to
the right but not to the left, while x and z agree on both sides (the tests hold such a case).  So
the order is made of all stretches around a candidate, one for each way of extending it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts_of, settle, texts
from .common import squeeze as _squeeze
from .common import unsqueeze as _unsqueeze

GRAM = 8
BASE = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """Word bytes -> 64-bit hash; emptied when it grows over its bound."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 300_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 1)
        return h


def word_hashes(text: str | None, memo: _Words) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").split()
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def rolled(h: np.ndarray, starts: np.ndarray | None, size: int) -> np.ndarray:
    """Hashes of the ``size`` words from each start (from every possible one, if None)."""
    n = len(h) - size + 1
    if starts is None:
        starts = np.arange(max(0, n))
    out = np.zeros(len(starts), np.uint64)
    for j in range(size):
        out = out * BASE + h[starts + j]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def twin(digest: np.ndarray, h: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """A second digest of the same stretches, from other mixings of their words."""
    return rolled((h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93), starts, size) ^ (digest >> np.uint64(7))


def minimisers(h: np.ndarray, min_words: int, window: int) -> np.ndarray:
    """Positions of retained suffixes: smallest gram of each window, the leftmost of equals."""
    grams = rolled(h, None, GRAM)
    if len(h) < min_words or len(grams) < window:
        return np.empty(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(grams, window)
    at = np.unique(view.argmin(axis=1) + np.arange(len(view)))
    return at[at + min_words - window + 1 <= len(h)]


_SUFFIX = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("mark", pa.int64()), ("pos", pa.int32())])


def _suffixes(min_words: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Words()
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                keys, at = [], []
                for text in part.column(2).to_pylist():
                    h = word_hashes(text, memo)
                    p = minimisers(h, min_words, window)
                    at.append(p)
                    keys.append(rolled(h, p, min_words - window + 1))
                n = np.array([len(p) for p in at])
                which = pa.array(np.repeat(np.arange(len(n)), n))
                key = np.concatenate(keys).view(np.int64) if keys else np.empty(0, np.int64)
                pos = np.concatenate(at).astype(np.int32) if at else np.empty(0, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(key), part.column(0).take(which), part.column(1).take(which), pa.array(pos)], schema=_SUFFIX)

    return run


_ROW = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("payload", pa.binary())])
_ROW_SQL = "block long, part int, payload binary"
#: Stands for a null document id: before all others.
NULL_ID = -(1 << 63)
#: Stretches of a block, which bounds its memory.
BLOCK = 1_500_000
#: Bytes of the documents for each part of the hash space, which bounds what a task compares: stretches of
#: that many bytes of text, each packed once for a block.
PART_BYTES = 32 << 20


def _row(block: int, part: int, payload: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([part], pa.int32()), pa.array([payload], pa.binary())], schema=_ROW)


def _stretches(min_words: int, window: int, parts: int):
    """Every stretch of ``min_words`` words that holds a candidate, hashed, in blocks of documents.

    A block emits a header (which documents, where the stretches start) and, for each part of the
    hash space, its distinct hashes with the first place of each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Words()
        back = np.arange(window)
        base, number = TaskContext.get().partitionId() << 32, 0
        docs: list[tuple[int, int, int]] = []
        starts: list[np.ndarray] = []
        hashes: list[np.ndarray] = []
        others: list[np.ndarray] = []

        def block() -> Iterator[pa.RecordBatch]:
            nonlocal number
            name = base + number
            number += 1
            n = np.array([d[2] for d in docs], np.int64)
            doc = np.repeat(np.array([d[0] for d in docs], np.int64), n)
            mark = np.repeat(np.array([d[1] for d in docs], np.int64), n)
            start, h, g = np.concatenate(starts), np.concatenate(hashes), np.concatenate(others)
            order = np.lexsort((start, mark, doc, g, h))
            new = _differs(h[order], g[order])
            first = order[new]  # the first place of each distinct hash
            group = np.empty(len(h), np.int64)
            group[order] = np.cumsum(new) - 1
            seen = np.argsort(first, kind="stable")  # distinct hashes by their first place in the block
            rank = np.empty(len(first), np.int64)
            rank[seen] = np.arange(len(first))
            first, which = first[seen], rank[group]
            times = np.bincount(which, minlength=len(first))
            home = (h[first] % np.uint64(parts)).astype(np.int32)
            same = (doc == doc[first[which]]) & (mark == mark[first[which]]) & (start == start[first[which]])
            yield _row(name, -1, _squeeze(np.array(docs, "<i8").ravel(), np.diff(start, prepend=0).astype("<i4"), np.diff(which, prepend=0).astype("<i4"), home.astype("<i4"), same.astype("<i1")))
            for p in np.unique(home).tolist():
                at = first[home == p]
                yield _row(name, p, _squeeze(h[at].astype("<u8"), g[at].astype("<u8"), doc[at].astype("<i8"), mark[at].astype("<i8"), start[at].astype("<i4"), np.minimum(times[home == p], 2).astype("<i1")))
            docs.clear()
            starts.clear()
            hashes.clear()
            others.clear()

        held = 0
        for batch in batches:
            for doc, mark, text, at in zip(*(c.to_pylist() for c in batch.columns)):
                h = word_hashes(text, memo)
                own = np.unique((np.array(at, np.int64)[:, None] - back).ravel())
                own = own[(own >= 0) & (own + min_words <= len(h))]
                if not len(own):
                    continue
                docs.append((NULL_ID if doc is None else doc, mark, len(own)))
                starts.append(own)
                hashes.append(rolled(h, own, min_words))
                others.append(twin(hashes[-1], h, own, min_words))
                held += len(own)
                if held >= BLOCK:
                    yield from block()
                    held = 0
        if docs:
            yield from block()

    return run


def _differs(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """In sorted order: whether a digest differs from its neighbour before."""
    return np.r_[True, (h[1:] != h[:-1]) | (g[1:] != g[:-1])]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For a part of the hash space: which hashes of each block occur twice or more, and which block has the first."""
    names, own = [], []
    for batch in batches:
        for block, part, payload in zip(*(c.to_pylist() for c in batch.columns)):
            if part < 0:
                yield _row(block, part, payload)
            else:
                names.append((block, part))
                own.append(_unsqueeze(payload))
    if not names:
        return
    h, g, doc, mark, start, times = (np.concatenate([np.frombuffer(x[i], t) for x in own]) for i, t in enumerate(("<u8", "<u8", "<i8", "<i8", "<i4", "<i1")))
    order = np.lexsort((start, mark, doc, g, h))
    new = _differs(h[order], g[order])
    group = np.empty(len(h), np.int64)
    group[order] = np.cumsum(new) - 1
    first = order[new]
    repeated = np.bincount(group, times.astype(np.int64)) > 1
    same = (doc == doc[first[group]]) & (mark == mark[first[group]]) & (start == start[first[group]])
    flags = (repeated[group] + 2 * same).astype("<i1")
    at = 0
    for (block, part), x in zip(names, own):
        n = len(x[0]) // 8
        yield _row(block, part, _squeeze(flags[at : at + n]))
        at += n


def _spans(min_words: int):
    """Rows come sorted by block, its header first: neighbouring stretches that match are joined."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("later", pa.bool_())])

    def spans(header: list[bytes], flags: dict[int, np.ndarray]) -> pa.RecordBatch:
        docs = np.frombuffer(header[0], "<i8").reshape(-1, 3)
        start = np.cumsum(np.frombuffer(header[1], "<i4"), dtype=np.int64)
        which = np.cumsum(np.frombuffer(header[2], "<i4"), dtype=np.int64)
        home = np.frombuffer(header[3], "<i4")
        flag = np.zeros(len(home), np.int8)
        for part, own in flags.items():
            flag[home == part] = own
        flag = flag[which]
        first = (flag >= 2) & (np.frombuffer(header[4], "<i1") == 1)
        owner = np.repeat(np.arange(len(docs)), docs[:, 2])
        cols: list[list] = [[], [], [], []]
        for later in (False, True):
            at = np.flatnonzero((flag % 2 == 1) & (first != later))
            if not len(at):
                continue
            o, s = owner[at], start[at]
            cut = np.r_[True, (o[1:] != o[:-1]) | (s[1:] > s[:-1] + min_words)]
            begin = np.flatnonzero(cut)
            end = np.r_[begin[1:], len(at)] - 1
            cols[0].append(docs[o[begin], 0])
            cols[1].append(s[begin])
            cols[2].append(s[end] + min_words)
            cols[3].append(np.full(len(begin), later))
        doc, lo, hi, later = (np.concatenate(c) if c else np.empty(0, np.int64) for c in cols)
        return pa.RecordBatch.from_arrays([pa.array(doc, mask=doc == NULL_ID), pa.array(lo), pa.array(hi), pa.array(later.astype(bool))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, header, flags = None, [], {}
        for batch in batches:
            for block, part, payload in zip(*(c.to_pylist() for c in batch.columns)):
                if part < 0:
                    if name is not None:
                        yield spans(header, flags)
                    name, header, flags = block, _unsqueeze(payload), {}
                else:
                    if block != name:
                        raise ValueError(f"block {block} has no header")
                    flags[part] = np.frombuffer(_unsqueeze(payload)[0], "<i1")
        if name is not None:
            yield spans(header, flags)

    return run


def repeated_passages(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, window: int = 16
) -> DataFrame:
    """``doc_id``, ``start``, ``stop`` (word positions, stop exclusive), ``later``: repeated passages.

    Words are runs of anything but ASCII white space.  ``later`` is false where the words are the
    corpus's first occurrence (smallest document id, then position), true elsewhere: removing the
    passages with ``later`` keeps one copy of each.  Spans of one kind that touch or overlap are one.
    A null text has no passages; documents without any have no row.  A document with a null id comes
    before all others and keeps its null.  Rows that repeat both id and text repeat each other, and
    are reported once.  Texts of any length are searched whole; a text takes memory in proportion to its
    words, and a block ends at the text that fills it.  An empty table gives no rows.  Other columns are
    not read.  The steps before the last run at once.
    """
    if min_words < window + GRAM - 1:
        raise ValueError("min_words must hold a window of grams")
    own = texts(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("mark"), "text")
    # settled, as both the counts and the places are taken from them, and so that a hot key can be split
    suffixes = settle(own.mapInArrow(_suffixes(min_words, window), "key long, doc_id long, mark long, pos int"))
    twice = settle(suffixes.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    hits = suffixes.join(twice, "key", "left_semi").groupBy("doc_id", "mark").agg(F.collect_set("pos").alias("at"))
    hits = hits.select(F.col("doc_id").alias("d"), F.col("mark").alias("m"), "at")
    met = own.join(hits, own["doc_id"].eqNullSafe(hits["d"]) & (own["mark"] == hits["m"])).select("doc_id", "mark", "text", "at")
    parts = parts_of(docs, PART_BYTES)
    blocks = met.mapInArrow(_stretches(min_words, window, parts), _ROW_SQL)
    home = F.when(F.col("part") < 0, F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int")).otherwise(F.col("part"))
    flags = blocks.repartitionById(parts, home).mapInArrow(_compare, _ROW_SQL)
    back = flags.repartition(parts, "block").sortWithinPartitions("block", "part")
    return back.mapInArrow(_spans(min_words), "doc_id long, start long, stop long, later boolean").distinct()
