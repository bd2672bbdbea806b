"""Token counts without token ids.

1. Blocks of documents are cut into pre-tokens; a block keeps, for each distinct pre-token, its
   frequency in each of its documents (pre-aggregated, so a frequent pre-token is one posting list
   per block, however many documents hold it).
2. The posting lists are dealt by pre-token.  There the pieces of each distinct pre-token are
   counted once and joined to its frequencies; what leaves is a partial sum per document and block.
3. The partial sums of a block meet again and are added up.

Posting lists and sums travel as compressed binary columns.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import BYTE_LEVEL_PATTERN, ByteLevelEncoder, split_batch
from .common import squeeze as _squeeze
from .common import parts_of, texts
from .common import unsqueeze as _unsqueeze

#: Distinct pre-tokens whose pieces a task remembers; a part has fewer, as parts grow in number with the input.
MOST_PIECES = 2_000_000

_ROW = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("payload", pa.binary())])


def _blocks(specials: list[str], parts: int, block_docs: int, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        cut = regex.compile(BYTE_LEVEL_PATTERN)
        special = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        pieces_of: dict[str, list[str]] = {}
        base = TaskContext.get().partitionId() << 32
        number = 0

        def pretokens(text: str) -> list[str]:
            if special is None or not special.search(text):
                return cut.findall(text)
            out, at = [], 0
            for m in special.finditer(text):
                out += cut.findall(text[at : m.start()]) + [m[0]]
                at = m.end()
            return out + cut.findall(text[at:])

        def block(ids: list, texts_: pa.Array) -> Iterator[pa.RecordBatch]:
            nonlocal number
            codes, chunks, docs, whole = split_batch(texts_, specials)
            key, freq = np.unique(docs * len(chunks) + codes, return_counts=True)
            docs, codes = key // max(1, len(chunks)), key % max(1, len(chunks))
            names: dict[str, int] = {}
            flat: list[int] = []
            sizes = []
            if len(pieces_of) > 120_000:
                pieces_of.clear()
            for chunk in chunks:
                own = pieces_of.get(chunk)
                if own is None:
                    own = cut.findall(chunk)
                    if len(chunk) <= 64:
                        pieces_of[chunk] = own
                sizes.append(len(own))
                flat += [names.setdefault(p, len(names)) for p in own]
            size = np.array(sizes, np.int64)
            first = np.cumsum(size) - size
            n = size[codes]
            ends = np.cumsum(n)
            where = np.repeat(first[codes] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
            tok = [np.array(flat, np.int64)[where]]
            doc, freq = [np.repeat(docs, n)], [np.repeat(freq, n)]
            for k in whole.tolist():
                own = [names.setdefault(p, len(names)) for p in pretokens(texts_[k].as_py())]
                tok.append(np.array(own, np.int64))
                doc.append(np.full(len(own), k))
                freq.append(np.ones(len(own), np.int64))
            key = np.concatenate(tok) * len(ids) + np.concatenate(doc)
            order = np.argsort(key, kind="stable")
            key, freq = key[order], np.concatenate(freq)[order]
            at = np.flatnonzero(np.diff(key, prepend=-1))
            freq = np.add.reduceat(freq, at) if len(at) else freq
            key = key[at]
            tok_, doc_ = key // max(1, len(ids)), key % max(1, len(ids))
            spelled = [p.encode("utf-8", "surrogatepass") for p in names]
            home = np.array([zlib.crc32(p) % parts for p in spelled], np.int64)
            lists = np.bincount(tok_, minlength=len(spelled))
            stops = np.cumsum(lists)
            mine = [[] for _ in range(parts)]
            for t, h in enumerate(home.tolist()):
                mine[h].append(t)
            n_bytes = np.array([len(t.encode("utf-8")) if t else 0 for t in texts_.to_pylist()], "<i8")
            head = json.dumps(ids).encode()
            name = base + number
            number += 1
            rows = [(name, -1, _squeeze(head, n_bytes))]
            for h in range(parts):
                if mine[h]:
                    own = np.array(mine[h])
                    n = lists[own]
                    ends = np.cumsum(n)
                    where = np.repeat(stops[own] - ends, n) + np.arange(ends[-1])
                    lens = np.array([len(spelled[t]) for t in mine[h]], "<i4")
                    rows.append((name, h, _squeeze(lens, b"".join(spelled[t] for t in mine[h]), n.astype("<i4"), doc_[where].astype("<i4"), freq[where].astype("<i4"), np.array([len(ids)], "<i8"))))
            for lo in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[lo : lo + 64]), _ROW)], schema=_ROW)

        ids: list = []
        held: list[pa.Array] = []
        size = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids += part.column(0).to_pylist()
                held.append(part.column(1).fill_null(""))
                size += held[-1].nbytes
                if len(ids) >= block_docs or size >= block_bytes:
                    yield from block(ids, pa.concat_arrays(held))
                    ids, held, size = [], [], 0
        if ids:
            yield from block(ids, pa.concat_arrays(held))

    return run


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ByteLevelEncoder(path, memo_limit=0)
        n_pieces: dict[bytes, int] = {}
        for batch in batches:
            for block, part, payload in zip(*(c.to_pylist() for c in batch.columns)):
                if part >= 0:
                    lens, spelled, lists, docs, freq, n_docs = _unsqueeze(payload)
                    at, counts = 0, []
                    for size in np.frombuffer(lens, "<i4").tolist():
                        p = spelled[at : at + size]
                        at += size
                        n = n_pieces.get(p)
                        if n is None:
                            if len(n_pieces) >= MOST_PIECES:
                                n_pieces.clear()
                            n = n_pieces[p] = len(encoder.encode(p.decode("utf-8", "surrogatepass")))
                        counts.append(n)
                    weight = np.repeat(np.array(counts, np.int64), np.frombuffer(lists, "<i4"))
                    sums = np.zeros(int(np.frombuffer(n_docs, "<i8")[0]), "<i8")
                    np.add.at(sums, np.frombuffer(docs, "<i4"), weight * np.frombuffer(freq, "<i4"))
                    payload = _squeeze(sums)
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([part], pa.int32()), pa.array([payload], pa.binary())], schema=_ROW)

    return run


def _total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block, its header first."""
    ids: list = []
    n_bytes = sums = None
    name = None

    def done():
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n_bytes), pa.array(sums)], names=["doc_id", "n_bytes", "n_tokens"])

    for batch in batches:
        for block, part, payload in zip(*(c.to_pylist() for c in batch.columns)):
            if part < 0:
                if name is not None:
                    yield done()
                name = block
                head, sizes = _unsqueeze(payload)
                ids, n_bytes = json.loads(head), np.frombuffer(sizes, "<i8").astype(np.int64)
                sums = np.zeros(len(ids), np.int64)
            else:
                if block != name:
                    raise ValueError(f"block {block} has no header")
                sums = sums + np.frombuffer(_unsqueeze(payload)[0], "<i8")
    if name is not None:
        yield done()


def token_counts(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    specials: tuple[str, ...] = ("<|endoftext|>",),
    limit: int = 1024,
    block_docs: int = 8192,
    block_bytes: int = 10 << 20,
) -> DataFrame:
    """UTF-8 bytes and tokens of each text, and whether the tokens are over ``limit``.

    A null or empty text has 0 bytes and 0 tokens; a null id stays null; repeated rows are counted
    each for itself; an empty table gives no rows; other columns are not read.  ``specials`` are the
    strings that the tokenizer takes as one special token wherever they stand.  ``block_docs`` and
    ``block_bytes`` bound a block's memory, not what is counted.
    """
    parts = parts_of(docs)
    row = "block long, part int, payload binary"
    lists = texts(docs, id_col, text_col).mapInArrow(_blocks(list(specials), parts, block_docs, block_bytes), row)
    home = F.when(F.col("part") < 0, F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int")).otherwise(F.col("part"))
    sums = lists.repartitionById(parts, home).mapInArrow(_count(tokenizer_path), row)
    met = sums.repartition(parts, "block").sortWithinPartitions("block", "part")
    counts = met.mapInArrow(_total, "doc_id long, n_bytes long, n_tokens long")
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
