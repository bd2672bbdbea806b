"""Packing of token streams into fixed-length training sequences.

Documents are dealt at random to tasks and, within a task, taken in groups of about
``group_tokens`` tokens.  Each group is packed by itself: every full ``capacity`` of a long
document is a sequence of its own, and the remainders are placed by first-fit decreasing, where a
tournament tree over the bins' free capacities finds the first bin that still fits in logarithmic
time.  Then the emptiest bins are cut up to fill the gaps of the others, so at most one sequence of
a group is padded.  A group is the unit of memory, so nothing grows with the corpus.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import ByteLevelEncoder, split_batch
from .common import texts

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class CapacityTree:
    """A tournament tree: each node holds the largest free capacity of the bins below it."""

    def __init__(self, bins: int, capacity: int):
        self.width = 1
        while self.width < max(1, bins):
            self.width *= 2
        self.best = [capacity] * (2 * self.width)

    def first_fit(self, need: int) -> int:
        """The first bin with at least ``need`` free, from which ``need`` is then taken; -1 if none."""
        best, node = self.best, 1
        if best[1] < need:
            return -1
        while node < self.width:
            node *= 2
            if best[node] < need:
                node += 1
        found = node - self.width
        best[node] -= need
        while node > 1:
            node //= 2
            left, right = best[2 * node], best[2 * node + 1]
            best[node] = left if left > right else right
        return found


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Item numbers of each bin; sizes are from 1 to ``capacity``; ties keep their order."""
    tree = CapacityTree(len(sizes), capacity)
    bins: list[list[int]] = []
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = tree.first_fit(sizes[item])
        if at == len(bins):
            bins.append([])
        bins[at].append(item)
    return bins


def pack_group(lengths: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document number, start, length) that hold every token of the group once."""
    full, rest = [], []
    for i, n in enumerate(lengths):
        full += [[(i, s, capacity)] for s in range(0, n - capacity + 1, capacity)]
        if n % capacity:
            rest.append((i, n - n % capacity, n % capacity))
    bins = [[rest[k] for k in b] for b in first_fit_decreasing([r[2] for r in rest], capacity)]
    done, loose = [], []
    for b in bins:
        (done if sum(p[2] for p in b) == capacity else loose).append(b)
    loose.sort(key=lambda b: -sum(p[2] for p in b))
    low, high = 0, len(loose) - 1
    while low < high:  # the emptiest bin is cut into the gaps of the fullest ones
        gap = capacity - sum(p[2] for p in loose[low])
        while gap and low < high:
            doc, start, size = loose[high].pop()
            cut = min(gap, size)
            loose[low].append((doc, start, cut))
            gap -= cut
            if cut < size:
                loose[high].append((doc, start + cut, size - cut))
            if not loose[high]:
                high -= 1
        if not gap:
            low += 1
    return full + done + [b for b in loose[: high + 1] if b]


def _pack_partition(path: str, capacity: int, group_tokens: int, end_id: int | None, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ByteLevelEncoder(path)
        sequence = TaskContext.get().partitionId() << 40
        ids: list[bytes] = []
        names: list[int | None] = []
        held = 0

        def flush():
            nonlocal sequence, held
            cols: list[list] = [[] for _ in range(8)]
            for pieces in pack_group([len(x) // 4 for x in ids], capacity):
                offset = 0
                for doc, start, size in pieces:
                    own = ids[doc][4 * start : 4 * (start + size)]
                    for col, v in zip(cols, (names[doc], start, size, zlib.crc32(own), len(ids[doc]) // 4, sequence, offset)):
                        col.append(v)
                    if with_ids:
                        cols[7].append(np.frombuffer(own, dtype="<u4").astype(np.int32))
                    offset += size
                sequence += 1
            arrays = [pa.array(c, type=pa.int64()) for c in cols[:7]]
            fields = SCHEMA.replace(" long", "").split(", ")
            if with_ids:
                arrays.append(pa.array(cols[7], type=pa.list_(pa.int32())))
                fields.append("ids")
            ids.clear()
            names.clear()
            held = 0
            return pa.RecordBatch.from_arrays(arrays, names=fields)

        tail = b"" if end_id is None else int(end_id).to_bytes(4, "little")
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                for name, own in zip(part.column(0).to_pylist(), encode_batch(encoder, part.column(1))):
                    own += tail
                    if not own:
                        continue
                    ids.append(own)
                    names.append(name)
                    held += len(own) // 4
                    if held >= group_tokens:
                        yield flush()
        if ids:
            yield flush()

    return run


def encode_batch(encoder: ByteLevelEncoder, column: pa.Array) -> list[bytes]:
    """The ids of each text, as little-endian unsigned 32-bit integers."""
    codes, chunks, docs, whole = split_batch(column, encoder.specials)
    flat, starts, sizes = encoder.spans(chunks)
    n = sizes[codes]
    ends = np.cumsum(n)
    where = np.repeat(starts[codes] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
    ids = flat[where].astype("<u4")
    stops = np.zeros(len(column) + 1, np.int64)
    np.add.at(stops, docs + 1, n)
    stops = np.cumsum(stops)
    raw = ids.tobytes()
    out = [raw[4 * a : 4 * b] for a, b in zip(stops[:-1].tolist(), stops[1:].tolist())]
    for k in whole.tolist():
        out[k] = np.array(encoder.encode(column[k].as_py()), dtype="<u4").tobytes()
    return out


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 2048,
    group_tokens: int = 1 << 21,
    end_id: int | None = 1,
    seed: int = 17,
    with_ids: bool = False,
) -> DataFrame:
    """Pack ``docs`` into sequences of at most ``capacity`` tokens; a row for each piece.

    A null text counts as empty: only its end id is packed (nothing, without an end id).  A null
    id stays null.  Repeated rows are documents of their own.  Documents of any length are cut into
    as many sequences as they need.  An empty table gives no rows.  Other columns are not read.
    ``sequence_id`` is unique; pieces lie in a sequence one after another from offset 0.
    ``with_ids`` adds the token ids of each piece.
    """
    # sorted, so that a task that runs again packs the same sequences
    dealt = texts(docs, id_col, text_col).withColumn("deal", F.rand(seed)).repartition("deal").sortWithinPartitions("deal", "doc_id").select("doc_id", "text")
    schema = SCHEMA + (", ids array<int>" if with_ids else "")
    return dealt.mapInArrow(_pack_partition(tokenizer_path, capacity, group_tokens, end_id, with_ids), schema)
