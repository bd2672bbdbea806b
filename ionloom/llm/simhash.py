"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most ``radius`` bits share a variant: a word that differs from
each in at most half of that.  So every distinct fingerprint stands for the ball of its variants
within half the radius, variants are dealt by value, and fingerprints that meet on one are linked.

A ball has 2,081 variants at radius 4, so they are not written out before the shuffle: the first
bits of a variant are its bucket, a fingerprint is sent once to each bucket its ball touches (56 of
1,024 at 10 bits, 211 of a million at 20) with the flips that are left, and the variants inside a
bucket are listed there.  The number of bits grows with the number of fingerprints, so that a bucket
holds at most about :data:`BUCKET` of them.  A bucket whose variants exceed ``LIST`` is split on its next bits.  Copies collapse
to one fingerprint beforehand, and within a bucket the links of a set are cut to a spanning forest,
so a large group of copies never becomes pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, settle, texts
from .components import components

BITS = 64
#: Fingerprints that a bucket holds on average at most, and the fewest bits of a bucket.
BUCKET, LEAST_BITS = 500_000, 10
#: Variants listed at a time.
LIST = 4_000_000


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """The SimHash of a text's word shingles: a bit is 1 if over half the shingles' hashes have it."""
    return fingerprints(text, words, seed)[0]


#: Odd multipliers that turn a shingle's hash into another one, for further rounds (fixed values).
REMIX = tuple(np.uint64(m) for m in (1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))


def _remixed(h: np.ndarray, r: int) -> np.ndarray:
    if r == 0:
        return h
    h = (h ^ (h >> np.uint64(31))) * REMIX[r]
    return h ^ (h >> np.uint64(29))


def fingerprints(text: str | None, words: int, seed: int, rounds: int = 1) -> list[int]:
    """The SimHash by the shingles' hashes, and by further hashes made from them for each further round."""
    import xxhash

    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return [0] * rounds
    joined = b" ".join(tokens)
    digest = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return [int(_remixed(np.array([digest(joined, seed)], np.uint64), r)[0]) for r in range(rounds)]
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1
    ends = np.cumsum(sizes)
    starts = (ends - sizes)[: len(tokens) - words + 1].tolist()
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist())], dtype="<u8")
    out = []
    for r in range(rounds):
        ones = np.zeros(BITS, np.int64)
        for lo in range(0, len(hashes), 8192):
            part = _remixed(hashes[lo : lo + 8192], r)
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0]))
    return out


def _fingerprints(words: int, seed: int, rounds: int):
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("more", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprints(t, words, seed, rounds) for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64).reshape(-1, rounds)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps[:, 0]), pa.array(list(fps[:, 1:]), pa.list_(pa.int64()))], schema=schema)

    return run


def flips(bits: int, most: int) -> list[np.ndarray]:
    """For each number of flips up to ``most``, the masks of so many of the lowest ``bits`` bits."""
    return [np.array([sum(1 << b for b in c) for c in combinations(range(bits), k)], dtype=np.uint64) for k in range(most + 1)]


_SENT = pa.schema([("bucket", pa.int64()), ("left", pa.int32()), ("fps", pa.binary())])


def _send(half: int, bucket_bits: int):
    """Each fingerprint to the buckets that its ball touches, with the flips left for the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = flips(bucket_bits, half)
        for batch in batches:
            fps = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False)).view(np.uint64)
            head = fps >> np.uint64(BITS - bucket_bits)
            rows: list[tuple] = []
            for used, own in enumerate(masks):
                buckets = (head[:, None] ^ own[None, :]).ravel()
                order = np.argsort(buckets, kind="stable")
                buckets, sent = buckets[order], np.repeat(fps, len(own))[order]
                cuts = np.flatnonzero(np.diff(buckets)) + 1
                for b, part in zip(buckets[np.r_[0, cuts]].tolist() if len(buckets) else [], np.split(sent, cuts)):
                    rows.append((int(b), half - used, part.astype("<u8").tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SENT)], schema=_SENT)

    return run


def meet(fps: np.ndarray, left: np.ndarray, prefix: int, known: int) -> Iterator[np.ndarray]:
    """Pairs of positions in ``fps`` that share a variant whose first ``known`` bits are ``prefix``.

    ``left``: the flips that each may still make in the other bits.
    """
    rest = BITS - known
    most = int(left.max(initial=0))
    counts = np.array([sum(len(m) for m in flips(min(rest, 6), k)) if rest <= 6 else 1 + rest * (k > 0) + rest * (rest - 1) // 2 * (k > 1) for k in range(most + 1)])
    if most <= 2 and counts[left].sum() > LIST and rest > 8:
        bits = 4  # split on the next bits
        head = (fps >> np.uint64(rest - bits)) & np.uint64((1 << bits) - 1)
        for sub in range(1 << bits):
            spent = np.bitwise_count(head ^ np.uint64(sub)).astype(np.int64)
            at = np.flatnonzero(spent <= left)
            if len(at) > 1:
                for pairs in meet(fps[at], left[at] - spent[at], (prefix << bits) | sub, known + bits):
                    yield at[pairs]
        return
    low = fps & np.uint64((1 << rest) - 1)
    masks = flips(rest, most)
    keys, owners = [], []
    for k in range(most + 1):
        at = np.flatnonzero(left == k)
        if len(at):
            own = np.concatenate(masks[: k + 1])
            keys.append((low[at][:, None] ^ own[None, :]).ravel())
            owners.append(np.repeat(at.astype(np.int32), len(own)))
    if not keys:
        return
    key, owner = np.concatenate(keys), np.concatenate(owners)
    order = np.argsort(key)
    key = key[order]
    same = np.flatnonzero(key[1:] == key[:-1])
    if len(same):
        a, b = owner[order[same]].astype(np.int64), owner[order[same + 1]].astype(np.int64)
        code = np.unique(np.minimum(a, b) << 32 | np.maximum(a, b))
        yield np.stack([code >> 32, code & 0xFFFFFFFF], axis=1)


def _meet_buckets(radius: int, bucket_bits: int):
    """Rows come sorted by bucket; a bucket's links are cut to a spanning forest."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(bucket: int, held: list[tuple[int, bytes]]) -> pa.RecordBatch | None:
        fps = np.concatenate([np.frombuffer(p, "<u8") for _, p in held])
        left = np.concatenate([np.full(len(p) // 8, k) for k, p in held])
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.get(x, x) != x:
                parent[x] = parent.get(parent[x], parent[x])
                x = parent[x]
            return x

        for pairs in meet(fps, left, bucket, bucket_bits):
            near = np.bitwise_count(fps[pairs[:, 0]] ^ fps[pairs[:, 1]]) <= radius
            for a, b in pairs[near].tolist():
                parent.setdefault(a, a)
                parent.setdefault(b, b)
                x, y = root(a), root(b)
                if x != y:
                    parent[max(x, y)] = min(x, y)
        nodes = [x for x in parent if root(x) != x]
        if not nodes:
            return None
        signed = fps.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(signed[[root(x) for x in nodes]]), pa.array(signed[nodes])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = None, []
        for batch in batches:
            for bucket, left, fps in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != name:
                    if held and (out := links(name, held)):
                        yield out
                    name, held = bucket, []
                held.append((left, fps))
        if held and (out := links(name, held)):
            yield out

    return run


def bucket_bits_for(n: int, half: int) -> int:
    """Bits of a bucket for ``n`` fingerprints, of which each goes to all buckets within ``half`` flips."""
    bits = LEAST_BITS
    while bits < 32 and n * sum(comb(bits, k) for k in range(half + 1)) > BUCKET << bits:
        bits += 1
    return bits


def near_links(fps: DataFrame, radius: int = 4, bucket_bits: int | None = None) -> DataFrame:
    """``a``, ``b``: links between distinct fingerprints ``fp`` that span each set within reach.

    ``radius`` must be even: then any two that share a variant are within it, so neighbours in the
    variant's list stand for all of them.  The fingerprints are counted at once.
    """
    if radius % 2:
        raise ValueError("the radius must be even")
    half, n = radius // 2, fps.count()
    bucket_bits = bucket_bits or bucket_bits_for(n, half)
    sent_bytes = 8 * n * sum(comb(bucket_bits, k) for k in range(half + 1))
    parts = max(8, int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(1 << bucket_bits, sent_bytes >> 26))
    sent = fps.select("fp").mapInArrow(_send(half, bucket_bits), "bucket long, left int, fps binary")
    dealt = sent.repartition(parts, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(_meet_buckets(radius, bucket_bits), "a long, b long")


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4, seed: int = 42, rounds: int = 1
) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` for each row of ``docs``.

    Letters A-Z are lower-cased; words are runs of anything but ASCII white space; a text of fewer
    words than a shingle is one shingle; a null, empty or blank text has fingerprint zero and links
    like any other.  Fingerprints link at ``radius`` or fewer differing bits, and a component's id
    is the smallest ``doc_id`` that can be reached (null ids are passed over; a component of null
    ids only has a null id).  Repeated rows each have their row.  An empty table gives no rows.
    Whole texts of any length count.  Other columns are not read.  Steps before the last run at once.
    ``rounds`` above 1 links by further fingerprints from other hashes of
    the same shingles too, which catches copies that one fingerprint happens to set further apart.
    """
    fps = settle(texts(docs, id_col, text_col).mapInArrow(_fingerprints(words, seed, rounds), "doc_id long, fp long, more array<long>"))
    nodes = settle(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    links = near_links(nodes, radius)
    if rounds > 1:  # documents are told apart by their first fingerprint
        links = settle(links)
        also = settle(fps.select("fp", F.posexplode("more").alias("r", "g")).distinct())
        stands = settle(also.groupBy("r", "g").agg(F.min("fp").alias("b")))
        links = links.union(also.join(stands, ["r", "g"]).where("fp <> b").select(F.col("fp").alias("a"), "b"))
        for r in range(rounds - 1):
            own = stands.where(F.col("r") == r).select("g", "b")
            near = settle(near_links(own.select(F.col("g").alias("fp")), radius))
            one = near.join(own.select(F.col("g").alias("a"), F.col("b").alias("x")), "a").join(own.select(F.col("g").alias("b"), F.col("b").alias("y")), "b")
            links = links.union(one.select(F.col("x").alias("a"), F.col("y").alias("b")))
    tree = components(links)
    # the smallest doc_id of each component of several fingerprints
    member = tree.select(F.col("node").alias("fp"), "root").union(tree.select(F.col("root").alias("fp"), "root").distinct())
    named = nodes.join(member, "fp").groupBy("root").agg(F.min("first").alias("component_id"))
    linked = member.join(named, "root").select("fp", "component_id", F.lit(True).alias("linked"))
    placed = settle(
        nodes.join(linked, "fp", "left").select("fp", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("first")).alias("component_id"))
    )
    discard(docs.sparkSession, nodes, tree)
    return fps.join(placed, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, radius: int = 4, seed: int = 42, rounds: int = 1) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that of the smallest id.

    Rows of one id whose texts aren't near are documents of their own; in a group, equal ids go by a
    hash of the text.  Rows without an id go by a hash of their text, after all ids.  Columns stay as
    they are.
    """
    names = docs.columns
    text = docs[text_col].cast("string")
    # stands in for a null id: above all ids up to 2**62
    spare = F.lit(1 << 62) + F.pmod(F.xxhash64(text), F.lit(1 << 61))
    mark = F.coalesce(F.xxhash64(text), F.lit(0))  # tells texts of one id apart
    rows = docs.select(
        F.coalesce(docs[id_col].cast("long"), spare).alias("_id"), mark.alias("mark"), text.alias("_text"), F.struct(*(docs[c] for c in names)).alias("_row")
    )
    # texts stand for themselves: their marks are grouped, and a group's smallest id is looked up after
    found = near_duplicates(rows.select("mark", "_text").distinct(), id_col="mark", text_col="_text", words=words, radius=radius, seed=seed, rounds=rounds)
    groups = found.select(F.col("doc_id").alias("mark"), "component_id").distinct()
    own = rows.select("_id", "mark").distinct().join(groups, "mark")
    chosen = settle(own.groupBy("component_id").agg(F.min(F.struct("_id", "mark")).alias("one")).select("one._id", "one.mark"))
    kept = rows.join(chosen, ["_id", "mark"], "left_semi")
    one = kept.groupBy("_id", "mark").agg(F.min_by("_row", "mark").alias("_row"))
    return one.select(*(F.col("_row")[c].alias(c) for c in names))
