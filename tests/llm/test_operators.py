"""Each operator on awkward documents and on none, against brute force."""

import collections
import json
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ionloom.llm import bpe, line_dedup, packing, pii, quality, queries, secrets, simhash, suffix_dedup, token_counts, vptree

BYTE = public_tokenizers.path("byte_bpe_50k.json")
WORD = public_tokenizers.path("word_bpe_49k.json")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def same(got, want):
    assert collections.Counter(map(tuple, got)) == collections.Counter(want)


def test_packing(awkward, rows):
    library = Tokenizer.from_file(BYTE)
    ids = collections.defaultdict(list)
    for i, t, *_ in rows:
        ids[i].append(library.encode(t or "", add_special_tokens=False).ids + [1])
    pieces = collections.defaultdict(list)
    bins = collections.defaultdict(list)
    for p in packing.pack(awkward, BYTE).collect():
        pieces[p.doc_id].append(p)
        bins[p.sequence_id].append((p.offset, p.length))
        assert any(p.doc_tokens == len(x) and zlib.crc32(np.array(x[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32 for x in ids[p.doc_id])
    assert {i: sum(p.length for p in v) for i, v in pieces.items()} == {i: sum(map(len, v)) for i, v in ids.items()}
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048


def test_token_counts(awkward, rows):
    library = Tokenizer.from_file(BYTE)
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t, *_ in rows]
    same(token_counts.token_counts(awkward, BYTE).collect(), want)
    same(token_counts.token_counts(awkward, BYTE, block_docs=2).collect(), want)


def test_bpe(awkward, rows):
    library = Tokenizer.from_file(WORD)
    want = []
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, tuple(ids), library.decode(ids, skip_special_tokens=False)))
    got = bpe.encode_decode(awkward, WORD).collect()
    same([(r.doc_id, tuple(r.ids), r.decoded) for r in got], want)
    import hashlib

    digests = [(i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(d.encode()).hexdigest()) for i, ids, d in want]
    same(bpe.round_trip_digests(awkward, WORD).collect(), digests)


def brute_pii(text):
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(s):
        return sum(v if i % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v) for i, v in enumerate(map(int, reversed(s)))) % 10 == 0

    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m[0])) <= 15]
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_pii(spark, awkward, rows):
    import random

    rnd = random.Random(5)
    bits = ["a", "@", "b.c", ".", "1", "23", "255", "256", "4111 1111 1111 1111", "+", "+1 (017) 555-7713", "-", " ", "(", ")", "é", "_", "\n", "00001.2.3.4"]
    made = [(100 + k, "".join(rnd.choice(bits) for _ in range(rnd.randint(1, 40)))) for k in range(400)]
    own = awkward.select("doc_id", "text").union(spark.createDataFrame(made, "doc_id long, text string"))
    want = [(i, brute_pii(t or "")) for i, t, *_ in [*rows, *made]]
    got = pii.detect(own).collect()
    same([(r.doc_id, r.base) for r in got], want)
    for r in got:
        assert set(filter(None, r.base.split(","))) <= set(r.spans.split(","))
        assert r.n_email == r.base.count("email:")


def test_pii_candidates_and_redaction(spark):
    df = spark.createDataFrame([(1, "call 555-123-4567 or joe [at] foo [dot] com, ssn 123-45-6789, on 2020-10-12 order 1234567890"), (2, "é x@y.zz!"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert "555-123-4567" not in got[1] and "foo" not in got[1] and "123-45-6789" not in got[1]
    assert "2020-10-12" in got[1] and "1234567890" in got[1]
    assert got[2] == "é <EMAIL>!" and got[3] is None
    held = pii.model(spark).held_out
    assert held["precision"] >= 0.98 and held["recall"] >= 0.8


def brute_quality(text):
    w = WORDS.findall(text)
    n = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {i + k for i in range(len(w) - 7) if n[tuple(w[i : i + 8])] > 1 for k in range(8)}
    lines = [s for s in text.split("\n") if WORDS.search(s)]
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_quality(awkward, rows):
    got = quality.quality(awkward).collect()
    same([tuple(r)[:7] for r in got], [(i, *brute_quality(t or "")) for i, t, *_ in rows])
    assert all(not r.kept for r in got if r.base_failed)


def test_stored_references_give_the_same_verdicts(awkward):
    rounded = lambda df: df.drop("class_distance", "word_distance").collect()  # noqa: E731  means are sums in any order
    same(rounded(quality.quality(awkward)), rounded(quality.quality(awkward, stored=quality.references(awkward))))


def test_divergence(spark):
    import math

    df = spark.createDataFrame([([0.5, 0.5, 0.0], [0.25, 0.25, 0.5])], "p array<double>, q array<double>")
    m = [0.375, 0.375, 0.25]
    kl = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m) if x)
    want = math.sqrt((kl([0.5, 0.5, 0.0]) + kl([0.25, 0.25, 0.5])) / 2)
    assert df.select(quality.js_distance(F.col("p"), F.col("q"))).first()[0] == pytest.approx(want)


def test_quality_tells_junk_from_prose(spark):
    from .conftest import prose

    rows = [(i, prose(i, 150), "en") for i in range(40)] + [(100, " ".join(w + "###" for w in prose(99, 150).split()), "en")]
    kept = {r.doc_id for r in quality.kept_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert kept == set(range(40))


def test_simhash(awkward, rows):
    def brute(text):
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
        w = WORDS.findall(text)
        if not w:
            return 0
        shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [(i, brute(t or "")) for i, t, *_ in rows]
    root = list(range(len(fps)))
    for _ in fps:
        root = [min(root[j] for j in range(len(fps)) if (fps[i][1] ^ fps[j][1]).bit_count() <= 4) for i in range(len(fps))]
    names = {r: min((fps[j][0] for j in range(len(fps)) if root[j] == r and fps[j][0] is not None), default=None) for r in root}
    same(simhash.near_duplicates(awkward).collect(), [(i, f"{fp:016x}", names[root[k]]) for k, (i, fp) in enumerate(fps)])


def test_one_of_each_group_stays(awkward):
    kept = simhash.keep_one(awkward, words=4)
    assert kept.columns == awkward.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "4", "7", "8", "9", "10", "11", "12"])


def brute_lines(rows):
    seen, out = [], []
    lines = []
    for i, t in sorted(rows, key=lambda r: r[0]):
        lines += [(i, k, tuple(WORDS.findall(s.lower()))) for k, s in enumerate((t or "").split("\n")) if WORDS.search(s)]

    def near(a, b):
        if min(len(a), len(b)) < 8:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) <= 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    for i, k, w in lines:
        exact = next((p for p in seen if p[2] == w), None)
        hit = exact or next((p for p in seen if near(p[2], w)), None)
        if hit:
            # a line near an earlier one points to the earliest; so does its first occurrence
            out.append((i, k, "exact" if exact else "near", hit[0], hit[1]))
        seen.append((i, k, w))
    return out


def test_lines(spark):
    import random

    rnd = random.Random(11)
    vocabulary = ["alpha", "Beta", "gamma", "delta"]
    base = [[rnd.choice(vocabulary) for _ in range(rnd.randint(7, 11))] for _ in range(12)]
    docs = []
    for i in range(30):
        lines = []
        for _ in range(5):
            w = list(rnd.choice(base))
            for _ in range(rnd.randint(0, 2)):
                k = rnd.randrange(len(w))
                w[k : k + rnd.randint(0, 1)] = rnd.choice(([], ["x%d" % rnd.randint(0, 3)]))
            lines.append(rnd.choice((" ", "  ", "\t")).join(w))
        docs.append((i, "\n".join(lines)))
    got = line_dedup.removed_lines(spark.createDataFrame(docs, "doc_id long, text string")).drop("mark").collect()
    assert len(got) > 20 and {r.kind for r in got} == {"exact", "near"}
    same(got, brute_lines(docs))


def test_lines_of_awkward_documents(awkward, rows):
    gone = line_dedup.removed_lines(awkward).collect()
    assert {(r.doc_id, r.line, r.kind) for r in gone if r.doc_id in (5, 7, None)} == {(5, 0, "exact"), (7, 1, "exact"), (None, 0, "exact")}
    out = line_dedup.dedup_lines(awkward)
    assert out.columns == awkward.columns
    text = collections.defaultdict(list)
    for r in out.collect():
        text[r.doc_id].append(r.text)
    assert 5 not in text and text[4] == [rows[3][1]] and text[7] == [rows[8][1].split("\n")[0]]
    assert text[1] == [None] and text[2] == [""] and text[None] == [None]


@pytest.mark.parametrize(("a", "b", "near"), [([1, 2], [1, 2], True), ([1, 2], [1], True), ([], [1], True), ([1, 2, 3], [1, 4, 3], True), ([1, 2, 3], [3, 2, 1], False), ([1], [1, 2, 3], False), ([1, 2, 3], [2, 3], True), ([1, 2, 3, 4], [2, 3, 4, 5], False)])
def test_edit_distance(spark, a, b, near):
    df = spark.createDataFrame([(a, b)], "a array<bigint>, b array<bigint>")
    assert df.select(line_dedup.edit_within_one(F.col("a"), F.col("b"))).first()[0] is near


def brute_passages(rows, n=50):
    words = {i: WORDS.findall(t or "") for i, t in rows}
    count, first = collections.Counter(), {}
    for i in sorted(words):
        for k in range(len(words[i]) - n + 1):
            g = tuple(words[i][k : k + n])
            count[g] += 1
            first.setdefault(g, (i, k))
    out = set()
    for i, w in words.items():
        for later in (False, True):
            span = None
            for k in range(len(w) - n + 1):
                g = tuple(w[k : k + n])
                if count[g] > 1 and (first[g] != (i, k)) is later:
                    if span and k <= span[1]:
                        span[1] = k + n
                    else:
                        out |= {(i, *span, later)} if span else set()
                        span = [k, k + n]
            out |= {(i, *span, later)} if span else set()
    return out


def test_passages(spark):
    from .conftest import prose

    shared = [prose(50 + k, n) for k, n in enumerate((49, 50, 51, 90, 200))]
    docs = [(i, " ".join([prose(i, 30 + i), shared[i % 5], prose(100 + i, 20), shared[(i + 2) % 5]])) for i in range(20)]
    got = suffix_dedup.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    same(got, list(brute_passages(docs)))


def test_passages_of_awkward_documents(awkward):
    got = {r.doc_id for r in suffix_dedup.repeated_passages(awkward).collect()}
    assert {4, 5, 6, 7, 9, None} <= got and not got & {1, 2, 3, 8, 11, 12}


def test_neighbours(spark):
    rnd = np.random.default_rng(3)
    good = [(i, [float(x) for x in rnd.normal(size=6)]) for i in range(300)]
    bad = [(1000, None), (1001, [0.0] * 6), (1002, [float("nan")] + [1.0] * 5), (1003, [float("inf")] + [1.0] * 5), (1004, [None] + [1.0] * 5), (None, [1.0] * 6), (1100, [])]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<float>").withColumn("v", F.lit(1)).withColumn("shard", F.lit(2))
    points = {r.vec_id: np.array(r.embedding, float) for r in df.where("vec_id < 1000").collect()}
    got = vptree.nearest(df, df.where("vec_id % 100 = 0"), shard_rows=64, leaf=8).collect()
    for q in (0, 100, 200):
        want = sorted((float(vptree.distances(p, points[q])), i) for i, p in points.items() if i != q)[:10]
        assert [(r.score, r.vec_id) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == want
    assert {r.query_id for r in got} == {0, 100, 200}
    few = df.where("vec_id in (0, 5)")
    assert [tuple(r)[:3] for r in vptree.nearest(few, few.where("vec_id = 0")).collect()] == [(0, 1, 5)]


def test_secrets(awkward, rows):
    got = secrets.secret_scan(awkward).collect()
    assert len(got) == len(rows) and all(r.base == "" for r in got if r.doc_id in (1, 2, 3))


def test_empty_tables(empty, spark):
    assert packing.pack(empty, BYTE).count() == 0
    assert token_counts.token_counts(empty, BYTE).count() == 0
    assert bpe.encode_decode(empty, WORD).count() == 0
    assert pii.detect(empty).count() == 0
    assert quality.quality(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0
    assert line_dedup.removed_lines(empty).count() == 0
    assert suffix_dedup.repeated_passages(empty).count() == 0
    assert secrets.secret_scan(empty).count() == 0
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vptree.nearest(none, none).count() == 0


def test_queries_are_registered():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{n}" for n in range(1, 14)]
    assert json.dumps(sorted(queries.ORACLES))


def test_more_rounds_catch_more_near_copies(spark):
    import random

    from .conftest import prose

    rnd = random.Random(4)
    rows = []
    for i in range(40):
        w = prose(300 + i, 300, 3_000).split()
        rows.append((2 * i, " ".join(w)))
        for _ in range(2):  # about one shingle in thirty goes
            w[rnd.randrange(len(w))] = "changed"
        rows.append((2 * i + 1, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    caught = {}
    for rounds in (1, 8):
        got = {r.doc_id: r.component_id for r in simhash.near_duplicates(df, words=5, rounds=rounds).collect()}
        assert all(c in (d, d - d % 2) for d, c in got.items())
        caught[rounds] = sum(c != d for d, c in got.items())
    assert caught[8] > caught[1] and caught[8] >= 36
