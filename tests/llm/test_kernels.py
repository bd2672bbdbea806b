"""Kernels against brute force, without Spark."""

import base64
import gzip
import random
import re

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ionloom.llm import bpe, chunks, packing, pii, secrets, simhash, suffix_dedup, vptree


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_bpe_equals_the_library(name):
    codec, library = bpe.Codec(public_tokenizers.path(name)), Tokenizer.from_file(public_tokenizers.path(name))
    rnd = random.Random(2)
    pieces = ["a", "b", "the", "er", "ing", " ", "  ", "é", "ß", "1", "'s", "!", "<|endoftext|>", "日", "\n", "Σ", "İ", "é"]
    cases = ["", " ", "a" * 4000, "ab" * 2500 + "c", "the" * 3000] + ["".join(rnd.choice(pieces) for _ in range(rnd.choice((4, 40, 2500)))) for _ in range(60)]
    for text in cases:
        ids = library.encode(text, add_special_tokens=False).ids
        assert codec.encode(text) == ids
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_transducer_keeps_a_bounded_buffer():
    codec = bpe.Codec(public_tokenizers.path("word_bpe_49k.json"))
    t = codec.transducer
    text = "".join(random.Random(4).choice("abcdethingr") for _ in range(20_000))
    parts = list(t.stream(text[i : i + 7] for i in range(0, len(text), 7)))
    assert len(parts) > 5  # emitted on the way, not at the end
    whole = t.rewrite([codec.vocab[c] for c in text[:-1]] + [codec.vocab[text[-1] + "</w>"]])
    assert [i for p in parts for i in p] == whole


def test_chunked_ids_equal_the_library():
    import pyarrow as pa

    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, library = chunks.ByteLevelEncoder(path), Tokenizer.from_file(path)
    texts = ["", " ", "  two", "a  b", "a \n b", "x\n y z", "end ", "<|endoftext|> a", "it's 12 é", None, "\x1c x", "a  b c"]
    got = packing.encode_batch(encoder, pa.array(texts, pa.string()))
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_packing_places_every_token_once():
    rnd = random.Random(1)
    for _ in range(20):
        lengths = [rnd.choice((1, 5, rnd.randint(1, 300), 64, 128, 1000)) for _ in range(rnd.randint(1, 60))]
        bins = packing.pack_group(lengths, 64)
        seen = {}
        for b in bins:
            assert 0 < sum(p[2] for p in b) <= 64
            for doc, start, size in b:
                seen.setdefault(doc, []).extend(range(start, start + size))
        assert {d: sorted(v) for d, v in seen.items()} == {d: list(range(n)) for d, n in enumerate(lengths)}
        assert sum(sum(p[2] for p in b) < 64 for b in bins) <= 1


def test_first_fit_decreasing_is_that():
    rnd = random.Random(3)
    sizes = [rnd.randint(1, 50) for _ in range(200)]
    plain: list[list[int]] = []
    for i in sorted(range(200), key=lambda i: -sizes[i]):
        for b in plain:
            if sum(sizes[j] for j in b) + sizes[i] <= 64:
                b.append(i)
                break
        else:
            plain.append([i])
    assert packing.first_fit_decreasing(sizes, 64) == plain


def test_meeting_finds_every_link_within_radius():
    rnd = np.random.default_rng(5)
    centers = rnd.integers(0, 1 << 63, 12, dtype=np.uint64)
    fps = []
    for c in centers:
        for _ in range(8):
            x = int(c)
            for b in rnd.choice(64, rnd.integers(0, 6), replace=False):
                x ^= 1 << int(b)
            fps.append(x)
    fps = np.unique(np.array(fps, np.uint64))
    pairs = {tuple(sorted(p)) for part in simhash.meet(fps, np.full(len(fps), 2), 0, 0) for p in part.tolist()}
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def classes(links):
        root[:] = range(len(fps))
        for a, b in links:
            root[max(find(a), find(b))] = min(find(a), find(b))
        return [find(i) for i in range(len(fps))]

    near = [(i, j) for i in range(len(fps)) for j in range(i) if np.bitwise_count(fps[i] ^ fps[j]) <= 4]
    assert near and classes(pairs) == classes(near)


def test_meeting_splits_large_buckets(monkeypatch):
    rnd = np.random.default_rng(6)
    base = rnd.integers(0, 1 << 63, 300, dtype=np.uint64)
    fps = np.unique(np.r_[base, base ^ np.uint64(5)])
    whole = {tuple(sorted(p)) for part in simhash.meet(fps, np.full(len(fps), 2), 0, 0) for p in part.tolist()}
    monkeypatch.setattr(simhash, "LIST", 20_000)
    split = {tuple(sorted(p)) for part in simhash.meet(fps, np.full(len(fps), 2), 0, 0) for p in part.tolist()}
    assert len(whole) >= 300 and split == whole


def test_vantage_tree_is_exact_at_slack_one_and_recalls_beyond():
    rnd = np.random.default_rng(7)
    points = rnd.normal(size=(1500, 8))
    points[10] = points[11]  # a tie
    names = np.arange(1500)
    tree = vptree.VantageTree(points, 16)
    queries = points[::50]
    d = np.stack([vptree.distances(points, q) for q in queries])
    d[np.arange(len(queries)), names[::50]] = np.inf
    want = np.lexsort((np.broadcast_to(names, d.shape), d), axis=1)[:, :10]
    _, found = tree.search(queries, names[::50], names, 10, 1.0)
    assert (found == want).all()
    _, loose = tree.search(queries, names[::50], names, 10, 1.5)
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(loose, want)]) >= 0.9


SECRET = 'token = "AbCdEf0123456789xyz"'
B64 = lambda s: base64.b64encode(s if isinstance(s, bytes) else s.encode()).decode()


@pytest.mark.parametrize("hidden", [B64(SECRET), B64(gzip.compress(SECRET.encode())), B64(B64(SECRET)), "".join(f"%{b:02X}" for b in SECRET.encode()), "".join(f"\\u{b:04x}" for b in SECRET.encode()), "".join(f"%{b:02x}" for b in B64(SECRET).encode())])
def test_hidden_secrets_map_to_the_text(hidden):
    text = "é start " + hidden + " end"
    base, every = secrets.scan(text)
    assert base == []
    a = text.index(hidden)
    assert any(k == "assign" and a <= s < e <= a + len(hidden) for s, k, e in every)


def test_base_secrets_equal_the_patterns():
    rnd = random.Random(8)
    bits = ["token", "API_key", "secret", '"', "'", " = ", ":", "=", "AbC123+/", "AKIA", "ABCDEFGHIJKLMNOPQ", "deadbeef", "0123456789abcdef", " ", "\n", "é", "%41", "=="]
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for _ in range(2000):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randint(1, 30)))
        want = [(m.start(), "assign", m.end()) for m in assign.finditer(text) if len(m[2]) >= 12]
        want += [(m.start(), "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
        want += [(m.start(), "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
        assert secrets.scan(text)[0] == sorted(want, key=lambda s: (s[0], secrets.KINDS.index(s[1])))


def test_clean_text_has_no_secrets():
    assert secrets.scan("Internationalization counterrevolutionaries 100%25 sure \\ud800 &#99999999;") == ([], [])


def test_minimisers_agree_in_copies():
    rnd = np.random.default_rng(9)
    shared = rnd.integers(0, 1 << 63, 50, dtype=np.uint64)
    a, b = (np.concatenate([rnd.integers(0, 1 << 63, n, dtype=np.uint64), shared, rnd.integers(0, 1 << 63, 60, dtype=np.uint64)]) for n in (33, 71))
    in_a = {int(x) - 33 for x in suffix_dedup.minimisers(a, 50, 16) if 33 <= x <= 33 + 15}
    in_b = {int(x) - 71 for x in suffix_dedup.minimisers(b, 50, 16) if 71 <= x <= 71 + 15}
    assert in_a & in_b


def test_trees_learn_and_calibrate():
    rnd = np.random.default_rng(1)
    x = rnd.integers(0, 5, size=(800, 3)).astype(float)
    y = ((x[:, 0] > 2) ^ (x[:, 1] > 2)).astype(float)
    trees = pii.Trees().fit(x, y)
    assert trees.held_out["precision"] >= 0.97 and trees.held_out["recall"] >= 0.9


def test_unknown_chunks_are_encoded_in_one_go(monkeypatch):
    encoder = chunks.ByteLevelEncoder(public_tokenizers.path("byte_bpe_50k.json"), memo_limit=300)
    rnd = random.Random(5)
    piece = lambda: "".join(rnd.choice(["a", "the", "ing", "é", "日", "\n", "\t", "\u3000", "'s", "1", "!", "😀", "\x1c"]) for _ in range(rnd.choice((1, 3, 90))))
    alone, encode = [], encoder.encode
    monkeypatch.setattr(encoder, "encode", lambda c: alone.append(c) or encode(c))
    for _ in range(6):  # over the memo's limit, too
        some = ["", " ", "x", *{" " + piece() for _ in range(200)}, *{piece() for _ in range(9)}]
        flat, starts, sizes = encoder.spans(some)
        for c, at, n in zip(some, starts.tolist(), sizes.tolist()):
            assert flat[at : at + n].tolist() == encode(c)
    assert {c for c in alone if c[:1] == " " and not c[-1].isspace()} == set()
