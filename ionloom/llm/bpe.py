"""BPE encoding and decoding as streaming transducers with bounded lookahead.

Encoding a word by a merge list is a rewriting in rank order, and text to the right of a position
can change the tokens before it only through a chain of merges of rising rank, each of which takes
in the token to its left.  The longest such chain follows from the merge list alone
(:func:`sufficient_lookahead`): once that many symbols beyond a token have been read, no further
input can change it, so it is emitted and forgotten.  What the transducer keeps is the symbols of
one lookahead window, however long the text is.  Decoding is a state machine over tokens: between
two tokens it holds at most an unfinished byte sequence.

Words up to a window's length are rewritten in one step, and their ids and decoded bytes are kept
in a memo of bounded size.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .chunks import byte_alphabet
from .common import texts

#: Characters read at a time from a long text.
READ = 1 << 14
#: Blocks of old and settled characters, for which this Python's tables and the tokenizer library's are
#: alike; pre-tokens of anything else are cut by the library itself, whose tables may be newer or older.
SETTLED = r"[\x00-\u024f\u0391-\u03a1\u03a3-\u03a9\u03b1-\u03c9\u0410-\u044f\u05d0-\u05ea\u0621-\u063a\u0641-\u064a\u2010-\u2027\u2030-\u203a\u20ac\u3041-\u3094\u30a1-\u30fa\u4e00-\u9fa5]*"


def sufficient_lookahead(merges: list[tuple[str, str]]) -> int:
    """Symbols to read beyond a token before it can't change any more.

    A merge of rank r moves the place up to which two inputs agree left by the length of its left
    token; that merge's right token must start, on its left spine, with the left token of the
    merge before it in the chain.  ``reach`` keeps the furthest move by the token it ends at.
    """
    left: dict[str, str] = {}
    size: dict[str, int] = {}
    reach: dict[str, int] = {}
    longest = 1

    def length(token: str) -> int:
        return size.get(token) or (1 if token not in left else len(token))

    for a, b in merges:
        spine, best = b, reach.get(b, 0)
        while spine in left:
            spine = left[spine]
            best = max(best, reach.get(spine, 0))
        reach[a] = max(reach.get(a, 0), length(a) + best)
        left.setdefault(a + b, a)
        size[a + b] = length(a) + length(b)
        longest = max(longest, size[a + b])
    return max(reach.values(), default=0) + longest


class WordTransducer:
    """Ids of one pre-token, fed symbol by symbol in any portions."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        self.vocab, self.suffix = vocab, suffix
        #: a pair's key -> its rank, and rank -> the merged token's id
        self.ranks = {(vocab[a] << 20) | vocab[b]: r for r, (a, b) in enumerate(merges)}
        self.merged = [vocab[a + b] for a, b in merges]
        self.length = {i: len(t.removesuffix(suffix)) if suffix and t.endswith(suffix) and len(t) > len(suffix) else len(t) for t, i in vocab.items()}
        self.lookahead = sufficient_lookahead(merges)

    def rewrite(self, ids: list[int]) -> list[int]:
        """Apply the merges to symbols, lowest rank first and from the left."""
        get, none, merged = self.ranks.get, len(self.merged), self.merged
        if len(ids) > 256:  # many at once: a merged token can't take part in a merge of lower rank
            while len(ids) > 1:
                ranks = [get((a << 20) | b, none) for a, b in zip(ids, ids[1:])]
                low = min(ranks)
                if low == none:
                    break
                new, out, i, last = merged[low], [], 0, len(ids) - 1
                while i <= last:
                    if i < last and ranks[i] == low:
                        out.append(new)
                        i += 2
                    else:
                        out.append(ids[i])
                        i += 1
                ids = out
            return ids
        ranks = [get((a << 20) | b, none) for a, b in zip(ids, ids[1:])]
        ids = list(ids)
        while ranks:
            low = min(ranks)
            if low == none:
                break
            i = ranks.index(low)
            new = ids[i] = merged[low]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get((ids[i - 1] << 20) | new, none)
            if i < len(ranks):
                ranks[i] = get((new << 20) | ids[i + 1], none)
        return ids

    def stream(self, portions: Iterable[str]) -> Iterator[list[int]]:
        """Ids of the word whose symbols come in portions; each list is final when it is given."""
        vocab, buffer, held = self.vocab, [], ""
        for portion in portions:
            if not portion:
                continue
            symbols = held + portion
            held = symbols[-1]  # the last symbol of a word carries the suffix, so it waits
            buffer += [vocab[s] for s in symbols[:-1]]
            if len(buffer) > 2 * self.lookahead + 64:
                stable = len(buffer) - self.lookahead
                done, at = [], 0
                for token in self.rewrite(buffer):
                    if at + self.length[token] > stable:
                        break
                    done.append(token)
                    at += self.length[token]
                if done:
                    yield done
                    del buffer[:at]
        if held:
            yield self.rewrite(buffer + [vocab[held + self.suffix]])


class Codec:
    """A tokenizer file's encoder and decoder as transducers over portions of text.

    Understands files with a BPE model over the byte alphabet, normalizers NFC, Replace of white
    space and Lowercase, and the pre-tokenizers Split and ByteLevel.
    """

    def __init__(self, path: str, memo_limit: int = 400_000):
        import regex

        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.settled = regex.compile(SETTLED)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("continuing_subword_prefix"):
            raise ValueError("a BPE model over the byte alphabet is needed")
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.vocab: dict[str, int] = model["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in (self.vocab | self.specials).items()}
        self.transducer = WordTransducer(self.vocab, merges, model.get("end_of_word_suffix") or "")
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) or r"(?!)")
        steps = spec["normalizer"] or {"type": "Sequence", "normalizers": []}
        self.steps = steps.get("normalizers", [steps])
        for s in self.steps:
            if s["type"] not in ("NFC", "Lowercase") and s.get("content") != " ":
                raise ValueError(f"normalizer {s['type']} isn't known")
        pre = spec["pre_tokenizer"]
        pres = pre.get("pretokenizers", [pre])
        splits = [p["pattern"]["Regex"] for p in pres if p["type"] == "Split"]
        from .chunks import BYTE_LEVEL_PATTERN

        self.cut = regex.compile(splits[0] if splits else BYTE_LEVEL_PATTERN)
        self.drops_space = bool(splits)
        self.spaces = regex.compile(r"\s+")
        self.lowers = any(s["type"] == "Lowercase" for s in self.steps)
        self.alphabet = byte_alphabet()
        self.bytes_of = {c: b for b, c in enumerate(self.alphabet)}
        self.joins = spec["decoder"] is None
        self.memo: dict[str, tuple[bytes, bytes]] = {}
        self.word_memo: dict[str, tuple[bytes, bytes]] = {}
        self.memo_limit = memo_limit

    # encoding

    def normalize(self, text: str) -> str:
        if text.isascii() and self.drops_space:  # pre-tokens hold no white space: it needn't be joined
            return text.lower() if self.lowers else text
        for s in self.steps:
            if s["type"] == "NFC":
                text = unicodedata.normalize("NFC", text)
            elif s["type"] == "Lowercase":  # letter by letter, without the rule for a final sigma
                text = text.replace("Σ", "σ").lower()
            else:
                text = self.spaces.sub(" ", text)
        return text

    def words(self, text: str) -> list[str]:
        """Pre-tokens of text without special strings."""
        text = self.normalize(text)
        return [text] if text.isalpha() and self.drops_space else self.cut.findall(text)

    def spelled(self, text: str) -> Iterator[str]:
        """The pre-tokens in symbols of the byte alphabet."""
        if self.settled.fullmatch(text):
            for word in self.words(text):
                yield "".join([self.alphabet[b] for b in word.encode("utf-8")])
        else:
            even = self.library.normalizer.normalize_str(text) if self.library.normalizer else text
            for symbols, _ in self.library.pre_tokenizer.pre_tokenize_str(even):
                yield symbols

    def encode_stretch(self, text: str) -> Iterator[list[int]]:
        """Ids of text without special strings, a list for each stable stretch."""
        for symbols in self.spelled(text):
            yield from self.transducer.stream(symbols[i : i + READ] for i in range(0, len(symbols), READ))

    def encode_chunk(self, chunk: str) -> Iterator[list[int]]:
        at = 0
        for m in self.special.finditer(chunk):
            yield from self.encode_stretch(chunk[at : m.start()])
            yield [self.specials[m[0]]]
            at = m.end()
        yield from self.encode_stretch(chunk[at:])

    def chunks(self, text: str) -> Iterator[str]:
        """Pieces of a text that are encoded independently, as words never hold white space; cut portion by portion."""
        if not self.drops_space:
            yield text
            return
        at = 0
        while at < len(text):
            stop = text.find(" ", at + READ)
            stop = len(text) if stop < 0 else stop
            yield from text[at:stop].split(" ")
            at = stop + 1

    def round_trip(self, text: str) -> Iterator[tuple[bytes, bytes]]:
        """The text's ids (little-endian, 32 bits) and decoded bytes, portion by portion."""
        memo = self.memo
        if len(memo) > self.memo_limit:
            memo.clear()
        decoder = Decoder(self)
        for chunk in self.chunks(text):
            known = memo.get(chunk)
            if known is not None:
                yield known[0], decoder.follow(known[1])
            elif len(chunk) <= 64 and self.joins:
                known = memo[chunk] = self.short_chunk(chunk)
                yield known[0], decoder.follow(known[1])
            else:
                for ids in self.encode_chunk(chunk):
                    yield np.array(ids, "<u4").tobytes(), decoder.feed(ids)
        yield b"", decoder.end()

    def short_chunk(self, chunk: str) -> tuple[bytes, bytes]:
        """Ids and decoded bytes of a chunk, with a memo of its words."""
        if self.special.search(chunk) or not self.settled.fullmatch(chunk):
            ids = [i for part in self.encode_chunk(chunk) for i in part]
            return np.array(ids, "<u4").tobytes(), Decoder(self).feed(ids)
        memo, got = self.word_memo, []
        if len(memo) > self.memo_limit:
            memo.clear()
        for word in self.words(chunk):
            known = memo.get(word)
            if known is None:
                alphabet, ids = self.alphabet, []
                for part in self.transducer.stream(("".join([alphabet[b] for b in word.encode("utf-8")]),)):
                    ids += part
                token = self.token
                known = memo[word] = (array("I", ids).tobytes(), " ".join([token[i] for i in ids]).encode("utf-8"))
            got.append(known)
        return b"".join([g[0] for g in got]), b" ".join([g[1] for g in got])

    # whole values, for callers that want them

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(b"".join(ids for ids, _ in self.round_trip(text)), "<u4").tolist()

    def decode(self, ids: Iterable[int]) -> str:
        decoder = Decoder(self)
        return (decoder.feed(ids) + decoder.end()).decode("utf-8")


class Decoder:
    """Tokens to UTF-8 text, portion by portion.

    With a byte-level decoder the state is the unfinished UTF-8 sequence at the end of what came;
    bytes that are no UTF-8 become U+FFFD.  Without one, tokens are joined by a space and the state
    is whether one came before.
    """

    def __init__(self, codec: Codec):
        self.codec = codec
        self.begun = False
        self.utf8 = None if codec.joins else codecs.getincrementaldecoder("utf-8")("replace")

    def follow(self, joined: bytes) -> bytes:
        """Go on with tokens that are decoded already."""
        if not joined:
            return b""
        out = b" " + joined if self.begun else joined
        self.begun = True
        return out

    def feed(self, ids: Iterable[int]) -> bytes:
        token = self.codec.token
        if self.codec.joins:
            return self.follow(" ".join([token[i] for i in ids]).encode("utf-8"))
        back = self.codec.bytes_of
        raw = b"".join(t.encode("utf-8") if (t := token[i]) in self.codec.specials else bytes([back[c] for c in t]) for i in ids)
        return self.utf8.decode(raw).encode("utf-8")

    def end(self) -> bytes:
        return b"" if self.utf8 is None else self.utf8.decode(b"", True).encode("utf-8")


def _map(path: str, schema: pa.Schema, make):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows = [(name, *make(codec, text or "")) for name, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def encode_decode(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, token ``ids`` and the text ``decoded`` from them, for each document.

    A null or empty text has no ids and decodes to the empty text; a null id stays null; repeated
    rows are encoded each for itself; pairs of equal rank merge from the left; a text of any length is
    encoded whole, portion by portion; an empty table gives no rows; other columns are not read.
    """

    def make(codec: Codec, text: str):
        parts = list(codec.round_trip(text))
        return np.frombuffer(b"".join(p[0] for p in parts), "<u4").astype(np.int32), b"".join(p[1] for p in parts).decode("utf-8")

    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])
    return texts(docs, id_col, text_col).mapInArrow(_map(tokenizer_path, schema, make), "doc_id long, ids array<int>, decoded string")


def round_trip_digests(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of :func:`encode_decode`'s ids and texts, taken portion by portion as they stream.

    Empty cases as there: 0 tokens and the digests of nothing.
    """

    def make(codec: Codec, text: str):
        ids, decoded, n = hashlib.sha256(), hashlib.sha256(), 0
        held: list[tuple[bytes, bytes]] = []

        def drain() -> int:
            raw = b"".join([h[0] for h in held])
            ids.update(raw)
            decoded.update(b"".join([h[1] for h in held]))
            held.clear()
            return len(raw) // 4

        for portion in codec.round_trip(text):
            held.append(portion)
            if len(held) >= 4096:
                n += drain()
        n += drain()
        return n, ids.hexdigest(), decoded.hexdigest()

    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    return texts(docs, id_col, text_col).mapInArrow(_map(tokenizer_path, schema, make), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
