"""Byte-level BPE of whole texts, worked out once for each distinct white-space chunk.

A byte-level pre-tokenizer never lets a token hold a non-space followed by a space, so a text may
be cut before every space that follows a non-space: the pieces are encoded independently and the
ids of the text are the ids of its pieces one after another.  Texts with runs of white space that
end in a space, or with special strings, are encoded whole.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The split pattern of byte-level pre-tokenization (fixed by the tokenizer format).
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A white-space character followed by a space: here the text can't be cut before each space.
RUN_BEFORE_SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}] "


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(extra)) for b in range(256)]


class ByteLevelEncoder:
    """Ids of chunks by the vocabulary file at ``path``.

    Where the file's merges are in the order of their ids (as rank vocabularies have it), chunks go
    through tiktoken's merge engine loaded with the same vocabulary; otherwise, and for texts with
    special strings, through the tokenizers library.
    """

    def __init__(self, path: str, memo_limit: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.memo_limit = memo_limit
        self.engine = self._engine(spec)
        self.forget()
        if self.engine is not None:
            #: Bytes of each token.
            self.widths = np.zeros(self.engine.n_vocab, np.int64)
            for token in self.engine.token_byte_values():
                self.widths[self.engine.encode_single_token(token)] = len(token)

    def forget(self) -> None:
        """Empty the memo of :meth:`spans`: the number of each chunk, the ids of all, where a chunk's begin and how many they are."""
        self.numbers: dict[str, int] = {}
        self.flat, self.starts, self.sizes = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    @staticmethod
    def _engine(spec: dict):
        vocab = spec["model"]["vocab"]
        added = {t["content"] for t in spec["added_tokens"]}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        order = [vocab.get(a + b, -1) for a, b in merges]
        plain = spec["pre_tokenizer"].get("type") == "ByteLevel" and not spec["pre_tokenizer"].get("add_prefix_space")
        if not plain or spec["normalizer"] or order != sorted(order) or -1 in order:
            return None
        import tiktoken

        back = {c: b for b, c in enumerate(byte_alphabet())}
        ranks = {bytes(back[c] for c in t): i for t, i in vocab.items() if t not in added}
        return tiktoken.Encoding("own", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        """Ids of a chunk or a whole text, as the tokenizers library gives them."""
        if self.engine is None or any(s in text for s in self.specials):
            return self.library.encode(text, add_special_tokens=False).ids
        return self.engine.encode_ordinary(text)

    def spans(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids known, and for each chunk where its ids begin there and how many they are.

        Chunks that begin with a space and end in none are encoded in one go: a token never holds a
        non-space followed by a space, so their ids are cut apart where the tokens' bytes fill a chunk.
        """
        if len(self.numbers) > self.memo_limit or len(self.flat) > 16 * self.memo_limit:
            self.forget()
        got = list(map(self.numbers.get, chunks))
        lost = [k for k, x in enumerate(got) if x is None]
        if lost:
            flat, sizes = [self.flat], np.zeros(len(lost), np.int64)
            free = [self.engine is not None and c[:1] == " " and not c[-1].isspace() for c in map(chunks.__getitem__, lost)]
            joined = [k for k, x in zip(lost, free) if x]
            alone = [k for k, x in zip(lost, free) if not x]
            if joined:
                ids = self.engine.encode_to_numpy("".join(map(chunks.__getitem__, joined)), disallowed_special=())
                ends = np.cumsum([len(chunks[k].encode()) for k in joined])
                cuts = np.searchsorted(np.cumsum(self.widths[ids]), ends) + 1
                sizes[: len(joined)] = np.diff(cuts, prepend=0)
                flat.append(ids)
            for at, k in enumerate(alone, len(joined)):
                ids = np.array(self.encode(chunks[k]), np.uint32)
                sizes[at] = len(ids)
                flat.append(ids)
            first = len(self.starts)
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.flat = np.concatenate(flat)
            for number, k in enumerate(joined + alone, first):
                got[k] = number
                if len(chunks[k]) <= 64:
                    self.numbers[chunks[k]] = number
        number = np.array(got, np.int64)
        return self.flat, self.starts[number], self.sizes[number]


def split_batch(texts: pa.Array, specials: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """Chunk every text of a batch.

    Returns, for the texts in their order, the code of each chunk, the distinct chunks by code, the
    document number of each chunk, and the texts that have to be encoded whole (their numbers).
    """
    texts = pc.fill_null(texts, "")
    whole = pc.match_substring_regex(texts, RUN_BEFORE_SPACE)
    for s in specials:
        whole = pc.or_(whole, pc.match_substring(texts, s))
    parts = pc.split_pattern(pc.if_else(whole, "", texts), " ")
    sizes = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    docs = np.repeat(np.arange(len(texts)), sizes)
    coded = pc.dictionary_encode(parts.flatten())
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    words = coded.dictionary.to_pylist()
    # a text's first chunk has no space before it; it gets a code of its own
    chunks = [" " + w for w in words]
    starts = np.cumsum(sizes) - sizes
    firsts = codes[starts]
    used, inverse = np.unique(firsts, return_inverse=True)
    chunks += [words[k] for k in used.tolist()]
    codes[starts] = len(words) + inverse
    return codes, chunks, docs, np.flatnonzero(whole.to_numpy(zero_copy_only=False))
