"""Secret scans through nested encodings.

Every text is the first layer of a worklist.  A layer is scanned for secrets; then its URL escapes,
Unicode escapes, base64 runs and the compressed data inside those are unwrapped, and each result is
a new layer, until none is left.  A layer that was seen before (the same text from the same places)
is not taken again, so a cycle ends.  Each layer knows where in the text it comes from: escapes map
character by character, a base64 or compressed run maps as a whole, so what is found in a layer
becomes a span of the text.

Compressed data are inflated portion by portion, each a layer that begins with the end of the one
before it, so a small text that holds a huge one needs no more memory than a few portions; nothing of
it is left out.  The worklist holds one open layer for each depth.  An escape escaped over and over (``%252525...41``) is peeled at once.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from array import array
from collections.abc import Iterator
from urllib.parse import unquote_to_bytes

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import texts

#: The kinds in their order.
KINDS = ("assign", "access", "hex")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(
    r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Runs below 16 characters fail, and a run can't hold a match that starts later, so they are not matched at all.
HEX = re.compile(r"[0-9a-f]{16,}")

#: An escape's first character escaped eight times over or more: one layer takes the whole chain off.
DEEP_URL = r"%(?:25){8,}(?=[0-9A-Fa-f]{2})"
DEEP_UNICODE = r"\\(?:u005[cC]|x5[cC]|u\{0{0,4}5[cC]\}|U0000005[cC]){8,}(?=[uxU])|&(?:#0{0,5}38;|#[xX]0{0,4}26;){8,}(?=#)"
URL = re.compile(DEEP_URL + r"|(?:%[0-9A-Fa-f]{2})+")
UNICODE = re.compile(DEEP_UNICODE + r"|\\u\{[0-9A-Fa-f]{1,6}\}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}+={0,2}")
#: Runs too short for a secret, but not for compressed data that hold one.
SHORT = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{6,15}+(?![A-Za-z0-9+/_-])")
#: What encoded runs are made of, with the line breaks inside them.
_ENCODED = bytes(sorted(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=%&#;{}\\\r\n\t "))
#: Base64 over several lines; the last may be short.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{16,}+[ \t]*+\r?\n[ \t]*+)++[A-Za-z0-9+/_-]++={0,2}")
BASE64_LINE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
LINE = re.compile(r"[^\n]+")
OPENERS = ((b"\x1f\x8b", lambda: zlib.decompressobj(31)), (b"BZh", bz2.BZ2Decompressor), (b"\xfd7zXZ\x00", lzma.LZMADecompressor))
#: Headers of zlib data: the first byte names the method and window, both together divide by 31, and no preset dictionary is asked for.
ZLIB = [re.escape(bytes((first,))) + b"[" + b"".join(re.escape(bytes((x,))) for x in range(256) if (first << 8 | x) % 31 == 0 and not x & 32) + b"]" for first in range(0x08, 0x79, 0x10)]
COMPRESSED = re.compile(b"|".join([*(re.escape(magic) for magic, _ in OPENERS), *ZLIB]), re.S)


def find(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the secrets that stand in ``text`` itself."""
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return found


#: Bytes of inflated data in a layer, and how many of them the next layer repeats at least: more, where an
#: encoded run or compressed data begin before that and go on.  All of inflated data stands for one span, so
#: a longer secret is found by its pieces.  A layer has LONGEST bytes at most, as memory must have a bound:
#: an encoded run or compressed data longer than that, themselves inside inflated data, are seen in pieces.
PORTION, OVERLAP, LONGEST = 4 << 20, 1 << 18, 16 << 20
#: Bytes that are fed to an inflater at once; where one fails, what it gave before is kept.
FEED = 4096


class Layer:
    """Text that was unwrapped, and for each character the span of the first layer it stands for.

    ``starts`` and ``ends`` are two lists, two numbers where all characters stand for one span, or None
    in the first layer.
    """

    __slots__ = ("text", "starts", "ends")

    def __init__(self, text: str, starts: list[int] | int | None, ends: list[int] | int | None):
        self.text, self.starts, self.ends = text, starts, ends

    def span(self, start: int, end: int) -> tuple[int, int]:
        if self.starts is None:
            return start, end
        if isinstance(self.starts, int):
            return self.starts, self.ends
        return self.starts[start], self.ends[end - 1]

    def mark(self) -> bytes:
        """A digest of the text and of all the places it comes from."""
        digest = hashlib.blake2b(self.text.encode("utf-8", "surrogatepass"), digest_size=16)
        for places in (self.starts, self.ends):
            digest.update(b"|" + (str(places).encode() if isinstance(places, int) else array("q", places).tobytes()))
        return digest.digest()


def _members(raw: memoryview) -> Iterator[tuple[bytes, int]]:
    """What the compressed data at the start of ``raw`` holds, in portions; (b"", n) says that a member ended after n bytes."""
    for magic, make in OPENERS:
        if bytes(raw[: len(magic)]) == magic:
            break
    else:
        if len(raw) < 3 or raw[0] & 15 != 8 or (raw[0] << 8 | raw[1]) % 31:
            return
        magic, make = b"", zlib.decompressobj
    at: int | None = 0
    while True:  # gzip, bzip2 and xz may have several members
        at = yield from _portions(make(), raw[at:], at)
        if at is None:
            return
        yield b"", at
        if not magic or bytes(raw[at : at + len(magic)]) != magic:
            return


def _portions(member, raw: memoryview, base: int) -> Iterator[tuple[bytes, int]]:
    """One member's portions; returns where it ends, or None if it breaks off or is broken."""
    for lo in range(0, len(raw), FEED):
        rest: bytes | memoryview = raw[lo : lo + FEED]
        spare = member.copy() if hasattr(member, "copy") else None
        gave = 0
        try:
            while True:
                part = member.decompress(rest, PORTION)
                if part:
                    gave += len(part)
                    yield part, base
                if member.eof:
                    return base + min(lo + FEED, len(raw)) - len(member.unused_data)
                rest = getattr(member, "unconsumed_tail", b"")
                if not rest and (len(part) < PORTION or getattr(member, "needs_input", True)):
                    break
        except (OSError, EOFError, zlib.error, lzma.LZMAError, ValueError):
            yield from _rest_of_broken(spare, raw[lo : lo + FEED], gave, base)
            return None
    return None


def _rest_of_broken(member, fed: memoryview, gave: int, base: int) -> Iterator[tuple[bytes, int]]:
    """What an inflater gives of bytes at which it fails, byte by byte, beyond what it ``gave`` already."""
    if member is None:
        return
    try:
        for i in range(len(fed)):
            rest: bytes | memoryview = fed[i : i + 1]
            while rest:
                part, rest = member.decompress(rest, PORTION), member.unconsumed_tail
                if part[gave:]:
                    yield part[gave:], base
                gave = max(0, gave - len(part))
    except (OSError, EOFError, zlib.error, ValueError):
        return


def _layers_of(raw: bytes) -> Iterator[str]:
    """The texts that bytes may stand for: UTF-8, else byte by byte; and UTF-16 where every second byte is mostly zero."""
    try:
        yield raw.decode("utf-8")
    except UnicodeDecodeError:
        yield raw.decode("latin-1")
    if raw.count(0) * 4 > len(raw):
        for name, zeros in (("utf-16-le", raw[1::2]), ("utf-16-be", raw[::2])):
            if zeros.count(0) * 2 > len(zeros):
                yield raw[: len(raw) // 2 * 2].decode(name, "replace")


def _open_start(held: bytes) -> int:
    """Where what must be seen together with what follows begins: an encoded run at the end, compressed data that haven't ended, or the last OVERLAP bytes."""
    at = len(held) - OVERLAP
    at = max(0, min(at, len(held.rstrip(_ENCODED))))
    found = 0
    while (m := COMPRESSED.search(held, found)) is not None and m.start() < at:
        found, ended = m.start() + 1, None
        try:
            for magic, make in (*OPENERS, (b"", zlib.decompressobj)):
                if held.startswith(magic, m.start()):
                    member, lo = make(), m.start()
                    while not member.eof and lo < len(held):
                        rest: bytes = held[lo : lo + FEED]
                        lo += FEED
                        while rest or not getattr(member, "needs_input", True):
                            member.decompress(rest, PORTION)
                            rest = getattr(member, "unconsumed_tail", b"")
                            if member.eof:
                                break
                    ended = min(lo, len(held)) - len(member.unused_data) if member.eof else None
                    break
        except (OSError, EOFError, zlib.error, lzma.LZMAError, ValueError):
            continue
        if ended is None:
            return m.start()
        found = max(found, ended)
    return at


def _windows(parts: Iterator[bytes]) -> Iterator[bytes]:
    """Portions as pieces, each of which repeats the end of the one before (:func:`_open_start`).

    A piece is longer than a portion only where what began in it must be seen whole.
    """
    held, fresh, most = bytearray(), False, PORTION
    for part in parts:
        held += part
        fresh = True
        if len(held) >= most:
            whole = bytes(held)
            start = _open_start(whole)
            if start < len(whole) // 2:
                if len(whole) < LONGEST:
                    most = 2 * len(whole)
                    continue
                start = len(whole) - OVERLAP
            yield whole
            held, fresh, most = bytearray(whole[start:]), False, max(PORTION, 2 * (len(whole) - start))
    if fresh:
        yield bytes(held)


def _inflated(raw: bytes, span) -> Iterator[Layer]:
    """Layers of the compressed data anywhere in ``raw``; ``span(i, j)`` is where its bytes come from.

    The data are read twice, first for where they end.  Data that break off or are broken count as far as they
    go and stand for all that follows; what follows is looked through all the same.
    """
    at = 0
    while (m := COMPRESSED.search(raw, at)) is not None:
        at = m.start() + 1
        view, size, last = memoryview(raw)[m.start() :], 0, None
        for part, read in _members(view):
            size += len(part)
            last = last if part else read
        if not size:
            continue
        end = len(raw) if last is None else m.start() + last
        for held in _windows(part for part, _ in _members(view) if part):
            yield from _opened(held, *span(m.start(), end))
        if last is not None:
            at = max(at, end)


def _opened(raw: bytes, a: int, b: int) -> Iterator[Layer]:
    """Unwrapped bytes as layers, and the compressed data in them."""
    if len(raw) >= 6:  # less is too short for a secret and for an encoded run
        for text in _layers_of(raw):
            yield Layer(text, a, b)
    yield from _inflated(raw, lambda i, j: (a, b))


def _headless(raw: bytes, a: int, b: int) -> Iterator[Layer]:
    """Layers of bytes that are one whole deflate stream without a header."""

    def parts() -> Iterator[bytes]:
        member, rest = zlib.decompressobj(-15), raw
        while not member.eof and (part := member.decompress(rest, PORTION)):
            rest = member.unconsumed_tail
            yield part
        if not member.eof or member.unused_data:
            raise zlib.error("not a whole stream")

    try:
        if not sum(map(len, parts())):
            return
    except zlib.error:
        return
    for held in _windows(parts()):
        yield from _opened(held, a, b)


def _escapes(layer: Layer, pattern: re.Pattern, decode) -> Iterator[Layer]:
    """Each line that holds escapes, with the escapes replaced."""
    for line in LINE.finditer(layer.text):
        if not pattern.search(line[0]):
            continue
        out, starts, ends, at = [], [], [], line.start()
        raw: list[bytes] = []  # the line as bytes, in which compressed data stands
        from_, to = [], []

        def keep(lo: int, hi: int) -> None:
            out.append(layer.text[lo:hi])
            for i in range(lo, hi):
                a, b = layer.span(i, i + 1)
                starts.append(a)
                ends.append(b)
                put(layer.text[i].encode("utf-8", "surrogatepass"), a, b)

        def put(data: bytes, a: int, b: int) -> None:
            raw.append(data)
            from_.extend([a] * len(data))
            to.extend([b] * len(data))

        for m in pattern.finditer(layer.text, line.start(), line.end()):
            deep = len(m[0]) > 12 and m[0].count(m[0][0]) == 1 and not (m[0][0] == "%" and len(m[0]) == 3)
            pieces = [(0, len(m[0]), m[0][0])] if deep else decode(m[0])
            if pieces is None:
                continue
            keep(at, m.start())
            for lo, hi, new in pieces:
                a, b = layer.span(m.start() + lo, m.start() + hi)
                out.append(new)
                starts += [a] * len(new)
                ends += [b] * len(new)
                if pattern is not URL:
                    put(new.encode("latin-1" if new < "\u0100" else "utf-8", "surrogatepass"), a, b)
            if pattern is URL and deep:
                put(b"%", *layer.span(m.start(), m.end()))
            elif pattern is URL:
                for k, byte in enumerate(unquote_to_bytes(m[0])):
                    put(bytes((byte,)), *layer.span(m.start() + 3 * k, m.start() + 3 * k + 3))
            at = m.end()
        keep(at, line.end())
        yield Layer("".join(out), starts, ends)
        yield from _inflated(b"".join(raw), lambda i, j: (from_[i], to[j - 1]))


def _url(run: str) -> list[tuple[int, int, str]] | None:
    raw = unquote_to_bytes(run)
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        text = raw.decode("latin-1")
        return [(3 * i, 3 * i + 3, c) for i, c in enumerate(text)]
    out, at = [], 0
    for c in text:
        n = 3 * len(c.encode("utf-8"))
        out.append((at, at + n, c))
        at += n
    return out


def _unicode(escape: str) -> list[tuple[int, int, str]] | None:
    body = escape.strip("\\uUx{}&#;X")
    code = int(body or "0", 10 if escape.startswith("&#") and escape[2] not in "xX" else 16)
    if code > 0x10FFFF or 0xD800 <= code < 0xE000:
        return None
    return [(0, len(escape), chr(code))]


def _base64(layer: Layer) -> Iterator[Layer]:
    for m in BASE64.finditer(layer.text):
        yield from _decoded(m[0], *layer.span(m.start(), m.end()))
    fresh = {run for run in SHORT.findall(layer.text) if run not in _BARREN}
    laden = {run for run in fresh if _may_inflate(run)}
    if len(_BARREN) + len(fresh) > 1 << 19:
        _BARREN.clear()
    _BARREN.update(fresh - laden)
    if laden:
        for m in SHORT.finditer(layer.text):
            if m[0] in laden:
                yield from _decoded(m[0], *layer.span(m.start(), m.end()))
    if "\n" not in layer.text:
        return
    for m in WRAPPED.finditer(layer.text):
        lines = list(BASE64_LINE.finditer(layer.text, m.start(), m.end()))
        width = [len(x[0]) for x in lines]
        at = 0
        while at < len(lines):  # lines of one width, a shorter last one, and perhaps a first one that stands after other text
            stop = at + 1
            while stop < len(lines) and width[stop] == width[at]:
                stop += 1
            end = stop + (stop < len(lines) and width[stop] < width[at])
            for first in {max(at - 1, 0), at}:
                if end - first > 1:
                    yield from _decoded("".join(x[0] for x in lines[first:end]), *layer.span(lines[first].start(), lines[end - 1].end()))
            at = stop


#: Short runs in which no start inflates, so that a common word is tried once; emptied when full.
_BARREN: set[str] = set()


def _starts(run: str) -> Iterator[bytes]:
    """A run decoded from each of four starts, as other characters of the alphabet (a path's, say) may stand before the data."""
    run = run.rstrip("=").translate(_URLSAFE)
    for skip in range(4):
        own = run[skip : len(run) - ((len(run) - skip) % 4 == 1)]
        if len(own) < 4:
            return
        try:
            yield binascii.a2b_base64(own + "=" * (-len(own) % 4))
        except (binascii.Error, ValueError):
            continue


def _may_inflate(run: str) -> bool:
    """Whether a short run may hold compressed data: a header in it, or a deflate stream from one of its starts (of literal or fixed codes, as no deflater writes codes of its own into so few bytes)."""
    for raw in _starts(run):
        if COMPRESSED.search(raw):
            return True
        if raw[0] & 6 == 2 or raw[0] & 6 == 0 and len(raw) > 5 and raw[1] ^ raw[3] == raw[2] ^ raw[4] == 255:
            try:
                member = zlib.decompressobj(-15)
                if member.decompress(raw, 64) and (member.eof or member.unconsumed_tail):
                    return True
            except zlib.error:
                pass
    return False


def _decoded(run: str, a: int, b: int) -> Iterator[Layer]:
    for raw in _starts(run):
        yield from _opened(raw, a, b)
        yield from _headless(raw, a, b)


_URLSAFE = str.maketrans("-_", "+/")


def unwrap(layer: Layer) -> Iterator[Layer]:
    """The layers directly inside a layer."""
    if "%" in layer.text and URL.search(layer.text):
        yield from _escapes(layer, URL, _url)
    if ("\\" in layer.text or "&#" in layer.text) and UNICODE.search(layer.text):
        yield from _escapes(layer, UNICODE, _unicode)
    yield from _base64(layer)


def scan(text: str) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
    """(spans in the text itself, all spans with those of the layers inside), each in order."""
    order = {k: i for i, k in enumerate(KINDS)}
    key = lambda s: (s[0], order[s[1]], s[2])
    base = sorted(find(text), key=key)
    every = set(base)
    seen = set()
    work = [unwrap(Layer(text, None, None))]
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        mark = layer.mark()
        if mark in seen:
            continue
        seen.add(mark)
        for start, kind, end in find(layer.text):
            a, b = layer.span(start, end)
            every.add((a, kind, b))
        work.append(unwrap(layer))
    return base, sorted(every, key=key)


def _spell(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


_OUT = pa.schema([("doc_id", pa.int64()), ("base", pa.string()), ("spans", pa.string()), *((f"n_{k}", pa.int64()) for k in KINDS)])


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols: list[list] = [[] for _ in _OUT]
        for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            base, every = scan(text or "")
            n = {k: 0 for k in KINDS}
            for _, kind, _ in base:
                n[kind] += 1
            for col, v in zip(cols, (name, _spell(base), _spell(every), *n.values())):
                col.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _OUT)], schema=_OUT)


def secret_scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets of each document: ``base`` spans in the text itself, all ``spans``, counts by kind.

    Spans are ``kind:start:end`` in code points, end exclusive, by start, then kind, comma-joined;
    a span found in several layers is given once.  A null or empty text has no spans (empty
    strings); a null id stays null; repeated rows are scanned each for itself; spans of one start and
    kind (ties) stand by their end; a text of any length is scanned whole, in time and memory in
    proportion to it and to what it unwraps to; an empty table gives no rows; other columns are not
    read.
    """
    return texts(docs, id_col, text_col).mapInArrow(_scan_batches, "doc_id long, base string, spans string, n_assign long, n_access long, n_hex long")
