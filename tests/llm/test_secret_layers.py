"""Secrets in wrapped, escaped and binary layers."""

import base64
import bz2
import gzip
import lzma
import random
import zlib

import pytest

from ionloom.llm import secrets

SECRET = 'token = "AbCdEf0123456789xyz"'
LONG = ("".join(random.Random(1).choice("klmnopqrst \n") for _ in range(400)) + " " + SECRET).encode()


def wrapped(raw, width):
    run = base64.b64encode(raw).decode()
    return "\n".join(run[i : i + width] for i in range(0, len(run), width))


def found(hidden):
    text = "\u00e9 start " + hidden + " end"
    a = text.index(hidden)
    return any(k == "assign" and a <= s < e <= a + len(hidden) for s, k, e in secrets.scan(text)[1])


@pytest.mark.parametrize("width", [64, 76])
@pytest.mark.parametrize("squeeze", [gzip.compress, bz2.compress, lzma.compress, zlib.compress])
def test_compressed_base64_over_lines(width, squeeze):
    assert found(wrapped(squeeze(LONG), width))
    assert found("A" * 20 + "\n" + wrapped(squeeze(LONG), width).replace("\n", "\r\n"))


def test_a_secret_over_a_line_break_is_whole():
    raw = b"x" * 40 + SECRET.encode() + b"y" * 40
    assert found(wrapped(raw, 64))


@pytest.mark.parametrize("squeeze", [gzip.compress, bz2.compress, lzma.compress, zlib.compress])
def test_escaped_compressed_bytes(squeeze):
    raw = squeeze(SECRET.encode())
    assert found("".join(f"%{b:02X}" for b in raw))
    assert found("".join(chr(b) if chr(b).isalnum() and b < 128 else f"%{b:02X}" for b in raw))
    assert found("".join(f"\\x{b:02x}" for b in raw))


@pytest.mark.parametrize("odd", [b"\xff", b"\x01"])
def test_bytes_that_are_no_plain_text_are_scanned(odd):
    assert found(base64.b64encode(odd + SECRET.encode()).decode())


def spans(text):
    return [s for s in secrets.scan(text)[1] if s not in secrets.scan(text)[0]]


def noisy(n, seed=4):
    rnd = random.Random(seed)
    return "".join(rnd.choice("klmnopqrst \n") for _ in range(n))


@pytest.mark.parametrize("squeeze", [gzip.compress, zlib.compress])
def test_data_that_break_off_or_are_broken_count_as_far_as_they_go(squeeze):
    raw = squeeze((noisy(20_000) + " " + SECRET + " " + noisy(3_000, 5)).encode())
    run = base64.b64encode(raw[:-9]).decode()
    assert (0, "assign", len(run)) in spans(run)
    bad = bytearray(raw)
    bad[-300] ^= 0x55
    assert found(base64.b64encode(bytes(bad)).decode())


def test_short_compressed_data():
    assert spans("x eJxLTCQOAAA26w8p y") == [(2, "hex", 18)]  # zlib of 40 letters, 12 bytes
    pack = zlib.compressobj(9, zlib.DEFLATED, -15)
    raw = pack.compress(b"a" * 40) + pack.flush()
    assert len(raw) == 6 and spans("say " + base64.b64encode(raw).decode() + " now") == [(4, "hex", 12)]
    tiny = zlib.compress(b"b" * 20)
    assert len(tiny) < 16 and spans("".join(f"%{b:02x}" for b in tiny)) == [(0, "hex", 3 * len(tiny))]
    assert spans("plain words of some length, nothing hidden; Identifiers_and/paths-too") == []


def test_long_runs_inside_inflated_data_are_whole(monkeypatch):
    monkeypatch.setattr(secrets, "PORTION", 1 << 14)
    monkeypatch.setattr(secrets, "OVERLAP", 1 << 8)
    body = random.Random(5).randbytes(30_000)
    for inner in (base64.b64encode(gzip.compress(body + SECRET.encode())), gzip.compress(body + SECRET.encode())):
        outer = gzip.compress(b"some words\n" * 3_000 + inner + b"\nother words" * 3_000)
        run = base64.b64encode(outer).decode()
        assert (0, "assign", len(run)) in spans(run)
    long = gzip.compress(b"words \n" * 5_000 + b"ab" * 50_000 + b" \n" + b"token = " + b"Z" * 60_000 + b"\n")
    run = base64.b64encode(long).decode()
    assert {(0, "hex", len(run)), (0, "assign", len(run))} <= set(spans(run))


@pytest.mark.parametrize("chain", [lambda n: "%" + "25" * n + "41", lambda n: "\\" + "u005c" * n + "u0041", lambda n: "\\" + "x5c" * n + "x41", lambda n: "&" + "#38;" * n + "#65;"])
def test_deep_chains_take_time_in_proportion(chain):
    import time

    for n in (1, 7, 8, 9, 300, 25_000):
        text = "token = " + chain(n) + "bCdEf0123456789xyz"
        began = time.time()
        assert any(kind == "assign" and (a, b) == (0, len(text)) for a, kind, b in secrets.scan(text)[1])
        assert time.time() - began < 5
