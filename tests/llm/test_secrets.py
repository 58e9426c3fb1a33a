"""Secrets behind repeated, nested, long and hostile encodings."""

from __future__ import annotations

import gzip
import time
import zlib
from base64 import b64encode

import pytest

from palimpsest.llm import secrets

SECRET = "api_key = 'ABCDEFGHIJKL1234'"


def kinds(text: str) -> list[str]:
    return [k for k, *_ in secrets.find_secrets_in(text)]


def test_each_copy_is_found():
    one = b64encode(SECRET.encode()).decode()
    assert [(k, a) for k, a, *_ in secrets.find_secrets_in(f"first {one} second {one}")] == [("base64.assign", 6), ("base64.assign", 13 + len(one) + 1)]


@pytest.mark.parametrize("filler", [b" " * 17_000_000, b"A" * 18_000_000 + b"\n", b"stone water garden " * 1_000_000])
def test_streams_are_read_to_their_end(filler):
    assert "base64.zip.assign" in kinds(b64encode(zlib.compress(filler + SECRET.encode())).decode())


@pytest.mark.parametrize("cut", range(1, 60, 7))
def test_windows_cut_nothing(monkeypatch, cut):
    monkeypatch.setattr(secrets, "WINDOW", 1024)
    text = "x " * 500 + " " * cut + SECRET.replace(" = ", " = " + " " * 3000) + " and more"
    assert "base64.zip.assign" in kinds(b64encode(zlib.compress(text.encode())).decode())


def test_compressed_again_and_again():
    data = SECRET.encode()
    for _ in range(50):
        data = zlib.compress(data)
    assert kinds(b64encode(data).decode()) == ["base64." + "zip." * 50 + "assign"]
    assert kinds(b64encode(gzip.compress(b"nothing ") + gzip.compress(SECRET.encode())).decode()) == ["base64.zip.assign"]


def test_broken_streams_give_what_they_hold():
    assert kinds(b64encode(zlib.compress(SECRET.encode())[:-4]).decode()) == ["base64.zip.assign"]


def test_a_stream_that_inflates_to_itself_ends(monkeypatch):
    monkeypatch.setattr(secrets, "inflated", lambda chunks: iter([b"\x78\x9c" + SECRET.encode()]))
    assert "base64.zip.assign" in kinds(b64encode(b"\x78\x9cabcdefghijklmnop").decode())


@pytest.mark.parametrize("text", ["x" * 1_000_000 + " \\u0041 ", "x" * 1_000_000 + "%41", "%" + "25" * 200_000 + "41", "\\u005c" * 100_000, "%41" * 300_000, "token " * 200_000, "%20=" * 100_000])
def test_long_words_take_no_long_time(text):
    began = time.time()
    secrets.find_secrets_in(text)
    assert time.time() - began < 8


def test_only_what_decoding_touched_is_reported_again():
    assert kinds("go ?token=ABCDEFGHIJKLMNOP&n=a%20b now") == ["assign"]


def test_a_keyword_meets_its_escaped_value():
    found = secrets.find_secrets_in('{"password": "\\u0061\\u0062cdefghijklmnop"} token = %41%42cdefghijklmn')
    assert [(k, a, b) for k, a, b, *_ in found] == [("unicode.assign", 2, 40), ("url.assign", 43, 69)]


PLAIN = ("some words before it; " + SECRET + " and after it, so that lines are wrapped").encode()


def wrapped(data: bytes, width: int = 76, end: str = "\n") -> str:
    text = b64encode(data).decode()
    return end.join(text[i : i + width] for i in range(0, len(text), width))


@pytest.mark.parametrize("before", ["data/", "https://x.example/", "blob_", "a-", "x", "xy", "key/id_"])
def test_runs_behind_other_characters(before):
    assert "base64.assign" in kinds(before + b64encode(PLAIN).decode())
    assert "base64.zip.assign" in kinds(before + b64encode(zlib.compress(PLAIN)).decode())
    assert "base64.zip.assign" in kinds(before + b64encode(gzip.compress(PLAIN)).decode())


@pytest.mark.parametrize("after", ["", "x", "xy", "_tail", "/a/b"])
def test_runs_before_other_characters(after):
    assert "base64.assign" in kinds(b64encode(PLAIN).decode().rstrip("=") + after)


@pytest.mark.parametrize("odd", [b"\0", b"\x1b", b"\xff", b"\xc3", "\u00fc".encode()])
def test_layers_with_odd_bytes(odd):
    for data in (odd + PLAIN, PLAIN + odd, b"first" + odd + PLAIN):
        assert kinds(b64encode(data).decode()) == ["base64.assign"]
        assert kinds(b64encode(zlib.compress(data)).decode()) == ["base64.zip.assign"]


@pytest.mark.parametrize("width", [16, 20, 21, 33, 64, 76])
@pytest.mark.parametrize("end", ["\n", "\r\n", "\n    "])
def test_wrapped_lines(width, end):
    for data, kind in ((PLAIN, "base64.assign"), (zlib.compress(PLAIN), "base64.zip.assign"), (b64encode(PLAIN), "base64.base64.assign")):
        assert kind in kinds("see\n" + wrapped(data, width, end) + "\nend")


def test_a_secret_in_one_line_of_several_is_reported_once():
    text = wrapped(b"a line of words. " * 10 + SECRET.encode() + b" more words" * 20, 400)
    assert kinds(text) == ["base64.assign"]


def test_places_of_decoded_spans():
    text = "see blob_" + b64encode(PLAIN).decode()
    (kind, a, b, *_), = secrets.find_secrets_in(text)
    whole = 9 + PLAIN.index(b"api_key") * 4 // 3
    assert kind == "base64.assign" and a == whole and b <= len(text) and b - a <= len(SECRET) * 4 // 3 + 2
    one = wrapped(PLAIN, 40)
    (kind, a, b, *_), = secrets.find_secrets_in(one)
    assert one[a:b].count("\n") == 1 and one[a:b].replace("\n", "") in b64encode(PLAIN).decode()


def test_long_base64_in_a_stream(monkeypatch):
    monkeypatch.setattr(secrets, "WINDOW", 1 << 12)
    monkeypatch.setattr(secrets, "LONGEST_WORD", 1 << 14)
    import numpy as np

    noise = np.random.default_rng(5).integers(33, 127, 60_000).astype("u1").tobytes()
    inner = zlib.compress(noise + b"\n" + SECRET.encode())
    for data, kind in ((inner, "base64.zip.base64.zip.assign"), (noise + b"\n" + SECRET.encode(), "base64.zip.base64.assign")):
        outer = b"words " * 3000 + b64encode(data) + b" words" * 3000
        assert kind in kinds(b64encode(zlib.compress(outer)).decode())


def test_24_million_characters_without_a_blank():
    data = zlib.compress(b"A" * 9_000_000 + SECRET.encode(), 0)
    data += b"\0" * (18_000_000 - len(data))
    assert "base64.zip.base64.zip.assign" in kinds(b64encode(zlib.compress(b64encode(data), 1)).decode())


def test_two_thousand_streams_in_each_other():
    data = SECRET.encode()
    for _ in range(2000):
        data = zlib.compress(data)
    assert kinds(b64encode(data).decode()) == ["base64." + "zip." * 2000 + "assign"]
