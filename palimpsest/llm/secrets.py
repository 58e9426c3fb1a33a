"""Secret scans with a recursive decoding worklist.

The raw text is layer 0 and gives the base spans. Each layer is unwrapped to new layers, which are scanned and unwrapped in
turn until nothing new appears:

- all URL escapes, or all \\uXXXX escapes, of a layer decoded, the rest as it stands, so that a plain keyword and its
  escaped value meet; escapes of the escape character itself (``%2525..41``) are undone in one step;
- each base64 run, a byte for a character: if it is text as a whole, that; else, from each of its four first characters, what
  holds a stretch of text, so that a run is read behind ``data/`` or ``blob_``, with a stray character and with a few odd bytes;
- base64 that goes on over lines, of which the spans across a line end are reported, the others by the line itself;
- what zlib or gzip data inflates to, wherever in a run it begins, in windows of bounded size, and again while that is
  compressed itself.

Content is not entered again at the same place of the raw text, so loops end, and nor is a stream that inflates to one
of its own ancestors; equal segments at several places are found at each. Layers map their characters to places of the raw
text, so a secret three layers deep is reported where it stands in the input, with the layers in its kind, as in
``base64.url.assign``; a secret in a stream has the place of the stream. Every decoding step of a reported span has touched
one of its characters: what a layer shares with the one above is reported once.

Work is linear in the decoded sizes, but for streams of more than a window inside each other: each is inflated from the
outermost again. A stream is never held whole. A base64 run in a stream that is longer than ``LONGEST_WORD`` is decoded as a
stream of its own. Windows of other words of that length, and of escapes in them, repeat ``OVERLAP`` characters.
"""

from __future__ import annotations

import binascii
import hashlib
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Generator, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import map_rows
from palimpsest.llm.pii import SPAN_TYPE, digest_columns

BASE_KINDS = ("assign", "access", "hex")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_HINTS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}+")

URL_ESCAPE = re.compile(r"%(?:25)*([0-9A-Fa-f]{2})")
URL_ESCAPES = re.compile(r"(?:%(?:25)*[0-9A-Fa-f]{2})++")
UNICODE_ESCAPE = re.compile(r"\\u(?:005[Cc]u)*([0-9A-Fa-f]{4})")
#: Shorter runs are words more often than data; 16 characters hold 12 bytes, the least that a base kind reports.
BASE64_RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}+={0,2}")
BASE64_LINES = re.compile(r"[A-Za-z0-9+/_-]{16,}+(?:\r?\n[ \t]*+[A-Za-z0-9+/_-]++)*+={0,2}")
LINE_END = re.compile(r"\r?\n[ \t]*")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
IN_ALPHABET = re.compile(rb"[A-Za-z0-9+/_-]*+")
TO_STANDARD = str.maketrans("-_", "+/")
#: The first bytes of gzip, and of zlib at its four levels, in base64.
STREAM_HEAD = re.compile(r"H4sI|eA[E-H]|eF[4-7]|eJ[w-z]|eN[o-r]")
#: Characters of decoded base64 that do not count as text, and the least stretch that a base kind or an encoding takes.
NOT_TEXT = re.compile(r"[^\x09\x0A\x0D\x20-\x7E\xA0-\U0010FFFF]")
STRETCH = re.compile(rb"[\x20-\x7E]{12}")
#: Bytes that are inflated at once; characters that a window repeats of the one before, more than any keyword, separator
#: and least value take; the longest run without white space that is kept in one window of an inflated stream.
WINDOW, OVERLAP, LONGEST_WORD = 1 << 20, 256, 16 << 20
BLANKS = re.compile(" {3,}")


def scan(text: str) -> Iterator[tuple[str, int, int]]:
    """Leftmost non-overlapping matches per kind that are long enough."""
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= 12:
                yield "assign", m.start(), m.end()
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= 18:
                yield "access", m.start(), m.end()
    for m in HEX.finditer(text):
        yield "hex", m.start(), m.end()


class Unescaped:
    """A text with its escapes decoded, and where its parts come from."""

    def __init__(self, text: str, escapes: re.Pattern, decode: Callable[[re.Match], str]):
        parts, self.starts, self.sources, self.decoded, at, size = [], [], [], [0], 0, 0
        for m in escapes.finditer(text):
            for part, a, b, of in ((text[at : m.start()], at, m.start(), 0), (decode(m), m.start(), m.end(), 1)):
                if part:
                    parts.append(part)
                    self.starts.append(size)
                    self.sources.append((a, b, of))
                    self.decoded.append(self.decoded[-1] + of)
                    size += len(part)
            at = m.end()
        if at < len(text):
            parts.append(text[at:])
            self.starts.append(size)
            self.sources.append((at, len(text), 0))
            self.decoded.append(self.decoded[-1])
        self.text = "".join(parts)

    def place(self, x: int, y: int) -> tuple[int, int] | None:
        """Where the characters x to y, y exclusive, come from; None if none of them was decoded."""
        i, j = bisect_right(self.starts, x) - 1, bisect_left(self.starts, y) - 1
        if self.decoded[j + 1] == self.decoded[i]:
            return None
        (a, _, first), (b, stop, last) = self.sources[i], self.sources[j]
        return a if first else a + x - self.starts[i], stop if last else b + y - self.starts[j]


class Decoded:
    """Where the bytes of a base64 run come from: a run at ``start``, of which ``skipped`` characters are not read; in a run
    over lines, the positions behind its line ends and how many characters these took up to there."""

    def __init__(self, start: int, skipped: int, ends: list[int] | None = None, taken: list[int] | None = None):
        self.start, self.skipped, self.ends, self.taken = start, skipped, ends, taken

    def place(self, x: int, y: int) -> tuple[int, int] | None:
        """None if the bytes x to y, y exclusive, are those of one line of several."""
        a, b = self.skipped + x * 4 // 3, self.skipped - (-y * 4 // 3)
        if self.ends:
            i, j = bisect_right(self.ends, a), bisect_left(self.ends, b)
            if i == j:
                return None
            a, b = a + self.taken[i], b + self.taken[j]
        return self.start + a, self.start + b


@dataclass
class Layer:
    text: str
    names: str = ""
    steps: tuple[Unescaped | Decoded, ...] = ()  #: from the raw text, or from what ``inside`` holds, to this one
    inside: tuple[int, int] | None = None  #: place of the raw text that holds the stream this layer is in
    whole: tuple[int, int] | None = None  #: place of the raw text that the layer was decoded from, if not all of it

    def place(self, x: int, y: int) -> tuple[int, int] | None:
        """Where the characters stand in the raw text; None if one of the steps did not touch them."""
        for step in reversed(self.steps):
            if (at := step.place(x, y)) is None:
                return None
            x, y = at
        return self.inside or (x, y)


@dataclass
class Stream:
    """Bytes that ``read`` gives from their start, as often as it is called."""

    read: Callable[[], Iterator[bytes]]
    names: str
    place: tuple[int, int]
    ancestors: frozenset[bytes] = frozenset()


def from_url(m: re.Match) -> str:
    return bytes.fromhex("".join(URL_ESCAPE.findall(m[0]))).decode("utf-8", "replace")


def from_unicode(m: re.Match) -> str:
    """A lone surrogate cannot be text and becomes the replacement character."""
    c = chr(int(m[1], 16))
    return c if not 0xD800 <= ord(c) <= 0xDFFF else "�"


def from_base64(body: str) -> bytes:
    """A last character that is no byte yet is left out."""
    body = body[: len(body) - (len(body) % 4 == 1)]
    return binascii.a2b_base64(body + "=" * (-len(body) % 4))


def pieces(body: str, start: int) -> Iterator[bytes]:
    """The bytes of a base64 run from a character on, few at first, since most starts prove to be none."""
    size = 1024
    while start < len(body):
        yield from_base64(body[start : start + size])
        start, size = start + size, WINDOW


def run_at(chunks: Iterator[bytes], start: int) -> Iterator[bytes]:
    """The base64 run that begins at a place of a stream."""
    for chunk in chunks:
        if start >= len(chunk):
            start -= len(chunk)
            continue
        part = IN_ALPHABET.match(chunk, start)[0]
        yield part
        if start + len(part) < len(chunk):
            return
        start = 0


def decoded(chunks: Iterator[bytes], skipped: int) -> Iterator[bytes]:
    """The bytes of a base64 run that comes in parts."""
    rest = ""
    for chunk in chunks:
        text = rest + chunk.decode("ascii").translate(TO_STANDARD)
        text, skipped = text[skipped:], max(0, skipped - len(text))
        whole = len(text) // 4 * 4
        yield from_base64(text[:whole])
        rest = text[whole:]
    yield from_base64(rest)


def is_compressed(head: bytes) -> bool:
    """zlib or gzip by its first bytes."""
    return head[:2] == b"\x1f\x8b" or (len(head) > 2 and head[0] == 0x78 and (head[0] * 256 + head[1]) % 31 == 0)


def inflated(chunks: Iterator[bytes]) -> Generator[bytes, None, int | None]:
    """The content of a zlib or gzip stream, gzip members one after the other, up to its end or to where it is broken. Of one
    that ends as it should, the number of its bytes is returned."""
    stream, given = zlib.decompressobj(47), 0
    for chunk in chunks:
        given += len(chunk)
        while chunk or stream.eof:
            if stream.eof:
                chunk = stream.unused_data + chunk
                if chunk[:2] != b"\x1f\x8b":
                    return given - len(chunk)
                stream = zlib.decompressobj(47)
            try:
                out = stream.decompress(chunk, WINDOW)
            except zlib.error:
                return None
            chunk = stream.unconsumed_tail
            if out:
                yield out
            elif not chunk and not (stream.eof and stream.unused_data):
                break
    return None


def noting_end(stream: Iterator[bytes], ended: list[int]) -> Iterator[bytes]:
    if size := (yield from stream):
        ended.append(size)


def windows(chunks: Iterator[bytes], long_runs: list[int]) -> Iterator[str]:
    """The stream as texts, a character for a byte, that end at white space. Each repeats the end of the one before, so that
    nothing a scan looks for is cut; longer runs of blanks are shortened, since places inside a stream are not asked for.
    Base64 runs that had to be cut are noted by their start."""
    held, size, read, cut_run = [], 0, 0, False
    for chunk in chunks:
        read += len(chunk)
        part = BLANKS.sub("  ", chunk.decode("latin-1"))
        held.append(part)
        size += len(part)
        if size < WINDOW:
            continue
        space = max(part.rfind(" "), part.rfind("\n"))
        if space >= 0 or size > LONGEST_WORD:
            text = "".join(held)
            cut = len(text) - len(part) + space + 1 if space >= 0 else len(text)
            yield text[:cut]
            run = 0 if space >= 0 else len(text) - len(text.rstrip(ALPHABET))
            if run > OVERLAP and not (cut_run and run == len(text)):
                long_runs.append(read - run)
            cut_run = run > OVERLAP
            held = [text[max(0, cut - OVERLAP) :]]
            size = len(held[0])
    yield "".join(held)


def contents(stream: Stream) -> Iterator[Layer | Stream]:
    """The layers that a stream holds: its windows, base64 runs longer than these, and what it inflates to."""
    digest, held, size, long_runs = hashlib.blake2b(), [], 0, []

    def noted() -> Iterator[bytes]:
        nonlocal size
        for c in stream.read():
            digest.update(c)
            if size < 3 or size + len(c) <= WINDOW:
                held.append(c)
            size += len(c)
            yield c

    for text in windows(noted(), long_runs):
        if text:
            yield Layer(text, stream.names, (), stream.place, stream.place)
    if digest.digest() in stream.ancestors:
        return
    ancestors, read = stream.ancestors | {digest.digest()}, stream.read
    for start in long_runs:
        for skipped in range(4):
            yield Stream(lambda a=start, s=skipped: decoded(run_at(read(), a), s), stream.names + "base64.", stream.place, ancestors)
    data = b"".join(held)
    if is_compressed(data[:3]):
        deeper = Stream((lambda: inflated(iter([data]))) if size == len(data) else lambda: inflated(read()), stream.names + "zip.", stream.place, ancestors)
        held = []  # a path of many streams does not hold them all
        yield deeper


def runs(text: str) -> Iterator[tuple[int, str, list[int], list[int], bool]]:
    """Base64 runs: start, characters, line ends as in ``Decoded``, and whether streams are looked for in them: in a run over
    lines, not in each of these."""
    for m in BASE64_LINES.finditer(text):
        lines = "\n" in m[0]
        for line in BASE64_RUN.finditer(m[0]):
            yield m.start() + line.start(), line[0].rstrip("="), [], [], not lines
        if lines:
            parts, ends, taken, at = [], [], [0], 0
            for e in LINE_END.finditer(m[0]):
                parts.append(m[0][at : e.start()])
                ends.append(e.start() - taken[-1])
                taken.append(taken[-1] + e.end() - e.start())
                at = e.end()
            yield m.start(), "".join([*parts, m[0][at:]]).rstrip("="), ends, taken, True


def is_text(data: bytes) -> bool:
    try:
        return not NOT_TEXT.search(data.decode("utf-8"))
    except UnicodeDecodeError:
        return False


def unwrap(layer: Layer) -> Iterator[Layer | Stream]:
    for sign, escapes, decode, name in (("%", URL_ESCAPES, from_url, "url."), ("\\u", UNICODE_ESCAPE, from_unicode, "unicode.")):
        if sign in layer.text and escapes.search(layer.text):
            step = Unescaped(layer.text, escapes, decode)
            yield Layer(step.text, layer.names + name, (*layer.steps, step), layer.inside, layer.whole)
    for start, run, ends, taken, streams in runs(layer.text):
        stop = start + len(run) + (taken[-1] if taken else 0)
        if (place := layer.place(start, stop)) is None:
            continue
        body = run.translate(TO_STANDARD)
        for skipped in range(4):
            data = from_base64(body[skipped:])
            if STRETCH.search(data):
                step = Decoded(start, skipped, ends, taken)
                yield Layer(data.decode("latin-1"), layer.names + "base64.", (*layer.steps, step), layer.inside, place)
            if not skipped and is_text(data):
                break
        if streams:
            read_to = 0
            for m in STREAM_HEAD.finditer(body):
                a, ended = m.start() + (taken[bisect_right(ends, m.start())] if ends else 0), []
                if m.start() >= read_to and (at := layer.place(start + a, stop)):
                    yield Stream(lambda b=body, a=m.start(), e=ended: noting_end(inflated(pieces(b, a)), e), layer.names + "base64.zip.", at)
                    if ended:  # read to its end by now: what it holds is not looked for once more
                        read_to = m.start() + ended[0] * 4 // 3


def find_secrets_in(text: str) -> list[tuple[str, int, int, float, bool]]:
    """(kind, start, stop, score, base) by start, then base kinds as listed, then layered kinds by name."""
    found = {(a, BASE_KINDS.index(k), k, b) for k, a, b in scan(text)}
    raw = Layer(text)
    seen, work = {(hashlib.blake2b(text.encode("utf-8", "surrogatepass")).digest(), None)}, [unwrap(raw)]
    while work:  # depth first, so that only one path of layers is held
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        if isinstance(layer, Stream):
            work.append(contents(layer))
            continue
        key = (hashlib.blake2b(layer.text.encode("utf-8", "surrogatepass")).digest(), layer.whole)
        if key in seen:
            continue
        seen.add(key)
        for kind, x, y in scan(layer.text):
            if place := layer.place(x, y):
                found.add((place[0], len(BASE_KINDS), layer.names + kind, place[1]))
        work.append(unwrap(layer))
    return [(k, a, b, 1.0 if rank < len(BASE_KINDS) else 0.9, rank < len(BASE_KINDS)) for a, rank, k, b in sorted(found)]


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (doc_id, spans), each span with kind, start, stop, score and base.

    Null text counts as empty and has no spans. Ids may repeat or be null; each row is scanned for itself. Texts are scanned
    whole, however long. Other columns are ignored, whatever their names; an empty table gives an empty result."""

    def run(cols: list) -> list:
        ids, texts = cols
        return [ids, [[dict(zip(("kind", "start", "stop", "score", "base"), s, strict=True)) for s in find_secrets_in(t or "")] for t in texts]]

    return map_rows(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), f"doc_id {dict(docs.dtypes)[id_col]}, spans {SPAN_TYPE}", run)


def op5_query(docs: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, all spans; nulls, repeats and empty tables as in ``find_secrets``."""
    return digest_columns(find_secrets(docs), BASE_KINDS)
