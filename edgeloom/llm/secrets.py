"""Secret scan: patterns over every text and over whatever decodes out of it.

A worklist starts with the text itself.  Each layer is scanned for secrets and for encoded
runs - percent escapes, Unicode escapes (\\u, \\U, \\x, &#; and full-width forms), base64 and,
once binary, zlib, gzip or bare deflate streams - and what they decode to becomes a new layer,
until nothing new appears.  Bytes of any kind of run are inflated, and read as Latin-1 and
UTF-16 where they aren't UTF-8.  A digest of every layer seen breaks cycles.

Every layer keeps, for each of its characters, the place in the original text that it comes
from, so a secret is reported where its own characters are encoded; in a compressed stream
that is the whole stream, as none of its characters has a place of its own.

Streams are inflated piece by piece, PIECE bytes with OVERLAP of the piece before, so size
alone keeps nothing from being scanned and memory stays bounded.  A document whose streams
come to more than MOST_INFLATED bytes in all is a decompression bomb: what is left of it gets a span of
the kind "bomb", which redaction masks like a secret.

Defined results: a null text is an empty one; rows are scanned one by one, so ids may be
null or repeated; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from edgeloom.llm.arrays import Batch, release, slices
from edgeloom.llm.frames import map_texts, span_digest

KINDS = ("assign", "access", "hex")
ORDER = (*KINDS, "bomb")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # a failing AKIA match is a whole run, so nothing longer starts within it
HEX = re.compile(r"[0-9a-f]{32,}")
PIECE, OVERLAP, MOST_INFLATED = 8_000_000, 100_000, 1 << 30

#: Encoded runs.  A percent run is the token around the escapes, as its plain characters belong to the value.
#: Look-behinds and possessive runs make a run that fails cost its length once.
PERCENT = re.compile(r"""(?<![^\s"'<>%])[^\s"'<>%]*+(?:%[0-9A-Fa-f]{2}[^\s"'<>%]*+)+""")
_CODE = r"\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&\#[0-9]{1,7};|&\#[xX][0-9A-Fa-f]{1,6};|[！-～]"
UNICODE = re.compile(rf"""(?<![^\s"'<>\\&！-～])[^\s"'<>\\&！-～]*+(?:(?:{_CODE})[^\s"'<>\\&！-～]*+)+""")
ESCAPE = re.compile(_CODE)
BYTE = re.compile("%[0-9A-Fa-f]{2}")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}+={0,2}")
BASE64_LINES = re.compile(r"(?<![A-Za-z0-9+/])(?:[A-Za-z0-9+/]{48,76}\r?\n)+[A-Za-z0-9+/]{2,76}={0,2}(?![A-Za-z0-9+/=])")
WIDE = re.compile("[\uFF01-\uFF5E]")
#: Where a gzip or zlib stream may begin inside of bytes.
STREAM = re.compile(rb"\x1f\x8b\x08|[\x78\x68\x58\x48\x38\x28\x18\x08](?=[\x00-\xff])")
UNCLEAN = re.compile("[\x00-\x08\x0e-\x1f\x7f-\x9f\ufffd]")

_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")


def base_matches(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then kind as listed."""
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda f: (f[1], KINDS.index(f[0]), f[2]))


Places = np.ndarray | int  # for each item, or one for all of them


@dataclass
class Layer:
    """A text and, for each character, the span [lo, hi) of the original text that it comes from; None for the original itself."""

    text: str
    lo: Places | None = None
    hi: Places | None = None

    def span(self, a: int, b: int) -> tuple[int, int]:
        if self.lo is None:
            return a, b
        return (self.lo, self.hi) if isinstance(self.lo, int) else (int(self.lo[a]), int(self.hi[b - 1]))

    def below(self, text: str, start: Places, end: Places) -> Layer:
        """A layer whose characters come from [start, end) of this one's."""
        if self.lo is None:
            return Layer(text, start, end)
        if isinstance(self.lo, int):
            return Layer(text, self.lo, self.hi)
        if isinstance(start, int):
            return Layer(text, *self.span(start, end))
        return Layer(text, self.lo[start], self.hi[end - 1])


class Bomb(Exception):
    """The streams of a document come to more bytes than is allowed."""


class Budget:
    def __init__(self, most: int):
        self.left = most

    def spend(self, n: int) -> None:
        self.left -= n
        if self.left < 0:
            raise Bomb


def _printable(raw: bytes) -> str | None:
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        return None
    odd = sum(c < " " and c not in "\t\n\r\x0b\x0c" or "\x7f" <= c < "\xa0" for c in text)
    return text if text and odd * 20 <= len(text) else None


def _inflated(raw: bytes, start: int, bits: int, budget: Budget) -> tuple[list[bytes], int] | None:
    """(what the stream holds, in pieces, and where it ends in raw); None if it isn't a whole one."""
    pieces, stream, left, tail = [], zlib.decompressobj(bits), memoryview(raw)[start:], b""
    try:
        while not stream.eof:
            got = stream.decompress(left, PIECE)
            left = stream.unconsumed_tail
            if not got:
                break
            budget.spend(len(got))
            pieces.append(tail + got)
            tail = pieces[-1][-OVERLAP:]
    except zlib.error:
        return None
    return (pieces, len(raw) - len(stream.unused_data)) if stream.eof and pieces else None


def _streams(raw: bytes, budget: Budget) -> list[tuple[list[bytes], int, int]]:
    """(pieces, start, end) of the gzip and zlib streams wherever they begin, and of bare deflate at the start."""
    out, at = [], 0
    for bits, start in [(31 if m[0][0] == 0x1F else 15, m.start()) for m in STREAM.finditer(raw)] + [(-15, 0)]:
        if start < at or bits == 15 and (raw[start] * 256 + raw[start + 1]) % 31:
            continue
        if (got := _inflated(raw, start, bits, budget)) is not None:
            out.append((got[0], start, got[1]))
            at = got[1]
    return out


def _cut(places: Places, at: np.ndarray | slice) -> Places:
    return places if isinstance(places, int) else places[at]


def _texts(raw: bytes, start: Places, end: Places, budget: Budget, seen: set[bytes] | None = None) -> Iterator[tuple[str, Places, Places]]:
    """(text, start, end) of all that bytes hold: UTF-8, else Latin-1 and UTF-16, and whatever inflates, to any depth.

    start and end are where each byte comes from, and where each character does.
    """
    seen = set() if seen is None else seen
    mark = hashlib.blake2b(raw, digest_size=16).digest()
    if mark in seen or not raw:
        return
    seen.add(mark)
    if (text := _printable(raw)) is not None:
        lead = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
        yield text, _cut(start, lead), _cut(end, np.append(lead[1:], len(raw)) - 1)
        return
    yield raw.decode("latin-1"), start, end
    if b"\0" in raw:
        full = np.flatnonzero(np.frombuffer(raw, np.uint8))
        yield raw.replace(b"\0", b"").decode("latin-1"), _cut(start, full), _cut(end, full)
        for order in ("le", "be"):
            text = raw.decode(f"utf-16-{order}", "replace")
            wide = np.fromiter((2 + 2 * (c > "\uffff") for c in text), np.int64, len(text))
            first = np.cumsum(wide) - wide
            yield text, _cut(start, np.minimum(first, len(raw) - 1)), _cut(end, np.minimum(first + wide, len(raw)) - 1)
    for pieces, a, b in _streams(raw, budget):
        whole = (start, end) if isinstance(start, int) else (int(start[a]), int(end[b - 1]))
        for piece in pieces:
            yield from _texts(piece, *whole, budget, seen)


def _base64(run: str) -> bytes:
    """What a run decodes to; a last character that is alone adds nothing."""
    body = run.rstrip("=").translate({45: "+", 95: "/"})
    body = body[: len(body) - (len(body) % 4 == 1)]
    return base64.b64decode(body + "=" * (-len(body) % 4))


def _sixes(raw: bytes, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each byte comes from if the base64 characters are at these places."""
    byte = np.arange(len(raw))
    return places[byte * 8 // 6], places[(byte * 8 + 7) // 6] + 1


def _blobs(run: str, at: int, budget: Budget) -> Iterator[tuple[str, Places, Places]]:
    """(text, start, end) of the blobs in one run of base64 characters, which begins at `at`.

    A blob may begin after a '/' or '-', as in a path, and end before one: it is what decodes
    to clean text or to a stream.  The rest is decoded from each of the four alignments.
    """
    body, covered = run.rstrip("="), 0

    def decoded(a: int, b: int, size: int | None = None) -> Iterator[tuple[str, Places, Places]]:
        whole = _base64(body[a:b])
        raw = whole[:size]
        start, end = _sixes(raw, at + np.arange(a, b))
        if len(raw) == len(whole) and b == len(body):
            end[-1:] = at + len(run)  # the padding goes with the last byte
        yield from _texts(raw, start, end, budget)

    def rest(a: int, b: int) -> Iterator[tuple[str, Places, Places]]:
        if b - a >= 16:
            for k in range(4):
                yield from decoded(a + k, b)

    for s in [0, *(i + 1 for i, c in enumerate(body) if c in "/-")]:
        if s < covered or len(body) - s < 16:
            continue
        head = _base64(body[s : s + 16])
        if not (head[:2] == b"\x1f\x8b" or head[0] & 15 == 8 and (head[0] * 256 + head[1]) % 31 == 0 or not UNCLEAN.search(head.decode("utf-8", "ignore")) and len(head.decode("utf-8", "ignore").encode()) > 8):
            continue
        raw = _base64(body[s:])
        stream = None
        if head[:2] == b"\x1f\x8b" or head[0] & 15 == 8:
            stream = _inflated(raw, 0, 31 if head[0] == 0x1F else 15, budget)
        if stream:
            size = stream[1]
        else:
            text = raw.decode("utf-8", "replace")
            text = text[: m.start() if (m := UNCLEAN.search(text)) else len(text)]
            size = len(text.encode())
        end = min(len(body), s + -(-size * 4 // 3))
        if end < len(body):
            while end < len(body) and body[end] not in "/-":
                end += 1
        if size < 12:
            continue
        yield from rest(covered, s)
        yield from decoded(s, len(body), size)
        if size < len(raw):
            yield from decoded(s, end)
        covered = end
    yield from rest(covered, len(body))


def _character(m: re.Match) -> str:
    s = m[0]
    if len(s) == 1:
        return chr(ord(s) - 0xFEE0)  # full-width forms of ASCII
    code = int(s.strip("\\&#;uUxX{}"), 16 if s[0] == "\\" or s[2] in "xX" else 10)
    return chr(code) if code < 0x110000 else s


def _pieces(run: str, at: int, code: re.Pattern) -> Iterator[tuple[str, int, re.Match | None]]:
    """The plain parts of a run, with their places, and the escapes between them."""
    done = 0
    for m in code.finditer(run):
        if m.start() > done:
            yield run[done : m.start()], at + done, None
        yield m[0], at + m.start(), m
        done = m.end()
    if done < len(run):
        yield run[done:], at + done, None


def _escaped(run: str, at: int) -> tuple[str, np.ndarray, np.ndarray]:
    """A run with its Unicode escapes replaced, halves of a pair joined; and where each character comes from."""
    text, start, end = [], [], []
    for part, place, m in _pieces(run, at, ESCAPE):
        made = part if m is None else _character(m)
        for i, c in enumerate(made):
            a, b = (place, place + len(part)) if m is not None else (place + i, place + i + 1)
            if text and "\udc00" <= c <= "\udfff" and "\ud800" <= text[-1] <= "\udbff":
                text[-1], end[-1] = (text[-1] + c).encode("utf-16", "surrogatepass").decode("utf-16"), b
            else:
                text.append(c)
                start.append(a)
                end.append(b)
    plain = ["?" if "\ud800" <= c <= "\udfff" else c for c in text]
    return "".join(plain), np.array(start, np.int64), np.array(end, np.int64)


def _percent(run: str, at: int) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The bytes of a run with percent escapes, and where each comes from."""
    raw, start, end = [], [], []
    for part, place, m in _pieces(run, at, BYTE):
        if m is not None:
            raw.append(bytes([int(part[1:], 16)]))
            start.append([place])
            end.append([place + 3])
        else:
            raw.append(part.encode("utf-8", "replace"))
            wide = np.arange(len(part)) if part.isascii() else np.repeat(np.arange(len(part)), [len(c.encode("utf-8", "replace")) for c in part])
            start.append(place + wide)
            end.append(place + wide + 1)
    return b"".join(raw), np.concatenate(start).astype(np.int64), np.concatenate(end).astype(np.int64)


def unwrapped(text: str, budget: Budget) -> Iterator[tuple[str, Places, Places]]:
    """(decoded text, start, end) of the encoded runs of one text, one level down; where each character comes from."""
    if "%" in text:
        for m in PERCENT.finditer(text):
            yield from _texts(*_percent(m[0], m.start()), budget)
    if "\\" in text or "&#" in text or WIDE.search(text):
        for m in UNICODE.finditer(text):
            layer = _escaped(m[0], m.start())
            yield layer
            if UNCLEAN.search(layer[0]) or not layer[0].isascii():  # escapes of bytes
                try:
                    raw = layer[0].encode("latin-1")
                except UnicodeEncodeError:
                    continue
                yield from _texts(raw, *layer[1:], budget)
    for m in BASE64.finditer(text):
        if not HEX.fullmatch(m[0]):
            yield from _blobs(m[0], m.start(), budget)
    for m in BASE64_LINES.finditer(text):
        places = m.start() + np.array([i for i, c in enumerate(m[0]) if c not in "\r\n="], np.int64)
        raw = _base64("".join(m[0].split()))
        yield from _texts(raw, *_sixes(raw, places), budget)


def scan(text: str, most: int = MOST_INFLATED) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans) of one text; both sorted by start, then kind."""
    base = base_matches(text)
    spans, seen, budget = set(base), set(), Budget(most)
    work = deque([Layer(text)])
    while work:
        layer = work.popleft()
        if layer.text != text:
            spans.update((kind, *layer.span(a, b)) for kind, a, b in base_matches(layer.text))
        try:
            for below in unwrapped(layer.text, budget):
                if not below[0]:
                    continue
                new = layer.below(*below)
                mark = hashlib.blake2b(new.text.encode("utf-8", "surrogatepass") + b"\0%d:%d" % new.span(0, len(new.text)), digest_size=16).digest()
                if mark not in seen and new.text != text:
                    seen.add(mark)
                    work.append(new)
        except Bomb:
            spans.add(("bomb", *layer.span(0, len(layer.text))))
    return base, sorted(spans, key=lambda f: (f[1], ORDER.index(f[0]), f[2]))


def encode(text: str, how: list[str]) -> str:
    """Wraps a text in the layers named, innermost first; for tests and for planting cases."""
    raw = text.encode()
    for x in how:
        raw = {"url": lambda r: b"".join(b"%%%02X" % c for c in r), "unicode": lambda r: "".join(f"\\u{ord(c):04x}" for c in r.decode()).encode(), "entity": lambda r: "".join(f"&#{ord(c)};" for c in r.decode()).encode(), "wide": lambda r: "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in r.decode()).encode(), "base64": base64.b64encode, "zlib": zlib.compress, "gzip": lambda r: gzip.compress(r, mtime=0)}[x](raw)
    return raw.decode()


_RUN = np.zeros(256, bool)
_RUN[[*range(48, 58), *range(65, 91), *range(97, 123), 43, 47, 61, 95, 45]] = True


def _suspects(batch: Batch) -> np.ndarray:
    """Whether a text has anything that scan() could report: a long run, an escape or a key word."""
    from edgeloom.llm.arrays import _LOWER

    out = np.zeros(batch.n, bool)
    data = batch.data
    if not len(data):
        return out
    off = np.flatnonzero(~_RUN[data])  # runs may cross two texts: one more candidate, never one fewer
    edges = np.concatenate([[-1], off, [len(data)]])
    long = np.flatnonzero(np.diff(edges) > 16)
    for a, b in zip(edges[long] + 1, edges[long + 1]):
        out[np.searchsorted(batch.offsets, a, "right") - 1 : np.searchsorted(batch.offsets, b - 1, "right")] = True
    low = _LOWER[data].tobytes()
    for mark in (b"passw", b"secret", b"token", b"api_key", b"apikey", b"%", b"\\", b"&#", b"\xef\xbc", b"\xef\xbd"):
        at = low.find(mark)
        while at >= 0:
            i = int(np.searchsorted(batch.offsets, at, "right")) - 1
            out[i] = True
            at = low.find(mark, int(batch.offsets[i + 1]))  # on with the next text
    return out


def find(documents: DataFrame, most: int = MOST_INFLATED) -> DataFrame:
    """doc_id, base and spans: the spans as arrays of (kind, start, end), code points, end exclusive."""
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = Batch.of_arrow(batch.column("text"))
        base, spans = [[]] * found.n, [[]] * found.n
        for i in np.flatnonzero(_suspects(found)):
            one, all_ = scan(found.text(i), most)
            base[i], spans[i] = ([dict(zip(("kind", "start", "end"), s)) for s in x] for x in (one, all_))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(base, span), pa.array(spans, span)], ["doc_id", "base", "spans"])

    kind = "array<struct<kind:string,start:long,end:long>>"
    return map_texts(documents.select("doc_id", "text"), run, f"doc_id long, base {kind}, spans {kind}")


def masked(text: str, spans: list[tuple[str, int, int]], mark: str = "[SECRET]") -> str:
    """The text with every span (overlapping ones merged) replaced by the mark."""
    out, at = [], 0
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(documents: DataFrame, most: int = MOST_INFLATED) -> DataFrame:
    """The documents, all their columns, with the secrets masked in text (and n_chars made to fit, if there is one)."""
    from pyspark.sql import functions as F

    names = documents.columns
    place = names.index("text")

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                found = Batch.of_arrow(batch.column("text"))
                suspect = np.flatnonzero(_suspects(found))
                texts = batch.column("text").to_pylist()
                for i in suspect:
                    if texts[i] is None:  # between two texts that make one run
                        continue
                    texts[i] = masked(texts[i], scan(texts[i], most)[1])
                columns = list(batch.columns)
                columns[place] = pa.array(texts, batch.schema.field(place).type)
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)
        release()

    out = documents.mapInArrow(run, documents.schema)
    return out.withColumn("n_chars", F.char_length("text").cast(documents.schema["n_chars"].dataType)) if "n_chars" in names else out


__all__ = ["KINDS", "base_matches", "encode", "find", "masked", "redact", "scan", "span_digest", "unwrapped"]
