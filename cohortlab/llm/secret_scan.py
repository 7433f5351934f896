"""Secrets in texts and in what is encoded in them.

Base patterns are searched in the text itself. Then a worklist unwraps layers: percent escapes, Unicode and character-reference escapes,
base64 (both alphabets), and compressed data (gzip, zlib, bzip2, xz) inside base64. Every layer is scanned like the text and
unwrapped again until nothing is left. Every distinct content is looked into once, so cycles (a compressed file that holds itself) end; what is
found in it is reported at every place where it stands. Each character of a layer knows the range of the text it came from.

Base64 may be wrapped; it may stand in a path. Compressed data count wherever they begin in decoded bytes, all members are read, cut or
damaged ones as far as they go. Decoding needs no key, so a layer's content is as good as open. Content of more than ``MAX_LAYER``
bytes is scanned in chunks that overlap by ``OVERLAP`` bytes; compressed data inside that cross the end of a chunk are read up to there.

Defined results: NULL and empty texts have no spans; repeated rows are scanned alike; a secret found twice at one range counts once;
spans are code points, end exclusive. Other columns are never read.
"""

from __future__ import annotations

import base64
import bisect
import bz2
import hashlib
import html
import itertools
import lzma
import re
import zlib
from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed patterns.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run of 24 is found where the run begins
LEAST_VALUE, LEAST_ACCESS = 6, 20
KINDS = ("assign", "access", "hex")
#: Part of every key word of ASSIGN, to pass over texts without any.
HINTS = ("passw", "secret", "token", "apikey", "api_key")

#: Bytes of unpacked content that are scanned at once, and how far such chunks overlap.
MAX_LAYER, OVERLAP = 64 << 20, 1 << 20
#: Most bytes unpacked at once, and compressed bytes given at once.
PIECE, FEED = 1 << 20, 64
#: Shortest base64 run and shortest content that is looked into.
LEAST_RUN, LEAST_CONTENT = 16, 8

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"\\u\{[0-9A-Fa-f]{1,6}\}|(?:\\u[0-9A-Fa-f]{4})+|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{%d,}={0,2}" % LEAST_RUN)
#: Base64 over line breaks (with quoting and indentation), one line of it, and what stands between the separators of paths and names.
WRAPPED = re.compile(r"[A-Za-z0-9+/_-]{%d,}(?:\r?\n[ \t>]*[A-Za-z0-9+/_-]{%d,})*(?:\r?\n[ \t>]*[A-Za-z0-9+/_-]+)?" % (LEAST_RUN, LEAST_RUN))
LINE = re.compile(r"[A-Za-z0-9+/_-]+")
PART = re.compile(r"[A-Za-z0-9+]{%d,}" % LEAST_RUN)
#: Beginning of gzip, bzip2, xz and zlib data.
BEGINNINGS = r"\x1f\x8b\x08|BZh[1-9]1AY&SY|\xfd7zXZ\x00|\x78[\x01\x5e\x9c\xda]"
PACKED, PACKED_TEXT = re.compile(BEGINNINGS.encode("latin-1")), re.compile(BEGINNINGS)
URL_SAFE = str.maketrans("-_", "+/")

Span = tuple[str, int, int]  # kind, start, end
#: Where a range of a content is in the text around it.
Place = Callable[[int, int], tuple[int, int]]


def base_spans(text: str) -> list[Span]:
    """(kind, start, end), leftmost and not overlapping within a kind."""
    out = []
    low = text.lower()
    if any(h in low for h in HINTS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


class Layer(NamedTuple):
    """A decoded text; character k came from start[k] to end[k] of the document; ``new`` tells which are decoded in this layer."""

    text: str
    start: np.ndarray
    end: np.ndarray
    new: np.ndarray


def _replaced(layer: Layer, pattern: re.Pattern, decode: Callable[[str], str | None]) -> Layer | None:
    """The layer with every match decoded; None if nothing could be."""
    pieces: list[tuple[str, np.ndarray, np.ndarray, np.ndarray]] = []
    at, changed = 0, False
    for m in pattern.finditer(layer.text):
        got = decode(m[0])
        if got is None:
            continue
        a, b, k = m.start(), m.end(), len(got)
        pieces.append((layer.text[at:a], layer.start[at:a], layer.end[at:a], np.zeros(a - at, bool)))
        if k * 3 == b - a:  # one character for one escape of three
            where = a + 3 * np.arange(k)
            pieces.append((got, layer.start[where], layer.end[where + 2], np.ones(k, bool)))
        else:
            pieces.append((got, np.full(k, layer.start[a]), np.full(k, layer.end[b - 1]), np.ones(k, bool)))
        at, changed = b, True
    if not changed:
        return None
    pieces.append((layer.text[at:], layer.start[at:], layer.end[at:], np.zeros(len(layer.text) - at, bool)))
    return Layer("".join(p[0] for p in pieces), *(np.concatenate([p[k] for p in pieces]) for k in (1, 2, 3)))


def _percent(run: str) -> str:
    return bytes.fromhex(run.replace("%", "")).decode("utf-8", "replace")


def _escape(run: str) -> str | None:
    try:
        if run.startswith("&"):
            return html.unescape(run)
        if run.startswith("\\u{"):
            return chr(int(run[3:-1], 16))
        if run.startswith("\\u"):  # halves of a surrogate pair go together
            units = b"".join(int(x, 16).to_bytes(2, "big") for x in run[2:].split("\\u"))
            return units.decode("utf-16-be", "replace")
        return chr(int(run[2:], 16))
    except (ValueError, OverflowError):
        return None


def _opener(raw: bytes, at: int) -> Any:
    if raw[at : at + 1] in (b"\x1f", b"\x78"):
        return zlib.decompressobj(47)
    return bz2.BZ2Decompressor() if raw[at : at + 1] == b"B" else lzma.LZMADecompressor()


def _unpacked(raw: bytes, at: int, ends: list[int]) -> Iterator[bytes]:
    """Content of compressed data at a place, in pieces, with all members that follow; damaged or cut data up to there. Places behind whole members go to ``ends``."""
    while PACKED.match(raw, at):
        d, k = _opener(raw, at), at
        try:
            while not d.eof:
                if rest := getattr(d, "unconsumed_tail", b""):
                    got = d.decompress(rest, PIECE)
                elif not getattr(d, "needs_input", True):
                    got = d.decompress(b"", PIECE)
                elif k < len(raw):  # little at a time: damage costs what is given at once
                    got = d.decompress(raw[k : k + FEED], PIECE)
                    k += FEED
                elif not (got := d.decompress(b"", PIECE)):
                    return
                if got:
                    yield got
        except (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError):
            return
        at = min(k, len(raw)) - len(d.unused_data)
        ends.append(at)


def _chunks(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The content in chunks of MAX_LAYER bytes that overlap."""
    held, size, fresh = [], 0, False
    for piece in pieces:
        held.append(piece)
        size, fresh = size + len(piece), True
        if size >= MAX_LAYER:
            whole = b"".join(held)
            yield whole
            held, size, fresh = [whole[-OVERLAP:]], min(OVERLAP, size), False
    if fresh:
        yield b"".join(held)


def _texts(raw: bytes) -> Iterator[tuple[str, np.ndarray | None]]:
    """(text, byte of every character or None if they are the same) of bytes, and without NUL bytes if there are any (UTF-16, UTF-32).

    A character is a byte, as patterns are ASCII: nothing is lost where bytes are no valid UTF-8.
    """
    yield raw.decode("latin-1"), None
    if b"\0" in raw:
        yield raw.replace(b"\0", b"").decode("latin-1"), np.flatnonzero(np.frombuffer(raw, np.uint8))


def _packed(text: str) -> Iterator[tuple[str, Place]]:
    """Contents of the compressed data in a text whose characters are bytes."""
    raw, at = None, 0
    while m := PACKED_TEXT.search(text, at):
        if raw is None:
            try:
                raw = text.encode("latin-1")
            except UnicodeEncodeError:
                return
        ends: list[int] = []
        for chunk in _chunks(_unpacked(raw, m.start(), ends)):
            for inner, _ in _texts(chunk):
                if len(inner) >= LEAST_CONTENT and (ends or _holds(inner)):
                    yield inner, lambda i, j, a=m.start(), ends=ends, n=len(raw): (a, ends[-1] if ends else n)
        at = ends[-1] if ends else m.start() + 1


def _plausible(raw: bytes) -> bool:
    try:
        return raw.decode().translate({9: None, 10: None, 13: None}).isprintable()
    except UnicodeDecodeError:
        return False


def _holds(text: str) -> bool:
    """Whether a secret or a further layer is in a text."""
    return bool(base_spans(text)) or any(p.search(text) for p in (BASE64, PERCENT, ESCAPE, PACKED_TEXT))


class Run(NamedTuple):
    """Base64 characters, and where the lines they came in begin among them and in the text."""

    body: str
    cuts: list[int]
    starts: list[int]

    def at(self, k: int) -> int:
        line = bisect.bisect_right(self.cuts, k) - 1
        return self.starts[line] + k - self.cuts[line]


def _run(text: str, lines: list[tuple[int, int]]) -> Run:
    cuts = [0, *itertools.accumulate(b - a for a, b in lines[:-1])]
    return Run("".join(text[a:b] for a, b in lines).translate(URL_SAFE), cuts, [a for a, _ in lines])


def _decoded(run: Run) -> Iterator[tuple[int, bytes]]:
    """(characters skipped, bytes): a run may begin at any of four places."""
    for skip in range(4):
        body = run.body[skip:]
        if len(body) % 4 == 1:
            body = body[:-1]
        if len(body) < LEAST_RUN - 4:
            return
        yield skip, base64.b64decode(body + "=" * (-len(body) % 4))


def _whole(run: Run) -> bool:
    """Whether a run as it stands is plain text, or holds compressed data with its end."""
    for _, raw in _decoded(run):
        if _plausible(raw):
            return True
        for m in PACKED.finditer(raw):
            ends: list[int] = []
            for _ in _unpacked(raw, m.start(), ends):
                pass
            if ends:
                return True
    return False


def _runs(text: str) -> Iterator[Run]:
    """Runs of base64 over all their lines, and what else they may be: single lines, parts between separators, all but a short last line."""
    for m in WRAPPED.finditer(text):
        lines = [x.span() for x in LINE.finditer(text, *m.span())]
        every = _run(text, lines)
        yield every
        parts = [(a, b) for u, v in lines for a, b in _parts(text, u, v)]
        if (len(lines) > 1 or parts) and not _whole(every):
            if len(lines) > 1:
                yield from (_run(text, [x]) for x in lines)
                yield _run(text, lines[:-1])
            yield from (_run(text, [x]) for x in parts)


def _parts(text: str, a: int, b: int) -> Iterator[tuple[int, int]]:
    for m in PART.finditer(text, a, b):
        if m.span() != (a, b):
            yield m.span()


def _base64(layer: Layer, seen: set) -> Iterator[tuple[str, Place]]:
    """Contents of the base64 runs of a layer, and where a range of each is in the text the layer came from. ``seen``: where the same text has which.

    Of the readings of a run those without a secret, a layer or plain text give nothing.
    """
    for run in _runs(layer.text):
        for skip, raw in _decoded(run):
            for inner, byte in _texts(raw):
                if len(inner) < LEAST_CONTENT or not (_plausible(raw if byte is None else inner.encode("latin-1")) or _holds(inner)):
                    continue
                if (key := (int(layer.start[run.at(skip)]), _name(inner))) in seen:  # a layer of escapes has runs of its text again
                    continue
                seen.add(key)

                def place(i: int, j: int, run: Run = run, skip: int = skip, byte: np.ndarray | None = byte) -> tuple[int, int]:
                    first, last = (i, j - 1) if byte is None else (int(byte[i]), int(byte[j - 1]))
                    # byte k is in characters 4k/3 and the next
                    return int(layer.start[run.at(skip + first * 4 // 3)]), int(layer.end[run.at(min(skip + last * 4 // 3 + 1, len(run.body) - 1))])

                yield inner, place


def _inside(text: str, decoded: bool) -> Iterator[Span | tuple[str, Place] | None]:
    """What a text holds: spans behind escapes, None for every layer of escapes, and contents of base64 runs (of compressed data too, if its characters are bytes) with their places."""
    if decoded:
        yield from _packed(text)
    n = np.arange(len(text), dtype=np.int32)
    work = [Layer(text, n, n + 1, np.zeros(0, bool))]
    seen, runs = set(), set()
    while work:
        layer = work.pop()
        yield from _base64(layer, runs)
        for hints, pattern, decode in ((("%",), PERCENT, _percent), (("\\", "&#"), ESCAPE, _escape)):
            got = _replaced(layer, pattern, decode) if any(h in layer.text for h in hints) else None
            if got is None or (key := (_name(got.text), got.start.tobytes(), got.end.tobytes())) in seen:
                continue
            seen.add(key)
            yield None
            for kind, a, b in base_spans(got.text):
                if got.new[a:b].any():  # the rest is found where it stands open
                    yield kind, int(got.start[a]), int(got.end[a:b].max())
            work.append(got._replace(new=np.zeros(0, bool)))


def scan(text: str) -> tuple[list[Span], list[Span], int]:
    """(base spans, all spans, layers unwrapped) of a text."""
    base = base_spans(text)
    if not ("%" in text or "\\" in text or "&#" in text or BASE64.search(text)):
        return base, base, 0
    # every distinct content is looked into once; its spans then go to all places where it stands
    root = _name(text)
    spans: dict[bytes, set[Span]] = {root: set(base)}
    places: dict[bytes, list[tuple[bytes, Place]]] = {root: []}
    work, count = [(root, _inside(text, False))], 0
    while work:
        name, inside = work[-1]
        found = next(inside, work)
        if found is work:
            work.pop()
        elif found is None:
            count += 1
        elif len(found) == 3:
            spans[name].add(found)
        else:
            inner, place = found
            own = _name(inner)
            if own not in spans:
                count += 1
                spans[own], places[own] = set(base_spans(inner)), []
                work.append((own, _inside(inner, True)))
            places[own].append((name, place))
    new = [(name, s) for name, own in spans.items() for s in own]
    while new:
        name, (kind, a, b) = new.pop()
        for outer, place in places[name]:
            s = (kind, *place(a, b))
            if s not in spans[outer]:
                spans[outer].add(s)
                new.append((outer, s))
    return base, list(spans[root]), count


def _name(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def written(spans: list[Span]) -> str:
    order = sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in order)


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, n_assign, n_access, n_hex, base_sha256, spans, n_layers) of every row. Nothing is shuffled."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: dict[str, list[int]] = {k: [] for k in KINDS}
            sha, spans, layers = [], [], []
            for value in b.column(1):
                base, every, n = scan(value.as_py() or "")
                for k in KINDS:
                    counts[k].append(sum(s[0] == k for s in base))
                sha.append(hashlib.sha256(written(base).encode()).hexdigest())
                spans.append(written(every))
                layers.append(n)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(sha, pa.string()), pa.array(spans, pa.string()), pa.array(layers, pa.int64())],
                names=["_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_layers"],
            )

    id_type = docs.schema[id_col].dataType.simpleString()
    kinds = f"_id {id_type}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_layers bigint"
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(each, kinds)
