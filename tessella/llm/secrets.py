"""Secret scans with a recursive decoding worklist.

A text is the first layer. Every layer is scanned for secrets; then each way of unwrapping it (percent-encoding, Unicode and byte
escapes and character references, base64 of any alignment and over line ends, and what decoded bytes hold compressed or as UTF-16) gives further layers, until the
worklist is empty. A layer of the same content from the same spans of its text is not taken again, which ends cycles. Each
layer keeps, for every character, the span of the original text it comes from, so a find in any layer is a span of the original.

Defined results: a null text is an empty text and has no finds; a find at the same span and of the same kind counts
once; texts are scanned whole; repeated rows give the same finds each. A compressed layer of more than ``MOST_UNPACKED`` bytes is
scanned as a stream of overlapping parts, so that a decompression bomb costs time but no memory.
"""

from __future__ import annotations

import base64
import bz2
import itertools
import lzma
import re
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import unquote_to_bytes

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col

KINDS = ("assign", "access", "hex")
MOST_UNPACKED = 1 << 28
#: Parts of a larger layer, and how far each goes back into the one before.
PART, OVERLAP = 1 << 23, 1 << 16
SCHEMA = "array<struct<kind:string,start:long,end:long,base:boolean,path:string>>"
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("path", pa.string())])

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|((?:\\u[0-9A-Fa-f]{4})+)|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});|%u([0-9A-Fa-f]{4})")
#: The same with the escapes of one letter, as in spelled-out bytes.
_SPELLED = re.compile(_ESCAPE.pattern + r"|\\([abfnrtv0\\'\"/])")
_LETTERS = dict(zip("abfnrtv0", "\a\b\f\n\r\t\v\0"))
#: Characters that stand for bytes, and those among them that begin compressed ones.
_LATIN = re.compile("[\x00-\xff]+")
_LATIN_MAGIC = re.compile(r"\x1f\x8b\x08|x[\x01\x5e\x9c\xda]|BZh[1-9]1AY|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")
#: Bytes written as text: escaped ones and those that need no escape.
_ESCAPED = re.compile(r"(?:%[0-9A-Fa-f]{2}|[A-Za-z0-9_.~/!'()*+-])+")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{12,}")
#: Base64 over line ends, which may be spelled as escapes.
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:[ \t]*+(?:\r?\n|(?:\\r)?\\n)[ \t]*+[A-Za-z0-9+/_-]++)++")
_RUN = re.compile(r"[A-Za-z0-9+/_-]++")
_BREAK = re.compile(r"[ \t]*+(?:\r?\n|(?:\\r)?\\n)[ \t]*+")
_MAGIC = re.compile(rb"\x1f\x8b\x08|\x78[\x00-\xff]|BZh[1-9]|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")
#: No find and no text that unwraps to one is shorter.
SHORTEST = 12
_WORDS = ("passw", "secret", "token", "api")


@dataclass
class Layer:
    """Decoded text; starts and ends map each of its characters to the original, None for the original itself and numbers where all come from one span."""

    text: str
    starts: list[int] | int | None
    ends: list[int] | int | None
    path: str

    def span(self, a: int, b: int) -> tuple[int, int]:
        if self.starts is None:
            return a, b
        if isinstance(self.starts, int):
            return self.starts, self.ends
        return min(self.starts[a:b]), max(self.ends[a:b])

    def key(self) -> tuple:
        """What tells layers apart; long texts by a hash of 128 bits."""
        import xxhash

        text = self.text if len(self.text) < 4096 else xxhash.xxh3_128_digest(self.text.encode("utf-8", "surrogatepass"))
        return (text, tuple(self.starts), tuple(self.ends)) if isinstance(self.starts, list) else (text, self.starts, self.ends)


def finds(text: str) -> Iterator[tuple[str, int, int]]:
    """Base finds of a text: for each kind leftmost and non-overlapping."""
    low = text.lower()
    if any(w in low for w in _WORDS):
        for m in _ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= 6:
                yield "assign", m.start(), m.end()
    if "AKIA" in text:
        for m in _ACCESS.finditer(text):
            if m.end() - m.start() >= 20:
                yield "access", m.start(), m.end()
    for m in _HEX.finditer(text):
        yield "hex", m.start(), m.end()


def _substituted(layer: Layer, pieces: list[tuple[int, int, str, list[tuple[int, int]]]], name: str) -> Layer:
    """The layer with each (begin, end, decoded, per-character source spans) in its place."""
    text, starts, ends, at = [], [], [], 0
    if isinstance(layer.starts, int):
        for a, b, decoded, _ in pieces:
            text += [layer.text[at:a], decoded]
            at = b
        return Layer("".join([*text, layer.text[at:]]), layer.starts, layer.ends, f"{layer.path}/{name}")

    def keep(a: int, b: int) -> None:
        text.append(layer.text[a:b])
        starts.extend(range(a, b) if layer.starts is None else layer.starts[a:b])
        ends.extend(range(a + 1, b + 1) if layer.ends is None else layer.ends[a:b])

    for a, b, decoded, spans in pieces:
        keep(at, a)
        text.append(decoded)
        for x, y in spans:
            s, e = layer.span(x, y)
            starts.append(s)
            ends.append(e)
        at = b
    keep(at, len(layer.text))
    return Layer("".join(text), starts, ends, f"{layer.path}/{name}")


def _decoded(raw: bytes) -> tuple[str, list[int]]:
    """The text of bytes, with the offset of each character and the end; a byte that is not UTF-8 is a lone surrogate."""
    text = raw.decode("utf-8", "surrogateescape")
    offsets, b = [0], 0
    for c in text:
        b += 1 if c < "\x80" or "\udc80" <= c <= "\udcff" else len(c.encode("utf-8"))
        offsets.append(b)
    return text, offsets


def _percent(layer: Layer) -> Iterator[Layer]:
    if "%" not in layer.text:
        return
    pieces = []
    for m in _PERCENT.finditer(layer.text):
        text, offsets = _decoded(bytes.fromhex(m[0].replace("%", "")))
        pieces.append((m.start(), m.end(), text, [(m.start() + 3 * x, m.start() + 3 * y) for x, y in zip(offsets, offsets[1:])]))
    if not pieces:
        return
    yield _substituted(layer, pieces, "url")
    for m in _ESCAPED.finditer(layer.text):
        if "%" in m[0]:
            for spelled in {m[0], m[0].replace("+", " ")}:
                yield from _packed(layer, unquote_to_bytes(spelled), m.start(), m.end(), f"{layer.path}/url")


def _unicode(layer: Layer) -> Iterator[Layer]:
    if "\\" not in layer.text and "&#" not in layer.text and "%u" not in layer.text:
        return
    letters = "\\x" in layer.text or "\\u00" in layer.text
    for pattern in (_ESCAPE, _SPELLED) if letters else (_ESCAPE,):
        pieces, escapes = [], 0
        for m in pattern.finditer(layer.text):
            if m[2]:
                units = bytes.fromhex(m[2].replace("\\u", ""))
                try:
                    decoded = units.decode("utf-16-be")
                except UnicodeDecodeError:
                    continue
                spans, u = [], 0
                for c in decoded:
                    n = 1 + (ord(c) > 0xFFFF)
                    spans.append((m.start() + 6 * u, m.start() + 6 * (u + n)))
                    u += n
            elif pattern is _SPELLED and m[8]:
                decoded, spans = _LETTERS.get(m[8], m[8]), [(m.start(), m.end())]
                escapes += 1
            else:
                code = int(m[1] or m[3] or m[4] or m[5] or m[7] or "0", 16) if not m[6] else int(m[6])
                if not (0 < code or m[4]) or code > 0x10FFFF or 0xD800 <= code < 0xE000:
                    continue
                decoded, spans = chr(code), [(m.start(), m.end())]
            pieces.append((m.start(), m.end(), decoded, spans))
        if pieces and (escapes or pattern is _ESCAPE):
            yield _substituted(layer, pieces, "unicode")


def _bytes(layer: Layer) -> Iterator[Layer]:
    """Compressed bytes that stand in the text as the characters of their numbers."""
    if not _LATIN_MAGIC.search(layer.text):
        return
    for m in _LATIN.finditer(layer.text):
        if _LATIN_MAGIC.search(m[0]):
            yield from _packed(layer, m[0].encode("latin-1"), m.start(), m.end(), layer.path)


def _opened(raw: memoryview) -> tuple[str, Callable[[], object]]:
    """The name of the compression that starts here and what makes its decompressor."""
    if raw[0] == 0x1F:
        return "gzip", lambda: zlib.decompressobj(31)
    if raw[0] == 0x78:
        return "zlib", lambda: zlib.decompressobj(15)
    if raw[0] == 0x42:
        return "bzip2", bz2.BZ2Decompressor
    if raw[0] == 0xFD:
        return "xz", lambda: lzma.LZMADecompressor(lzma.FORMAT_XZ)
    import zstandard

    return "zstd", lambda: zstandard.ZstdDecompressor().decompressobj()


def _stream(raw: memoryview) -> Iterator[bytes]:
    """What compressed bytes hold, in parts, all members one after the other; what follows them is left."""
    try:
        name, make = _opened(raw)
        magic = bytes(raw[:2])
        while bytes(raw[:2]) == magic:
            d = make()
            if name == "zstd":
                feed = 0
                while feed < len(raw) and not d.eof:  # it has no limit of its own: small pieces bound what one gives
                    yield d.decompress(raw[feed : feed + 4096])
                    feed += 4096
            elif name in ("gzip", "zlib"):
                part = d.decompress(raw, PART)
                while part:
                    yield part
                    part = d.decompress(d.unconsumed_tail, PART)
            else:
                part = d.decompress(raw, PART)
                while part:
                    yield part
                    part = b"" if d.eof or d.needs_input else d.decompress(b"", PART)
            if not d.eof:
                return
            raw = memoryview(d.unused_data)
    except (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError, ImportError, RuntimeError, MemoryError):
        return  # no member, or broken off
    except Exception as e:  # zstandard's own error has no base class of these
        if type(e).__name__ != "ZstdError":
            raise


def _unpacked(raw: memoryview) -> Iterator[bytes]:
    """What compressed bytes hold (gzip, zlib, bzip2, xz or Zstandard): whole up to MOST_UNPACKED bytes, then in overlapping parts."""
    parts, size = [], 0
    stream = _stream(raw)
    for part in stream:
        parts.append(part)
        size += len(part)
        if size > MOST_UNPACKED:
            break
    else:
        if size:
            yield b"".join(parts)
        return
    held = b""
    for part in itertools.chain([b"".join(parts)], stream):
        held += part
        while len(held) > PART + OVERLAP:
            yield held[: PART + OVERLAP]
            held = held[PART:]
    yield held


def _packed(layer: Layer, raw: bytes, begin: int, end: int, path: str) -> Iterator[Layer]:
    """Layers of what raw, which stands at begin to end of layer, holds compressed at any place and depth."""
    import xxhash

    seen: set[bytes] = set()

    def below(raw: bytes, path: str) -> Iterator[Layer]:
        for m in _MAGIC.finditer(raw):
            if raw[m.start()] == 0x78 and (raw[m.start()] << 8 | raw[m.start() + 1]) % 31:
                continue
            name = _opened(memoryview(raw)[m.start() :])[0]
            for out in _unpacked(memoryview(raw)[m.start() :]):
                if (digest := xxhash.xxh3_128_digest(out)) in seen:
                    continue
                seen.add(digest)
                text = out.decode("utf-8", "surrogateescape")
                if _holds(text):
                    yield Layer(text, *layer.span(begin, end), f"{path}/{name}")
                yield from below(out, f"{path}/{name}")

    yield from below(raw, path)


def _holds(text: str) -> bool:
    """Whether a decoded text has a find or may be unwrapped further."""
    return len(text) >= SHORTEST and (next(finds(text), None) is not None or any(r.search(text) for r in (_BASE64, _WRAPPED, _PERCENT, _ESCAPE)))


def _base64_runs(text: str) -> Iterator[tuple[str, Sequence[int]]]:
    """Runs of base64 characters with the place of each, within lines and over line ends."""
    for m in _BASE64.finditer(text):
        yield m[0], range(m.start(), m.end())
    for m in _WRAPPED.finditer(text):
        parts, at = [], m.start()
        while at < m.end():
            run = _RUN.match(text, at, m.end())
            parts.append(run)
            gap = _BREAK.match(text, run.end(), m.end())
            at = gap.end() if gap else m.end()
        if any(len(p[0]) >= 12 for p in parts):
            yield "".join(p[0] for p in parts), [i for p in parts for i in range(*p.span())]


def _base64(layer: Layer) -> Iterator[Layer]:
    path = f"{layer.path}/base64"
    for body, places in _base64_runs(layer.text):
        if body.isalpha() and (body.islower() or body[1:].islower() or body.isupper()):
            continue  # a word
        plain = body.translate({45: 43, 95: 47})
        for first in range(4):  # other text may be glued to its front
            chars = plain[first:]
            if len(chars) % 4 == 1:
                chars = chars[:-1]
            raw = base64.b64decode(chars + "=" * (-len(chars) % 4))
            if _MAGIC.search(raw):
                yield from _packed(layer, raw, places[first], places[first + len(chars) - 1] + 1, path)
            wide = raw.count(0) * 3 > len(raw)
            if wide:  # UTF-16 text
                for low in (0, 1):
                    text = raw[low : len(raw) - (len(raw) - low) % 2].decode("utf-16-le", "replace")
                    if _holds(text):
                        yield Layer(text, *layer.span(places[first], places[first + len(chars) - 1] + 1), path)
            if not _holds(raw.decode("utf-8", "surrogateescape")):
                continue
            text, offsets = _decoded(raw)
            if isinstance(layer.starts, int):
                yield Layer(text, layer.starts, layer.ends, path)
                continue
            spans = [layer.span(places[first + x * 4 // 3], places[min(len(chars), -(-y * 4 // 3)) + first - 1] + 1) for x, y in zip(offsets, offsets[1:])]
            yield Layer(text, [s for s, _ in spans], [e for _, e in spans], path)


UNWRAP = (_percent, _unicode, _bytes, _base64)


def scan(text: str | None) -> list[tuple[str, int, int, bool, str]]:
    """All finds (kind, start, end, base, path) of a whole text, by start, then kind; path tells the layers unwrapped.

    The worklist is one of generators, so that no more than one layer a depth is held at once.
    """
    first = Layer(text or "", None, None, "")
    found: dict[tuple[str, int, int], tuple[bool, str]] = {}
    seen: set[tuple] = set()
    work: list[Iterator[Layer]] = [iter((first,))]
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        if layer is not first:
            if (key := layer.key()) in seen or layer.text == first.text:
                continue
            seen.add(key)
        for kind, a, b in finds(layer.text):
            s, e = layer.span(a, b)
            found.setdefault((kind, s, e), (layer is first, layer.path))
        work.append(itertools.chain.from_iterable(map(lambda unwrap, layer=layer: unwrap(layer), UNWRAP)))
    return sorted(((k, s, e, base, path) for (k, s, e), (base, path) in found.items()), key=lambda f: (f[1], KINDS.index(f[0]), f[2]))


def secrets(text: Column) -> Column:
    """Finds of each whole text as an array of (kind, start, end, base, path); spans in code points, end exclusive."""

    @F.arrow_udf(SCHEMA)
    def spans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            offsets, rows = [0], []
            for text in batch:
                rows.extend(scan(text.as_py()))
                offsets.append(len(rows))
            columns = list(zip(*rows)) or [()] * 5
            yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SPAN)], fields=list(_SPAN)))

    return spans(text)


def _merged(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    out, at = [], 0
    for s, e in sorted(spans):
        if e <= at:
            continue
        if s >= at:
            out += [text[at:s], mark]
        at = e
    return "".join([*out, text[at:]])


def redacted(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with mark in the place of every find, until another scan finds nothing."""
    while text and (found := scan(text)):
        again = _merged(text, [(s, e) for _, s, e, _, _ in found], mark)
        if again == text:
            break
        text = again
    return text


def redact(df: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """df with every find in text_col replaced by mark; other columns, and texts without finds, stay as they are."""

    @F.arrow_udf("string")
    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([redacted(t, mark) for t in batch.to_pylist()], pa.string())

    return df.select(*[clean(col(c)).alias(c) if c == text_col else col(c) for c in df.columns])
