"""BPE encoding and decoding with a pair occurrence index.

Encoding works on the distinct pieces of a batch of documents at once. All pieces lie in one flat symbol
list; the *pair occurrence index* maps each mergeable pair, by its rank, to all positions at which it stands.
Active ranks are applied in ascending order from a heap; each merge updates the occurrence lists of the two
neighbouring pairs only, so a merge never rescans a piece. Text is then rebuilt by one lookup per
white-space-delimited chunk, which makes the cost of running text that of a dictionary lookup.

Defined results: a null text is an empty text and has no ids; an empty text has none either; repeated rows are
encoded each; texts of any length are encoded whole.
"""

from __future__ import annotations

import gc
import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Chunks that a worker keeps from batch to batch. It bounds memory only: a chunk that was forgotten is encoded again.
CACHE_CHUNKS = 800_000
#: New chunks that are encoded at once; it bounds memory only.
LEARN_CHUNKS = 50_000


def byte_symbols() -> list[str]:
    """The printable character that byte-level BPE uses for each byte value."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(extra)) for b in range(256)]


class BpeModel:
    """A vocabulary file of word-end BPE: normaliser, pattern, merges and special tokens as the file states them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        steps = [s["type"] for s in (spec.get("normalizer") or {}).get("normalizers", [])]
        parts = spec["pre_tokenizer"]["pretokenizers"]
        if model["type"] != "BPE" or steps != ["NFC", "Replace", "Lowercase"] or [p["type"] for p in parts] != ["Split", "ByteLevel"]:
            raise ValueError("the vocabulary is not word-end BPE over lower-cased NFC text")
        self.path = path
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.pattern = regex.compile(parts[0]["pattern"]["Regex"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        symbols = byte_symbols()
        self.inner = [self.vocab[s] for s in symbols]
        self.final = [self.vocab[s + self.suffix] for s in symbols]
        self.rank: dict[tuple[int, int], int] = {}
        self.made: list[tuple[int, int, int]] = []
        for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            pair = self.vocab[a], self.vocab[b]
            self.rank[pair] = len(self.made)
            self.made.append((*pair, self.vocab[a + b]))

    @cached_property
    def token_names(self) -> list[str]:
        return [self.names.get(i, "") for i in range(max(self.names) + 1)]

    def pieces(self, text: str) -> list[str]:
        """The pieces of a special-free text, normalised as the file says."""
        return self.pattern.findall(self.normal(text))

    def normal(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no final-sigma rule: each character by itself
        return text.lower()

    @cached_property
    def _pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys of the mergeable pairs and the rank of each."""
        keys = np.fromiter((a * len(self.names) + b for a, b in self.rank), np.int64, len(self.rank))
        order = np.argsort(keys)
        return keys[order], np.fromiter(self.rank.values(), np.int64, len(self.rank))[order]

    @cached_property
    def _late(self) -> set[int]:
        """Ranks whose product stands in a pair of lower rank: after such a merge, the lower rank comes first."""
        least: dict[int, int] = {}
        for r, (a, b, _) in enumerate(self.made):
            for x in (a, b):
                least.setdefault(x, r)
        return {r for r, (_, _, c) in enumerate(self.made) if least.get(c, r) < r}

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, -1 where it can't be merged."""
        keys, ranks = self._pairs
        wanted = left.astype(np.int64) * len(self.names) + right
        at = np.searchsorted(keys, wanted)
        at[at == len(keys)] = 0
        return np.where(keys[at] == wanted, ranks[at], -1)

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece through the pair occurrence index over all of them."""
        raw = [p.encode("utf-8") for p in pieces]
        flat = np.frombuffer(b"".join(raw), np.uint8)
        n = len(flat)
        if not n:
            return [b""] * len(raw)
        ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
        first, last = np.concatenate(([0], ends[:-1])), ends - 1
        sym = np.array(self.inner, np.int32)[flat]
        sym[last] = np.array(self.final, np.int32)[flat[last]]
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        after[last], before[first] = -1, -1
        owner = np.repeat(np.arange(len(raw), dtype=np.int32), np.diff(ends, prepend=0))
        where: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(spots: np.ndarray, ranks: np.ndarray) -> None:
            able = ranks >= 0
            spots, ranks = spots[able], ranks[able]
            if not len(spots):
                return
            order = np.argsort(ranks, kind="stable")
            spots, ranks = spots[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            bounds = [0, *cuts.tolist(), len(spots)]
            for r, lo, hi in zip(ranks[bounds[:-1]].tolist(), bounds, bounds[1:]):
                if r in where:
                    where[r].append(spots[lo:hi])
                else:
                    where[r] = [spots[lo:hi]]
                    heapq.heappush(heap, r)

        start = np.flatnonzero(after >= 0).astype(np.int32)
        add(start, self._ranks(sym[start], sym[start + 1]))
        while heap:
            r = heapq.heappop(heap)
            a, b, c = self.made[r]
            lists = where.pop(r)
            at = np.unique(np.concatenate(lists)) if len(lists) > 1 else lists[0]
            mate = after[at]
            good = (sym[at] == a) & (mate >= 0) & (sym[mate] == b)
            at, mate = at[good], mate[good]
            if a == b and len(at) > 1:  # of overlapping occurrences the left one counts
                taken, keep = -1, []
                for i, j in zip(at.tolist(), mate.tolist()):
                    keep.append(i != taken)
                    taken = j if keep[-1] else taken
                at, mate = at[keep], mate[keep]
            if r in self._late and len(at) > 1:  # one merge a piece, then whatever rank is lowest there
                lead = np.concatenate(([True], owner[at[1:]] != owner[at[:-1]]))
                if not lead.all():
                    where[r] = [at[~lead]]
                    heapq.heappush(heap, r)
                at, mate = at[lead], mate[lead]
            if not len(at):
                continue
            sym[at], sym[mate] = c, -1
            follow = after[mate]
            after[at] = follow
            some = follow >= 0
            before[follow[some]] = at[some]
            prior = before[at]
            there = prior >= 0
            lefts, rights = np.concatenate((at[some], prior[there])), np.concatenate((follow[some], at[there]))
            add(lefts, self._ranks(sym[lefts], sym[rights]))
        alive = sym >= 0
        stops = np.cumsum(alive)[last] * 4
        data = sym[alive].astype("<u4").tobytes()
        return [data[lo:hi] for lo, hi in zip([0, *stops.tolist()], stops.tolist())]


def _library(model: BpeModel) -> Callable[[list[str]], list[bytes]]:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(model.path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda pieces: [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids. engine: "index" (the pair occurrence index) or "library"."""

    def __init__(self, path: str, engine: str = "index"):
        self.model = BpeModel(path)
        self.engine = engine
        self.learn_pieces: Callable[[list[str]], list[bytes]] | None = None
        self.chunks: dict[str, bytes] = {}

    def _learn(self, chunks: list[str]) -> None:
        special = self.model.split_special
        if self.engine == "library":
            if self.learn_pieces is None:
                self.learn_pieces = _library(self.model)
            self.chunks.update(zip(chunks, self.learn_pieces(chunks)))
            return
        if special and (odd := [c for c in chunks if "<|" in c]):
            for c in odd:
                parts = [[s] if s in self.model.special else self.model.pieces(s) for s in special.split(c)]
                known = dict(zip(names := list({p for ps in parts for p in ps if p not in self.model.special}), self.model.encode_pieces(names)))
                known |= {s: struct.pack("<I", i) for s, i in self.model.special.items()}
                self.chunks[c] = b"".join([known[p] for ps in parts for p in ps])
            chunks = [c for c in chunks if "<|" not in c]
        if not chunks:
            return
        low = self.model.normal("\n".join(chunks)).split("\n")  # no chunk holds a line end
        plan = [c if c.isalpha() else self.model.pattern.findall(c) for c in low]
        todo = {p for p in plan if isinstance(p, str)}
        todo.update(*[p for p in plan if not isinstance(p, str)])
        names = list(todo)
        known = dict(zip(names, self.model.encode_pieces(names)))
        get = known.__getitem__
        self.chunks.update(zip(chunks, [get(p) if isinstance(p, str) else b"".join(map(get, p)) for p in plan]))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each text's ids begin and end (one offset more than texts)."""
        split = pc.ascii_split_whitespace(texts.fill_null(""))
        coded = split.flatten().dictionary_encode()
        chunks = coded.dictionary.to_pylist()
        if len(self.chunks) + len(chunks) > CACHE_CHUNKS:
            self.chunks.clear()
        collecting = gc.isenabled()
        gc.disable()  # many short strings and no cycles
        if new := [c for c in chunks if c not in self.chunks]:
            for at in range(0, len(new), LEARN_CHUNKS):
                self._learn(new[at : at + LEARN_CHUNKS])
        parts = list(map(self.chunks.__getitem__, chunks))
        if collecting:
            gc.enable()
        ids = np.frombuffer(b"".join(parts), "<u4")
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        begins = np.cumsum(sizes) - sizes
        which = coded.indices.to_numpy()
        counts = sizes[which]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        out = ids[np.repeat(begins[which] - (ends - counts), counts) + np.arange(total)]
        bounds = np.asarray(split.offsets) - split.offsets[0].as_py()
        return out, np.concatenate(([0], ends))[bounds]


@lru_cache(maxsize=4)
def encoder(path: str, engine: str = "index") -> Encoder:
    """One encoder a worker process and vocabulary."""
    return Encoder(path, engine)


def blocks(batches: Iterator[pa.Array], chars: int = 4_000_000) -> Iterator[tuple[pa.Array, list[int]]]:
    """Runs of whole texts of about so many bytes, with the lengths of the batches that end in each; one batch or several."""
    waiting: list[pa.Array] = []
    size = 0
    for batch in batches:
        batch = batch.cast(pa.string())
        waiting.append(batch)
        size += batch.nbytes
        if size >= chars:
            yield pa.concat_arrays(waiting), [len(w) for w in waiting]
            waiting, size = [], 0
    if waiting:
        yield pa.concat_arrays(waiting), [len(w) for w in waiting]


def binary_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Slices of little-endian numbers as an Arrow binary array."""
    data = np.ascontiguousarray(data, "<u4")
    return pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * 4).astype(np.int32)), pa.py_buffer(data)])


def names_array(model: BpeModel) -> pa.Array:
    return pa.array(model.token_names, pa.string())


def joined(ids: np.ndarray, offsets: np.ndarray, names: pa.Array) -> pa.Array:
    """Text of each slice of ids: its token strings joined by one space; ids outside the vocabulary are left out."""
    known = ids < len(names)
    if not known.all():
        offsets = np.concatenate(([0], np.cumsum(known)))[offsets]
        ids = ids[known]
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), names.take(pa.array(ids, pa.uint32()))), " ")


def sliced(whole: pa.Array, sizes: list[int]) -> Iterator[pa.Array]:
    """The array in slices of the given lengths."""
    at = 0
    for n in sizes:
        yield whole.slice(at, n)
        at += n


def encode(text: Column, vocabulary: str, engine: str = "index") -> Column:
    """Ids of each whole text as binary: little-endian unsigned 32-bit integers, without added special tokens.

    Null and empty texts give an empty binary. The strings of special tokens in a text give their ids, as the
    tokenizers library does by default.
    """

    @F.arrow_udf("binary")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        e = encoder(vocabulary, engine)
        for texts, sizes in blocks(batches):
            yield from sliced(binary_array(*e.encode(texts)), sizes)

    return ids(text)


def decode(ids: Column, vocabulary: str) -> Column:
    """Text of ids (binary as encode() gives it): token strings joined by one space, as a vocabulary without a decoder states.

    Null and empty ids give an empty text; ids outside the vocabulary are left out.
    """

    @F.arrow_udf("string")
    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = names_array(encoder(vocabulary).model)
        for batch in batches:
            raw = batch.fill_null(b"").to_pylist()
            offsets = np.concatenate(([0], np.cumsum([len(r) // 4 for r in raw]))).astype(np.int64)
            yield joined(np.frombuffer(b"".join(raw), "<u4"), offsets, names)

    return texts(ids)


def round_trip(text: Column, vocabulary: str, engine: str = "index") -> Column:
    """A struct (ids, decoded) of each whole text: encode() and decode() in one pass, so that ids travel to one worker only."""

    @F.arrow_udf("struct<ids:binary,decoded:string>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        e = encoder(vocabulary, engine)
        names = names_array(e.model)
        for texts, sizes in blocks(batches):
            ids, offsets = e.encode(texts)
            yield from sliced(pa.StructArray.from_arrays([binary_array(ids, offsets), joined(ids, offsets, names)], names=["ids", "decoded"]), sizes)

    return both(text)


def token_count(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("long")
