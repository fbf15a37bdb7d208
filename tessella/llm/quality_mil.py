"""Quality classifier by attention-based multiple-instance learning.

A text is a bag of passages of ``PASSAGE`` words. Each passage is encoded by a small network from what its characters and words are: shares of
kinds of characters, repetition, and hashed n-grams, namely how much more often its letter triples and its words occur in good documents than
in bad ones and in random letters. Gated attention learns, from labels of whole documents alone, how much each passage counts; the
score is that of the attention-weighted passage representation. Every passage of every text is encoded and scored.

The model is fitted on at most ``TRAIN_ROWS`` labelled documents (chosen by a hash of the id), each with all its passages, however long it is: their
features wait in a file of the driver, and gradients are taken over ``CHUNK`` passages at a time, which bounds the driver's memory. Scoring has no such limit. n-gram counts of either half of these documents serve the other half in
training, so that none is judged by its own words; in scoring both count. Good documents with their letters drawn at random or exchanged, and
the empty text, teach as bad ones, since labelled bad documents show only some ways of being bad.

Defined results: null and empty texts are one empty passage and get a score as others do; labels without a quality or
document teach nothing, nor do ids that don't compare with those of the other table; a document with several labels counts with the smallest; an id, of any type, of several rows teaches once, with the smallest text; without any labels every score is 0.5 and a filter keeps all;
repeated rows get equal scores. Labels, language, source and id are never inputs of a score.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import blocks, sliced
from .common import bounded_batches, col, drop, written

PASSAGE = 64
TRAIN_ROWS = 4096
#: Passages whose gradient is taken at once; a longer text is walked twice. It bounds memory only, as do the next three.
CHUNK = 16_384
#: Bytes of training texts that a worker encodes at once, and bytes of features that go to the driver at once.
BLOCK_BYTES = 4_000_000
SENT_BYTES = 16_000_000
#: Different words whose letter triples are held at once.
WORDS = 1 << 16
THRESHOLD = 0.7
#: Classes of bytes: space, line end, lower, upper, digit, symbol, exclamation, other ASCII, lead byte, later byte.
_CLASS = np.full(256, 7, np.uint8)
_CLASS[[9, 11, 12, 13, 32]] = 0
_CLASS[10] = 1
_CLASS[97:123] = 2
_CLASS[65:91] = 3
_CLASS[48:58] = 4
_CLASS[[ord(c) for c in "#*$%&|<>"]] = 5
_CLASS[[33, 63]] = 6
_CLASS[128:192] = 9
_CLASS[192:] = 8
FEATURES = 17
GRAM_BITS = 14
#: What n-grams are counted in: good and bad labelled documents, good ones with random letters, and those with their own letters exchanged.
GOOD, BAD, RANDOM, MIXED = range(4)


def grams(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of words without white space: the buckets of all their letter triples (of bytes, ends marked, in lower case), where each word's begin, and each word's own bucket."""
    words = pc.utf8_lower(words.cast(pa.string()))
    sizes = np.asarray(pc.binary_length(words), np.int64)
    first = np.concatenate(([0], np.cumsum(sizes)))
    raw = np.frombuffer(words.buffers()[2] or b"", np.uint8)[: first[-1]]
    spaced = np.full(len(raw) + 2 * len(sizes), 32, np.uint32)
    spaced[np.arange(len(raw)) + 2 * np.repeat(np.arange(len(sizes)), sizes) + 1] = raw
    at = np.arange(int(sizes.sum())) + 2 * np.repeat(np.arange(len(sizes)), sizes)
    code = spaced[at] << 16 | spaced[at + 1] << 8 | spaced[at + 2]
    mixed = code * np.uint32(0x9E3779B1)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x85EBCA77)
    own = np.add.reduceat(mixed, first[:-1], dtype=np.uint32) * np.uint32(0xC2B2AE3D) if len(sizes) else np.zeros(0, np.uint32)
    shift = np.uint32(32 - GRAM_BITS)
    return (mixed >> shift).astype(np.int64), first[:-1], (own >> shift).astype(np.int64)


def _gram_parts(words: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """grams of WORDS words at a time, with the number of the first."""
    for at in range(0, len(words), WORDS):
        yield at, *grams(pa.concat_arrays([words.slice(at, WORDS)]))


@dataclass
class Grams:
    """Log ratios by bucket: of triples in good documents to bad ones, to random letters and to exchanged ones, and of words in good documents to bad ones."""

    tables: np.ndarray

    @staticmethod
    def of(triples: np.ndarray, words: np.ndarray) -> Grams:
        """From counts by kind of document and bucket."""
        share = lambda c: np.log((c + 1.0) / (c.sum() + len(c)))
        ratios = [share(triples[GOOD]) - share(triples[k]) for k in (BAD, RANDOM, MIXED)] + [share(words[GOOD]) - share(words[BAD])]
        return Grams(np.clip(np.stack(ratios), -2, 2).astype(np.float32))

    def values(self, words: pa.Array) -> np.ndarray:
        """A row of the four mean ratios for each word."""
        if not len(words):
            return np.zeros((0, 4))
        out = np.zeros((len(words), 4))
        for at, triples, begin, own in _gram_parts(words):
            n = np.diff(np.append(begin, len(triples)))
            part = out[at : at + len(n)]
            for k in range(3):
                part[:, k] = np.add.reduceat(self.tables[k][triples], begin, dtype=np.float64) / n
            part[:, 3] = self.tables[3][own]
        return out


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different words of all texts, the number of each word of all texts in order, and where each text's words begin and end."""
    words = pc.ascii_split_whitespace(texts)
    flat = words.flatten()
    bounds = np.asarray(words.offsets).astype(np.int64)
    bounds -= bounds[0] if len(bounds) else 0
    real = np.asarray(pc.binary_length(flat), np.int64) > 0
    bounds = np.concatenate(([0], np.cumsum(real)))[bounds]
    coded = flat.filter(pa.array(real)).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), bounds


def gram_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """How often each bucket occurs among the letter triples and among the words of all texts."""
    known, ids, _ = _words(pc.fill_null(texts.cast(pa.string()), ""))
    size = 1 << GRAM_BITS
    if not len(ids):
        return np.zeros(size), np.zeros(size)
    times = np.bincount(ids, minlength=len(known)).astype(np.float64)
    of_triples, of_words = np.zeros(size), np.zeros(size)
    for at, triples, begin, own in _gram_parts(known):
        some = times[at : at + len(own)]
        of_triples += np.bincount(triples, np.repeat(some, np.diff(np.append(begin, len(triples)))), size)
        of_words += np.bincount(own, some, size)
    return of_triples, of_words


def spoilt(text: str, kind: int) -> str:
    """The text with each letter drawn at random (RANDOM) or exchanged with another of its letters (MIXED), capitals where they were; the same each time."""
    import zlib

    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    at = np.flatnonzero(((points | 32) - 97 < 26) | (points >= 0xC0))
    rng = np.random.default_rng([zlib.crc32(text.encode("utf-8", "surrogatepass")), kind])
    capital = points[at] - 65 < 26
    low = points[at] + 32 * capital.astype(np.uint32)
    low = rng.integers(97, 123, len(at)).astype(np.uint32) if kind == RANDOM else low[rng.permutation(len(at))]
    points[at] = low - 32 * (capital & (low - 97 < 26)).astype(np.uint32)
    return points.tobytes().decode("utf-32-le", "surrogatepass")


def featurize(texts: pa.Array, known: Grams | None = None, passage: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of all texts, and where each text's passages begin and end (one offset more than texts)."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    if texts.offset or not len(texts):
        texts = pa.concat_arrays([texts.slice(0, len(texts)), pa.array([], pa.string())])
    ends = np.cumsum(np.asarray(pc.binary_length(texts), np.int64)) if len(texts) else np.zeros(0, np.int64)
    joined = "".join(texts.to_pylist()).encode("utf-8")
    data = np.frombuffer(joined, np.uint8)
    kind = _CLASS[data]
    upper2 = np.zeros(len(data), bool)
    upper2[1:] = (data[:-1] == 0xC3) & (data[1:] < 0x9F)
    different, ids, bounds = _words(texts)
    n_words = np.diff(bounds)
    n_passages = np.maximum(1, -(-n_words // passage))
    offsets = np.concatenate(([0], np.cumsum(n_passages)))
    total = int(offsets[-1])
    x = np.zeros((total, FEATURES), np.float32)
    if len(ids):
        solid = kind > 1
        start = solid.copy()
        start[1:] &= ~solid[:-1]
        doc_begin = ends - np.asarray(pc.binary_length(texts), np.int64)
        inner = doc_begin[doc_begin < len(data)]
        start[inner] |= solid[inner]
        at = np.flatnonzero(start)
        text_of = np.repeat(np.arange(len(n_words)), n_words)
        nth = np.arange(len(ids)) - bounds[:-1][text_of]
        where = offsets[text_of] + nth // passage
        first = np.flatnonzero(nth % passage == 0)
        rows = where[first]
        cuts = at[first]
        sums = {c: np.add.reduceat(kind == c, cuts, dtype=np.int64).astype(np.float64) for c in (1, 2, 3, 4, 5, 6, 7, 8)}
        up2 = np.add.reduceat(upper2, cuts, dtype=np.int64)
        count = np.bincount(where, minlength=total)[rows].astype(np.float64)
        chars = np.maximum(1, sum(sums[c] for c in (2, 3, 4, 5, 6, 7, 8)))
        distinct = np.bincount(np.unique(where * (int(ids.max()) + 1) + ids) // (int(ids.max()) + 1), minlength=total)[rows]
        same = np.zeros(len(ids), np.int64)
        same[1:] = (ids[1:] == ids[:-1]) & (text_of[1:] == text_of[:-1])
        same[2:] |= (ids[2:] == ids[:-2]) & (text_of[2:] == text_of[:-2])
        ratios = known.values(different) if known else np.zeros((len(different), 4))
        ratios = [np.bincount(where, r[ids], total)[rows] / count for r in ratios.T]
        x[rows] = np.stack(
            [
                np.ones(len(rows)),
                np.log1p(count) / 4,
                np.minimum(chars / count, 20) / 10,
                (sums[3] + up2) / chars * 2,
                np.minimum(1, (sums[3] + up2) / chars * 8),
                sums[4] / chars * 4,
                np.minimum(2, sums[5] / count * 2),
                np.minimum(1, sums[5] / count * 20),
                np.minimum(2, sums[6] / count * 2),
                np.minimum(2, sums[7] / count * 4),
                np.minimum(2, sums[1] / count * 8),
                distinct / count * 2,
                np.minimum(1, np.bincount(where, same, minlength=total)[rows] / count * 4),
                *ratios,
            ],
            axis=1,
        )
    return x, offsets


@dataclass
class Mil:
    """Encoder (w, b), gated attention (v, u, a) and score (c, d), with the features' mean and scale."""

    weights: dict[str, np.ndarray]
    mean: np.ndarray
    scale: np.ndarray
    trained: bool = True
    grams: Grams | None = None

    def score(self, x: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return _forward(self.weights, (x - self.mean) / self.scale, offsets)["p"]

    def attention(self, x: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """How much each passage counts in its text."""
        return _forward(self.weights, (x - self.mean) / self.scale, offsets)["alpha"]


def _forward(w: dict[str, np.ndarray], x: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    x = x.astype(np.float64)
    starts, owner = offsets[:-1], np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    h = np.tanh(x @ w["w"] + w["b"])
    gate_v, gate_u = np.tanh(h @ w["v"]), 1 / (1 + np.exp(-h @ w["u"]))
    e = (gate_v * gate_u) @ w["a"]
    e = np.exp(e - np.maximum.reduceat(e, starts)[owner]) if len(e) else e
    alpha = e / np.add.reduceat(e, starts)[owner] if len(e) else e
    z = np.add.reduceat(alpha[:, None] * h, starts, axis=0) if len(e) else np.zeros((0, h.shape[1]))
    p = 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["d"], -30, 30)))
    return {"x": x, "h": h, "v": gate_v, "u": gate_u, "alpha": alpha, "z": z, "p": p, "owner": owner}


def _gradient(w: dict[str, np.ndarray], x: np.ndarray, offsets: np.ndarray, y: np.ndarray, of: int | None = None) -> dict[str, np.ndarray]:
    """The gradient of the loss of whole bags, as a part of a batch of so many bags (these alone by default)."""
    f = _forward(w, x, offsets)
    delta = (f["p"] - y) / (of or len(y))
    dz = (delta[:, None] * w["c"])[f["owner"]]
    da = (f["h"] * dz).sum(axis=1)
    even = np.add.reduceat(f["alpha"] * da, offsets[:-1])[f["owner"]]
    return _passage_gradient(w, f["x"], f["h"], f["v"], f["u"], f["alpha"], dz, da - even) | {"c": f["z"].T @ delta, "d": np.array([delta.sum()])}


def _passage_gradient(w: dict[str, np.ndarray], x: np.ndarray, h: np.ndarray, v: np.ndarray, u: np.ndarray, alpha: np.ndarray, dz: np.ndarray, pull: np.ndarray) -> dict[str, np.ndarray]:
    """What passages add to the gradients of the encoder and the attention. dz: of their bag's z; pull: how much more than their bag's mean they move the loss."""
    de = alpha * pull
    dv = de[:, None] * w["a"] * u * (1 - v**2)
    du = de[:, None] * w["a"] * v * u * (1 - u)
    dh = (alpha[:, None] * dz + dv @ w["v"].T + du @ w["u"].T) * (1 - h**2)
    return {"w": x.T @ dh, "b": dh.sum(axis=0), "v": h.T @ dv, "u": h.T @ du, "a": (v * u).T @ de}


def _long_gradient(w: dict[str, np.ndarray], parts: Callable[[], Iterator[np.ndarray]], y: float, of: int) -> dict[str, np.ndarray]:
    """_gradient of one bag that parts gives in pieces, each time from its begin: one walk for the attention's sum, one for the gradient."""

    def encoded() -> Iterator[tuple[np.ndarray, ...]]:
        for x in parts():
            x = x.astype(np.float64)
            h = np.tanh(x @ w["w"] + w["b"])
            v, u = np.tanh(h @ w["v"]), 1 / (1 + np.exp(-h @ w["u"]))
            yield x, h, v, u, (v * u) @ w["a"]

    top, total, z = -np.inf, 0.0, np.zeros_like(w["c"])
    for _, h, _, _, e in encoded():
        higher = max(top, e.max())
        share, shrunk = np.exp(e - higher), np.exp(top - higher)
        top, total, z = higher, total * shrunk + share.sum(), z * shrunk + share @ h
    z /= total
    delta = (1 / (1 + np.exp(-np.clip(z @ w["c"] + w["d"], -30, 30)))[0] - y) / of
    dz = delta * w["c"]
    out = {k: np.zeros_like(a) for k, a in w.items()} | {"c": z * delta, "d": np.array([delta])}
    for x, h, v, u, e in encoded():
        for k, part in _passage_gradient(w, x, h, v, u, np.exp(e - top) / total, dz, h @ dz - z @ dz).items():
            out[k] += part
    return out


def _moments(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and scale of the features, CHUNK rows at a time."""
    pieces = range(0, len(x), CHUNK)
    mean = sum(x[a : a + CHUNK].sum(axis=0, dtype=np.float64) for a in pieces) / len(x)
    square = sum(((x[a : a + CHUNK] - mean) ** 2).sum(axis=0) for a in pieces) / len(x)
    return mean.astype(np.float32), (np.sqrt(square) + 1e-3).astype(np.float32)


def _runs(bags: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """The bags in runs of at most CHUNK passages; one that has more is a run of its own."""
    begin, held = 0, 0
    for k, n in enumerate(sizes[bags].tolist()):
        if k > begin and held + n > CHUNK:
            yield bags[begin:k]
            begin, held = k, 0
        held += n
    yield bags[begin:]


def fit(x: np.ndarray, offsets: np.ndarray, y: np.ndarray, hidden: int = 24, gates: int = 8, epochs: int = 40, batch: int = 128, rate: float = 0.01, decay: float = 1e-4, seed: int = 0) -> Mil:
    """A model of bags x[offsets[i]:offsets[i+1]] with labels y, by Adam on the cross entropy; of x, which may lie in a file, CHUNK rows are held at once."""
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    small = lambda *s: rng.normal(size=s) / np.sqrt(s[0])
    w = {"w": small(d, hidden), "b": np.zeros(hidden), "v": small(hidden, gates), "u": small(hidden, gates), "a": small(gates), "c": small(hidden), "d": np.zeros(1)}
    mean, scale = _moments(x) if len(x) else (np.zeros(d), np.ones(d))
    if not len(y):
        w["c"][:] = 0
        return Mil(w, mean, scale, trained=False)
    scaled = lambda rows: (x[rows] - mean) / scale
    m, s, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    sizes = np.diff(offsets)
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(order), batch):
            bags = order[at : at + batch]
            g = {k: np.zeros_like(v) for k, v in w.items()}
            for run in _runs(bags, sizes):
                if sizes[run[0]] > CHUNK:
                    a, b = int(offsets[run[0]]), int(offsets[run[0] + 1])
                    part = _long_gradient(w, lambda a=a, b=b: (scaled(slice(k, min(k + CHUNK, b))) for k in range(a, b, CHUNK)), y[run[0]], len(bags))
                else:
                    rows = np.concatenate([np.arange(offsets[b], offsets[b + 1]) for b in run])
                    part = _gradient(w, scaled(rows), np.concatenate(([0], np.cumsum(sizes[run]))), y[run], len(bags))
                for k, v in part.items():
                    g[k] += v
            step += 1
            for k in w:
                grad = g[k] + decay * w[k]
                m[k] = 0.9 * m[k] + 0.1 * grad
                s[k] = 0.999 * s[k] + 0.001 * grad**2
                w[k] = w[k] - rate * (0.3 if epoch > epochs // 2 else 1) * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
    return Mil(w, mean, scale)


def held_out(doc_id: Column) -> Column:
    """Rows that never teach: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _same_id(docs: DataFrame, id_col: str, chosen: DataFrame) -> Column:
    """doc equals id. Of a string and another type the string is read as the other; one that can't be read equals nothing, where a plain comparison would fail."""
    left, right = docs.select(col(id_col)).schema[0].dataType, chosen.schema["id"].dataType
    doc, label = F.col("doc"), F.col("id")
    if left == right:
        return doc == label
    if left.typeName() == "string":
        return doc.try_cast(right) == label
    if right.typeName() == "string":
        return doc == label.try_cast(left)
    return doc == label


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS) -> Mil:
    """A model fitted on a bounded sample of the labelled documents that are not held out."""
    bounded_batches(docs.sparkSession)
    known = labels.filter(col(label_col).isNotNull() & col(id_col).isNotNull() & ~held_out(col(id_col))).groupBy(col(id_col).alias("id")).agg(F.min(col(label_col).cast("int")).alias("y"))
    chosen = written(known.orderBy(F.xxhash64("id"), "id").limit(rows), "labels")
    named = docs.select(col(id_col).alias("doc"), col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), _same_id(docs, id_col, chosen))  # at most TRAIN_ROWS labels
    spelt = F.hex("id") if chosen.schema["id"].dataType.typeName() == "binary" else F.col("id").cast("string")  # bytes need not be UTF-8
    bags = named.groupBy("id", "y").agg(F.min("text").alias("text")).select(spelt.alias("id"), "y", "text", F.pmod(F.xxhash64("id"), F.lit(12)).cast("int").alias("part"))
    bags = written(bags, "bags")
    spread = bags.repartition(8, "id")

    def variants(batch: pa.RecordBatch) -> Iterator[tuple[str, int, int, int, str]]:
        """(id, half, kind, y, text) of each document, and of a sixth of the good ones that are not short with letters spoilt in either way."""
        for i, y, text, part in zip(*(c.to_pylist() for c in batch.columns)):
            text = text or ""
            yield i, part % 2, GOOD if y else BAD, y, text
            if y and part // 2 == 0 and len(text) >= 300:
                yield from ((i, part % 2, kind, 0, spoilt(text, kind)) for kind in (RANDOM, MIXED))

    def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[str, int, int, int, str]]]:
        """All variants, some BLOCK_BYTES of text at a time."""
        block, size = [], 0
        for batch in batches:
            for row in range(batch.num_rows):
                for v in variants(batch.slice(row, 1)):
                    block.append(v)
                    size += len(v[4])
                    if size >= BLOCK_BYTES:
                        yield block
                        block, size = [], 0
        if block:
            yield block

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((2, 4, 2, 1 << GRAM_BITS))
        for block in blocks_of(batches):
            groups: dict[tuple[int, int], list[str]] = {}
            for _, half, kind, _, text in block:
                groups.setdefault((half, kind), []).append(text)
            for (half, kind), texts in groups.items():
                found[half, kind] += np.stack(gram_counts(pa.array(texts, pa.string())))
        yield pa.RecordBatch.from_arrays([pa.array([found.astype(np.float32).tobytes()], pa.binary())], names=["counts"])

    counts = sum((np.frombuffer(c, np.float32).reshape(2, 4, 2, -1).astype(np.float64) for (c,) in spread.mapInArrow(counted, "counts binary").collect()), np.zeros((2, 4, 2, 1 << GRAM_BITS)))  # one row of fixed size a task
    table = lambda c: Grams.of(c[:, 0], c[:, 1])
    other = [table(counts[1]), table(counts[0])]

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks_of(batches):
            rows = []
            for half in (0, 1):
                some = [v for v in block if v[1] == half]
                if some:
                    x, offsets = featurize(pa.array([v[4] for v in some], pa.string()), other[half])
                    for (i, _, kind, y, _), begin, end in zip(some, offsets[:-1].tolist(), offsets[1:].tolist()):
                        rows += [(i, kind, nth, y, x[at : min(at + CHUNK, end)].tobytes()) for nth, at in enumerate(range(begin, end, CHUNK))]
            kinds = pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary()
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["id", "kind", "nth", "y", "x"])

    encoded = written(spread.mapInArrow(features, "id string, kind int, nth int, y int, x binary"), "features")
    size = encoded.agg(F.sum(F.octet_length("x").cast("long"))).head()[0] or 0
    ordered = encoded.repartitionByRange(1 + size // SENT_BYTES, "id", "kind", "nth").sortWithinPartitions("id", "kind", "nth")
    with tempfile.TemporaryFile() as file:
        sizes: list[int] = []
        labels_: list[int] = []
        for _, _, nth, y, x in ordered.toLocalIterator():  # a partition at a time: some SENT_BYTES, of at most TRAIN_ROWS documents and two variants of each in all
            if nth == 0:
                sizes.append(0)
                labels_.append(y)
            sizes[-1] += file.write(x) // (4 * FEATURES)
        drop(chosen, bags, encoded)
        if sizes:
            empty = max(4, len(sizes) // 50)
            file.write(featurize(pa.array([""]))[0].tobytes() * empty)
            sizes += [1] * empty
            labels_ += [0] * empty
        file.flush()
        x = np.memmap(file, np.float32, "r", shape=(sum(sizes), FEATURES)) if sizes else np.zeros((0, FEATURES), np.float32)
        model = fit(x, np.concatenate(([0], np.cumsum(sizes))).astype(np.int64), np.array(labels_, np.float64))
    model.grams = table(counts.sum(axis=0))
    return model


def score(text: Column, model: Mil) -> Column:
    """The score of each whole text, 0 to 1."""

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts, sizes in blocks(batches):
            yield from sliced(pa.array(model.score(*featurize(texts, model.grams)) if len(texts) else [], pa.float64()), sizes)

    return scored(text)


def quality_filter(docs: DataFrame, model: Mil, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score threshold or more, with the columns of docs; all rows if no label taught the model."""
    return docs.filter(score(col(text_col).cast("string"), model) >= threshold) if model.trained else docs
