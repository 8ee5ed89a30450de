"""Problem 10: the subject areas of documents.

1. Documents are cut in sentences and informative words, which are hashed to ``DIMS`` features; document frequencies are counted over all documents.
2. Normalised tf-idf vectors, projected to ``WIDTH`` random signs, are clustered by bisecting k-means: of all leaves the one is split whose halves
   gain most. The tree is fitted on all documents: nodes of more than ``HELD`` are cut by passes over their vectors, all nodes of a level in the same
   passes; smaller ones are held by a task each, which grows the tree below them. Vectors are whole numbers and so are their sums, so the tree doesn't
   depend on how documents are dealt to tasks. Every document is placed at its nearest leaf, and each leaf's terms are counted over all documents.
3. A leaf's terms are those it has more often than other leaves, by log-odds. Each sentence is placed at the leaves by their terms, softly; a document's
   leaf mixture is that of its sentences, by length.
4. A leaf's mixture of areas comes from the hand labels of documents, by their leaf mixtures, and from those of its terms that the areas' titles and notes
   hold. A document's share of an area is its leaf mixture times the leaves' mixtures: areas have no other way to a document.
5. A document gets the areas that fill ``LEAST`` or more of it. A passing mention stays below.

Words of scripts without letter case count like others; scripts written without blanks give pairs of neighbouring characters.

Hand labels are read without regard to case and outer blanks; unknown and null ones are dropped, repeated ones count once, and
a document's labels share its weight. Null, empty and blank texts, and null ids, get no area; each row of a repeated id is judged by itself.
Without documents or areas there are no rows. Areas are at most ``MOST_AREAS``, else it raises: their number is the width of a table that tasks hold.
"""

from __future__ import annotations

import math
import pickle
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce
from typing import Any

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.keys import plain_key
from tessella.session import materialize, release

DIMS, WIDTH, LEAVES, ROUNDS, TRIES, SEED = 32_768, 192, 96, 6, 3, 11
#: Documents of a node that one task cuts on, at most.
HELD = 50_000
#: Vectors are in whole parts of FINE, centres in whole parts of twice that; products of both, and sums of PART vectors, are then exact in 32-bit floats.
FINE, PART = 2_000, 4_096
#: Tasks whose answers the driver joins; those of more are joined in tasks first.
GATHERED = 16
#: Tasks that count leaves' terms, each with at most LEAVES * DIMS sums.
COUNTING = 4_096
MOST_AREAS = 1_000
#: Share of a document's text from which an area is one of its own: half of it, less what is said of other things.
LEAST = 0.3
#: Weight of no evidence, for each area, and of a leaf's terms in the areas' notes, in labelled documents.
PRIOR, NOTES = 0.02, 0.5
#: Leaves that hold several areas count less than pure ones: their mixtures are raised to this power.
POWER = 2

_WORD = re.compile(r"(?<![\w.])[^\W\d_]+(?:[-’'][^\W\d_]+)*(?![\w])")
#: The same with combining marks, which belong to the letters before them.
_MARKED = regex.compile(r"(?<![\w\p{M}.])\p{L}[\p{L}\p{M}]*(?:[-’']\p{L}[\p{L}\p{M}]*)*(?![\w\p{M}])")
_UNSPACED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]")
_FAR = re.compile("[\u0300-\U0010ffff]")
_SENTENCE = re.compile(r"(?<=[.!?؟।])\s+|(?<=[。！？])|\n+")


def _dim(word: str) -> int:
    return zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % DIMS


class _Dims(dict):
    """Written words to features, -1 for those left out, worked out when first met."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        cased = word.lower() != word.upper()
        fit = len(word) > (3 if cased else 1) and ("-" in word or not any(c.isupper() for c in word[1:]))
        self[word] = dim = _dim(word) if fit else -1
        return dim


_dims = _Dims()


def features(sentence: str) -> list[int]:
    """Hashed words of four letters or more, of two in scripts without case; formulas and symbols, with capitals inside, are left out.

    Runs of a script written without blanks give their pairs of neighbouring characters.
    """
    if not _FAR.search(sentence):
        return [d for w in _WORD.findall(sentence) if (d := _dims[w]) >= 0]
    out = []
    for w in _MARKED.findall(sentence):
        if _UNSPACED.search(w):
            out += [_dim(w[i : i + 2]) for i in range(max(1, len(w) - 1))]
        elif (d := _dims[w]) >= 0:
            out.append(d)
    return out


_TOKENS = pa.schema([("doc_id", pa.int64()), ("sizes", pa.list_(pa.int32())), ("chars", pa.list_(pa.int32())), ("dims", pa.list_(pa.int32()))])
_TOKENS_DDL = "doc_id long, sizes array<int>, chars array<int>, dims array<int>"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 1000):
            part = b.slice(at, 1000)
            sizes, chars, dims = [], [], []
            for text in part.column(1).to_pylist():
                s = [x for x in _SENTENCE.split(text) if x.strip()]
                f = [features(x) for x in s]
                sizes.append([len(x) for x in f])
                chars.append([len(x) for x in s])
                dims.append([d for x in f for d in x])
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, pa.list_(pa.int32())) for c in (sizes, chars, dims)]], schema=_TOKENS)


def _flat(b: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and the lengths of its rows."""
    col = b.column(name)
    offs = np.diff(col.offsets.to_numpy())
    return col.flatten().to_numpy(), offs


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df = np.zeros(DIMS, np.int64)
    n = 0
    for b in batches:
        dims, sizes = _flat(b, "dims")
        n += len(sizes)
        pair = np.unique(np.repeat(np.arange(len(sizes), dtype=np.int64), sizes) * DIMS + dims)
        df += np.bincount(pair % DIMS, minlength=DIMS)
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1].astype(np.int32)), pa.array(np.r_[df[at], n])], names=["dim", "n"])


@lru_cache(maxsize=1)
def _signs() -> np.ndarray:
    return (np.random.default_rng(SEED).integers(0, 2, (DIMS, WIDTH), dtype=np.int8) * 2 - 1).astype(np.float32)


def _vectors(b: pa.RecordBatch, idf: np.ndarray) -> np.ndarray:
    """Projected tf-idf vectors of unit length; zero for a document without features."""
    signs = _signs()
    dims, sizes = _flat(b, "dims")
    pair, tf = np.unique(np.repeat(np.arange(len(sizes), dtype=np.int64), sizes) * DIMS + dims, return_counts=True)
    row, dim = pair // DIMS, pair % DIMS
    w = (np.log1p(tf) * idf[dim]).astype(np.float32)
    cuts = np.searchsorted(row, np.arange(len(sizes) + 1)).tolist()
    out = np.zeros((len(sizes), WIDTH), np.float32)
    for i, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        out[i] = w[lo:hi] @ signs[dim[lo:hi]]
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def _vectored(idf: np.ndarray):
    """Adds each document's vector, in whole parts of ``FINE``, as the bytes of 16-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                yield b.append_column("x", _packed(np.rint(_vectors(b, idf) * FINE).astype(np.int16)))

    return run


def _packed(x: np.ndarray) -> pa.Array:
    ends = np.arange(len(x) + 1, dtype=np.int32) * (2 * WIDTH)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(x))])


def _unpacked(col: pa.Array) -> np.ndarray:
    if not len(col):
        return np.zeros((0, WIDTH), np.int16)
    first = int(np.frombuffer(col.buffers()[1], np.int32, 1, 4 * col.offset)[0])
    return np.frombuffer(col.buffers()[2], np.int16, len(col) * WIDTH, first).reshape(-1, WIDTH)


def _unit(v: np.ndarray) -> np.ndarray:
    return np.rint(v * (2 * FINE / max(float(np.linalg.norm(v)), 1e-9))).astype(np.float32)


@lru_cache(maxsize=1)
def _odd() -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 1 << 63, WIDTH // 4 + TRIES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _drawn(x: np.ndarray) -> list[list[tuple[int, bytes]]]:
    """For each try but the first, the two different vectors of the lowest hashes."""
    odd, out = _odd(), []
    h = (np.ascontiguousarray(x).view(np.uint64) * odd[: WIDTH // 4]).sum(1, dtype=np.uint64)
    for salt in odd[WIDTH // 4 + 1 :]:
        k = (h ^ salt) * salt
        k = (k ^ (k >> np.uint64(31))) * odd[0]
        k ^= k >> np.uint64(29)
        least, at = np.unique(k, return_index=True)
        out.append([(int(v), x[i].tobytes()) for v, i in zip(least[:2], at[:2], strict=True)])
    return out


def _answer(x: np.ndarray, ask: dict[str, Any]) -> dict[str, Any]:
    """What ``PART`` vectors of a node, at most, say to what its cut asks."""
    y, out = x.astype(np.float32), {}
    if "all" in ask:
        out["all"] = len(x), y.sum(0).astype(np.float64)
    if "far" in ask:  # of equally far ones that of the least bytes
        v = y @ ask["far"]
        out["far"] = float(v.min()), min({x[i].tobytes() for i in np.flatnonzero(v == v.min())})
    if "draw" in ask:
        out["draw"] = _drawn(x)
    if "ways" in ask:
        second = (y @ ask["ways"] < 0).astype(np.float32)
        out["ways"] = second.sum(0).astype(np.int64), (second.T @ y).astype(np.float64)
    return out


def _joined(p: dict[str, Any], q: dict[str, Any]) -> dict[str, Any]:
    out = {k: (p[k][0] + q[k][0], p[k][1] + q[k][1]) for k in ("all", "ways") if k in p}
    if "far" in p:
        out["far"] = min(p["far"], q["far"])
    if "draw" in p:
        out["draw"] = [sorted({*a, *b})[:2] for a, b in zip(p["draw"], q["draw"], strict=True)]
    return out


class _Cut:
    """A node's cut in two by k-means, the best of ``TRIES``: what it asks of the node's vectors next, and what it makes of the answers.

    The first try begins with the vector furthest from the centre and that furthest from it, the others with vectors drawn by hash. ``best`` is what the
    cut gains (how much longer the halves' sums are than the whole's), its direction, and number and sum of the vectors in the second half.
    """

    def __init__(self, n: int, total: np.ndarray):
        self.n, self.total, self.best = n, total, None
        self.far, self.first, self.draw = _unit(total), None, TRIES > 1
        self.ways: dict[int, np.ndarray] = {}
        self.rounds = [0] * TRIES
        self.over = n <= 3

    def ask(self) -> dict[str, Any]:
        out: dict[str, Any] = {"far": self.far} if self.far is not None else {}
        if self.draw:
            out["draw"] = True
        if self.ways:
            out["ways"] = np.stack([self.ways[t] for t in sorted(self.ways)], axis=1)
        return out

    def told(self, part: dict[str, Any]) -> None:
        if "ways" in part:
            for t, n, second in zip(sorted(self.ways), *part["ways"], strict=True):
                self._halved(t, int(n), second)
        vector = lambda b: _unit(np.frombuffer(b, np.int16).astype(np.float64))
        if "draw" in part:
            self.draw = False
            self.ways |= {t: vector(two[0][1]) - vector(two[1][1]) for t, two in enumerate(part["draw"], 1) if len(two) == 2}
        if "far" in part and self.first is None:
            self.far = self.first = vector(part["far"][1])
        elif "far" in part:
            self.far, self.ways[0] = None, self.first - vector(part["far"][1])
        self.over = self.far is None and not self.draw and not self.ways

    def _halved(self, t: int, n: int, second: np.ndarray) -> None:
        way = self.ways.pop(t)
        if not 0 < n < self.n:
            return
        moved = _unit(self.total - second) - _unit(second)
        if self.rounds[t] < ROUNDS and (moved != way).any():
            self.rounds[t] += 1
            self.ways[t] = moved
            return
        gain = float(np.linalg.norm(second) + np.linalg.norm(self.total - second) - np.linalg.norm(self.total))
        if self.best is None or (gain, -t) > (self.best[0], -self.best[4]):
            self.best = gain, way, n, second, t


@dataclass
class _Node:
    """Documents of a node and the sum of their vectors; open until its cut is known. ``kids`` are its halves, if it can be cut."""

    n: int
    total: np.ndarray
    gain: float = 0.0
    way: np.ndarray | None = None
    kids: tuple[int, ...] = ()
    open: bool = True
    group: int = -1


def _settle(nodes: list[_Node], i: int, cut: _Cut) -> None:
    """Notes the cut of a node and makes its halves."""
    node = nodes[i]
    node.open = False
    if cut.best:
        node.gain, node.way, n, second, _ = cut.best
        node.kids = len(nodes), len(nodes) + 1
        nodes += [_Node(node.n - n, node.total - second, group=node.group), _Node(n, second, group=node.group)]


def _leaves(nodes: list[_Node], leaves: int) -> list[int]:
    """Leaves of the tree that splits the leaf of most gain again and again, as far as cuts are known.

    An open leaf that isn't among them stays out however the open ones will be cut, as new cuts only take the place of known ones.
    """
    held = [0]
    while len(held) < leaves:
        able = [i for i in held if nodes[i].kids]
        if not able:
            break
        i = max(able, key=lambda k: nodes[k].gain)
        at = held.index(i)
        held[at : at + 1] = nodes[i].kids
    return held


def _parts(x: np.ndarray) -> Iterator[np.ndarray]:
    return (x[at : at + PART] for at in range(0, len(x), PART))


def bisected(x: np.ndarray, picks: int) -> list[_Node]:
    """The tree of bisecting k-means over the vectors ``x``, of which ``picks`` nodes are split at most; their halves' cuts are known too."""
    x = np.array(x)
    nodes = [_Node(len(x), x.sum(0, dtype=np.float64))]
    rows = {0: (0, len(x))}

    def settle(i: int) -> None:
        own = x[slice(*rows[i])]
        cut = _Cut(nodes[i].n, nodes[i].total)
        while not cut.over:
            ask = cut.ask()
            cut.told(reduce(_joined, (_answer(p, ask) for p in _parts(own))))
        _settle(nodes, i, cut)

    settle(0)
    held = [0]
    for _ in range(picks):
        able = [i for i in held if nodes[i].kids]
        if not able:
            break
        i = max(able, key=lambda k: nodes[k].gain)
        lo, hi = rows.pop(i)
        own = x[lo:hi]
        second = np.concatenate([p.astype(np.float32) @ nodes[i].way < 0 for p in _parts(own)])
        own[:] = np.concatenate([own[~second], own[second]])
        middle = hi - int(second.sum())
        at = held.index(i)
        held[at : at + 1] = nodes[i].kids
        for k, span in zip(nodes[i].kids, ((lo, middle), (middle, hi)), strict=True):
            rows[k] = span
            settle(k)
    return nodes


def _grown(picks: dict[int, int]):
    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        i = key[0].as_py()
        x = np.concatenate([_unpacked(c) for c in group.column("x").chunks])
        return pa.table({"node": pa.array([i], pa.int32()), "part": pa.array([pickle.dumps(bisected(x[x.any(1)], picks[i]))], pa.binary())})

    return run


def _rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """Vectors by node, batch by batch; those without features are left out, as they are nearest to no centre."""
    for b in batches:
        node, x = b.column("node").to_numpy(), _unpacked(b.column("x"))
        some = np.flatnonzero(x.any(1))
        some = some[np.argsort(node[some], kind="stable")]
        ids, n = np.unique(node[some], return_counts=True)
        for i, end, k in zip(ids.tolist(), np.cumsum(n), n, strict=True):
            yield i, x[some[end - k : end]]


def _answers(asks: dict[int, dict[str, Any]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict[str, Any]] = {}
        for i, x in _rows_of(batches):
            for p in _parts(x) if i in asks else ():
                new = _answer(p, asks[i])
                held[i] = _joined(held[i], new) if i in held else new
        yield _said(held)

    return run


def _said(held: dict[int, dict[str, Any]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([pickle.dumps(x) for x in held.values()], pa.binary())], names=["node", "part"])


def _heard(rows: Iterable[tuple[int, bytes]]) -> dict[int, dict[str, Any]]:
    held: dict[int, dict[str, Any]] = {}
    for i, part in rows:
        new = pickle.loads(part)
        held[i] = _joined(held[i], new) if i in held else new
    return held


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield _said(_heard(x for b in batches for x in zip(b.column("node").to_pylist(), b.column("part").to_pylist(), strict=True)))


def _asked(level: DataFrame, asks: dict[int, dict[str, Any]], tasks: int) -> dict[int, dict[str, Any]]:
    """The answers of all vectors of ``level`` to ``asks`` by node, in one pass."""
    said = level.mapInArrow(_answers(asks), "node int, part binary")
    if tasks > GATHERED:
        said = said.repartition(GATHERED, "node").mapInArrow(_gathered, "node int, part binary")
    return _heard((r["node"], bytes(r["part"])) for r in said.collect())


def _moved(cuts: dict[int, tuple[np.ndarray, tuple[int, ...]]], live: list[int]):
    """Vectors of cut nodes, at those of their halves that are ``live``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, x in _rows_of(batches):
            if i not in cuts or not {*cuts[i][1]} & {*live}:
                continue
            way, kids = cuts[i]
            second = np.concatenate([p.astype(np.float32) @ way < 0 for p in _parts(x)])
            for kid, rows in zip(kids, (x[~second], x[second]), strict=True):
                if kid in live and len(rows):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), kid, np.int32)), _packed(rows)], names=["node", "x"])

    return run


def fitted(vectors: DataFrame, leaves: int) -> np.ndarray:
    """Unit centres of the leaves of a bisecting k-means over all of ``vectors`` (a column ``x``); fewer than asked for if nothing is left to split."""
    level = vectors.select(F.lit(0).alias("node"), "x")
    tasks = level.rdd.getNumPartitions()
    whole = _asked(level, {0: {"all": True}}, tasks)
    if not whole:
        return np.zeros((1, WIDTH), np.float32)
    nodes = [_Node(*whole[0]["all"])]
    few, many = ([0], []) if nodes[0].n <= HELD else ([], [0])
    small = [level] if few else []
    while many:
        cuts = {i: _Cut(nodes[i].n, nodes[i].total) for i in many}
        while asks := {i: c.ask() for i, c in cuts.items() if not c.over}:
            for i, part in _asked(level, asks, tasks).items():
                cuts[i].told(part)
        for i, c in cuts.items():
            _settle(nodes, i, c)
        ways = {i: (nodes[i].way, nodes[i].kids) for i in many if nodes[i].kids}
        fresh = {k for _, kids in ways.values() for k in kids} & {*_leaves(nodes, leaves)}
        held = level
        few, many = (sorted(i for i in fresh if (nodes[i].n <= HELD) == fits) for fits in (True, False))
        if few:
            small.append(materialize(held.mapInArrow(_moved(ways, few), "node int, x binary"), "few"))
        if many:
            level = materialize(held.mapInArrow(_moved(ways, many), "node int, x binary"), "level")
            tasks = level.rdd.getNumPartitions()
        release(held)
    _grow(nodes, small, leaves)
    for t in small:
        release(t)
    centres = np.stack([nodes[i].total for i in _leaves(nodes, leaves)])
    return (centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def _grow(nodes: list[_Node], small: list[DataFrame], leaves: int) -> None:
    """Grows the tree below the nodes in the tables ``small``, each in a task; one whose share of splits doesn't reach is grown again, to all that there can be."""
    seen: set[int] = set()
    while wanted := {(i if nodes[i].group < 0 else nodes[i].group) for i in _leaves(nodes, leaves) if nodes[i].open}:
        picks = {i: leaves - 1 if i in seen else min(leaves - 1, 4 + math.ceil(2 * leaves * nodes[i].n / nodes[0].n)) for i in wanted}
        seen |= wanted
        rows = reduce(DataFrame.union, small).where(F.col("node").isin(sorted(wanted)))
        for r in rows.groupBy("node").applyInArrow(_grown(picks), "node int, part binary").collect():
            root, base = r["node"], len(nodes) - 1
            grown = pickle.loads(bytes(r["part"]))
            for x in grown:
                x.kids, x.group = tuple(k + base for k in x.kids), root
            nodes[root] = grown[0]
            nodes += grown[1:]


def _leaf_terms(centres: np.ndarray):
    """Counts of features by leaf; a document is at its nearest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(len(centres) * DIMS, np.int64)
        for b in batches:
            dims, sizes = _flat(b, "dims")
            leaf = np.concatenate([np.zeros(0, np.int64), *((p.astype(np.float32) @ centres.T).argmax(1) for p in _parts(_unpacked(b.column("x"))))])
            key, n = np.unique(np.repeat(leaf, sizes) * DIMS + dims, return_counts=True)
            out[key] += n
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out[at])], names=["term", "n"])

    return run


def log_odds(counts: np.ndarray) -> np.ndarray:
    """For each feature and leaf, the logarithm of its share in the leaf against the mean over leaves. ``counts`` has a row per leaf."""
    p = np.log(counts + 0.05) - np.log((counts + 0.05).sum(1, keepdims=True))
    return np.ascontiguousarray((p - p.mean(0)).T.astype(np.float32))


def sentence_leaves(dims: np.ndarray, sizes: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """How likely each leaf is for each sentence; ``sizes`` are the sentences' features. Even for a sentence without any."""
    score = np.zeros((len(sizes), odds.shape[1]), np.float32)
    starts = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    longest = -sizes[order]
    for k in range(int(sizes.max(initial=0))):  # the k-th features of all sentences that have so many
        live = order[: np.searchsorted(longest, -k)]
        score[live] += odds[dims[starts[live] + k]]
    e = np.exp(score - score.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _document_leaves(b: pa.RecordBatch, odds: np.ndarray) -> np.ndarray:
    """Each document's leaf mixture, a row each: how much of its text, in sentences that have features, is at each leaf."""
    dims, _ = _flat(b, "dims")
    sizes, sentences = _flat(b, "sizes")
    chars, _ = _flat(b, "chars")
    leaves = sentence_leaves(dims, sizes, odds) * (chars * (sizes > 0))[:, None]
    out = np.zeros((len(sentences), odds.shape[1]))
    some = np.flatnonzero(sentences)
    if len(some):
        out[some] = np.add.reduceat(leaves, (np.cumsum(sentences) - sentences)[some], axis=0)
    return out / np.maximum(out.sum(1, keepdims=True), 1e-9)


def _votes(odds: np.ndarray, areas: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((odds.shape[1], areas))
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                area, given = _flat(b, "areas")
                doc = np.repeat(np.arange(len(given)), given)
                label = np.zeros((len(given), areas))
                np.add.at(label, (doc, area), 1 / given[doc])
                out += _document_leaves(b, odds).T @ label
        i, k = np.nonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(out[i, k])], names=["leaf", "area", "w"])

    return run


def _shares(odds: np.ndarray, mixture: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                mix = _document_leaves(b, odds) @ mixture
                i, s = np.nonzero(mix)
                yield pa.RecordBatch.from_arrays([pa.array(b.column("doc_id").to_numpy(zero_copy_only=False)[i]), pa.array(s.astype(np.int32)), pa.array(mix[i, s])], names=["doc_id", "area", "share"])

    return run


def leaf_mixtures(labels: np.ndarray, odds: np.ndarray, per_leaf: np.ndarray, notes: np.ndarray) -> np.ndarray:
    """Probability of each area in each leaf.

    ``labels`` are label weights by leaf and area, ``odds`` and ``per_leaf`` the leaves' log-odds and counts of features, ``notes`` says which features
    each area's title and note hold. A leaf's terms among them, by their log-odds, add up to ``NOTES`` of a label's weight.
    """
    hints = (np.maximum(odds.T, 0) * (per_leaf > 0)) @ notes
    total = hints.sum(1, keepdims=True)
    weight = labels + PRIOR + NOTES * hints / np.maximum(total, 1e-9)
    return weight / weight.sum(1, keepdims=True)


def subject_shares(documents: DataFrame, labels: DataFrame, subjects: DataFrame, leaves: int = LEAVES) -> DataFrame:
    """``doc_id, subject, share`` of every area that a document's text is in, in any part; shares of a document add up to 1."""
    spark = documents.sparkSession
    given_areas = subjects.where("subject is not null").orderBy("subject").limit(MOST_AREAS + 1).collect()
    if len(given_areas) > MOST_AREAS:
        raise ValueError(f"more than {MOST_AREAS} areas")
    areas = [(r["subject"], " ".join(x for x in (r["title"], r["note"]) if x)) for r in given_areas]
    empty = spark.createDataFrame([], "doc_id long, subject string, share double")
    texts = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), "text").where(F.length(F.trim("text")) > 0)
    tokens = materialize(texts.mapInArrow(_cut, _TOKENS_DDL), "tokens")
    counted = {r["dim"]: r["n"] for r in tokens.select("dims").mapInArrow(_document_counts, "dim int, n long").groupBy("dim").agg(F.sum("n").alias("n")).collect()}
    n = counted.pop(-1, 0)
    if not n or not areas:
        return empty
    idf = np.zeros(DIMS, np.float32)
    for d, k in counted.items():
        idf[d] = np.log(n / k)
    placed = materialize(tokens.mapInArrow(_vectored(idf), f"{_TOKENS_DDL}, x binary"), "placed")
    release(tokens)
    centres = fitted(placed, leaves)

    names, leaves = [a for a, _ in areas], len(centres)
    index = spark.createDataFrame([(a.lower(), i) for i, a in enumerate(names)], "s string, area int")
    given = labels.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), plain_key(F.col("subject")).alias("s")).join(F.broadcast(index), "s").select("doc_id", "area").distinct()
    given = given.groupBy("doc_id").agg(F.collect_set("area").alias("areas"))
    notes = np.zeros((DIMS, len(names)))
    for i, (name, note) in enumerate(areas):
        notes[features(f"{name} {note}".lower()), i] = 1
    terms = placed.select("x", "dims").coalesce(COUNTING).mapInArrow(_leaf_terms(centres), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    per_leaf = np.zeros(leaves * DIMS)
    per_leaf[terms.column("term").to_numpy()] = terms.column("n").to_numpy()
    per_leaf = per_leaf.reshape(leaves, DIMS)
    odds = log_odds(per_leaf)
    votes = np.zeros((leaves, len(names)))
    for r in placed.select("doc_id", "sizes", "chars", "dims").join(given, "doc_id").mapInArrow(_votes(odds, len(names)), "leaf int, area int, w double").groupBy("leaf", "area").agg(F.sum("w").alias("w")).collect():
        votes[r["leaf"], r["area"]] = r["w"]
    mixture = leaf_mixtures(votes, odds, per_leaf, notes) ** POWER
    mixture /= mixture.sum(1, keepdims=True)
    shares = placed.select("doc_id", "sizes", "chars", "dims").mapInArrow(_shares(odds, mixture), "doc_id long, area int, share double")
    named = F.get(F.array(*[F.lit(a) for a in names]), F.col("area"))
    return shares.select("doc_id", named.alias("subject"), "share")


def document_subjects(documents: DataFrame, labels: DataFrame, subjects: DataFrame, least: float = LEAST) -> DataFrame:
    """``doc_id, subject`` of the areas that fill ``least`` or more of a document."""
    return subject_shares(documents, labels, subjects).where(F.col("share") >= least).select("doc_id", "subject").distinct()
