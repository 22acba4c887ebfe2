"""Byte-level BPE with a public vocabulary: a segment tree over the ranks of adjacent pairs yields each merge."""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The pattern that splits a text before the merges; part of the vocabulary, a fixed value.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Words kept with their ids by one Python worker, characters of such a word, and characters of text taken at once.
WORDS_KEPT, WORD_CHARS, CHARS_AT_ONCE = 300_000, 40, 2_000_000
#: Cells of one array of trees, and the number of words under which they are merged one by one instead of side by side.
TREE_CELLS, SIDE_BY_SIDE = 1 << 19, 24
_NONE = np.int64(1) << 60


class Merges:
    """The pair table of a rank file: which two adjacent tokens become which one, and how soon."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.ranks = ranks
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {
            (ranks[t[:i]] << 20) | ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks
        }
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each adjacent pair, _NONE where the two do not merge or one of them is missing (-1)."""
        key = (left << 20) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((left >= 0) & (right >= 0) & (self.keys[at] == key), self.values[at], _NONE)


@lru_cache(maxsize=4)
def merges(path: str) -> Merges:
    return Merges(path)


def merge_one(word: bytes, table: Merges) -> list[int]:
    """The ids of one word, by a segment tree in plain Python: the way for a few, possibly very long, words."""
    n, none, pairs = len(word), int(_NONE), table.pairs
    size = 1 << max(1, (n - 1).bit_length())
    ids = [int(table.byte_ids[b]) for b in word]
    after, before = [*range(1, n), -1], list(range(-1, n - 1))
    tree = [none] * (2 * size)

    def leaf(p: int) -> int:
        q = after[p]
        r = pairs.get((ids[p] << 20) | ids[q]) if q >= 0 else None
        return none if r is None else r * size + p

    for p in range(n):
        tree[size + p] = leaf(p)
    for k in range(size - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])

    def put(p: int, value: int) -> None:
        k = size + p
        tree[k] = value
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            low = a if a < b else b
            if tree[k] == low:
                break
            tree[k] = low
            k >>= 1

    while tree[1] < none:
        p = tree[1] % size
        ids[p] = tree[1] // size
        q = after[p]
        after[p] = after[q]
        if after[q] >= 0:
            before[after[q]] = p
        ids[q] = -1
        put(q, none)
        put(p, leaf(p))
        if before[p] >= 0:
            put(before[p], leaf(before[p]))
    return [i for i in ids if i >= 0]


def merge_many(words: list[bytes], table: Merges) -> list[list[int]]:
    """The ids of each word: one segment tree per word, all trees of a power of two of leaves in one array.

    The root of a tree holds the leftmost pair of the lowest rank as rank * leaves + place. A merge rewrites the leaves
    of the pair, of the pair that goes and of the pair before, and the nodes above them.
    """
    out: list[list[int] | None] = [None] * len(words)
    by_size: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        by_size.setdefault(max(2, 1 << (len(w) - 1).bit_length()), []).append(k)
    for size, members in by_size.items():
        members.sort(key=lambda k: len(words[k]))
        step = max(1, TREE_CELLS // size)
        for at in range(0, len(members), step):
            some = members[at : at + step]
            if len(some) < SIDE_BY_SIDE:
                for k in some:
                    out[k] = merge_one(words[k], table)
            else:
                for k, ids in zip(some, _merge_block([words[k] for k in some], size, table)):
                    out[k] = ids
    return out


def _merge_block(words: list[bytes], size: int, table: Merges) -> list[list[int]]:
    n = len(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    place = np.arange(size, dtype=np.int64)
    filled = place < lengths[:, None]
    ids = np.full((n, size + 1), -1, np.int64)  # the last column answers for "no such place"
    ids[:, :size][filled] = table.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
    after = np.where(place + 1 < lengths[:, None], place + 1, size)
    before = np.broadcast_to(np.where(place > 0, place - 1, size), (n, size)).copy()
    tree = np.full((n, 2 * size), _NONE, np.int64)
    rank = table.rank(ids[:, :size], ids[:, 1 : size + 1])
    tree[:, size:] = np.where(rank < _NONE, rank * size + place, _NONE)
    level = size >> 1
    while level:
        tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        level >>= 1
    rows = np.flatnonzero(tree[:, 1] < _NONE)
    while len(rows):
        root = tree[rows, 1]
        p = root % size
        q = after[rows, p]
        past = after[rows, q]
        ids[rows, p] = root // size
        ids[rows, q] = -1
        after[rows, p] = past
        some = past < size
        before[rows[some], past[some]] = p[some]
        prior = before[rows, p]
        own = ids[rows, p]
        right = table.rank(own, ids[rows, past])
        tree[rows, size + q] = _NONE
        tree[rows, size + p] = np.where(right < _NONE, right * size + p, _NONE)
        some = prior < size
        left_rows, left = rows[some], prior[some]
        rank = table.rank(ids[left_rows, left], own[some])
        tree[left_rows, size + left] = np.where(rank < _NONE, rank * size + left, _NONE)
        nodes, of = np.concatenate([size + p, size + q, size + left]) >> 1, np.concatenate([rows, rows, left_rows])
        while nodes[0]:
            tree[of, nodes] = np.minimum(tree[of, 2 * nodes], tree[of, 2 * nodes + 1])
            nodes = nodes >> 1
        rows = rows[tree[rows, 1] < _NONE]
    flat = ids[:, :size]
    kept = flat >= 0
    values, ends = flat[kept].tolist(), np.cumsum(kept.sum(1)).tolist()
    return [values[a:b] for a, b in zip([0, *ends[:-1]], ends)]


class Encoder:
    """Texts to ids; words that were met before are not merged again."""

    def __init__(self, path: str):
        self.table, self.find, self.known = merges(path), regex.compile(SPLIT).findall, {}

    def _learn(self, new: set[str]) -> None:
        rest, ranks = [], self.table.ranks
        for w in new:
            b = w.encode("utf-8", "surrogatepass")
            if (r := ranks.get(b)) is not None:
                self.known[w] = (r,)
            else:
                rest.append((w, b))
        for (w, _), ids in zip(rest, merge_many([b for _, b in rest], self.table)):
            self.known[w] = tuple(ids)

    def _parts(self, texts: list[str | None]) -> Iterator[list[list[str]]]:
        """The words of some texts at a time, all of them known."""
        at = 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (end == at or chars + len(texts[end] or "") <= CHARS_AT_ONCE):
                chars += len(texts[end] or "")
                end += 1
            if len(self.known) > WORDS_KEPT:
                self.known = {}
            words = [self.find(t) if t else [] for t in texts[at:end]]
            new = set(chain.from_iterable(words)).difference(self.known)
            self._learn(new)
            yield words
            for w in new:
                if len(w) > WORD_CHARS:
                    self.known.pop(w, None)
            at = end

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each text)."""
        ids, counts = [], []
        for words in self._parts(texts):
            get = self.known.__getitem__
            for w in words:
                own = list(chain.from_iterable(map(get, w)))
                counts.append(len(own))
                ids.append(np.array(own, np.int32))
        return np.concatenate(ids) if ids else np.zeros(0, np.int32), np.array(counts, np.int64)

    def count(self, texts: list[str | None]) -> np.ndarray:
        """The number of ids of each text."""
        out = []
        for words in self._parts(texts):
            get = self.known.__getitem__
            out.extend(sum(map(len, map(get, w))) for w in words)
        return np.array(out, np.int64)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per Python worker and vocabulary, so that its words last from task to task."""
    return Encoder(path)


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[str | None]]]:
    """(ids, texts) of some rows of a batch at a time, as many as hold CHARS_AT_ONCE characters, one at least."""
    sizes = pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy().astype(np.int64)
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, at + int(np.searchsorted(np.cumsum(sizes[at:]), CHARS_AT_ONCE, side="right")))
        some = batch.slice(at, end - at)
        yield some.column(0), some.column(1).to_pylist()
        at = end


def encode_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ranks: str = DEFAULT_RANKS) -> DataFrame:
    """(doc_id, ids): the ids of each text by the vocabulary of the rank file, without special tokens.

    An empty and a null text get an empty list; strings of special tokens are ordinary text; a repeated row comes out
    as often as it comes in; other columns are ignored. A narrow pass over the rows as they lie, without a shuffle.
    The rank file must be at the same path on every machine; it is read once per Python worker.
    """
    kind = dict(docs.dtypes)[doc_id]
    id_type = pa.string() if kind == "string" else pa.int64()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, texts in (part for batch in batches for part in _slices(batch)):
            ids, counts = encoder(ranks).encode(texts)
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([names, lists], schema=pa.schema([(doc_id, id_type), ("ids", pa.list_(pa.int32()))]))

    return docs.select(
        F.col(doc_id).cast("string" if kind == "string" else "bigint").alias(doc_id), F.col(text)
    ).mapInArrow(run, f"`{doc_id}` {'string' if kind == 'string' else 'bigint'}, ids array<int>")


def count_tokens(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ranks: str = DEFAULT_RANKS) -> DataFrame:
    """(doc_id, n_tokens): the number of ids that encode_texts gives each text, without building the lists."""
    kind = "string" if dict(docs.dtypes)[doc_id] == "string" else "bigint"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, texts in (part for batch in batches for part in _slices(batch)):
            yield pa.RecordBatch.from_arrays([names, pa.array(encoder(ranks).count(texts), pa.int64())], names=[doc_id, "n_tokens"])

    return docs.select(F.col(doc_id).cast(kind).alias(doc_id), F.col(text)).mapInArrow(run, f"`{doc_id}` {kind}, n_tokens bigint")
