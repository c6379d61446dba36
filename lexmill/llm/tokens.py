"""Problem 8: the whole corpus as token ids of a public byte-level BPE vocabulary.

Speculate and verify. Each distinct word is first cut greedily into longest vocabulary entries. Such a cut is what
the merges would give exactly when every adjacent pair of tokens is *compatible*, that is, when merging the bytes of
the pair alone gives that pair back. All adjacent pairs of all new words of a batch are tested together against a
table of known pairs; a pair not seen before is settled once and kept. Only words with an incompatible pair go
through the merges themselves.

Cases: null and empty texts give an empty list; text that spells a special token is ordinary text; a text of any
length is handled whole; repeated rows give repeated lists; the input's other columns are ignored.
"""

from __future__ import annotations

import base64
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import int_lists, map_arrow, pick, spread

#: Fixed value: the public pattern that splits text before the merges.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_VOCABULARY = "byte_bpe_50k.tiktoken"
#: Words kept per Python worker; when full, the word table starts anew (the pair table is kept).
WORD_CACHE = 400_000


def vocabulary_path(name: str = DEFAULT_VOCABULARY) -> str:
    """The folder is the parameter LEXMILL_TOKENIZERS, else where the public files are installed."""
    folder = os.environ.get("LEXMILL_TOKENIZERS")
    if folder is None:
        try:
            import public_tokenizers

            return public_tokenizers.path(name)
        except ImportError:
            folder = "/opt/tokenizers"
    return os.path.join(folder, name)


class SpeculativeBPE:
    def __init__(self, path: str):
        import regex

        self.rank: dict[bytes, int] = {}
        with open(path, "rb") as f:
            for line in f:
                if line.strip():
                    word, rank = line.split()
                    self.rank[base64.b64decode(word)] = int(rank)
        self.bytes_of = {r: w for w, r in self.rank.items()}
        self.longest = max(map(len, self.rank))
        #: for each first byte, the lengths that occur, longest first: the greedy step tries no others
        by_first: dict[int, set[int]] = {}
        for w in self.rank:
            by_first.setdefault(w[0], set()).add(len(w))
        self.lengths = [sorted(by_first.get(b, {1}), reverse=True) for b in range(256)]
        self.words = regex.compile(WORD_PATTERN).findall
        self.known: dict[str, list[int]] = {}
        self.pairs = np.zeros(0, np.int64)  # sorted keys of pairs that were settled
        self.fits = np.zeros(0, bool)

    def merge(self, data: bytes) -> list[int]:
        """The merges themselves: always join the adjacent pair of lowest rank, leftmost first."""
        rank = self.rank
        if data in rank:
            return [rank[data]]
        if len(data) > 64:
            return self._merge_long(data)
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = [rank.get(data[i : i + 2]) for i in range(len(data) - 1)]
        while True:
            best, at = None, -1
            for i, r in enumerate(ranks):
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                return [rank[p] for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at < len(ranks):
                ranks[at] = rank.get(parts[at] + parts[at + 1])
            if at:
                ranks[at - 1] = rank.get(parts[at - 1] + parts[at])

    def _merge_long(self, data: bytes) -> list[int]:
        """The same for long words: a heap over a linked list, n log n instead of n squared."""
        import heapq

        rank, n = self.rank, len(data)
        end = list(range(1, n + 1))
        prev = list(range(-1, n - 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] == n:
                continue
            j = end[i]
            if end[j] != stop:
                continue
            end[i], alive[j] = stop, False
            if stop < n:
                prev[stop] = i
                if (r := rank.get(data[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := prev[i]) >= 0 and (r := rank.get(data[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(rank[data[i : end[i]]])
            i = end[i]
        return out

    def propose(self, data: bytes) -> list[int]:
        """Greedy longest match."""
        rank, lengths, n, i, out = self.rank, self.lengths, len(data), 0, []
        while i < n:
            left = n - i
            for k in lengths[data[i]]:
                if k <= left and (r := rank.get(data[i : i + k])) is not None:
                    out.append(r)
                    i += k
                    break
        return out

    def settle(self, keys: np.ndarray) -> np.ndarray:
        """Whether each pair (first << 32 | second) is compatible; unseen pairs are tested once and kept."""
        new = np.setdiff1d(keys, self.pairs)
        if len(new):
            ok = np.fromiter((self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b] for a, b in zip((new >> 32).tolist(), (new & 0xFFFFFFFF).tolist())), bool, len(new))
            keep = np.concatenate([self.pairs, new])
            order = np.argsort(keep)
            self.pairs, self.fits = keep[order], np.concatenate([self.fits, ok])[order]
        return self.fits[np.searchsorted(self.pairs, keys)]

    def learn(self, words: list[str]) -> None:
        """Encode new words: propose all, verify all pairs at once, merge the ones that fail."""
        raw = [w.encode("utf-8") for w in words]
        tokens = [[r] if (r := self.rank.get(x)) is not None else self.propose(x) for x in raw]
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        flat = np.fromiter((t for x in tokens for t in x), np.int64, int(sizes.sum()))
        failed = np.zeros(len(words), bool)
        if len(flat) > 1:
            owner = np.repeat(np.arange(len(words)), sizes)
            inside = owner[1:] == owner[:-1]
            keys = (flat[:-1] << 32 | flat[1:])[inside]
            if len(keys):
                failed[owner[1:][inside][~self.settle(keys)]] = True
        for i in np.flatnonzero(failed).tolist():
            tokens[i] = self.merge(raw[i])
        self.known.update(zip(words, tokens))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the offsets of the rows."""
        cut = [self.words(t) if t else [] for t in texts]
        if len(self.known) > WORD_CACHE:
            self.known.clear()
        known = self.known
        new = list({w for ws in cut for w in ws if w not in known})
        if new:
            self.learn(new)
        rows = [[i for w in ws for i in known[w]] for ws in cut]
        offsets = np.zeros(len(rows) + 1, np.int64)
        np.cumsum([len(r) for r in rows], out=offsets[1:])
        return np.fromiter((i for r in rows for i in r), np.int32, int(offsets[-1])), offsets


_loaded: dict[str, SpeculativeBPE] = {}


def encoder(path: str) -> SpeculativeBPE:
    """One per Python worker."""
    if path not in _loaded:
        _loaded[path] = SpeculativeBPE(path)
    return _loaded[path]


def encode_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, ids ARRAY<INT>): each row's text as token ids. A map without a shuffle."""
    path = path or vocabulary_path()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        flat, offsets = encoder(path).encode(b.column(1).to_pylist())
        return pa.RecordBatch.from_arrays([b.column(0), int_lists(flat, offsets)], [id_col, "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_arrow(spread(pick(df, **{"id": id_col, "text": text_col})), run, f"`{id_col}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, n_ids INT): only the lengths, so that nothing but two numbers a row leaves Python."""
    path = path or vocabulary_path()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        _, offsets = encoder(path).encode(b.column(1).to_pylist())
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(offsets).astype(np.int32))], [id_col, "n_ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_arrow(spread(pick(df, **{"id": id_col, "text": text_col})), run, f"`{id_col}` {kind}, n_ids int")
