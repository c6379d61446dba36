"""Problem 6: the most similar vectors of every vector, and all pairs above a cosine.

Index. A bounded sample trains coarse cells (k-means by inner product) and a product code of 32 parts with 16 entries
each, four bits a part. The code is *score-aware*: of the error it makes on a vector, the part parallel to the vector,
which shifts exactly the inner products that matter, weighs ETA times as much as the rest, both in choosing entries
and in fitting them. Every row is indexed; only the training uses the sample.

Scan. Within a cell, the score of a vector is the sum of its entries' inner products with the query; the entries are
looked up by the bytes of the codes, two parts each. Candidates are then reranked with the exact cosine.

All pairs. Eight independent sets of cells are used, so that a pair is missed only if it falls apart in all eight. Only
codes go to the cells, packed by cell: the product code and four bits a number for what it leaves. The scan itself loses
nothing: with each code goes a bound on its error for any partner above the cosine (its parallel part plus sin * its
rest), and whoever reaches the cosine less both bounds is a candidate. The vectors are shuffled once, by id, and meet
the candidates there for the exact cosine.

Cells that hold many vectors are cut into blocks, and blocks of vectors meet blocks of queries, so no task holds a
whole cell. Never are all vectors on the driver.

Cases: vectors that are null, of another length, not finite or all zero take no part; rows delivered twice count once;
different encoders never meet; equal vectors are neighbours with cosine 1; ties go to the lesser id; empty tables give
no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import pick, spread

PARTS, ENTRIES = 32, 16
#: weight of the parallel error: (d - 1) T^2 / (1 - T^2) for d = 64 and T = 0.2
ETA = 2.6
#: rows of the training sample, at most about so many
SAMPLE = 24_000
TABLES = 8
#: step of the four bits a number, in deviations of what the product code leaves: the least squared error for normal numbers
STEP = 0.335
#: vectors of a cell that are scanned in one task, and queries that scan them
BLOCK, QUERY_BLOCK = 32_768, 131_072
#: rows of a task that are packed by cell at a time, and candidates in a batch
PACK, BATCH = 131_072, 200_000


class Index:
    """Cells and code books; a few hundred kB, whatever the number of rows."""

    def __init__(self, cells: list[np.ndarray], books: np.ndarray, blocks: list[np.ndarray], step: float = 0.0):
        self.cells, self.books, self.blocks, self.step = cells, books, blocks, step
        self.pairs: np.ndarray | None = None

    def assign(self, x: np.ndarray, table: int = 0, top: int = 1) -> np.ndarray:
        s = x @ self.cells[table].T
        if top == 1:
            return s.argmax(1)[:, None]
        part = np.argpartition(-s, min(top, s.shape[1]) - 1, axis=1)[:, :top]
        return part

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes (two parts a byte), and the parallel and the remaining error of each row of unit vectors."""
        codes = score_aware_codes(x, self.books)
        along, rest = errors(x, decode(codes, self.books))
        return (codes[:, 0::2] << 4 | codes[:, 1::2]).astype(np.uint8), along, rest

    def refine(self, x: np.ndarray, packed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Four bits a number for what the codes leave (two numbers a byte), and the errors that are left then."""
        left = np.clip(np.rint((x - self.decoded(packed)) / self.step + 7.5), 0, 15).astype(np.uint8)
        fine = left[:, 0::2] << 4 | left[:, 1::2]
        return fine, *errors(x, self.refined(packed, fine))

    def refined(self, packed: np.ndarray, fine: np.ndarray) -> np.ndarray:
        byte = np.arange(256)
        two = ((np.stack([byte >> 4, byte & 15], axis=1) - 7.5) * self.step).astype(np.float32)
        return self.decoded(packed) + two[fine].reshape(len(fine), -1)

    def decoded(self, packed: np.ndarray) -> np.ndarray:
        """The entries of each row, looked up by byte (two parts)."""
        if self.pairs is None:
            w = self.books.shape[2]
            both = np.arange(ENTRIES * ENTRIES)
            self.pairs = np.concatenate([self.books[0::2][:, both >> 4], self.books[1::2][:, both & 15]], axis=2).astype(np.float32)
            assert self.pairs.shape == (PARTS // 2, ENTRIES * ENTRIES, 2 * w)
        return self.pairs[np.arange(PARTS // 2), packed].reshape(len(packed), -1)

    def scan(self, queries: np.ndarray, packed: np.ndarray) -> np.ndarray:
        """Approximate inner products, [queries, rows]: for each row the sum over its parts of the query's inner product
        with the part's entry. The entries are looked up once a row, and the sums for all queries are one matrix product,
        which gives the same numbers as a table of products for each query."""
        return queries @ self.decoded(packed).T


def errors(x: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parallel and the remaining error of each row of unit vectors."""
    r = x - near
    along = (r * x).sum(1)
    return np.abs(along), np.sqrt(np.maximum((r * r).sum(1) - along**2, 0))


def decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return books[np.arange(PARTS), codes].reshape(len(codes), -1)


def score_aware_codes(x: np.ndarray, books: np.ndarray, rounds: int = 2) -> np.ndarray:
    """Entries that minimise |r|^2 + (ETA - 1) (r . x)^2, one part at a time, the others fixed."""
    n = len(x)
    sub = x.reshape(n, PARTS, -1)
    codes = np.empty((n, PARTS), np.int64)
    along = np.empty((n, PARTS), np.float32)
    own = (sub * sub).sum(2)
    dots = np.einsum("npd,ped->npe", sub, books)
    norms = (books * books).sum(2)
    far = own[:, :, None] - 2 * dots + norms[None]
    codes[:] = far.argmin(2)
    rows = np.arange(n)
    for p in range(PARTS):
        along[:, p] = own[:, p] - dots[rows, p, codes[:, p]]
    total = along.sum(1)
    for _ in range(rounds):
        for p in range(PARTS):
            base = total - along[:, p]
            cand = own[:, p, None] - dots[:, p]
            best = (far[:, p] + (ETA - 1) * (base[:, None] + cand) ** 2).argmin(1)
            codes[:, p] = best
            along[:, p] = cand[rows, best]
            total = base + along[:, p]
    return codes


def train_books(x: np.ndarray, rounds: int = 6, seed: int = 3) -> np.ndarray:
    """Alternate choosing entries and fitting each entry to its members under the same score-aware loss."""
    rng = np.random.default_rng(seed)
    n, d = x.shape
    w = d // PARTS
    sub = x.reshape(n, PARTS, w)
    books = np.stack([sub[rng.choice(n, ENTRIES, replace=n < ENTRIES), p] for p in range(PARTS)]).astype(np.float32)
    for _ in range(rounds):
        codes = score_aware_codes(x, books)
        r = (x - decode(codes, books)).reshape(n, PARTS, w)
        along = (r * sub).sum(2)
        total = along.sum(1)
        for p in range(PARTS):
            y, base = sub[:, p].astype(np.float64), (total - along[:, p]).astype(np.float64)
            for e in range(ENTRIES):
                m = codes[:, p] == e
                if not m.any():
                    continue
                ym = y[m]
                lhs = np.eye(w) * len(ym) + (ETA - 1) * ym.T @ ym
                rhs = ym.sum(0) + (ETA - 1) * ((base[m] + (ym * ym).sum(1)) @ ym)
                books[p, e] = np.linalg.solve(lhs, rhs)
    return books


def train_cells(x: np.ndarray, n_cells: int, seed: int, rounds: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    cells = x[rng.choice(len(x), min(n_cells, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = (x @ cells.T).argmax(1)
        total = np.zeros_like(cells)
        np.add.at(total, own, x)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        cells = np.where(size > 1e-9, total / np.maximum(size, 1e-9), cells)
    return cells.astype(np.float32)


def usable(lists: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are usable, and their vectors (float32, as they stand)."""
    n = len(lists)
    size = np.asarray(lists.value_lengths().fill_null(-1))
    ok = np.flatnonzero(size == dim)
    if not len(ok):
        return ok, np.zeros((0, dim), np.float32)
    flat = lists.take(pa.array(ok)).flatten().cast(pa.float32()).fill_null(np.nan)
    x = np.asarray(flat).reshape(len(ok), dim)
    good = np.isfinite(x).all(1) & (x != 0).any(1)
    assert n >= len(ok)
    return ok[good], x[good]


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _base(df: DataFrame, id_col: str, emb_col: str, encoder_col: str) -> DataFrame:
    return pick(df, pos=id_col, enc=encoder_col, emb=emb_col).filter("pos is not null and emb is not null")


def _good(dim: int) -> Column:
    return F.coalesce((F.size("emb") == dim) & F.forall("emb", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists("emb", lambda v: v != 0), F.lit(False))


def build_index(base: DataFrame, dim: int, n_tables: int, cells_of: float, seed: int = 1) -> tuple[Index | None, int]:
    """Train on a hash sample of at most about SAMPLE rows."""
    base = base.filter(_good(dim))
    n = base.count()
    if not n:
        return None, 0
    part = base if n <= SAMPLE else base.filter(F.pmod(F.xxhash64("pos"), F.lit(10**9)) < math.ceil(SAMPLE / n * 10**9))
    table = part.select("emb").toArrow()
    _, x = usable(table.column(0).combine_chunks(), dim)
    if not len(x):
        return None, n
    x = unit(x).astype(np.float32)
    n_cells = max(1, min(int(cells_of * math.sqrt(n)), len(x) // 4 or 1))
    cells = [train_cells(x, n_cells, seed + t) for t in range(n_tables)]
    share = [np.bincount((x @ c.T).argmax(1), minlength=len(c)) / len(x) for c in cells]
    blocks = [np.maximum(1, np.ceil(s * n / BLOCK)).astype(np.int64) for s in share]
    books = train_books(x)
    left = x[:4096] - decode(score_aware_codes(x[:4096], books), books)
    return Index(cells, books, blocks, max(1e-6, STEP * float(left.std()))), n


KEY = "enc string, tab int, cell int, bi int, bj int"
ROW = f"{KEY}, side int, pos long, raw binary, code binary, along float, rest float"


def _emit(enc: pa.Array, parts: list[dict]) -> pa.RecordBatch:
    """One batch from pieces {rows, tab, cell, bi, bj, side} over the same encoded vectors."""
    names = ["enc", "tab", "cell", "bi", "bj", "side", "pos", "raw", "code", "along", "rest"]
    at = np.concatenate([p["rows"] for p in parts])
    cat = lambda k: pa.array(np.concatenate([np.broadcast_to(np.asarray(p[k], np.int32), len(p["rows"])) for p in parts]), pa.int32())
    src = parts[0]["src"]
    take = pa.array(at)
    cols = [enc.take(take), cat("tab"), cat("cell"), cat("bi"), cat("bj"), cat("side")] + [src[k].take(take) for k in ("pos", "raw", "code", "along", "rest")]
    return pa.RecordBatch.from_arrays(cols, names)


def _encoded(b: pa.RecordBatch, index: Index, dim: int) -> tuple[pa.Array, dict, np.ndarray] | None:
    ok, raw = usable(b.column(2), dim)
    if not len(ok):
        return None
    x = unit(raw).astype(np.float32)
    code, along, rest = index.encode(x)
    raw = np.ascontiguousarray(raw, np.float32)
    binary = lambda a, w: pa.FixedSizeBinaryArray.from_buffers(pa.binary(w), len(a), [None, pa.py_buffer(np.ascontiguousarray(a).tobytes())]).cast(pa.binary())
    take = pa.array(ok)
    src = {"pos": b.column(0).take(take).cast(pa.int64()), "raw": binary(raw, dim * 4), "code": binary(code, PARTS // 2), "along": pa.array(along.astype(np.float32)), "rest": pa.array(rest.astype(np.float32))}
    return b.column(1).take(take), src, x


def _salt(pos: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    h = pos.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(33)) % blocks.astype(np.uint64)).astype(np.int64)


def _unpack(t: pa.Table, dim: int) -> tuple[np.ndarray, ...]:
    t = t.combine_chunks()
    if not t.num_rows:
        return np.zeros(0, np.int64), np.zeros((0, dim)), np.zeros((0, PARTS // 2), np.uint8), np.zeros(0), np.zeros(0)
    pos = np.asarray(t.column("pos"))
    pos, first = np.unique(pos, return_index=True)  # delivered twice
    t = t.take(pa.array(first))
    joined = lambda k: b"".join(t.column(k).to_pylist())
    raw = np.frombuffer(joined("raw"), np.float32).reshape(-1, dim)
    code = np.frombuffer(joined("code"), np.uint8).reshape(-1, PARTS // 2)
    return pos, unit(raw), code, np.asarray(t.column("along")), np.asarray(t.column("rest"))


def _record(dim: int) -> np.dtype:
    """A vector in a cell: its codes, its error towards a partner above the cosine, and its whole error."""
    return np.dtype([("pos", "<i8"), ("code", "u1", (PARTS // 2,)), ("fine", "u1", (dim // 2,)), ("towards", "<f2"), ("whole", "<f2")])


def _records(b: pa.RecordBatch, index: Index, dim: int, slack: float) -> tuple[pa.Array, np.ndarray, list[np.ndarray]] | None:
    """Encoder, record and cell in each table of a batch's usable rows."""
    ok, raw = usable(b.column(2), dim)
    if not len(ok):
        return None
    x = unit(raw).astype(np.float32)
    out = np.empty(len(ok), _record(dim))
    take = pa.array(ok)
    out["pos"] = np.asarray(b.column(0).take(take).cast(pa.int64()))
    out["code"] = index.encode(x)[0]
    out["fine"], along, rest = index.refine(x, out["code"])
    up = lambda v: v * 1.001 + 1e-6  # never less after rounding to two bytes
    out["towards"], out["whole"] = up(along + slack * rest), up(np.hypot(along, rest))
    return b.column(1).take(take), out, [index.assign(x, t)[:, 0] for t in range(len(index.cells))]


def _packed(who: np.ndarray, names: pa.Array, recs: np.ndarray, cell: np.ndarray, blocks: np.ndarray, tab: int) -> Iterator[pa.RecordBatch]:
    """One row for each encoder, cell and pair of blocks, which holds the records of all its vectors."""
    salt = _salt(recs["pos"], blocks)
    for k in range(int(blocks.max())):  # block `salt` meets every block k of its cell once
        rows = np.flatnonzero(blocks > k)
        rows = rows[np.lexsort((salt[rows], cell[rows], who[rows]))]
        w, c, s = who[rows], cell[rows], salt[rows]
        first = np.flatnonzero(np.r_[True, (w[1:] != w[:-1]) | (c[1:] != c[:-1]) | (s[1:] != s[:-1])])
        ends = np.r_[first, len(rows)].astype(np.int32) * recs.dtype.itemsize
        blob = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(recs[rows].tobytes())])
        s = s[first]
        ints = [np.full(len(first), tab), c[first], np.minimum(s, k), np.maximum(s, k), s > k]
        yield pa.RecordBatch.from_arrays([names.take(pa.array(w[first])), *[pa.array(v.astype(np.int32)) for v in ints], blob], ["enc", "tab", "cell", "bi", "bj", "side", "recs"])


def similar_pairs(df: DataFrame, at_least: float = 0.9, id_col: str = "pos", emb_col: str = "emb", encoder_col: str = "encoder", dim: int = 64) -> DataFrame:
    """(pos_a, pos_b, cos), pos_a < pos_b: all pairs of the same encoder with cosine >= at_least."""
    base = _base(df, id_col, emb_col, encoder_col)
    index, n = build_index(base, dim, TABLES, 0.5)
    out = "pos_a long, pos_b long, cos double"
    if index is None:
        return df.sparkSession.createDataFrame([], out)
    base = base.withColumn("enc", F.coalesce(F.concat(F.lit("="), F.col("enc").cast("string")), F.lit("")))  # a name that joins, for no encoder too
    shared = df.sparkSession.sparkContext.broadcast(index)
    slack = math.sqrt(1 - min(1.0, max(0.0, at_least)) ** 2)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value

        def packed(held: list[tuple]) -> Iterator[pa.RecordBatch]:
            enc = pa.chunked_array([h[0] for h in held]).combine_chunks().dictionary_encode()
            recs = np.concatenate([h[1] for h in held])
            for t in range(len(index.cells)):
                cell = np.concatenate([h[2][t] for h in held])
                yield from _packed(np.asarray(enc.indices), enc.dictionary, recs, cell, index.blocks[t][cell], t)

        held: list[tuple] = []
        for whole in batches:
            for lo in range(0, whole.num_rows, 4096):
                if (got := _records(whole.slice(lo, 4096), index, dim, slack)) is not None:
                    held.append(got)
            if sum(len(h[1]) for h in held) >= PACK:
                yield from packed(held)
                held = []
        if held:
            yield from packed(held)

    def meet(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        enc, same = key[0], key[3].as_py() == key[4].as_py()
        sides: tuple[list, list] = ([], [])
        for b in batches:
            for side, blob in zip(b.column("side").to_pylist(), b.column("recs").to_pylist()):
                sides[side].append(blob)

        def rows(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            recs = np.frombuffer(b"".join(blobs), _record(dim))
            pos, first = np.unique(recs["pos"], return_index=True)  # delivered twice
            recs = recs[first]
            return pos, index.refined(recs["code"], recs["fine"]), *[recs[k].astype(np.float32)[:, None] for k in ("towards", "whole")]

        # x.y differs from the product of the decoded rows by at most towards_x + towards_y + whole_x * whole_y, which
        # is added by three more numbers in each row
        pos_q, near, towards, whole = left = rows(sides[0])
        one = np.ones_like(towards)
        x_q = np.concatenate([near, towards, one, whole], axis=1)
        if not same:
            pos_d, near, towards, whole = rows(sides[1])
        else:
            pos_d = left[0]
        x_d = np.concatenate([near, np.ones_like(towards), towards, whole], axis=1)
        lo = 0
        while lo < len(pos_q) and len(pos_d):
            from_d = lo if same else 0  # ids rise, and each pair is met once
            hi = lo + max(1, 2_000_000 // (len(pos_d) - from_d))
            s = x_q[lo:hi] @ x_d[from_d:].T
            at = np.flatnonzero(s.ravel() >= np.float32(at_least - 1e-5))
            a, b = pos_q[lo + at // s.shape[1]], pos_d[from_d + at % s.shape[1]]
            lo = hi
            keep = a < b if same else a != b
            a, b = a[keep], b[keep]
            for z in range(0, len(a), BATCH):
                p, q = a[z : z + BATCH], b[z : z + BATCH]
                yield pa.RecordBatch.from_arrays([pa.repeat(enc, len(p)), pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q))], ["enc", "pos_a", "pos_b"])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            (ok_a, a), (ok_b, b) = usable(t.column(2), dim), usable(t.column(3), dim)
            both, ia, ib = np.intersect1d(ok_a, ok_b, assume_unique=True, return_indices=True)
            if not len(both):
                continue
            cos = np.einsum("nd,nd->n", unit(a[ia]), unit(b[ib]))
            good = cos >= at_least - 1e-12
            take = pa.array(both[good])
            yield pa.RecordBatch.from_arrays([t.column(0).take(take), t.column(1).take(take), pa.array(np.minimum(cos[good], 1.0))], ["pos_a", "pos_b", "cos"])

    placed = spread(base).mapInArrow(place, f"{KEY}, side int, recs binary")
    met = placed.groupBy("enc", "tab", "cell", "bi", "bj").applyInArrow(meet, "enc string, pos_a long, pos_b long").distinct()
    asked = met.select("enc", F.explode(F.array("pos_a", "pos_b")).alias("pos"), "pos_a", "pos_b")
    once = base.filter(_good(dim)).select("enc", F.col("pos").cast("long").alias("pos"), "emb").repartition("enc", "pos").dropDuplicates(["enc", "pos"])
    side = lambda c: F.first(F.when(F.col("pos") == F.col(c), F.col("emb")), ignorenulls=True)
    both = asked.join(once, ["enc", "pos"]).groupBy("enc", "pos_a", "pos_b").agg(side("pos_a").alias("a"), side("pos_b").alias("b"))
    found = both.select("pos_a", "pos_b", "a", "b").mapInArrow(exact, out)
    return found.groupBy("pos_a", "pos_b").agg(F.max("cos").alias("cos")).filter("pos_a <> pos_b")


def nearest(df: DataFrame, k: int = 10, every: int = 20, id_col: str = "pos", emb_col: str = "emb", encoder_col: str = "encoder", dim: int = 64, probes: int | None = None) -> DataFrame:
    """(pos, neighbour, cos, place): the k most similar vectors of each query; queries are the ids divisible by `every`.

    There are about as many cells as the root of the rows; a query visits `probes` of them, by default 9 and one for
    every 60 cells there are (8.8 % of the rows at 14,000 rows, 4 % at 140,000).
    """
    base = _base(df, id_col, emb_col, encoder_col)
    index, n = build_index(base, dim, 1, 1.0)
    if index is None:
        return df.sparkSession.createDataFrame([], "pos long, neighbour long, cos double, place int")
    shared = df.sparkSession.sparkContext.broadcast(index)
    n_cells = len(index.cells[0])
    probes = min(n_cells, probes or 9 + n_cells // 60)
    query_blocks = max(1, math.ceil(n / every * probes / n_cells / QUERY_BLOCK))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 4096):
                if (got := _encoded(whole.slice(lo, 4096), index, dim)) is None:
                    continue
                enc, src, x = got
                pos = np.asarray(src["pos"])
                cell = index.assign(x)[:, 0]
                salt = _salt(pos, index.blocks[0][cell])
                rows = np.arange(len(pos))
                parts = [{"src": src, "rows": rows, "tab": 0, "cell": cell, "bi": salt, "bj": j, "side": 1} for j in range(query_blocks)]
                asked = np.flatnonzero(pos % every == 0)
                if len(asked):
                    near = index.assign(x[asked], 0, probes)
                    at, cells = np.repeat(asked, near.shape[1]), near.ravel()
                    bj = _salt(pos[at] + 1, np.full(len(at), query_blocks))
                    blocks = index.blocks[0][cells]
                    for b in range(int(blocks.max())):
                        some = blocks > b
                        parts.append({"src": src, "rows": at[some], "tab": 0, "cell": cells[some], "bi": b, "bj": bj[some], "side": 0})
                yield _emit(enc, parts)

    def meet(key: tuple, t: pa.Table) -> pa.Table:
        index = shared.value
        side = np.asarray(t.column("side").combine_chunks())
        pos_q, x_q = _unpack(t.filter(pa.array(side == 0)), dim)[:2]
        pos_d, x_d, code = _unpack(t.filter(pa.array(side == 1)), dim)[:3]
        a, b, c = [], [], []
        deep = min(len(pos_d), 12 * k + 20)
        step = max(1, 2_000_000 // max(1, len(pos_d)))
        for lo in range(0, len(pos_q) if deep else 0, step):
            q = np.arange(lo, min(lo + step, len(pos_q)))
            s = index.scan(x_q[q].astype(np.float32), code)
            top = np.argpartition(-s, deep - 1, axis=1)[:, :deep]
            cos = np.einsum("qd,qkd->qk", x_q[q], x_d[top])
            cos[pos_d[top] == pos_q[q][:, None]] = -np.inf
            cos = np.round(cos, 9)
            order = np.lexsort((pos_d[top], -cos), axis=1)[:, :k]
            best = np.take_along_axis(cos, order, 1)
            who = pos_d[np.take_along_axis(top, order, 1)]
            good = np.isfinite(best)
            a.append(np.repeat(pos_q[q], order.shape[1])[good.ravel()])
            b.append(who[good])
            c.append(best[good])
        if not a:
            return pa.table({"pos": pa.array([], pa.int64()), "neighbour": pa.array([], pa.int64()), "cos": pa.array([], pa.float64())})
        return pa.table({"pos": np.concatenate(a), "neighbour": np.concatenate(b), "cos": np.concatenate(c)})

    placed = spread(base).mapInArrow(place, ROW)
    found = placed.groupBy("enc", "tab", "cell", "bi", "bj").applyInArrow(meet, "pos long, neighbour long, cos double")
    w = Window.partitionBy("pos").orderBy(F.desc("cos"), "neighbour")
    return found.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)
