"""All pairs of two tables of vectors, without a row for each pair.

Vectors are packed into rows of up to ROWS of them, and each pair of such rows is one matrix product in an executor's Python. A product only says which
pairs can matter: their scores are computed again, term by term in the order of folio.functions.vectors, so results are those of the expressions there. A task
holds one pair of rows and the best of each query so far. Queries are broadcast, packed, while there are few; else both sides meet block by block."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.session import materialize, ship

#: Vectors of a block, results that a task holds before it hands them on, pairs whose scores are computed at once.
ROWS, HELD, AT_ONCE = 2048, 2_000_000, 1 << 18
#: A score is compared as rounded to 6 places, so what a product puts this close may still be before.
NEAR = 2e-6
_NULL = np.iinfo(np.int64).min


def packable(rows: DataFrame, key: str, column: str) -> bool:
    """Are keys whole numbers and vectors arrays of floating-point numbers?"""
    kind = rows.schema[column].dataType
    return isinstance(rows.schema[key].dataType, T.ByteType | T.ShortType | T.IntegerType | T.LongType) and isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType | T.DoubleType)


def pack(rows: DataFrame, key: str, column: str, group: str | None = None) -> DataFrame:
    """([grp,] ids, dim, cells): rows of up to ROWS vectors of one group and one length; those that are null or hold a null have dim -1 and no cells."""
    ship(rows.sparkSession)
    chosen = [F.col(key).cast("long").alias("key"), F.col(column).cast("array<double>").alias("v")]
    fields = [T.StructField("ids", T.BinaryType()), T.StructField("dim", T.IntegerType()), T.StructField("cells", T.BinaryType())]
    if group:
        chosen.append(F.col(group).alias("grp"))
        fields.append(T.StructField("grp", rows.schema[group].dataType))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict = {}  # (group, dim): ids, vectors, how many
        kind = None

        def out(at: tuple, least: int) -> Iterator[pa.RecordBatch]:
            ids, cells = np.concatenate(parts[at][0]), np.concatenate(parts[at][1])
            begin = 0
            while len(ids) - begin >= least and begin < len(ids):
                cut = slice(begin, begin + ROWS)
                columns = [pa.array([ids[cut].tobytes()], pa.binary()), pa.array([at[1]], pa.int32()), pa.array([cells[cut].tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array([at[0]], kind)] if group else []), names=[f.name for f in fields])
                begin += ROWS
            parts[at] = [[ids[begin:]], [cells[begin:]], len(ids[begin:])]

        for b in batches:
            if not b.num_rows:
                continue
            ids, v = pc.fill_null(b.column(0), _NULL).to_numpy(), b.column(1)
            size = pc.fill_null(pc.list_value_length(v), -1).to_numpy().astype(np.int64)
            flat = v.flatten()
            cells = flat.to_numpy(zero_copy_only=False)
            ends = np.cumsum(np.maximum(size, 0))
            starts, dims = ends - np.maximum(size, 0), size.copy()
            if flat.null_count:
                dims[np.searchsorted(ends, np.flatnonzero(flat.is_null().to_numpy(zero_copy_only=False)), "right")] = -1
            code, names = np.zeros(len(ids), np.int64), [None]
            if group:
                coded, kind = b.column(2).dictionary_encode(), b.column(2).type
                code, names = pc.fill_null(coded.indices, -1).to_numpy().astype(np.int64), [*coded.dictionary.to_pylist(), None]
            for c, d in np.unique(np.stack([code, dims], 1), axis=0).tolist():
                at = np.flatnonzero((code == c) & (dims == d))
                part = parts.setdefault((names[c], d), [[], [], 0])
                part[0].append(ids[at])
                part[1].append(cells[starts[at][:, None] + np.arange(max(d, 0))])
                part[2] += len(at)
                if part[2] >= ROWS:
                    yield from out((names[c], d), ROWS)
            if sum(p[2] for p in parts.values()) > 64 * ROWS:  # many groups: less full rows
                for at in list(parts):
                    yield from out(at, 1)
                    del parts[at]
        for at in list(parts):
            yield from out(at, 1)

    return rows.select(*chosen).mapInArrow(fold, T.StructType(fields))


def crossed(vectors: DataFrame, query: DataFrame, key: str, column: str, group: str | None, most: int) -> DataFrame:
    """Each packed row of the vectors with each packed row of the queries (query_id, q): q_ids, q_dim, q_cells. Up to `most` queries are broadcast."""
    asked = materialize(pack(query, "query_id", "q").toDF("q_ids", "q_dim", "q_cells"), "blocks")
    left = pack(vectors, key, column, group)
    tasks = 3 * vectors.sparkSession.sparkContext.defaultParallelism
    if (asked.agg(F.sum(F.length("q_ids"))).head()[0] or 0) <= 8 * most:
        return left.repartition(tasks).crossJoin(F.broadcast(asked))
    return materialize(left.repartition(tasks), "blocks").crossJoin(asked)


def _read(b: pa.RecordBatch, i: int, at: dict[str, int], prefix: str = "") -> tuple[np.ndarray, int, np.ndarray]:
    dim = b.column(at[prefix + "dim"])[i].as_py()
    ids = np.frombuffer(b.column(at[prefix + "ids"])[i].as_buffer(), np.int64)
    cells = b.column(at[prefix + "cells"])[i].as_buffer()
    return ids, dim, np.frombuffer(cells, np.float64).reshape(len(ids), dim) if dim > 0 else np.zeros((len(ids), 0))


def _norms(m: np.ndarray) -> np.ndarray:
    total = np.zeros(len(m))
    for d in range(m.shape[1]):
        total += m[:, d] * m[:, d]
    return np.sqrt(total)


def rounded(x: np.ndarray) -> np.ndarray:
    """To 6 places as Spark's round does: half up, by the digits that the number is written with."""
    y = np.abs(x) * 1e6
    with np.errstate(invalid="ignore"):
        out = np.copysign(np.floor(y + 0.5) / 1e6, x)
        close = np.flatnonzero((np.abs(y - np.floor(y) - 0.5) < 1e-3) & np.isfinite(y))
    for i in close:
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal("0.000001"), ROUND_HALF_UP)) if y[i] < 1e15 else x[i]
    return out


class Best:
    """The k best (key, score) of each query of a block so far: by rounded score, numbers before NaN (after it where more is better) before null, then by key."""

    def __init__(self, ids: np.ndarray, k: int, sign: int):
        self.ids, self.k, self.sign = ids, k, sign
        self.q, self.key, self.score, self.null = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool)
        self.limit = np.full(len(ids), np.inf)  # what a score must not be beyond

    def add(self, q: np.ndarray, key: np.ndarray, score: np.ndarray, null: np.ndarray) -> None:
        q, key, score, null = (np.concatenate(x) for x in ((self.q, q), (self.key, key), (self.score, score), (self.null, null)))
        worth = self.sign * rounded(score)
        odd = np.isnan(worth) | null
        rank = np.where(null, 2, np.where(np.isnan(worth), self.sign, 0))
        worth = np.where(odd, 0, worth)
        order = np.lexsort((key, worth, rank, q))
        nth = np.arange(len(q)) - np.searchsorted(q[order], q[order])
        last = order[nth == self.k - 1]
        kept = order[nth < self.k]
        self.limit[q[last]] = np.where(rank[last] == 0, worth[last], np.where(rank[last] < 0, -np.inf, np.inf))
        self.q, self.key, self.score, self.null = q[kept], key[kept], score[kept], null[kept]

    def meet(self, ids: np.ndarray, v: np.ndarray, q: np.ndarray, comparable: bool) -> None:
        """Takes in a block of vectors."""
        if not comparable:  # all scores are null: the first keys
            first = np.sort(ids)[: self.k]
            n = len(self.ids)
            self.add(np.repeat(np.arange(n), len(first)), np.tile(first, n), np.zeros(n * len(first)), np.ones(n * len(first), bool))
            return
        ones = np.ones
        with np.errstate(all="ignore"):
            if self.sign > 0:
                a, b = (v * v).sum(axis=1), (q * q).sum(axis=1)
                about = np.concatenate([v * -2, ones((len(v), 1)), a[:, None]], 1) @ np.concatenate([q, b[:, None], ones((len(q), 1))], 1).T
                near = NEAR + 1e-14 * (v.shape[1] + 8) * (a.max(initial=0) + b.max(initial=0))
                lengths = None
            else:
                lengths = _norms(v), _norms(q)
                about = (v / -lengths[0][:, None]) @ (q / lengths[1][:, None]).T
                about[lengths[0] == 0] = np.inf
                about[:, lengths[1] == 0] = np.inf
                near = NEAR
            limit = self.limit
            if len(v) > self.k and np.isinf(limit).any():
                limit = np.fmin(limit, np.partition(about, self.k - 1, axis=0)[self.k - 1])
            vi, qi = np.nonzero(~(about > limit + near))
        vt, qt = np.ascontiguousarray(v.T), np.ascontiguousarray(q.T)
        for begin in range(0, len(vi), AT_ONCE):
            i, j = vi[begin : begin + AT_ONCE], qi[begin : begin + AT_ONCE]
            score, null = np.zeros(len(i)), np.zeros(len(i), bool)
            with np.errstate(all="ignore"):
                for d in range(len(vt)):
                    if self.sign > 0:
                        x = vt[d][i] - qt[d][j]
                        score += x * x
                    else:
                        score += vt[d][i] * qt[d][j]
                if lengths:
                    size = lengths[0][i] * lengths[1][j]
                    null = size == 0
                    score = np.where(null, 0, score / np.where(null, 1, size))
            self.add(j, ids[i], score, null)


def nearest(vectors: DataFrame, query: DataFrame, k: int, metric: str, key: str, column: str, group: str | None, most: int) -> DataFrame:
    """(query_id, [group,] key, score): for each query, of each group if there is one, the k best vectors of every task at least; scores are not rounded."""
    pairs = crossed(vectors, query, key, column, group, most)
    at = {c: i for i, c in enumerate(pairs.columns)}
    sign = 1 if metric == "l2" else -1
    fields = [T.StructField("query_id", T.LongType()), T.StructField(key, T.LongType()), T.StructField("score", T.DoubleType())]
    if group:
        fields.append(T.StructField(group, vectors.schema[group].dataType))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        kind = None

        def out() -> Iterator[pa.RecordBatch]:
            for (g, *_), x in held.items():
                for begin in range(0, len(x.q), 50_000):
                    cut = slice(begin, begin + 50_000)
                    ids, keys = x.ids[x.q[cut]], x.key[cut]
                    columns = [pa.array(ids, mask=ids == _NULL), pa.array(keys, mask=keys == _NULL), pa.array(x.score[cut], mask=x.null[cut])]
                    yield pa.RecordBatch.from_arrays(columns + ([pa.array([g] * len(ids), kind)] if group else []), names=[f.name for f in fields])
            held.clear()

        for b in batches:
            for i in range(b.num_rows):
                ids, dim, v = _read(b, i, at)
                q_ids, q_dim, q = _read(b, i, at, "q_")
                if group:
                    kind = b.column(at["grp"]).type
                name = (b.column(at["grp"])[i].as_py() if group else None, q_dim, len(q_ids), q_ids.tobytes())
                if name not in held:
                    held[name] = Best(q_ids.copy(), k, sign)
                held[name].meet(ids, v, q, dim == q_dim and dim >= 0)
                if sum(len(x.q) for x in held.values()) > HELD:
                    yield from out()
        yield from out()

    found = pairs.mapInArrow(fold, T.StructType(fields))
    return found.select(F.col("query_id").cast(query.schema["query_id"].dataType), *([group] if group else []), F.col(key).cast(vectors.schema[key].dataType), "score")


def cosine_stats(vectors: DataFrame, query: DataFrame, group: str, key: str, column: str, most: int) -> DataFrame:
    """(query_id, group, avg_cosine, max_cosine) over all vectors of a group; a pair in which a vector has no length does not count."""
    pairs = crossed(vectors, query, key, column, group, most)
    at = {c: i for i, c in enumerate(pairs.columns)}
    fields = [T.StructField("query_id", T.LongType()), T.StructField("total", T.DoubleType()), T.StructField("n", T.LongType()), T.StructField("most", T.DoubleType()), T.StructField(group, vectors.schema[group].dataType)]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        kind = None

        def out() -> Iterator[pa.RecordBatch]:
            for (g, *_), (ids, total, n, most) in held.items():
                columns = [pa.array(ids, mask=ids == _NULL), pa.array(total), pa.array(n), pa.array(most, mask=n == 0), pa.array([g] * len(ids), kind)]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])
            held.clear()

        for b in batches:
            kind = b.column(at["grp"]).type
            for i in range(b.num_rows):
                ids, dim, v = _read(b, i, at)
                q_ids, q_dim, q = _read(b, i, at, "q_")
                name = (b.column(at["grp"])[i].as_py(), q_dim, q_ids.tobytes())
                m = len(q_ids)
                if name not in held:
                    held[name] = (q_ids.copy(), np.zeros(m), np.zeros(m, np.int64), np.full(m, -np.inf))
                _, total, n, most = held[name]
                if dim == q_dim and dim >= 0:
                    a, c = _norms(v), _norms(q)
                    v = v[a != 0] / a[a != 0][:, None]
                    if len(v):
                        with np.errstate(all="ignore"):
                            cos = v @ (q / np.where(c == 0, 1, c)[:, None]).T
                        ok = c != 0
                        total += np.where(ok, cos.sum(axis=0), 0)
                        n += np.where(ok, len(v), 0)
                        most[:] = np.where(ok, np.maximum(most, cos.max(axis=0)), most)
                if sum(len(x[0]) for x in held.values()) > HELD:
                    yield from out()
        yield from out()

    found = pairs.mapInArrow(fold, T.StructType(fields)).groupBy("query_id", group).agg(F.sum("total").alias("total"), F.sum("n").alias("n"), F.max("most").alias("most"))
    return found.select(F.col("query_id").cast(query.schema["query_id"].dataType), group, F.round(F.col("total") / F.nullif("n", F.lit(0)), 6).alias("avg_cosine"), F.round("most", 6).alias("max_cosine"))
