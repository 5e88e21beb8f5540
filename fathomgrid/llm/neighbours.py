"""The most similar vectors of every vector: a permutation index in pivot inverted files.

Pivots are a net over a bounded sample of the vectors. A vector is represented
by the order of its nearest pivots and posted in the inverted files of the
first of them. Within a file, blocks of candidates are ranked by the footrule
distance of their permutations, and the nearest blocks are compared by exact
cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PermutationIndex:
    """dims: length of a usable vector. sample, growth: the index is fitted on sample usable rows or growth times the square root of all, whichever is more (by hash of the identifier), so that pivots can grow with the collection.
    prefix: pivots in a permutation. posted, spill: a vector is posted in the file of its nearest pivot, and in up to posted files in all of pivots that are at least `spill` times as similar. candidates: a query is compared with whole blocks, nearest first, until it has met this many; its own block always counts.
    part: rows that a task holds at once; a file is searched in pairs of parts."""

    dims: int = 768
    sample: int = 2048
    growth: float = 2.0
    prefix: int = 8
    posted: int = 2
    spill: float = 0.5
    candidates: int = 512
    part: int = 32768


@dataclass(frozen=True)
class Pivots:
    """Unit rows about `centre`, the mean of the sample's unit rows."""

    rows: np.ndarray
    centre: np.ndarray

    def similarities(self, unit: np.ndarray) -> np.ndarray:
        return (unit - self.centre) @ self.rows.T


def _matrix(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, float32 rows) of the usable vectors: dims finite values that are not all zero."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy(zero_copy_only=False))
    starts = column.offsets.to_numpy(zero_copy_only=False)[:-1]
    values = column.values.to_numpy(zero_copy_only=False)  # nulls become NaN
    there = np.asarray(column.is_valid()) & (lengths == dims)
    rows = np.flatnonzero(there)
    if not len(rows):
        return rows, np.zeros((0, dims), np.float32)
    m = values[starts[rows][:, None] + np.arange(dims)].astype(np.float32)
    good = np.isfinite(m).all(axis=1) & (m != 0).any(axis=1)
    return rows[good], m[good]


def _unit(m: np.ndarray) -> np.ndarray:
    w = m.astype(np.float64)
    return (w / np.linalg.norm(w, axis=1, keepdims=True)).astype(np.float32)


def _pack(m: np.ndarray) -> list[bytes]:
    """Rows as bytes, as halves where that loses nothing."""
    with np.errstate(over="ignore"):
        half = m.astype(np.float16)
    exact = (half.astype(np.float32) == m).all(axis=1)
    return [h.tobytes() if e else f.tobytes() for h, f, e in zip(half, m, exact)]


def _unpack(rows: list[bytes], dims: int) -> np.ndarray:
    m = np.empty((len(rows), dims), np.float32)
    for i, b in enumerate(rows):
        m[i] = np.frombuffer(b, np.float16 if len(b) == 2 * dims else np.float32)
    return m


def usable(column: str, dims: int) -> Column:
    """Whether a vector has exactly dims finite values that are not all zero."""
    v = F.col(column)
    low, high = F.array_min(v).cast("double"), F.array_max(v).cast("double")  # NaN is the greatest value
    whole = (F.size(v) == dims) & (F.size(F.array_compact(v)) == dims)
    return F.coalesce(whole & ~F.isnan(high) & (high < float("inf")) & (low > float("-inf")) & ((high != 0) | (low != 0)), F.lit(False))


def net(unit: np.ndarray, step: int = 1024) -> Pivots:
    """Greedy net: a row becomes a pivot unless one is already near, that is, nearer than half the usual similarity of a row's nearest other row (both about the common centre). So each crowded region has few pivots and its rows agree on the nearest."""
    centre = unit.mean(axis=0)
    about = unit - centre
    norms = np.linalg.norm(about, axis=1)
    about = about[norms > 1e-6] / norms[norms > 1e-6, None]
    if not len(about):
        return Pivots(unit[:1] - 0 * centre, 0 * centre)
    best = np.full(len(about), -1.0, np.float32)
    for i in range(0, len(about), step):
        sims = about[i : i + step] @ about.T
        sims[np.arange(len(sims)), np.arange(i, i + len(sims))] = -1
        best[i : i + step] = sims.max(axis=1)
    bound = max(0.05, float(np.median(best)) / 2) if len(about) > 1 else 0.5
    chosen = [0]
    near = about @ about[0]
    for i in range(1, len(about)):
        if near[i] < bound:
            chosen.append(i)
            near = np.maximum(near, about @ about[i])
    return Pivots(about[chosen].astype(np.float32), centre.astype(np.float32))


def pivots(vectors: DataFrame, id_col: str, vector_col: str, index: PermutationIndex) -> Pivots | None:
    """The net over a sample of the usable rows, taken by hash of the identifier; None where no row is usable."""
    rows = vectors.where(usable(vector_col, index.dims) & F.col(id_col).isNotNull()).select(id_col, vector_col)
    total = rows.count()
    if not total:
        return None
    share = min(1.0, max(index.sample, index.growth * total**0.5) / total)
    bound = min(int(-(2**63) + share * (2**64 - 1)), 2**63 - 1)
    got = rows.where(F.xxhash64(F.col(id_col)) <= F.lit(bound)).toArrow()  # bounded: the sample's rows and chance
    if not got.num_rows:  # by chance, or all rows have one identifier
        got = rows.limit(index.sample).toArrow()
    _, m = _matrix(got.column(vector_col), index.dims)
    order = np.argsort(np.array([str(x) for x in got.column(id_col).to_pylist()], dtype=object), kind="stable")
    return net(_unit(m[order]))


def permutations(vectors: DataFrame, id_col: str, vector_col: str, index: PermutationIndex, anchors: Pivots, values: bool = True) -> DataFrame:
    """(id, perm, files, vec): each usable vector with its nearest pivots, nearest first, as 16-bit numbers, those in whose files it is posted, and its values (or nothing)."""
    shared = vectors.sparkSession.sparkContext.broadcast(anchors)  # at most the sample's rows
    prefix = min(index.prefix, len(anchors.rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = shared.value
        for b in batches:
            rows, m = _matrix(b.column(1), index.dims)
            if not len(rows):
                continue
            sims = a.similarities(_unit(m))
            near = np.argpartition(-sims, prefix - 1, axis=1)[:, :prefix] if prefix < len(a.rows) else np.tile(np.arange(len(a.rows)), (len(m), 1))
            near = np.take_along_axis(near, np.argsort(-np.take_along_axis(sims, near, 1), axis=1, kind="stable"), 1).astype(np.int16)
            strong = np.take_along_axis(sims, near[:, : index.posted].astype(int), 1)
            n_files = 1 + (np.cumprod(strong[:, 1:] >= index.spill * np.maximum(strong[:, :1], 1e-6), axis=1).sum(axis=1) if strong.shape[1] > 1 else np.zeros(len(m), int))
            files = pa.array([p[:n].tolist() for p, n in zip(near, n_files)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array([p.tobytes() for p in near], pa.binary()), files, pa.array(_pack(m) if values else [b""] * len(m), pa.binary())], names=["id", "perm", "files", "vec"])

    return vectors.select(F.col(id_col).alias("id"), vector_col).where("id is not null").mapInArrow(run, "id string, perm binary, files array<int>, vec binary")


def places(perms: np.ndarray, n_pivots: int) -> np.ndarray:
    """The mean place of each pivot over some permutation prefixes; an absent pivot stands behind the last place."""
    m = perms.shape[1]
    total = np.zeros(n_pivots)
    np.add.at(total, perms.ravel(), np.tile(np.arange(m) - m, len(perms)))
    return m + total / len(perms)


def footrule(a: np.ndarray, b: np.ndarray) -> float:
    """Footrule distance: the sum over pivots of the difference of their places."""
    return float(np.abs(a - b).sum())


def _blocks(pdf: pd.DataFrame, index: PermutationIndex, n_pivots: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(identifiers, unit rows, places) per first pivot."""
    perm = np.frombuffer(b"".join(pdf.perm), np.int16).reshape(len(pdf), -1)
    ids, first = pdf.id.to_numpy(), perm[:, 0]
    order = np.argsort(first, kind="stable")
    cuts = np.flatnonzero(np.diff(first[order])) + 1
    vec = pdf.vec.to_numpy()
    return [(ids[rows], _unit(_unpack(list(vec[rows]), index.dims)), places(perm[rows], n_pivots)) for rows in np.split(order, cuts)]


def _search(q: pd.DataFrame, c: pd.DataFrame, index: PermutationIndex, k: int, n_pivots: int, step: int = 256) -> pd.DataFrame:
    """The k best candidates of each query row within one inverted file: blocks by footrule, rows by cosine."""
    answer = _blocks(c, index, n_pivots)
    ask = answer if q is c else _blocks(q, index, n_pivots)
    ids, found, sims = [], [], []
    for qid, qv, at in ask:
        ranked = sorted(range(len(answer)), key=lambda j: (footrule(at, answer[j][2]), j))
        sizes = np.cumsum([len(answer[j][0]) for j in ranked])
        near = ranked[: int(np.searchsorted(sizes, index.candidates)) + 1]
        cid = np.concatenate([answer[j][0] for j in near])
        cv = answer[near[0]][1] if len(near) == 1 else np.concatenate([answer[j][1] for j in near])
        order = {x: i for i, x in enumerate(cid.tolist())}
        for i in range(0, len(qid), step):
            s = qv[i : i + step] @ cv.T
            own = np.array([order.get(x, -1) for x in qid[i : i + step].tolist()])
            here = own >= 0
            s[np.flatnonzero(here), own[here]] = -2
            top = np.argpartition(-s, k - 1, axis=1)[:, :k] if s.shape[1] > k else np.tile(np.arange(s.shape[1]), (len(s), 1))
            best = np.take_along_axis(s, top, 1)
            for x, t, b in zip(qid[i : i + step].tolist(), top, best):
                keep = b > -1.5
                ids.append(x)
                found.append(cid[t[keep]].tolist())
                sims.append(b[keep].astype(np.float64).tolist())
    return pd.DataFrame({"id": ids, "found": found, "sims": sims})


def nearest(vectors: DataFrame, id_col: str, vector_col: str, k: int = 10, index: PermutationIndex = PermutationIndex()) -> DataFrame:
    """(id, neighbour, similarity, rank): the k most similar other vectors of every usable vector, approximately.

    Null, short, all-zero and non-finite vectors neither ask nor answer, nor
    do rows without an identifier. Equal similarities rank by identifier. A
    vector delivered twice under one identifier is found once. Every vector
    is posted; no file is cut short: a file is searched in unordered pairs of
    its parts, each pair a task of its own that serves both sides, so that a
    row travels once per part of its file.
    """
    spark = vectors.sparkSession
    schema = "id string, found array<string>, sims array<double>"
    anchors = pivots(vectors, id_col, vector_col, index)
    if anchors is None:
        return spark.createDataFrame([], "id string, neighbour string, similarity double, rank int")
    n = len(anchors.rows)
    post = lambda values: permutations(vectors, id_col, vector_col, index, anchors, values).withColumn("pivot", F.explode("files"))

    sizes = {r[0]: -(-r[1] // index.part) for r in post(False).groupBy("pivot").count().collect()}  # at most a row per pivot
    parts = F.get(F.array(*[F.lit(sizes.get(p, 1)) for p in range(n)]), F.col("pivot"))
    rows = post(True).withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    met = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda b: F.struct(F.least("own", b).alias("a"), F.greatest("own", b).alias("b")))
    tiles = rows.select("pivot", "own", "id", "perm", "vec", F.explode(met).alias("t")).select("pivot", "own", "id", "perm", "vec", "t.a", "t.b")

    def one_tile(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf.a.iloc[0], pdf.b.iloc[0]
        left = pdf[pdf.own == a].drop_duplicates("id").reset_index(drop=True)
        if a == b:
            return _search(left, left, index, k, n)
        right = pdf[pdf.own == b].drop_duplicates("id").reset_index(drop=True)
        both = [_search(x, y, index, k, n) for x, y in ((left, right), (right, left)) if len(x) and len(y)]
        return pd.concat(both) if both else pd.DataFrame({"id": [], "found": [], "sims": []})

    got = tiles.groupBy("pivot", "a", "b").applyInPandas(one_tile, schema)
    every = got.groupBy("id").agg(F.array_sort(F.flatten(F.collect_list(F.arrays_zip(F.col("found").alias("neighbour"), F.col("sims").alias("similarity"))))).alias("all"))  # at most posted * parts * k
    once = F.filter("all", lambda x, i: (i == 0) | (x["neighbour"] != F.get("all", i - 1)["neighbour"]))  # files may differ in the last bit
    ranked = F.array_sort(F.transform(once, lambda x: F.struct((-x["similarity"]).alias("less"), x["neighbour"].alias("neighbour"))))
    top = every.select("id", F.slice(ranked, 1, k).alias("top"))
    return top.select("id", F.posexplode("top").alias("at", "x")).select("id", F.col("x.neighbour").alias("neighbour"), (-F.col("x.less")).alias("similarity"), (F.col("at") + 1).alias("rank"))
