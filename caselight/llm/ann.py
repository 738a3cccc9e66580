"""Nearest neighbours by cross-polytope hashing: pseudo-random rotations, nearest signed axes, multiprobe tables, exact rerank.

A rotation is three rounds of random signs and a fast Hadamard transform. The bucket of a unit vector in a table is the
signed axis nearest to its rotation; where there are so many vectors that buckets would grow with them, a second rotation's
nearest axis, among as many as needed, parts them further. Every vector is in one bucket of each table. A query asks the
buckets of its nearest axes, where all members are ranked by their exact inner products. How many it asks is fitted on a
bounded sample, so that recall doesn't fall with the number of vectors. A query that meets fewer than k others is compared
with all vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .chunks import tidy_batches, tidy_both

#: Tables: each holds every vector once.
TABLES = 4
#: Vectors of a bucket on average, at most, as long as the axes of two rotations suffice.
MEMBERS = 20_000
#: Vectors and queries that are compared as a block: a bucket with more is dealt into blocks, and each block of queries meets each of vectors.
BLOCK, ASKING = 40_000, 20_000
#: Vectors of the sample that the number of probes is fitted on, queries among them, and the share of neighbours that its tables must hold.
SAMPLE, SAMPLE_QUERIES, TARGET = 20_000, 300, 0.97
#: Bytes of placed vectors in a batch.
PLACED = 16_000_000


def _hadamard(x: np.ndarray) -> np.ndarray:
    n, h = x.shape[1], 1
    while h < n:
        pair = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack((pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]), axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def rotations(x: np.ndarray, count: int, seed: int) -> Iterator[np.ndarray]:
    """Pseudo-random rotations of the rows, padded with zeros to a power of two."""
    size = 1 << max(0, (x.shape[1] - 1).bit_length())
    padded = np.zeros((len(x), size), np.float32)
    padded[:, : x.shape[1]] = x
    for k in range(count):
        signs = np.random.default_rng((seed, k)).choice(np.array([-1, 1], np.float32), (3, size))
        y = padded
        for s in signs:
            y = _hadamard(y * s)
        yield y


def _axes(unit: np.ndarray, tables: int, second: int, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """For each table, the vectors' components along all signed axes of its first rotation, and along those of `second` dimensions of its second one."""
    turned = rotations(unit, tables * (2 if second else 1), seed)
    for y in turned:
        z = next(turned)[:, :second] if second else None
        yield np.concatenate((y, -y), axis=1), None if z is None else np.concatenate((z, -z), axis=1)


def second_dimensions(n: int, size: int) -> int:
    """Dimensions of the second rotation so that n vectors have MEMBERS a bucket, none if the first suffices."""
    axes = 2 << max(0, (size - 1).bit_length())
    return min(axes // 2, max(0, -(-n // (MEMBERS * axes * 2)))) if n > MEMBERS * axes else 0


def buckets(unit: np.ndarray, probes: int, tables: int, second: int, seed: int) -> np.ndarray:
    """(rows, tables, probes): numbers of the buckets nearest to each unit vector, the nearest first; -1 beyond the last bucket."""
    out = np.full((len(unit), tables, probes), -1, np.int64)
    for t, (one, two) in enumerate(_axes(unit, tables, second, seed)):
        if probes == 1:
            out[:, t, 0] = one.argmax(axis=1) if two is None else one.argmax(axis=1) * two.shape[1] + two.argmax(axis=1)
            continue
        step = len(unit) if two is None else max(1, 4_000_000 // (one.shape[1] * two.shape[1]))
        for a in range(0, len(unit), max(1, step)):
            near = one[a : a + step] if two is None else (one[a : a + step, :, None] + two[a : a + step, None, :]).reshape(-1, one.shape[1] * two.shape[1])
            most = min(probes, near.shape[1])
            best = np.argpartition(-near, most - 1, axis=1)[:, :most]
            best = np.take_along_axis(best, np.argsort(-np.take_along_axis(near, best, axis=1), axis=1, kind="stable"), axis=1)
            out[a : a + step, t, :most] = best
    return out


def fit_probes(sample: np.ndarray, n: int, k: int, tables: int, second: int, seed: int) -> int:
    """Buckets that a query must ask in each table, so that TARGET of its neighbours are in one of them.

    Neighbours are taken from the sample as near as the k nearest of n vectors, or nearest in the sample where those would be nearer still.
    """
    size = sample.shape[1]
    axes = 2 << max(0, (size - 1).bit_length())
    every = axes * (2 * second if second else 1)
    if len(sample) < 3:
        return every
    unit = (sample / np.linalg.norm(sample, axis=1, keepdims=True)).astype(np.float32)
    asks = unit[:SAMPLE_QUERIES]
    likeness = asks @ sample.astype(np.float32).T
    likeness[np.arange(len(asks)), np.arange(len(asks))] = -np.inf
    near = min(len(sample) - 1, max(1, round(k * len(sample) / max(n, 1))))
    found = np.argpartition(-likeness, near - 1, axis=1)[:, :near]
    rank = np.full(found.shape, every)
    for (one, two), (all_one, all_two) in zip(_axes(asks, tables, second, seed), _axes(unit, tables, second, seed), strict=True):
        at = np.take_along_axis(one, all_one.argmax(axis=1)[found], axis=1)
        if two is None:
            before = (one[:, None, :] > at[:, :, None]).sum(axis=2)
        else:
            at = at + np.take_along_axis(two, all_two.argmax(axis=1)[found], axis=1)
            ordered = np.sort(two, axis=1)
            before = np.array([[(len(o) - np.searchsorted(o, v - row, "right")).sum() for v in values] for row, o, values in zip(one, ordered, at, strict=True)])
        rank = np.minimum(rank, before)
    return int(min(every, np.quantile(rank, TARGET, method="higher") + 1))


def _usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = TABLES, probes: int | None = None, seed: int = 17) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k largest inner products found for each query row among the other rows.

    Every usable row is indexed. A vector that is null, zero, of another size than most, or holds a null or non-finite
    component takes no part, nor does a row without id. Ranks are from 1, ties go to the smaller id, the score is the inner product
    of the original vectors in double precision. Rows of one id count as one: the best score of any of them stands.
    Without `probes` their number is fitted on the SAMPLE rows with the smallest hashes of their ids.
    """
    kind = vectors.schema[vector_col].dataType.elementType
    number = np.float32 if isinstance(kind, T.FloatType) else np.float64
    plain = F.col(vector_col) if number is np.float32 else F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), plain.alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks")).where(F.col("id").isNotNull() & _usable(F.col("vector")))
    sizes = rows.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").limit(1).collect()
    size, n = (sizes[0]["size"], sizes[0]["n"]) if sizes else (1, 0)
    rows = rows.where(F.size("vector") == size)

    second = second_dimensions(n, size)
    if probes is None:
        picked = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").toPandas()["vector"]  # a bounded sample
        probes = fit_probes(np.stack(picked.to_numpy()).astype(np.float64), n, k, tables, second, seed) if len(picked) else 1

    def place(wanted: int, vectors_too: bool = True):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            step = max(1, PLACED // (tables * wanted * (8 * size + 16)))
            for batch in batches:
                for part in (batch.slice(i, step) for i in range(0, batch.num_rows, step)):
                    x = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(number).reshape(len(part), size)
                    scale = np.abs(x).max(axis=1, keepdims=True).astype(np.float64)
                    unit = x / scale
                    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                    found = buckets(unit.astype(np.float32), wanted, tables, second, seed)
                    row, table, probe = np.nonzero(found >= 0)
                    cells = pa.array(found[row, table, probe] * tables + table)
                    if not vectors_too:
                        yield pa.RecordBatch.from_arrays([cells], ["cell"])
                        continue
                    raw = pa.array([v.tobytes() for v in x], pa.binary())
                    yield pa.RecordBatch.from_arrays([cells, part.column(0).take(pa.array(row)), raw.take(pa.array(row))], ["cell", "id", "raw"])

        return tidy_batches(run)

    index = rows.select("id", "vector").mapInArrow(place(1), "cell long, id long, raw binary")
    asks = rows.where("asks").select("id", "vector")
    asked = asks.mapInArrow(place(probes), "cell long, id long, raw binary")
    # Blocks of large buckets, of their vectors and of their queries. Only buckets with several are joined.
    held = rows.select("id", "vector").mapInArrow(place(1, False), "cell long").groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    called = asks.mapInArrow(place(probes, False), "cell long").groupBy("cell").agg(F.ceil(F.count("*") / ASKING).cast("int").alias("calls"))
    large = held.join(called, "cell").where("blocks > 1 or calls > 1")

    def dealt_in(part: DataFrame, own: str, blocks: str, other: str, others: str) -> DataFrame:
        part = part.join(large, "cell", "left").withColumn(own, F.pmod(F.xxhash64("id"), F.coalesce(blocks, F.lit(1))).cast("int"))
        return part.withColumn(other, F.explode(F.sequence(F.lit(0), F.coalesce(others, F.lit(1)) - 1)))

    index = dealt_in(index, "block", "blocks", "call", "calls")
    asked = dealt_in(asked, "call", "calls", "block", "blocks")

    def rank(key: tuple, members: pa.Table, queries: pa.Table) -> pa.Table:
        ids = queries.column("id").to_numpy()
        if not members.num_rows or not len(ids):
            return pa.table({"query_id": pa.array([], pa.int64()), "found": pa.array([], pa.list_(pa.struct([("minus", pa.float64()), ("vec_id", pa.int64())])))})
        # Rows of one id count as one, so that an id that stands often doesn't take the places of others: by id, equal rows once.
        own, raw = members.column("id").to_numpy(), members.column("raw").to_pylist()
        order = np.argsort(own, kind="stable")
        if (np.diff(own[order]) == 0).any():
            order = np.array(list({(own[i], raw[i]): i for i in order}.values()))
        own, raw = own[order], [raw[i] for i in order]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        group = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(own)]))
        x = np.frombuffer(b"".join(raw), number).reshape(len(own), size).astype(np.float64)
        q = np.frombuffer(b"".join(queries.column("raw").to_pylist()), number).reshape(len(ids), size).astype(np.float64)
        lists, names = [], []
        step = max(1, 8_000_000 // len(own))
        for a in range(0, len(ids), step):
            mine = ids[a : a + step]
            s = q[a : a + step] @ x.T
            s[mine[:, None] == own[None, :]] = -np.inf
            best = s if len(first) == len(own) else np.maximum.reduceat(s, first, axis=1)
            least = np.partition(best, len(first) - k, axis=1)[:, len(first) - k, None] if len(first) > k else np.full((len(mine), 1), -np.inf)
            # Rounding differs between blocks: what is near the last place is computed again, pair by pair, in one fixed order.
            slack = np.where(np.isfinite(least), 1e-9 * (1 + np.abs(least)), 0)
            taken = (s >= least - slack) & (s > -np.inf)
            if best is not s:  # of an id's rows those that may be its best
                taken &= s >= (best - 1e-9 * (1 + np.abs(np.where(np.isfinite(best), best, 0))))[:, group]
            r, c = np.nonzero(taken)
            exact = np.empty(len(r))
            for b in range(0, len(r), 200_000):
                exact[b : b + 200_000] = (q[a + r[b : b + 200_000]] * x[c[b : b + 200_000]]).sum(axis=1)
            if best is not s:
                order = np.lexsort((-exact, own[c], r))
                r, c, exact = r[order], c[order], exact[order]
                once = np.r_[True, (r[1:] != r[:-1]) | (own[c][1:] != own[c][:-1])][: len(r)]
                r, c, exact = r[once], c[once], exact[once]
            order = np.lexsort((own[c], -exact, r))
            r, c, exact = r[order], c[order], exact[order]
            begin = np.searchsorted(r, np.arange(len(mine) + 1))
            for i in range(len(mine)):
                u, v = begin[i], min(begin[i + 1], begin[i] + k)
                if v > u:
                    names.append(int(mine[i]))
                    lists.append([{"minus": -m, "vec_id": w} for m, w in zip(exact[u:v].tolist(), own[c[u:v]].tolist(), strict=True)])
        return pa.table({"query_id": pa.array(names, pa.int64()), "found": pa.array(lists, pa.list_(pa.struct([("minus", pa.float64()), ("vec_id", pa.int64())])))})

    def placed(index: DataFrame, asked: DataFrame) -> DataFrame:
        met = index.select("cell", "block", "call", "id", "raw").groupBy("cell", "block", "call").cogroup(asked.select("cell", "block", "call", "id", "raw").groupBy("cell", "block", "call"))
        found = met.applyInArrow(tidy_both(rank), "query_id long, found array<struct<minus:double,vec_id:long>>")
        pairs = found.select("query_id", F.explode("found").alias("hit")).groupBy("query_id", F.col("hit.vec_id").alias("vec_id")).agg(F.min("hit.minus").alias("minus"))
        return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("minus", "vec_id"))).where(F.col("rank") <= k)

    near = cut(placed(index, asked))
    full = near.groupBy(F.col("query_id").alias("id")).count().where(F.col("count") >= k)
    short = cut(rows.where("asks").select("id", "vector").join(full, "id", "left_anti"))
    left = short.count()
    if left:  # each block of these queries meets each block of all vectors
        wide, deep = max(1, -(-left // BLOCK)), max(1, -(-n // BLOCK))

        def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(number).reshape(len(batch), size)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.tobytes() for v in x], pa.binary())], ["id", "raw"])

        def dealt(part: DataFrame, own: str, blocks: int, other: str, others: int) -> DataFrame:
            part = part.select("id", "vector").mapInArrow(tidy_batches(raw), "id long, raw binary").withColumn(own, F.pmod(F.xxhash64("id"), F.lit(blocks)))
            return part.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long")))).withColumn("call", F.lit(0))

        whole = placed(dealt(rows, "cell", deep, "block", wide), dealt(short, "block", wide, "cell", deep))
        near = near.join(short.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(whole)
    return near.select("query_id", "rank", "vec_id", (-F.col("minus")).alias("score"))

