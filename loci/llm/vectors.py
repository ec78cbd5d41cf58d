"""The most similar vectors of every vector: multi-probe p-stable hashing with exact reranking.

Tables of p-stable hashes ``floor((a.v + b) / w)`` are kept in groups that share a short prefix of
functions. A row goes to the shard of its prefix once per group; inside a shard all tables of the
group are probed: its own bucket first, then perturbed buckets in the order of their estimated
success (the sum of squared distances to the bucket borders that are crossed). Candidates of all
tables are merged and ranked by the exact cosine inside the shard, so that its best are the true
best of those that met. Equal vectors are one class from the start, so a group of copies is one row.
"""

from __future__ import annotations

import functools
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loci.runtime import default_parallelism, stored

#: Groups of tables: how often a row moves, whatever the size of the collection.
GROUPS = 4
#: Tables in a group, functions of a table beyond the shard's prefix, width of a bucket, extra buckets probed.
GROUP_TABLES, FUNCTIONS, WIDTH, PROBES = 4, 16, 2.0, 12
#: Width of the buckets of the shard's prefix, and its least length, so that small collections use all cores too.
SHARD_WIDTH, LEAST_PREFIX = 2.4, 3
#: Rows a shard should hold; the prefix grows with the logarithm of the collection to keep it there.
SHARD_ROWS = 96_000
#: A shard is worked on in blocks of at most so many rows; larger ones are split over tasks, block pair by block pair.
BLOCK_ROWS = 240_000
#: The cosine of single-precision unit vectors is at most this far from the exact one.
SLACK = 1e-5
_SEED = 977


def same_bucket(cosine: float) -> float:
    """Probability that unit vectors at a cosine share a bucket of one function of the prefix, whose borders are at multiples of ``SHARD_WIDTH``."""
    x = np.linspace(-8, 8, 4001)
    spread = math.sqrt(max(1e-12, 1 - cosine * cosine))
    below = np.vectorize(lambda z: 0.5 * math.erfc(-z / math.sqrt(2)))
    low = np.floor(x / SHARD_WIDTH) * SHARD_WIDTH
    share = below((low + SHARD_WIDTH - cosine * x) / spread) - below((low - cosine * x) / spread)
    return float((share * np.exp(-x * x / 2)).sum() / np.exp(-x * x / 2).sum())


def prefix_length(rows: int) -> int:
    """Functions of a shard's prefix; each keeps a little less than half of the rows in a bucket."""
    return max(LEAST_PREFIX, round(math.log2(max(1.0, rows / SHARD_ROWS)) / 1.1))


def expected_recall(rows: int, cosine: float, inside: float = 0.98) -> float:
    """Probability that vectors at a cosine meet in a shard of some group; ``inside`` is the recall of the probed tables there (measured: README)."""
    return 1 - (1 - same_bucket(cosine) ** prefix_length(rows) * inside) ** GROUPS


def perturbations(functions: int, probes: int) -> list[tuple[int, ...]]:
    """Sets of ranks among the sorted border distances, best expected score first (each function moves one way at most)."""
    m = functions
    z = [j * (j + 1) / (4 * (m + 1) * (m + 2)) for j in range(1, m + 1)]
    z += [1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4 * (m + 1) * (m + 2)) for j in range(m + 1, 2 * m + 1)]
    out: list[tuple[int, ...]] = []
    heap = [(z[0], (0,))]
    while heap and len(out) < probes:
        score, ranks = heapq.heappop(heap)
        top = ranks[-1]
        if top + 1 < 2 * m:
            heapq.heappush(heap, (score - z[top] + z[top + 1], (*ranks[:-1], top + 1)))
            heapq.heappush(heap, (score + z[top + 1], (*ranks, top + 1)))
        if all(2 * m - 1 - r not in ranks for r in ranks):
            out.append(ranks)
    return out


def _usable(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of vectors with ``dim`` finite elements, not all zero; and those vectors."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(lengths == dim)
    if not rows.size:
        return rows, np.empty((0, dim), np.float32)
    flat = column.take(pa.array(rows)).flatten()
    v = flat.to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)  # nulls become NaN
    ok = np.isfinite(v).all(axis=1) & (v != 0).any(axis=1)
    return rows[ok], v[ok]


def _unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _classes(v: np.ndarray) -> np.ndarray:
    v = v + np.float32(0)  # -0.0 and 0.0 are one value
    return np.array([xxhash.xxh3_64_intdigest(x.tobytes()) for x in v], dtype=np.uint64).view(np.int64)


def _read(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    for batch in batches:
        rows, v = _usable(batch.column(1), dim)
        if not rows.size:
            continue
        cid = _classes(v)
        fresh = []
        for c in cid.tolist():
            fresh.append(c not in seen)
            if len(seen) > 2_000_000:
                seen.clear()
            seen.add(c)
        fresh = np.array(fresh)
        offsets = np.concatenate([[0], np.cumsum(np.where(fresh, dim, 0))])
        vectors = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(v[fresh].ravel()), mask=pa.array(~fresh))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(cid), vectors], names=["id", "cid", "v"])


def _to_shards(batches: Iterator[pa.RecordBatch], dim: int, groups: int, prefix: int) -> Iterator[pa.RecordBatch]:
    rng = np.random.default_rng(_SEED)
    a = rng.normal(size=(dim, groups * prefix))
    # Borders at 0, where unit vectors are densest, so that no bucket of a shard's prefix holds more than about half.
    mix = rng.integers(1, 2**62, groups * prefix).astype(np.int64) * 2 + 1
    for batch in batches:
        if batch.num_rows == 0:
            continue
        v = batch.column(1).flatten().to_numpy().astype(np.float32).reshape(-1, dim)
        u = _unit(v)
        packed = pa.array([x.tobytes() for x in v], pa.binary())
        h = np.floor((u @ a) / SHARD_WIDTH).astype(np.int64) * mix
        for g in range(groups):
            key = h[:, g * prefix : (g + 1) * prefix].sum(axis=1)
            # The group is in the low bits, so that groups never share a shard.
            shard = (key - key % 1024) + g
            yield pa.RecordBatch.from_arrays([pa.array(shard), batch.column(0), packed], names=["shard", "cid", "q"])


def _exact(u: np.ndarray, i: np.ndarray, w: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cosines of the unit vectors ``u[i]`` and ``w[j]`` in double precision, row by row; in slices, so that memory stays bounded."""
    out = np.empty(i.size)
    for at in range(0, i.size, 20_000):
        out[at : at + 20_000] = np.einsum("ij,ij->i", u[i[at : at + 20_000]], w[j[at : at + 20_000]])
    return out


def _candidates(cid: np.ndarray, v: np.ndarray, group: int, k: int, least: float, mine: np.ndarray | None, theirs: np.ndarray | None) -> list[np.ndarray]:
    """Best ``k`` candidates of every row and all that tie with the last of them, by exact cosine: arrays (a, b, cosine).

    ``mine`` and ``theirs`` mark the two blocks of a split shard: then only pairs between them count.
    """
    n, dim = v.shape
    u = _unit(v)
    f = u.astype(np.float32)
    rng = np.random.default_rng([_SEED, group])
    plans = perturbations(FUNCTIONS, PROBES)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    held, room = 0, 4_000_000 + 2 * k * n

    def best(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        if not parts:
            return np.array([], np.int64), np.array([])
        pair, at = np.unique(np.concatenate([p[0] for p in parts]), return_index=True)
        cos = np.concatenate([p[1] for p in parts])[at]
        i = pair // n
        order = np.lexsort((-cos, i))
        pair, cos, i = pair[order], cos[order], i[order]
        first = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]])) if i.size else np.array([], np.int64)
        sizes = np.diff(np.append(first, i.size))
        last = cos[first + np.minimum(sizes, k) - 1] if i.size else cos
        keep = cos >= np.repeat(last, sizes)
        return pair[keep], cos[keep]

    for _ in range(GROUP_TABLES):
        a = rng.normal(size=(dim, FUNCTIONS)).astype(np.float32)
        b = rng.uniform(0, WIDTH, FUNCTIONS).astype(np.float32)
        mix = rng.integers(1, 2**62, FUNCTIONS).astype(np.int64) * 2 + 1
        x = (f @ a + b) / np.float32(WIDTH)
        h = np.floor(x)
        part = x - h
        base = (h.astype(np.int64) * mix).sum(axis=1)
        near = np.concatenate([part, 1 - part], axis=1)
        order = np.argsort(near, axis=1)
        moves = np.where(order < FUNCTIONS, -1, 1) * mix[order % FUNCTIONS]
        sort = np.argsort(base)
        table = base[sort]
        for ranks in ((), *plans):
            key = base + moves[:, list(ranks)].sum(axis=1) if ranks else base
            lo, hi = np.searchsorted(table, key, "left"), np.searchsorted(table, key, "right")
            count = hi - lo
            # In slices, so that candidates in memory stay bounded however full the buckets are.
            ends = np.cumsum(count)
            start = 0
            while start < n:
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + 2_000_000, "right")))
                c = count[start:stop]
                total = int(c.sum())
                if total:
                    i = np.repeat(np.arange(start, start + c.size), c)
                    j = sort[np.arange(total) - np.repeat(np.cumsum(c) - c, c) + np.repeat(lo[start:stop], c)]
                    ok = i != j
                    if mine is not None:
                        ok &= (mine[i] & theirs[j]) | (theirs[i] & mine[j])
                    i, j = i[ok], j[ok]
                    ok = np.einsum("ij,ij->i", f[i], f[j]) >= least - SLACK
                    i, j = i[ok], j[ok]
                    cos = _exact(u, i, u, j)
                    ok = cos >= least
                    i, j, cos = i[ok], j[ok], cos[ok]
                    # A probe that met is evidence for both.
                    found += [(i * n + j, cos), (j * n + i, cos)]
                    held += 2 * i.size
                    if held > room:
                        found = [best(found)]
                        held = found[0][0].size
                        room = 4_000_000 + max(2 * k * n, 2 * held)
                start = stop
    pair, cos = best(found)
    return [cid[pair // n], cid[pair % n], cos]


def _pair_shards(batches: Iterator[pa.RecordBatch], k: int, least: float, block_rows: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard -> candidates (block -1), and the rows of shards that are too large, with their block."""
    held: list[tuple] = []
    shard, rows, spilled = None, 0, 0

    def columns(parts):
        cid = np.concatenate([p[0] for p in parts])
        q = np.concatenate([p[1] for p in parts])
        keep = np.unique(cid, return_index=True)[1]  # copies from several tasks
        return cid[keep], q[keep]

    def out(block, a, b, cosine=None, q=None):
        empty = pa.array(q, pa.binary()) if q is not None else pa.nulls(len(a), pa.binary())
        cosine = pa.array(cosine, pa.float64()) if cosine is not None else pa.nulls(len(a), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), cosine, empty], names=["block", "a", "b", "cosine", "q"])

    def spill():
        nonlocal spilled, held, rows
        cid, q = columns(held)
        batch = out(np.full(cid.size, spilled), cid, np.full(cid.size, shard), q=[x.tobytes() for x in q])
        spilled, held, rows = spilled + 1, [], 0
        return batch

    def finish():
        nonlocal held, rows
        cid, q = columns(held)
        held, rows = [], 0
        if cid.size < 2:
            return None
        a, b, cosine = _candidates(cid, q, int(shard) % 1024, k, least, None, None)
        return out(np.full(a.size, -1), a, b, cosine)

    for batch in batches:
        s, cid = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not s.size:
            continue
        dim = len(batch.column(2)[0].as_py()) // 4
        q = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.float32).reshape(-1, dim)
        cuts = np.concatenate([[0], np.flatnonzero(s[1:] != s[:-1]) + 1, [s.size]])
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if shard is not None and s[lo] != shard:
                if held:
                    done = spill() if spilled else finish()
                    if done is not None:
                        yield done
                spilled = 0
            shard = s[lo]
            held.append((cid[lo:hi], q[lo:hi]))
            rows += hi - lo
            if rows >= block_rows:
                yield spill()
    if held:
        done = spill() if spilled else finish()
        if done is not None:
            yield done


def _pair_block(table: pa.Table, k: int, least: float) -> pa.Table:
    lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
    shard = table.column("shard")[0].as_py()
    block, cid = table.column("block").to_numpy(), table.column("a").to_numpy()
    rows = table.column("q").to_pylist()
    q = np.frombuffer(b"".join(rows), dtype=np.float32).reshape(len(rows), -1)
    a, b, cosine = _candidates(cid, q, int(shard) % 1024, k, least, block == lo, block == hi)
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "cosine": pa.array(cosine, pa.float64())})


def _blocked(large: DataFrame, k: int, least: float) -> DataFrame:
    tops = large.groupBy(F.col("b").alias("shard")).agg(F.max("block").alias("top"))
    rows = large.withColumnRenamed("b", "shard").join(tops, "shard")
    rows = rows.select("shard", "a", "block", "q", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("top"))).alias("other"))
    rows = rows.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
    return rows.groupBy("shard", "lo", "hi").applyInArrow(lambda t: _pair_block(t, k, least), "a bigint, b bigint, cosine double")


def nearest(
    vectors: DataFrame, k: int = 5, min_cosine: float = 0.9, ident: str = "memory_id", vector: str = "embedding", dim: int = 64, block_rows: int = BLOCK_ROWS,
    as_of: int | None = None,
) -> DataFrame:
    """``(id, other, cosine, rank)``: of every usable vector, the up to ``k`` most similar others with ``min_cosine`` or more.

    A vector is usable if it has ``dim`` elements, all finite, not all zero. Rows repeated under one
    id count once. Equal cosines are ordered by id. Neighbours are found with ``expected_recall``,
    which falls slowly as the collection grows; cosines are exact. Copies of a vector are each
    other's neighbours. Null ids take no part; an empty table gives no rows. ``as_of`` gives the
    prefix of a collection of so many rows, to see on a small one what a large one costs and finds.
    """
    named = vectors.select(F.col(ident).alias("id"), F.col(vector).cast("array<float>").alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    kind = named.schema["id"].dataType.simpleString()
    read = named.mapInArrow(functools.partial(_read, dim=dim), f"id {kind}, cid bigint, v array<float>")
    firsts = read.where(F.col("v").isNotNull()).select("cid", "v")
    groups, prefix = GROUPS, prefix_length(as_of or named.count())
    parts = default_parallelism(vectors)
    shards = firsts.mapInArrow(functools.partial(_to_shards, dim=dim, groups=groups, prefix=prefix), "shard bigint, cid bigint, q binary")
    met = (
        shards.repartition(parts, "shard")
        .sortWithinPartitions("shard")
        .mapInArrow(functools.partial(_pair_shards, k=k, least=min_cosine, block_rows=block_rows), "block bigint, a bigint, b bigint, cosine double, q binary")
    )
    met = stored(met, "met")
    links = met.where(F.col("block") < 0).select("a", "b", "cosine")
    large = met.where(F.col("block") >= 0)
    if not large.isEmpty():
        links = links.unionByName(_blocked(large, k, min_cosine))
    # A pair met in one shard may be among the best of one side only; it counts for both.
    directed = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "cosine")).groupBy("a", "b").agg(F.max("cosine").alias("cosine"))
    # All that tie with the k-th class go on: which of them counts is decided by the ids below.
    best = Window.partitionBy("a").orderBy(F.desc("cosine"))
    directed = directed.withColumn("n", F.rank().over(best)).where(F.col("n") <= k).drop("n")
    # Of a class of copies only its k + 1 smallest ids can be among the first k of anything.
    ids = read.select("id", "cid").distinct()
    few = ids.withColumn("n", F.row_number().over(Window.partitionBy("cid").orderBy("id"))).where(F.col("n") <= k + 1).drop("n")
    shared = few.groupBy("cid").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select(F.col("cid").alias("a"), F.col("cid").alias("b"), F.lit(1.0).alias("cosine"))
    offers = directed.unionByName(shared).join(few.select(F.col("cid").alias("b"), F.col("id").alias("other")), "b")
    near = ids.select(F.col("cid").alias("a"), "id").join(offers, "a").where(F.col("id") != F.col("other"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "other"))
    return near.select("id", "other", "cosine", rank.alias("rank")).where(F.col("rank") <= k)


def similar_pairs(vectors: DataFrame, k: int = 5, min_cosine: float = 0.9, ident: str = "memory_id", **more) -> DataFrame:
    """``(a, b)``, a < b: pairs of at least ``min_cosine`` where one is among the ``k`` most similar of the other."""
    near = nearest(vectors, k, min_cosine, ident, **more)
    return near.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def _exact_block(batches: Iterator[pa.RecordBatch], queries, k: int, dim: int) -> Iterator[pa.RecordBatch]:
    """Of a task's rows the ``k`` nearest others of every query, equal cosines by id: exactly what can be among the first of all."""
    ids, unit = queries.value
    names = np.array(ids, dtype=object)
    small = unit.astype(np.float32)
    # The k-th cosine so far of every query; nothing below it can be among the first.
    bound = np.full(names.size, -2.0, np.float32)
    held: pa.Table | None = None

    def first(t: pa.Table) -> pa.Table:
        t = t.sort_by([("q", "ascending"), ("cosine", "descending"), ("other", "ascending")])
        q = t.column("q").to_numpy()
        start = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if q.size else q
        rank = np.arange(q.size) - np.repeat(start, np.diff(np.append(start, q.size)))
        last = rank == k - 1
        bound[q[last]] = t.column("cosine").to_numpy()[last]
        return t.filter(pa.array(rank < k))

    for batch in batches:
        rows, v = _usable(batch.column(1), dim)
        if not rows.size or not names.size:
            continue
        w = _unit(v)
        near = np.ascontiguousarray(w.astype(np.float32).T)
        other = batch.column(0).take(pa.array(rows))
        own = np.array(other.to_pylist(), dtype=object)
        head = min(rows.size, 1024)
        step = max(1, 2_000_000 // rows.size)
        parts = [] if held is None else [held]
        for lo in range(0, names.size, step):
            cos = small[lo : lo + step] @ near
            least = bound[lo : lo + step]
            if held is None:
                # One place more, for the query itself. The head's k-th bounds the batch's from below.
                top = min(k + 1, head)
                least = np.partition(cos[:, :head], head - top, axis=1)[:, head - top]
            at = np.flatnonzero(cos >= (least - np.float32(2 * SLACK))[:, None])
            q, j = at // rows.size + lo, at % rows.size
            ok = names[q] != own[j]
            q, j = q[ok], j[ok]
            parts.append(first(pa.table({"q": pa.array(q), "other": other.take(pa.array(j)), "cosine": pa.array(_exact(unit, q, w, j))})))
        held = first(pa.concat_tables(parts).combine_chunks())
    if held is not None and held.num_rows:
        asked = pa.array(names, held.schema.field("other").type).take(held.column("q").combine_chunks())
        for part in pa.table({"id": asked, "other": held.column("other"), "cosine": held.column("cosine")}).to_batches(10_000):
            yield part


def _one_each(vectors: DataFrame, ident: str, vector: str, dim: int) -> DataFrame:
    """``(id, v)``: the usable vectors, one of each id."""
    named = vectors.select(F.col(ident).alias("id"), F.col(vector).cast("array<float>").alias("v")).where(F.col("id").isNotNull())
    broken = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return named.where((F.size("v") == dim) & ~broken & F.exists("v", lambda x: x != 0)).dropDuplicates(["id"])


def nearest_exact(
    vectors: DataFrame, queries: DataFrame, k: int = 5, ident: str = "memory_id", vector: str = "embedding", dim: int = 64, block: int = 20_000
) -> DataFrame:
    """``(id, other, cosine, rank)`` of a stated query set against all rows, by blocks of queries: exact at any similarity.

    For what hashing cannot reach: the nearest of a vector that has no similar one. ``queries`` has
    the columns of ``vectors``; it is read in blocks of at most ``block`` rows, each broadcast.
    """
    one = _one_each(vectors, ident, vector, dim)
    kind = one.schema["id"].dataType.simpleString()
    # Of a class of copies only its k + 1 smallest ids can be among the first k of anything.
    copies = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    src = stored(one.withColumn("n", copies).where(F.col("n") <= k + 1).select("id", "v"), "src")
    asked = stored(_one_each(queries, ident, vector, dim), "asked")
    blocks = max(1, -(-asked.count() // (block // 2)))
    # With many blocks of queries a task reads more of the rows, so that it hands on its best once and not once per small part.
    # Never one: a union of single partitions would be a single task.
    src = src.coalesce(max(2, -(-default_parallelism(vectors) // blocks)))
    result = None
    for n in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == n).toArrow()
        usable, v = _usable(rows.column("v").combine_chunks(), dim)
        ids = rows.column("id").take(pa.array(usable)).to_pylist()
        shared = vectors.sparkSession.sparkContext.broadcast((ids, _unit(v) if len(ids) else v))
        part = src.mapInArrow(functools.partial(_exact_block, queries=shared, k=k, dim=dim), f"id {kind}, other {kind}, cosine double")
        result = part if result is None else result.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "other"))
    return result.select("id", "other", "cosine", rank.alias("rank")).where(F.col("rank") <= k)


def nearest_of_all(
    vectors: DataFrame, k: int = 5, min_cosine: float = 0.9, ident: str = "memory_id", vector: str = "embedding", dim: int = 64, **more
) -> DataFrame:
    """``(id, other, cosine, rank)``: of every usable vector the ``k`` most similar others, at any similarity.

    Vectors with ``k`` neighbours at ``min_cosine`` get them from ``nearest``. The rest are asked of
    all rows by ``nearest_exact``, which costs their number times the number of rows.
    """
    near = stored(nearest(vectors, k, min_cosine, ident, vector, dim, **more), "near")
    full = near.where(F.col("rank") == k).select("id")
    rest = vectors.join(full.withColumnRenamed("id", ident), ident, "left_anti")
    return near.join(full, "id", "left_semi").unionByName(nearest_exact(vectors, rest, k, ident, vector, dim))
