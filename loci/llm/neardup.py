"""Near-duplicate texts by a MinHash LSH forest, verified exactly on their word sets.

A forest of prefix tries over min-hash labels. The first level of its tries is shared: a record goes
to one node for each of a few root functions, so it moves a fixed number of times however large the
collection is. A node that would not fit into one task is split a level deeper. Inside a node the
labels of further tries are sorted; every record starts from its full label in a trie and its matched
prefix is shortened while the run of records that share it stays small, so the depth follows the
data: short in sparse places, long in crowded ones. A record takes part in one trie after the other
until the depths it matched at give a pair at the threshold the target recall. Records whose full
labels are crowded are compared with each other directly. What meets is filtered by 64 one-byte
min-hashes and then compared word by word. Equal word sets are one class from the start.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loci.llm.words import Hasher, edge_words, run_words
from loci.runtime import checkpointed, default_parallelism, stored

#: Entries of a label, and one-byte min-hashes of a record from which labels and the filter are taken.
LABEL, SKETCH = 8, 64
#: Records that may share a matched prefix; a longer run keeps a longer prefix.
RUN = 16
#: Records of a node that one task holds; a larger node is split a level deeper, then into blocks.
NODE_ROWS = 500_000
#: Records with crowded full labels that are compared in place; more go to other tasks in blocks.
BLOCK_ROWS = 4096
#: Recall inside a node, for pairs at the threshold.
INSIDE = 0.98
_SEED = 20240229
_WORD_BITS = 48


def roots_needed(threshold: float, target: float) -> int:
    """Root functions with which a pair at the threshold shares a node, and is matched there, with the target probability."""
    return max(1, math.ceil(math.log(1 - target) / math.log(1 - threshold * INSIDE)))


def word_set(text: str | None) -> set[str]:
    return set(edge_words(text))


def shingle_set(text: str | None, size: int = 5) -> set[str]:
    """Runs of ``size`` successive words; a shorter text is one shingle."""
    w = run_words(text)
    return {" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def _functions(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([_SEED, seed])
    return rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def _minhash(flat: np.ndarray, starts: np.ndarray, seed: int, n: int) -> np.ndarray:
    """min-hashes (records x functions), each the upper half of a multiply-add hash of 48-bit words."""
    a, b = _functions(seed, n)
    out = np.empty((starts.size, n), dtype=np.uint32)
    if starts.size:
        for j in range(n):
            out[:, j] = np.minimum.reduceat((flat * a[j] + b[j]) >> np.uint64(32), starts)
    return out


def _node_keys(mins: np.ndarray, above: np.ndarray | int) -> np.ndarray:
    """Keys of the nodes below ``above`` that min-hashes lead to, a column for each function."""
    key = mins.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, mins.shape[1] + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    key ^= np.asarray(above, dtype=np.int64).view(np.uint64).reshape(-1, 1) * np.uint64(0xD6E8FEB86659FD93)
    key ^= key >> np.uint64(29)
    key *= np.uint64(0xBF58476D1CE4E5B9)
    return (key ^ (key >> np.uint64(32))).view(np.int64)


def _records(batches: Iterator[pa.RecordBatch], elements, least: int):
    """Of each batch: row numbers, class keys k1 and k2, the flat sorted words and their offsets."""
    hasher, mask = Hasher(), (1 << 64) - 1
    for batch in batches:
        rows, keys, values = [], [], []
        for i, text in enumerate(batch.column(1).to_pylist()):
            words = elements(text)
            if len(words) < max(1, least):
                continue
            h = np.sort(np.array([hasher[w] for w in words], dtype=np.int64))
            key = xxhash.xxh3_128_intdigest(h.tobytes())
            rows.append(i)
            keys.append((key & mask, key >> 64))
            values.append(h)
        if rows:
            k = np.array(keys, dtype=np.uint64).view(np.int64)
            flat = np.concatenate(values).view(np.uint64) & np.uint64(2**_WORD_BITS - 1)
            yield batch, np.array(rows), k[:, 0], k[:, 1], flat, np.concatenate([[0], np.cumsum([v.size for v in values])])


def _members(batches: Iterator[pa.RecordBatch], elements, least: int, roots: int) -> Iterator[pa.RecordBatch]:
    for batch, rows, k1, k2, flat, at in _records(batches, elements, least):
        keys = _node_keys(_minhash(flat, at[:-1], 0, roots), 0)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, roots), pa.int32()), pa.array(keys.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(k1), pa.array(k2), lists], names=["id", "k1", "k2", "roots"])


def _packed(flat: np.ndarray, at: np.ndarray) -> pa.Array:
    """Words as six bytes each, a binary per record."""
    raw = np.ascontiguousarray(flat).view(np.uint8).reshape(-1, 8)[:, : _WORD_BITS // 8].tobytes()
    return pa.Array.from_buffers(pa.binary(), at.size - 1, [None, pa.array(at * (_WORD_BITS // 8), pa.int32()).buffers()[1], pa.py_buffer(raw)])


def _to_nodes(batches: Iterator[pa.RecordBatch], elements, least: int, roots: int, fan: int, full) -> Iterator[pa.RecordBatch]:
    """A class, once per task, for every node it goes to; below the ``full`` ones it goes to nodes a level deeper."""
    seen: set[tuple[int, int]] = set()
    full = full.value
    for _, _, k1, k2, flat, at in _records(batches, elements, least):
        fresh = []
        for n, key in enumerate(zip(k1.tolist(), k2.tolist(), strict=True)):
            if key not in seen:
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(key)
                fresh.append(n)
        if not fresh:
            continue
        fresh = np.array(fresh)
        packed = _packed(flat, at)
        keys = _node_keys(_minhash(flat, at[:-1], 0, roots), 0)[fresh]
        below = None
        for r in range(roots):
            over = np.isin(keys[:, r], full)
            parts = [(keys[~over, r], fresh[~over])]
            if over.any():
                below = _minhash(flat, at[:-1], 1, fan)[fresh] if below is None else below
                deeper = _node_keys(below[over], keys[over, r])
                parts += [(deeper[:, f], fresh[over]) for f in range(fan)]
            for node, rows in parts:
                if node.size:
                    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(k1[rows]), pa.array(k2[rows]), packed.take(pa.array(rows))], names=["node", "k1", "k2", "words"])


def sketch_cut(threshold: float) -> int:
    """Fewest equal one-byte entries a pair at the threshold shows but once in a thousand cases."""
    p = threshold + (1 - threshold) / 256
    return math.floor(SKETCH * p - 3.1 * math.sqrt(SKETCH * p * (1 - p)))


class Node:
    """The records of complete nodes, and their matching. ``side`` marks the two blocks of a split node: then only pairs across count."""

    def __init__(self, node: np.ndarray, words: list[bytes], threshold: float, spanning: bool, side: np.ndarray | None = None) -> None:
        width = _WORD_BITS // 8
        self.node, self.threshold, self.spanning, self.side = node, threshold, spanning, side
        self.sizes = np.array([len(w) // width for w in words], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])[:-1]
        wide = np.zeros((int(self.sizes.sum()), 8), np.uint8)
        wide[:, :width] = np.frombuffer(b"".join(words), np.uint8).reshape(-1, width)
        self.flat = wide.view(np.uint64).ravel()
        self.sketch = np.empty((node.size, SKETCH), np.uint8)
        for lo in range(0, node.size, 20_000):  # in slices, so that memory stays bounded
            part = self.starts[lo : lo + 20_000]
            end = part[-1] + self.sizes[lo + part.size - 1]
            self.sketch[lo : lo + 20_000] = _minhash(self.flat[part[0] : end], part - part[0], 2, SKETCH) & np.uint32(255)
        self.cut = sketch_cut(threshold)
        self.parent = list(range(node.size)) if spanning else None
        self.comp = np.arange(node.size) if spanning else None
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.crowd: np.ndarray | None = None

    def _shared(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common words of the records, pair by pair."""
        out = np.empty(i.size, np.int64)
        total = np.cumsum(self.sizes[i] + self.sizes[j])
        lo = 0
        while lo < i.size:
            hi = min(lo + 65_536, max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + 4_000_000, "right"))))
            keys = []
            for rows in (i[lo:hi], j[lo:hi]):
                n = self.sizes[rows]
                pick = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.starts[rows], n)
                keys.append((np.repeat(np.arange(rows.size, dtype=np.uint64), n) << np.uint64(_WORD_BITS)) | self.flat[pick])
            both = np.sort(np.concatenate(keys))
            twice = both[1:][both[1:] == both[:-1]] >> np.uint64(_WORD_BITS)
            out[lo:hi] = np.bincount(twice.astype(np.int64), minlength=hi - lo)
            lo = hi
        return out

    def _offer(self, i: np.ndarray, j: np.ndarray) -> None:
        """Keep the pairs at or above the threshold; those that are joined already, or of one side, are left out."""
        if self.side is not None:
            ok = self.side[i] != self.side[j]
            i, j = i[ok], j[ok]
        if self.spanning:
            ok = self.comp[i] != self.comp[j]
            i, j = i[ok], j[ok]
        for lo in range(0, i.size, 500_000):
            a, b = i[lo : lo + 500_000], j[lo : lo + 500_000]
            ok = (self.sketch[a, :8] == self.sketch[b, :8]).sum(axis=1) >= 2
            a, b = a[ok], b[ok]
            ok = (self.sketch[a] == self.sketch[b]).sum(axis=1) >= self.cut
            a, b = a[ok], b[ok]
            if not a.size:
                continue
            pair = np.unique(np.minimum(a, b) * self.node.size + np.maximum(a, b))
            a, b = pair // self.node.size, pair % self.node.size
            shared = self._shared(a, b)
            similarity = shared / (self.sizes[a] + self.sizes[b] - shared)
            ok = similarity >= self.threshold
            a, b, similarity = a[ok], b[ok], similarity[ok]
            if self.spanning:
                new = np.array([self._join(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True)], dtype=bool)
                a, b, similarity = a[new], b[new], similarity[new]
            if a.size:
                self.found.append((a, b, similarity))

    def _root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def _join(self, x: int, y: int) -> bool:
        x, y = self._root(x), self._root(y)
        self.parent[max(x, y)] = min(x, y)
        return x != y

    def _refresh(self) -> None:
        if self.spanning:
            self.comp = np.array(self.parent)
            while not np.array_equal(up := self.comp[self.comp], self.comp):
                self.comp = up

    def _flush(self, held: list[tuple[np.ndarray, np.ndarray]]) -> None:
        if held:
            self._offer(*(np.concatenate(x) for x in zip(*held, strict=True)))
            self._refresh()
            held.clear()

    def _all_pairs(self, rows: np.ndarray) -> None:
        """Pairs of every two of ``rows`` (in order) that are in one node."""
        if not rows.size:
            return
        node = self.node[rows]
        at, step, held, size = np.arange(rows.size), 1, [], 0
        first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        length = np.diff(np.append(first, rows.size))
        while (at := at[at + step < rows.size]).size and (at := at[node[at] == node[at + step]]).size:
            held.append((rows[at], rows[at + step]))
            size += at.size
            if size > 500_000 or self.spanning and step < 4:
                self._flush(held)
                size = 0
                if self.spanning:
                    # Nothing is left to join in a node whose records are joined.
                    comp = self.comp[rows]
                    done = np.repeat(np.minimum.reduceat(comp, first) == np.maximum.reduceat(comp, first), length)
                    at = at[~done[at]]
            step += 1
        self._flush(held)

    def match(self, block_rows: int | None = None) -> None:
        """Find the pairs; ``crowd`` holds the rows that are to be compared in blocks elsewhere, if there are more than ``block_rows``."""
        opens = np.flatnonzero(np.concatenate([[True], self.node[1:] != self.node[:-1]]))
        size = np.diff(np.append(opens, self.node.size))
        size = np.repeat(size, size)
        # Where the whole node is a short run, the prefix is shortened to the node itself.
        self._all_pairs(np.flatnonzero((size > 1) & (size <= RUN)))
        active = size > RUN
        miss = np.ones(self.node.size)
        tree = 0
        while active.any():
            rows = np.flatnonzero(np.isin(self.node, np.unique(self.node[active])))
            entries = np.random.default_rng([_SEED, 3, tree]).permutation(SKETCH)[:LABEL]
            label = np.ascontiguousarray(self.sketch[rows][:, entries]).view(">u8").ravel().astype(np.uint64)
            order = np.lexsort((label, self.node[rows]))
            rows, label = rows[order], label[order]
            n = rows.size
            first = np.concatenate([[True], self.node[rows][1:] != self.node[rows][:-1]])
            differ = np.concatenate([[np.uint64(0)], label[1:] ^ label[:-1]])
            for d in range(LABEL, 0, -1):
                opens = np.flatnonzero(first | ((differ >> np.uint64(8 * (LABEL - d))) != 0))
                length = np.diff(np.append(opens, n))
                begin, long = np.repeat(opens, length), np.repeat(length, length)
                if d == LABEL:
                    depth, lo, hi, crowded = np.full(n, LABEL), begin, begin + long, long > RUN
                else:
                    ok = (long <= RUN) & (depth == d + 1)
                    depth[ok], lo[ok], hi[ok] = d, begin[ok], (begin + long)[ok]
            if tree == 0 and crowded.any():
                # More records than a run holds agree in a full label: these are compared with each other directly.
                crowd = np.sort(rows[crowded])
                if block_rows is not None and crowd.size > block_rows and not self.spanning:
                    self.crowd = crowd
                else:
                    self._all_pairs(crowd)
                active[crowd] = False
            on = active[rows]
            at, step, held, held_rows = np.arange(n), 1, [], 0
            while (at := at[at + step < n]).size:
                right = at + step
                if step < RUN:
                    meet = (right < hi[at]) & on[at] | (at >= lo[right]) & on[right]
                    held.append((rows[at[meet]], rows[right[meet]]))
                else:  # only runs of full labels are longer
                    at = at[right < hi[at]]
                    meet = on[at] | on[at + step]
                    held.append((rows[at[meet]], rows[at[meet] + step]))
                held_rows += held[-1][0].size
                if held_rows > 1_000_000:
                    self._flush(held)
                    held_rows = 0
                step += 1
            self._flush(held)
            miss[rows] *= 1 - self.threshold**depth
            active &= miss > 1 - INSIDE
            tree += 1

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.found:
            return np.array([], np.int64), np.array([], np.int64), np.array([])
        a, b, s = (np.concatenate(x) for x in zip(*self.found, strict=True))
        _, at = np.unique(a * self.node.size + b, return_index=True)
        return a[at], b[at], s[at]


_MET = "block bigint, node bigint, a1 bigint, a2 bigint, b1 bigint, b2 bigint, similarity double, words binary"


def _pair_nodes(batches: Iterator[pa.RecordBatch], threshold: float, spanning: bool, node_rows: int, block_rows: int, chunk: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Rows sorted by node -> verified pairs (block -1), and the rows that other tasks compare block by block."""
    names = [f.split()[0] for f in _MET.split(", ")]

    def out(block, node, a1, a2, b1=None, b2=None, similarity=None, words=None):
        n = len(a1)
        made = [pa.array(block, pa.int64()), pa.array(node, pa.int64()), pa.array(a1, pa.int64()), pa.array(a2, pa.int64())]
        made += [pa.array(x, pa.int64()) if x is not None else pa.nulls(n, pa.int64()) for x in (b1, b2)]
        made += [pa.array(similarity, pa.float64()) if similarity is not None else pa.nulls(n, pa.float64()), pa.array(words, pa.binary()) if words is not None else pa.nulls(n, pa.binary())]
        return pa.RecordBatch.from_arrays(made, names=names)

    def matched(table: pa.Table) -> Iterator[pa.RecordBatch]:
        node, k1, k2 = (table.column(c).to_numpy() for c in ("node", "k1", "k2"))
        order = np.lexsort((k2, k1, node))
        same = (np.diff(node[order]) == 0) & (np.diff(k1[order]) == 0) & (np.diff(k2[order]) == 0)
        keep = order[np.concatenate([[True], ~same])]  # copies of a class from several tasks
        size = np.diff(np.flatnonzero(np.concatenate([[True], np.diff(node[keep]) != 0, [True]])))
        keep = keep[np.repeat(size > 1, size)]
        if not keep.size:
            return
        node, k1, k2 = node[keep], k1[keep], k2[keep]
        words = table.column("words").take(pa.array(keep)).to_pylist()
        group = Node(node, words, threshold, spanning)
        group.match(block_rows)
        a, b, s = group.pairs()
        if a.size:
            yield out(np.full(a.size, -1), node[a], k1[a], k2[a], k1[b], k2[b], s)
        if group.crowd is not None:
            c = group.crowd
            yield out(np.arange(c.size) // (block_rows // 2), node[c] ^ 1, k1[c], k2[c], words=[words[x] for x in c])

    pending: list[pa.Table] = []  # complete nodes
    tail: list[pa.Table] = []  # the rows of the node that may go on
    current, blocks = None, 0

    def rows(parts: list[pa.Table]) -> int:
        return sum(t.num_rows for t in parts)

    def as_block(parts: list[pa.Table]) -> pa.RecordBatch:
        t = pa.concat_tables(parts).combine_chunks()
        return out(np.full(t.num_rows, blocks), t["node"].to_numpy(), t["k1"].to_numpy(), t["k2"].to_numpy(), words=t["words"].to_pylist())

    for batch in batches:
        nodes = batch.column(0).to_numpy()
        if not nodes.size:
            continue
        table = pa.Table.from_batches([batch])
        end = int(np.searchsorted(nodes, current, "right")) if current is not None else 0
        if end:
            tail.append(table.slice(0, end))
        if end < nodes.size:
            if blocks:
                if rows(tail):
                    yield as_block(tail)
            else:
                pending += tail
            last = int(np.searchsorted(nodes, nodes[-1]))
            pending.append(table.slice(end, last - end))
            tail, current, blocks = [table.slice(last)], nodes[-1], 0
        if rows(tail) > node_rows // 2 and (blocks or rows(tail) > node_rows):
            yield as_block(tail)
            tail, blocks = [], blocks + 1
        if rows(pending) >= chunk:
            yield from matched(pa.concat_tables(pending))
            pending = []
    if blocks:
        if rows(tail):
            yield as_block(tail)
    else:
        pending += tail
    if rows(pending):
        yield from matched(pa.concat_tables(pending))


def _pair_blocks(table: pa.Table, threshold: float, spanning: bool) -> pa.Table:
    """Pairs of two blocks of a split node, or of one block."""
    block, k1, k2 = (table.column(c).to_numpy() for c in ("block", "a1", "a2"))
    lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
    keep = np.unique(np.stack([k1, k2]), axis=1, return_index=True)[1]
    side = None if lo == hi else (block == hi)[keep]
    group = Node(np.zeros(keep.size, np.int64), table.column("words").take(pa.array(keep)).to_pylist(), threshold, spanning, side)
    group.match()
    a, b, s = group.pairs()
    k1, k2 = k1[keep], k2[keep]
    return pa.table({"a1": k1[a], "a2": k2[a], "b1": k1[b], "b2": k2[b], "similarity": s})


class NearDuplicates:
    """The stages of one run; all tables are in the shared folder and survive lost executors."""

    def __init__(
        self, records: DataFrame, ident: str, text: str, threshold: float, elements=word_set, least: int = 1, target: float = 0.96, spanning: bool = False,
        node_rows: int = NODE_ROWS, block_rows: int = BLOCK_ROWS,
    ) -> None:
        named = records.select(F.col(ident).alias("id"), F.col(text).alias("text")).where(F.col("id").isNotNull() & F.col("text").isNotNull())
        kind = named.schema["id"].dataType.simpleString()
        roots, fan = roots_needed(threshold, target), roots_needed(threshold, INSIDE)
        # id, its class (k1, k2: 128 bits of its element set), and the nodes of the first level.
        self.members = stored(
            named.mapInArrow(functools.partial(_members, elements=elements, least=least, roots=roots), f"id {kind}, k1 bigint, k2 bigint, roots array<bigint>"), "members"
        )
        # At most ``roots`` nodes for every ``node_rows`` records are over the bound; their keys are all that is collected and broadcast.
        sizes = self.members.select(F.explode("roots").alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n"))
        full = sizes.where(F.col("n") > node_rows).select("node").toArrow().column("node").to_numpy()
        shared = records.sparkSession.sparkContext.broadcast(full)
        send = functools.partial(_to_nodes, elements=elements, least=least, roots=roots, fan=fan, full=shared)
        met = (
            named.mapInArrow(send, "node bigint, k1 bigint, k2 bigint, words binary")
            .repartition(default_parallelism(records), "node")
            .sortWithinPartitions("node")
            .mapInArrow(functools.partial(_pair_nodes, threshold=threshold, spanning=spanning, node_rows=node_rows, block_rows=block_rows), _MET)
        )
        met = stored(met, "met")
        ends = ["a1", "a2", "b1", "b2"]
        pairs = met.where(F.col("block") < 0).select(*ends, "similarity")
        split = met.where(F.col("block") >= 0)
        if not split.isEmpty():
            pairs = pairs.unionByName(self._of_blocks(split, threshold, spanning))
        # A pair met in several nodes, and from either end.
        turned = (F.col("a1") > F.col("b1")) | ((F.col("a1") == F.col("b1")) & (F.col("a2") > F.col("b2")))
        first = [F.when(turned, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in zip(ends, ["b1", "b2", "a1", "a2"], strict=True)]
        self.links = pairs.select(*first, "similarity").groupBy(*ends).agg(F.max("similarity").alias("similarity"))

    @staticmethod
    def _of_blocks(split: DataFrame, threshold: float, spanning: bool) -> DataFrame:
        """Every pair of blocks of a split node is a task of its own."""
        tops = split.groupBy("node").agg(F.max("block").alias("top"))
        other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("top")))
        rows = split.select("node", "block", "a1", "a2", "words").join(tops, "node").select("node", "block", "a1", "a2", "words", other.alias("other"))
        rows = rows.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
        return rows.groupBy("node", "lo", "hi").applyInArrow(lambda t: _pair_blocks(t, threshold, spanning), "a1 bigint, a2 bigint, b1 bigint, b2 bigint, similarity double")

    def pairs(self) -> DataFrame:
        """``(id_a, id_b, similarity)``, id_a < id_b: all pairs of records, copies expanded."""
        ids = self.members.select("id", "k1", "k2")
        x = ids.select(F.col("id").alias("x"), F.col("k1").alias("a1"), F.col("k2").alias("a2"))
        y = ids.select(F.col("id").alias("y"), F.col("k1").alias("b1"), F.col("k2").alias("b2"))
        between = self.links.join(x, ["a1", "a2"]).join(y, ["b1", "b2"]).select("x", "y", "similarity")
        same = x.join(y, (F.col("a1") == F.col("b1")) & (F.col("a2") == F.col("b2")) & (F.col("x") < F.col("y")))
        within = same.select("x", "y", F.lit(1.0).alias("similarity"))
        both = between.unionByName(within).where(F.col("x") != F.col("y"))
        return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "similarity").distinct()

    def groups(self) -> DataFrame:
        """``(id, group_id)``: one row per record; ``group_id`` is the smallest id of its component."""
        ids = self.members.select("id", "k1", "k2").distinct()
        names = ids.groupBy("k1", "k2").agg(F.min("id").alias("name"))
        # To the rounds a class is known by a 64-bit hash of its key.
        a = F.xxhash64("a1", "a2").alias("src")
        b = F.xxhash64("b1", "b2").alias("dst")
        roots = components(self.links.select(a, b))
        named = names.withColumn("node", F.xxhash64("k1", "k2")).join(roots, "node", "left").select("k1", "k2", "name", F.coalesce("root", "node").alias("root"))
        per = named.groupBy("root").agg(F.min("name").alias("group_id"))
        return ids.join(named.join(per, "root").select("k1", "k2", "group_id"), ["k1", "k2"]).select("id", "group_id")


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every end of ``edges(src, dst)``: root is the smallest node it is connected with.

    Every node follows the least of its neighbours' roots and then the root of that root, so paths
    halve each round. Minima are combined before the shuffle, and the table of roots is joined as it
    is: a giant component is one value, not one key, and no node's neighbours are gathered.
    """
    links = checkpointed(edges.where("src <> dst").select("src", "dst").unionAll(edges.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    roots = checkpointed(links.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.col("src")).alias("root")))
    while True:
        # What a node's neighbours point at also pulls the node's own root along.
        seen = links.join(roots.select(F.col("node").alias("dst"), "root"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("root").alias("near"))
        best = roots.join(seen, "node").select("node", "root", F.least("root", "near").alias("best"))
        pulled = best.select(F.col("root").alias("node"), "best").unionAll(best.select("node", "best")).groupBy("node").agg(F.min("best").alias("best"))
        # The root of the root; ``pulled`` has every node once, and roots that many nodes share are few keys.
        up = pulled.select(F.col("node").alias("best"), F.col("best").alias("up"))
        after = checkpointed(pulled.join(up, "best", "left").select("node", F.least("best", F.coalesce("up", "best")).alias("root")))
        moved = after.join(roots.select("node", F.col("root").alias("was")), "node").where("root <> was").limit(1).count()
        roots = after
        if not moved:
            return roots


def near_duplicate_pairs(records: DataFrame, ident: str = "id", text: str = "content", threshold: float = 0.8, least: int = 1, **more) -> DataFrame:
    """``(id_a, id_b, similarity)``: pairs of records whose word sets have a Jaccard similarity of ``threshold`` or more.

    Records with fewer than ``least`` different words, those without any, null texts and null ids
    take no part. Equal texts under different ids are pairs; rows repeated under one id count once.
    Other columns are ignored; an empty table gives no rows. Pairs at the threshold are found with a
    probability of ``target`` (0.96 unless given), more similar ones with a higher one; every pair
    found is exact. ``elements`` is the set that is compared: words, or ``shingle_set``.
    """
    return NearDuplicates(records, ident, text, threshold, least=least, **more).pairs()


def near_duplicate_groups(records: DataFrame, ident: str = "id", text: str = "content", threshold: float = 0.8, least: int = 1, **more) -> DataFrame:
    """``(id, group_id)``: one row per record that takes part, as in ``near_duplicate_pairs``; groups are connected by pairs.

    Inside a node only pairs that join what is not yet joined are looked at, so a group of any size
    costs about its records and not their pairs.
    """
    return NearDuplicates(records, ident, text, threshold, least=least, spanning=True, **more).groups()
