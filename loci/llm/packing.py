"""Filling containers of fixed capacity with texts measured in tokens, by best-two-fit.

Sizes come from a public tokenizer. Rows of sizes are dealt over shards; each shard packs its own
containers, so no task sees more than a shard and every shard leaves at most a few open containers.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts a shard packs, on average. Larger shards fill containers better, smaller ones spread better.
SHARD_ITEMS = 16_384
#: Bits of a container id for its number within the shard.
SHARD_BITS = 32
TOKENIZER_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-tokenisation of the byte-level vocabulary; a fixed value of the tokenizer files.
TOKEN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.cache
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("loci", pat_str=TOKEN_PATTERN, mergeable_ranks=ranks, special_tokens={})


def _count_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    from loci.llm.packing import _encoding as encoding  # cached per worker process

    enc = encoding(path)
    for batch in batches:
        sizes = [0 if t is None else len(enc.encode_ordinary(t)) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["id", "n_tokens"])


def token_counts(docs: DataFrame, ident: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER_PATH) -> DataFrame:
    """``(id, n_tokens)`` of every row, over the whole text. Null and empty texts have 0 tokens."""
    src = docs.select(F.col(ident).alias("id"), F.col(text).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(functools.partial(_count_batches, path=tokenizer), f"id {kind}, n_tokens bigint")


def best_two_fit(sizes: Sequence[int], capacity: int) -> list[list[int]]:
    """Indices of ``sizes`` per bin. Every size must be in 1..capacity; ties go to the earlier index.

    A bin is filled greedily with the largest size that still fits. If a gap is left, its smallest
    item is taken out whenever two unpacked items together fit the expanded gap more tightly.
    """
    stacks: dict[int, list[int]] = {}
    for i in range(len(sizes) - 1, -1, -1):
        stacks.setdefault(int(sizes[i]), []).append(i)
    left = np.zeros(capacity + 1, dtype=np.int64)
    for s, items in stacks.items():
        left[s] = len(items)
    live = np.flatnonzero(left)  # sizes still there, ascending
    bins: list[list[int]] = []
    rest = len(sizes)

    def take(size: int) -> int:
        nonlocal live, rest
        left[size] -= 1
        rest -= 1
        if not left[size]:
            live = live[live != size]
        return stacks[size].pop()

    def give_back(size: int, item: int) -> None:
        nonlocal live, rest
        stacks[size].append(item)
        if not left[size]:
            live = np.insert(live, np.searchsorted(live, size), size)
        left[size] += 1
        rest += 1

    while rest:
        filled: list[tuple[int, int]] = []
        gap = capacity
        while gap and live.size and live[0] <= gap:
            size = int(live[np.searchsorted(live, gap, side="right") - 1])
            filled.append((size, take(size)))
            gap -= size
        if gap and live.size:
            k = min(range(len(filled)), key=lambda j: filled[j][0])
            small, item = filled[k]
            room = small + gap
            # For each first size, the largest second size that still fits beside it.
            second = np.searchsorted(live, room - live, side="right") - 1
            ok = (second >= 0) & (live <= room)
            b = np.where(ok, live[np.maximum(second, 0)], 0)
            single = (b == live) & (left[live] < 2)
            second = np.where(single, second - 1, second)
            ok &= second >= 0
            total = np.where(ok, live + live[np.maximum(second, 0)], 0)
            best = int(np.argmax(total)) if total.size else 0
            if total.size and total[best] > small:
                pair = (int(live[best]), int(total[best] - live[best]))
                filled.pop(k)
                new = [(s, take(s)) for s in pair]
                give_back(small, item)
                filled.extend(new)
        bins.append([i for _, i in filled])
    return bins


def _pack_shard(table: pa.Table) -> pa.Table:
    rows = table.sort_by([("rest", "descending"), ("id", "ascending")])
    capacity = rows.column("capacity")[0].as_py()
    shard = rows.column("shard")[0].as_py()
    n = rows.num_rows
    bins = best_two_fit(rows.column("rest").to_pylist(), capacity)
    container = np.empty(n, dtype=np.int64)
    for k, members in enumerate(bins):
        container[members] = k
    full = rows.column("parts").to_numpy() - 1
    # The rest of every item, then the full parts of divided items, each a container of its own.
    source = np.concatenate([np.arange(n), np.repeat(np.arange(n), full)])
    ends = np.cumsum(full)
    within = np.arange(int(full.sum())) - np.repeat(ends - full, full) + 1
    part_no = np.concatenate([full + 1, within])
    container = np.concatenate([container, len(bins) + np.arange(int(full.sum()))])
    tokens = np.concatenate([rows.column("rest").to_numpy(), np.full(int(full.sum()), capacity)])
    out = rows.select(["budget_id", "capacity", "id", "parts"]).take(pa.array(source))
    return pa.table({
        "budget_id": out.column("budget_id"), "capacity": out.column("capacity"),
        "container_id": pa.array((np.int64(shard) << SHARD_BITS) + container), "id": out.column("id"),
        "part_no": pa.array(part_no), "parts": out.column("parts"), "n_tokens": pa.array(tokens),
    })


def pack(
    sizes: DataFrame, budgets: Sequence[tuple[int, int]], count_of: DataFrame | None = None, shard_items: int = SHARD_ITEMS
) -> DataFrame:
    """Assign every item of ``sizes(id, n_tokens)`` to containers of each ``(budget_id, capacity)``.

    Result: ``(budget_id, capacity, container_id, id, part_no, parts, n_tokens)``, one row per part.
    Only an item above the capacity is divided: into full containers and one rest, which is packed
    like an item. Items of 0 or null tokens need no container and are left out; repeated rows are
    items of their own. ``container_id`` is unique within a budget. Capacities must be positive.
    ``count_of`` has as many rows as ``sizes`` but is cheap to count; it sets the number of shards.
    An empty table gives no rows.
    """
    if any(c < 1 for _, c in budgets):
        raise ValueError("capacities must be positive")
    kind = sizes.schema["id"].dataType.simpleString()
    counted = sizes if count_of is None else count_of
    # A scalar subquery, so the plan stays lazy.
    shards = counted.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / F.lit(float(shard_items)))).cast("bigint")).scalar()
    each = F.explode(F.array(*[F.struct(F.lit(b).cast("int").alias("budget_id"), F.lit(c).cast("bigint").alias("capacity")) for b, c in budgets]))
    items = (
        sizes.where(F.col("n_tokens") > 0)
        .select("id", F.col("n_tokens").cast("bigint").alias("n_tokens"), each.alias("b"))
        .select("id", "n_tokens", "b.budget_id", "b.capacity")
        .withColumn("parts", F.ceil(F.col("n_tokens") / F.col("capacity")).cast("bigint"))
        .withColumn("rest", F.col("n_tokens") - (F.col("parts") - 1) * F.col("capacity"))
        .withColumn("shard", F.pmod(F.xxhash64("id"), shards).cast("bigint"))
        .drop("n_tokens")
    )
    out = f"budget_id int, capacity bigint, container_id bigint, id {kind}, part_no bigint, parts bigint, n_tokens bigint"
    return items.groupBy("budget_id", "shard").applyInArrow(_pack_shard, out)


def fill_report(packed: DataFrame) -> DataFrame:
    """``(budget_id, capacity, containers, tokens, fill)``: share of the containers' room that is used."""
    per = packed.groupBy("budget_id", "capacity", "container_id").agg(F.sum("n_tokens").alias("used"))
    return per.groupBy("budget_id", "capacity").agg(
        F.count(F.lit(1)).alias("containers"),
        F.sum("used").alias("tokens"),
        (F.sum("used") / (F.count(F.lit(1)) * F.first("capacity"))).alias("fill"),
    )
