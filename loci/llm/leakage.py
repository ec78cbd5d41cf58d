"""Evaluation material inside training text: phrase and proximity search in a positional inverted index.

The index is built once and stored: every row is a shard of documents with its terms in order, their
posting lists (positions in the shard) and the places where its documents begin. Shards are made
where the documents are read, so documents never move, and all lists of a document lie together.
Term counts of the whole corpus come from the lists' lengths. Lists are intersected offset-adjusted
from the rarest test terms of a window on, and what is left is compared word for word. Test texts go
to the tasks one bounded block after the other; the tasks plan the windows themselves.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loci.llm.words import Hasher, run_words
from loci.runtime import stored

#: Characters of test text broadcast at once; more is searched for in several blocks.
BLOCK_CHARS = 16_000_000
#: Lists intersected before windows are compared word for word.
LISTS = 3
#: Words of a shard; a longer document is a shard of its own.
SHARD_WORDS = 1_000_000
#: Candidates in memory at once.
_SLICE = 2_000_000


class TestTexts:
    """One block of test texts, bounded by ``BLOCK_CHARS`` characters: words as places in a sorted vocabulary of 64-bit hashes."""

    __test__ = False

    def __init__(self, keys: list, texts: list[str]) -> None:
        hasher = Hasher()
        hashed = [np.array([hasher[w] for w in run_words(t)], dtype=np.int64) for t in texts]
        self.keys = keys
        self.sizes = np.array([h.size for h in hashed], dtype=np.int64)
        flat = np.concatenate(hashed) if hashed else np.array([], np.int64)
        self.terms, words = np.unique(flat, return_inverse=True)
        self.words = words.astype(np.int32)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])[:-1] if hashed else np.array([], np.int64)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents -> shards: ids, begins (a place for each document, one gap between), terms, bounds, positions."""
    hasher = Hasher()

    def shard(ids: pa.Array, words: list[np.ndarray]) -> pa.RecordBatch:
        sizes = np.array([w.size + 1 for w in words])
        begins = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        stream = np.concatenate(words)
        place = np.arange(stream.size) + np.repeat(np.arange(len(words)), sizes - 1)
        order = np.argsort(stream, kind="stable")
        terms, first = np.unique(stream[order], return_index=True)
        one = lambda a, kind: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), pa.array(a, kind) if kind else a)
        return pa.RecordBatch.from_arrays(
            [one(ids, None), one(begins, pa.int32()), one(terms, pa.int64()), one(np.append(first, stream.size), pa.int32()), one(place[order], pa.int32())],
            names=["ids", "begins", "terms", "bounds", "positions"],
        )

    for batch in batches:
        rows, words, total = [], [], 0
        for i, text in enumerate(batch.column(1).to_pylist()):
            w = np.array([hasher[x] for x in run_words(text)], dtype=np.int64)
            if not w.size:
                continue
            if rows and total + w.size > SHARD_WORDS:
                yield shard(batch.column(0).take(pa.array(rows)), words)
                rows, words, total = [], [], 0
            rows.append(i)
            words.append(w)
            total += w.size
        if rows:
            yield shard(batch.column(0).take(pa.array(rows)), words)


def positional_index(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """The stored index of ``docs``: one row a shard, for any number of searches. Null texts and texts without words are in no shard."""
    src = docs.select(F.col(ident).alias("id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    kind = src.schema["id"].dataType.simpleString()
    return stored(src.mapInArrow(_shards, f"ids array<{kind}>, begins array<int>, terms array<bigint>, bounds array<int>, positions array<int>"), "index")


class Shard:
    """One shard as arrays, with lookups by the vocabulary of a block of test texts."""

    def __init__(self, batch: pa.RecordBatch, row: int, vocabulary: np.ndarray, pad: int = 0) -> None:
        get = lambda k: batch.column(k)[row].values.to_numpy(zero_copy_only=False)
        self.ids, self.begins, bounds, positions = batch.column(0)[row].values, get(1), get(3), get(4)
        terms = get(2)
        at = np.minimum(np.searchsorted(terms, vocabulary), terms.size - 1)
        known = terms[at] == vocabulary
        self.low = np.where(known, bounds[at], 0).astype(np.int64)
        self.high = np.where(known, bounds[at + 1], 0).astype(np.int64)
        self.counts = self.high - self.low
        self.positions, self.pad = positions.astype(np.int64) + pad, pad

    def stream(self) -> np.ndarray:
        """Vocabulary numbers by position, -1 for all else, with ``pad`` places more at either end."""
        size = int(self.positions.max()) + 1 + self.pad if self.positions.size else 2 * self.pad
        out = np.full(size, -1, np.int32)
        which, pick = _gather(self.low, self.counts)
        out[self.positions[pick]] = which
        return out

    def document(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begins, positions - self.pad, side="right") - 1


def _gather(low: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(list number, place) of every entry of the lists that begin at ``low``."""
    which = np.repeat(np.arange(counts.size), counts)
    return which, np.arange(which.size) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(low, counts)


def _term_counts(batches: Iterator[pa.RecordBatch], tests) -> Iterator[pa.RecordBatch]:
    vocabulary = tests.value.terms
    counts = np.zeros(vocabulary.size, dtype=np.int64)
    for batch in batches:
        for row in range(batch.num_rows):
            counts += Shard(batch, row, vocabulary).counts
    hit = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(counts[hit])], names=["term", "n"])


class Plans:
    """Windows of ``width`` words with their rarest terms; windows of one text with the same ones are one plan."""

    def __init__(self, tests: TestTexts, counts: np.ndarray, width: int) -> None:
        long = np.flatnonzero(tests.sizes >= width)
        n = tests.sizes[long] - width + 1
        text = np.repeat(long, n)
        at = np.arange(text.size) - np.repeat(np.cumsum(n) - n, n) + tests.starts[text]
        rarity = counts[tests.words]
        lists = min(LISTS, width)
        rarest = np.empty((text.size, lists), np.int64)
        for lo in range(0, text.size, 100_000):
            part = at[lo : lo + 100_000]
            window = rarity[part[:, None] + np.arange(width)]
            rarest[lo : lo + 100_000] = np.argsort(window, axis=1, kind="stable")[:, :lists] + part[:, None]
        keys, plan = np.unique(rarest, axis=0, return_inverse=True)
        plan = plan.ravel()
        order = np.argsort(plan, kind="stable")
        #: Places of the rarest words, the text, and the windows (by place) of every plan.
        self.places, self.windows, self.width = keys, at[order], width
        self.window_counts = np.bincount(plan, minlength=len(keys))
        self.window_low = np.cumsum(self.window_counts) - self.window_counts
        self.text = text[order][self.window_low] if len(keys) else np.array([], np.int64)


def _phrases(batches: Iterator[pa.RecordBatch], tests, counts, width: int) -> Iterator[pa.RecordBatch]:
    tests, counts = tests.value, counts.value
    plans = Plans(tests, counts, width)
    pad = int(tests.sizes.max(initial=0)) + width
    words = tests.words
    for batch in batches:
        for row in range(batch.num_rows):
            index = Shard(batch, row, tests.terms, pad)
            stream = index.stream()
            lists = index.counts[words[plans.places[:, 0]]] if len(plans.places) else np.array([], np.int64)
            ends, hits = np.cumsum(lists), []
            lo = 0
            while lo < lists.size:
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + _SLICE, "right")))
                plan, pick = _gather(index.low[words[plans.places[lo:hi, 0]]], lists[lo:hi])
                plan += lo
                # Where the first word of all test texts would be, were they laid over the shard so that the rarest words meet.
                base = index.positions[pick] - plans.places[plan, 0]
                for k in range(1, plans.places.shape[1]):
                    place = plans.places[plan, k]
                    ok = stream[base + place] == words[place]
                    plan, base = plan[ok], base[ok]
                which, window = _gather(plans.window_low[plan], plans.window_counts[plan])
                window, plan, base = plans.windows[window], plan[which], base[which]
                same = np.ones(window.size, bool)
                for k in range(width):
                    same[same] = stream[(base + window)[same] + k] == words[window[same] + k]
                hits.append(np.stack([plans.text[plan[same]], base[same], window[same]]))
                lo = hi
            if not hits or not (found := np.unique(np.concatenate(hits, axis=1), axis=1)).size:
                continue
            text, base, window = found
            # Successive windows of one alignment make one longer passage.
            opens = np.flatnonzero(np.concatenate([[True], (np.diff(text) != 0) | (np.diff(base) != 0) | (np.diff(window) != 1)]))
            length = np.diff(np.append(opens, text.size)) + width - 1
            text, doc = text[opens], index.document(base[opens] + window[opens])
            best: dict[tuple[int, int], int] = {}
            for d, t, n in zip(doc.tolist(), text.tolist(), length.tolist(), strict=True):
                best[d, t] = max(best.get((d, t), 0), n)
            yield _matches(index.ids, tests, best, "words")


def _matches(ids: pa.Array, tests: TestTexts, found: dict[tuple[int, int], int], name: str) -> pa.RecordBatch:
    texts = [t for _, t in found]
    return pa.RecordBatch.from_arrays(
        [
            ids.take(pa.array([d for d, _ in found], pa.int64())), pa.array([tests.keys[t][0] for t in texts], pa.int64()),
            pa.array([tests.keys[t][1] for t in texts], pa.string()), pa.array(list(found.values()), pa.int64()),
        ],
        names=["id", "item", "field", name],
    )


def _proximity(batches: Iterator[pa.RecordBatch], tests, counts, terms: int, least: int, slack: float) -> Iterator[pa.RecordBatch]:
    tests, counts = tests.value, counts.value
    plans = []
    for start, size in zip(tests.starts.tolist(), tests.sizes.tolist(), strict=True):
        different = np.unique(tests.words[start : start + size])
        plans.append((different[np.argsort(counts[different], kind="stable")[:terms]], int(slack * size)))
    for batch in batches:
        for row in range(batch.num_rows):
            index = Shard(batch, row, tests.terms)
            best: dict[tuple[int, int], int] = {}
            for k, (wanted, span) in enumerate(plans):
                if wanted.size < least:
                    continue
                which, pick = _gather(index.low[wanted], index.counts[wanted])
                if which.size < least:
                    continue
                at = index.positions[pick]
                order = np.argsort(at, kind="stable")
                at, which = at[order], which[order]
                doc = index.document(at)
                # Terms within a span of each other: the window that opens at every position.
                ends = np.minimum(np.searchsorted(at, at + span, side="right"), np.searchsorted(doc, doc, side="right"))
                for i in np.flatnonzero(ends - np.arange(at.size) >= least):
                    n = np.unique(which[i : ends[i]]).size
                    if n >= least:
                        best[int(doc[i]), k] = max(best.get((int(doc[i]), k), 0), n)
            if best:
                yield _matches(index.ids, tests, best, "terms")


def _blocks(tests: DataFrame, block_chars: int) -> Iterator[TestTexts]:
    """The test texts one block after the other, each under the bound by its measured size (a single longer text is its own block)."""
    rows = tests.where(F.col("text").isNotNull()).select("item", "field", "text").distinct()
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-2 * chars // block_chars))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("item", "field"), F.lit(blocks)))
    for b in range(blocks):
        got = rows.where(F.col("block") == b).orderBy("item", "field").select("item", "field", "text").collect()
        yield TestTexts([(r["item"], r["field"]) for r in got], [r["text"] for r in got])


def _searched(index: DataFrame, tests: DataFrame, search, column: str, block_chars: int) -> DataFrame:
    """Results of ``search`` over all blocks of test texts; a block's result is written before the next one is read."""
    spark, parts = index.sparkSession, []
    kind = index.schema["ids"].dataType.elementType.simpleString()
    for block in _blocks(tests, block_chars):
        shared = spark.sparkContext.broadcast(block)
        rows = index.mapInArrow(functools.partial(_term_counts, tests=shared), "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros(block.terms.size, dtype=np.int64)
        counts[rows.column("term").to_numpy()] = rows.column("n").to_numpy()
        counted = spark.sparkContext.broadcast(counts)
        found = index.mapInArrow(functools.partial(search, tests=shared, counts=counted), f"id {kind}, item bigint, field string, {column} bigint")
        parts.append(stored(found, "found"))
        shared.unpersist()
        counted.unpersist()
    return functools.reduce(DataFrame.unionByName, parts)


def phrase_matches(
    docs: DataFrame, tests: DataFrame, width: int = 12, ident: str = "doc_id", text: str = "text", block_chars: int = BLOCK_CHARS, index: DataFrame | None = None
) -> DataFrame:
    """``(id, item, field, words)``: documents that hold at least ``width`` successive words of a test text.

    ``tests`` is ``(item BIGINT, field STRING, text)``; each text is matched on its own, shorter
    ones match nothing. ``words`` is the longest passage shared. Words are runs of letters and
    digits in lower case, told apart by 64-bit hashes. Documents with null or empty text match
    nothing; rows are looked at one by one, so repeated ids give repeated rows. Whole texts are
    searched. ``index`` is a ``positional_index`` of ``docs``; without one it is built.
    """
    index = positional_index(docs, ident, text) if index is None else index
    return _searched(index, tests, functools.partial(_phrases, width=width), "words", block_chars)


def proximity_matches(
    docs: DataFrame, tests: DataFrame, terms: int = 8, least: int = 6, slack: float = 1.5, ident: str = "doc_id", text: str = "text", block_chars: int = BLOCK_CHARS,
    index: DataFrame | None = None,
) -> DataFrame:
    """``(id, item, field, terms)``: documents with ``least`` of a test text's ``terms`` rarest words close together.

    Close means within ``slack`` times the text's length in words, in any order; this finds
    material that was reworded between its rare terms. Texts with fewer than ``least`` different
    words match nothing; other cases as in ``phrase_matches``.
    """
    index = positional_index(docs, ident, text) if index is None else index
    return _searched(index, tests, functools.partial(_proximity, terms=terms, least=least, slack=slack), "terms", block_chars)
