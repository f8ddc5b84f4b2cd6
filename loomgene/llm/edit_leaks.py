"""Benchmark decontamination by embedded edit distance.

A document leaks an item if some stretch of its words is within ``MAX_EDIT`` of the
item's length in word edits. Windows of the item's size are embedded by the CGK random
walk, which maps edit distance to Hamming distance; each repetition samples a few steps
of a walk as an LSH key. Windows that share a key with their item are verified exactly:
first whether an edit distance is low enough, by a bit-parallel search, then where and
how far, by the full table.

Walks drift further apart in longer items, so samples and repetitions are set by length:
pairs at the largest distance are simulated, and the most samples are taken with which
few repetitions reach ``TARGET_RECALL`` there. Leaks with fewer edits are found more surely.
Where ``MAX_REPEATS`` keys of one sample don't reach it (items of many thousand words)
every window counts as one that shares a key.

A stretch within e edits of an item holds one of the item's runs of L div (e + 1)
words unchanged (pigeonhole), and of its runs of k words at least L + 1 - k (e + 1), at
places shifted by at most e; only windows around so many runs are embedded, and this
leaves out no leak. Documents are scanned once, in place: nothing is shuffled. Items
are sent to the executors in blocks of bounded size, a scan for each block.

Words are runs of letters and digits, lower case in A-Z. Defined cases: null or empty
texts and items leak nothing, nor do items without an id; very long texts are read whole, a
slice at a time unless one text is longer; of repeated items each is reported once by id;
repeated documents are each reported; of equally near stretches (ties) the first counts, and
of those the shortest; an empty table gives an empty result; other columns, whatever their
names, are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgene.llm._store import Tidy
from loomgene.llm._words import SIGNS, Words, buffers, mix, sequences, slices, spread

MAX_EDIT = 0.2
TARGET_RECALL = 0.999
MOST_SAMPLES = 4
FEW_REPEATS = 32
MAX_REPEATS = 256
SEED_WORDS = 4
WINDOWS = 20_000
ITEM_BLOCK_BYTES = 8 << 20
LEAKS = "doc_id long, item_id long, distance int, start_word long, n_words int, item_words int"


class Walk:
    """One repetition: the steps that are sampled, and a random function per step that tells by a word whether the walk moves on."""

    def __init__(self, repeat: int, size: int, samples: int, seed: int = 71):
        # What a walk does depends on repetition and step only, never on the other windows of a call.
        name = np.uint64((seed * 1000 + repeat) << 32)
        shares = (mix(np.arange(samples, dtype=np.uint64) + name) >> np.uint64(11)).astype(float) / 2**53
        self.when = sorted((shares * 2 * size).astype(np.int64).tolist())
        self.odd = mix(np.arange(self.when[-1] + 1, dtype=np.uint64) + name + np.uint64(1 << 31)) | np.uint64(1)

    def keys(self, words: np.ndarray, start: np.ndarray, end: np.ndarray, beyond: int) -> np.ndarray:
        """A key for each window from start to end; past its end a walk reads ``beyond``."""
        held, at = np.r_[words, np.uint64(beyond)], start.copy()
        key = np.full(len(start), 1, np.uint64)
        for t, odd in enumerate(self.odd):
            word = held[np.where(at < end, at, len(words))]
            for _ in range(self.when.count(t)):
                key = mix(key * np.uint64(0xD1342543DE82EF95) + word)
            at += ((word * odd) >> np.uint64(63)).astype(np.int64)
        return key


@functools.lru_cache(maxsize=None)
def repetitions(size: int, max_edit: float, recall: float = TARGET_RECALL, trials: int = 200, repeats: int = 64) -> tuple[int, int] | None:
    """(samples per key, keys) for items of ``size`` words, from simulated pairs at the largest distance; None if MAX_REPEATS keys don't do."""
    edits = int(size * max_edit + 1e-9)
    rng = np.random.default_rng([11, size, edits])
    fresh = lambda n: rng.integers(1, 2**62, n)
    left, right = [], []
    for _ in range(trials):
        item = fresh(size).tolist()
        left += item
        for kind, word in zip(rng.integers(0, 3, edits), fresh(edits).tolist()):
            at = int(rng.integers(len(item)))
            item[at : at + (kind != 1)] = [word] if kind < 2 else []
        right += [*item, *fresh(edits).tolist()][:size]
    start = np.arange(trials) * size
    left, right = np.array(left, np.uint64), np.array(right, np.uint64)
    for samples in range(MOST_SAMPLES, 0, -1):
        walks = [Walk(r, size, samples) for r in range(repeats)]
        same = sum((w.keys(left, start, start + size, 0) == w.keys(right, start, start + size, 2**63)).astype(float) for w in walks)
        miss = 1 - (same + 0.5) / (repeats + 1)
        for r in range(1, (FEW_REPEATS if samples > 1 else MAX_REPEATS) + 1):
            if 1 - (miss**r).mean() >= recall:
                return samples, r
    return None


def plan_size(size: int) -> int:
    """The length whose plan serves ``size``: lengths grow by a quarter, so plans are few."""
    out = 5
    while out < size:
        out = 5 * math.ceil(out / 4)
    return out


def within(pattern: list[int], text: list[int], edits: int) -> bool:
    """Whether some stretch of ``text`` is within ``edits`` of ``pattern``, by a column of the table in one number (Myers)."""
    if not pattern:
        return True
    full, top = (1 << len(pattern)) - 1, 1 << (len(pattern) - 1)
    at: dict[int, int] = {}
    for i, word in enumerate(pattern):
        at[word] = at.get(word, 0) | 1 << i
    up, down, cost = full, 0, len(pattern)
    for word in text:
        same = at.get(word, 0)
        cross = (((same & up) + up) ^ up) | same
        more, less = down | (full & ~(cross | up)), up & cross
        cost += bool(more & top) - bool(less & top)
        if cost <= edits:
            return True
        more, less, level = more << 1 & full, less << 1 & full, same | down
        up, down = less | (full & ~(level | more)), more & level
    return cost <= edits


def best_stretch(pattern: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Least edit distance of ``pattern`` to any stretch of ``text``: (distance, start, end), the earliest and then shortest of the best."""
    n = len(text)
    cost = np.zeros(n + 1, np.int64)
    origin = np.arange(n + 1)
    steps = np.arange(n + 1)
    for i, p in enumerate(pattern):
        change = cost[:-1] + (text != p)
        drop = cost + 1
        best = drop.copy()
        came = origin.copy()
        better = change <= best[1:]
        best[1:][better] = change[better]
        came[1:][better] = origin[:-1][better]
        # Words of the text that the pattern lacks: a running minimum along the row.
        level = (best - steps) * (n + 2) + (steps[::-1])
        least = np.minimum.accumulate(level)
        source = n - (least % (n + 2))
        cost, origin = best[source] - source + steps, came[source]
    d = int(cost.min())
    ends = np.flatnonzero(cost == d)
    pick = ends[np.lexsort((ends - origin[ends], origin[ends]))[0]]
    return d, int(origin[pick]), int(pick)


class Items:
    """Benchmark items of one block: words and seeds."""

    def __init__(self, ids: list[int], texts: list[str], max_edit: float):
        raw, offsets = buffers(pa.array(texts, pa.large_string()))
        words = Words(raw, offsets, True, SIGNS)
        hashes, size = words.hashes(), np.diff(words.first)
        keep = np.flatnonzero(size > 0)
        self.ids = np.array(ids, np.int64)[keep]
        self.size = size[keep]
        self.first = words.first[:-1][keep]
        self.words = hashes
        self.edits = np.floor(self.size * max_edit + 1e-9).astype(np.int64)
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        run = np.minimum(SEED_WORDS, self.size // (self.edits + 1))
        for k in np.unique(run):
            mine = np.flatnonzero(run == k)
            count = self.size[mine] - k + 1
            place = spread(self.first[mine], count)
            grams = sequences(hashes, int(k))[place]
            owner = np.repeat(mine, count)
            order = np.argsort(grams, kind="stable")
            bits = np.zeros(1 << 20, bool)
            bits[(grams & np.uint64(0xFFFFF)).astype(np.int64)] = True
            self.seeds[int(k)] = grams[order], owner[order], (place - self.first[owner])[order], bits


def _matches(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (index in wanted, index in table) of equal values; table is sorted."""
    lo, hi = np.searchsorted(table, wanted, "left"), np.searchsorted(table, wanted, "right")
    return np.repeat(np.arange(len(wanted)), hi - lo), spread(lo, hi - lo)


def find_leaks(docs: DataFrame, items: DataFrame, max_edit: float = MAX_EDIT, recall: float = TARGET_RECALL, block_bytes: int = ITEM_BLOCK_BYTES) -> DataFrame:
    """One row per document and item that it leaks: the least distance, and where its first best stretch lies."""
    found = None
    for sent in _item_blocks(items, max_edit, recall, block_bytes):
        part = _scan(docs, sent, max_edit)
        found = part if found is None else found.unionByName(part)
    return found


def mark_leaks(docs: DataFrame, items: DataFrame, name: str = "n_leaks", max_edit: float = MAX_EDIT, recall: float = TARGET_RECALL, block_bytes: int = ITEM_BLOCK_BYTES) -> DataFrame:
    """All rows and columns of ``docs``, in place, with the number of items that each row leaks; a column called ``name`` is replaced."""
    out = docs.drop(name).withColumn(name, F.lit(0).cast("long"))
    place = out.columns.index("text")
    for sent in _item_blocks(items, max_edit, recall, block_bytes):
        out = out.mapInArrow(Tidy(_marker(sent, max_edit, place)), out.schema)
    return out


def _marker(sent, max_edit: float, place: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *rows, plans = sent.value
        items = Items(*rows, max_edit)
        for batch in batches:
            count = np.asarray(batch.column(batch.num_columns - 1)).copy()
            for lo, _, words in slices(batch.column(place), True, space=SIGNS):
                if len(items.ids) and len(words):
                    for row, _ in verify(items, words, words.hashes(), plans):
                        count[lo + row] += 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(count)], schema=batch.schema)

    return run


def _item_blocks(items: DataFrame, max_edit: float, recall: float, block_bytes: int) -> Iterator:
    """Broadcast items in blocks of bounded size, with the repetitions for their lengths."""
    if not 0 <= max_edit < 0.5:
        raise ValueError("max_edit must be at least 0 and below 0.5")
    rows = items.filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n_blocks = max(1, -(-size // block_bytes))
    for b in range(n_blocks):
        ids, texts = [], []
        for row in rows.filter(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == b).dropDuplicates(["item_id", "text"]).orderBy("item_id", "text").toLocalIterator():
            ids.append(row["item_id"])
            texts.append(row["text"])
        plans = {int(n): repetitions(plan_size(int(n)), max_edit, recall) for n in np.unique(Items(ids, texts, max_edit).size)}
        yield items.sparkSession.sparkContext.broadcast((ids, texts, plans))


def _scan(docs: DataFrame, sent, max_edit: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *rows, plans = sent.value
        items = Items(*rows, max_edit)
        for batch in batches:
            ids = batch.column(0)
            for lo, _, words in slices(batch.column(1), True, space=SIGNS):
                if not len(items.ids) or not len(words):
                    continue
                if found := [(ids[lo + row].as_py(), *leak) for row, leak in verify(items, words, words.hashes(), plans)]:
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], names=["doc_id", "item_id", "distance", "start_word", "n_words", "item_words"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(Tidy(run), LEAKS)


def seeded(items: Items, words: Words, hashes: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Stretches around enough unchanged runs, a document's in order: (document, item, first word, end)."""
    for k, (grams, owner, offset, bits) in items.seeds.items():
        own = sequences(hashes, k)
        if not len(own):
            continue
        maybe = np.flatnonzero(bits[(own & np.uint64(0xFFFFF)).astype(np.int64)] & (words.doc[: len(own)] == words.doc[k - 1 :]))
        at, hit = _matches(grams, own[maybe])
        if not len(at):
            continue
        place, item = maybe[at], owner[hit]
        doc, shift = words.doc[place], place - offset[hit]
        order = np.lexsort((shift, item, doc))
        doc, item, shift = doc[order], item[order], shift[order]
        edits, size = items.edits[item], items.size[item]
        # The last of the runs that a stretch needs, if this is its first.
        last = np.arange(len(doc)) + np.maximum(1, size + 1 - k * (edits + 1)) - 1
        here = np.flatnonzero(last < len(doc))
        last = last[here]
        fit = (doc[here] == doc[last]) & (item[here] == item[last]) & (shift[last] - shift[here] <= 2 * edits[here])
        here, last = here[fit], last[fit]
        if not len(here):
            continue
        doc, item, edits = doc[here], item[here], edits[here]
        low = np.maximum(shift[last] - edits, words.first[doc])
        high = np.minimum(shift[here] + 2 * edits + size[here], words.first[doc + 1])
        # Both bounds grow within a document and item; stretches that overlap are taken as one.
        head = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (low[1:] > high[:-1])])
        tail = np.r_[head[1:], len(doc)] - 1
        yield from zip(doc[head].tolist(), item[head].tolist(), low[head].tolist(), high[tail].tolist())


def embedded(items: Items, words: Words, hashes: np.ndarray, plans: dict) -> Iterator[tuple[int, int, int, int]]:
    """Of the seeded stretches those with a window that shares an LSH key with its item."""
    spots = np.array(list(seeded(items, words, hashes)), np.int64).reshape(-1, 4)
    for n in np.unique(items.size[spots[:, 1]]):
        mine = spots[items.size[spots[:, 1]] == n]
        if (plan := plans[int(n)]) is None:
            yield from mine.tolist()
            continue
        # A leak may be shorter than its item by all its edits.
        count = np.maximum(1, mine[:, 3] - mine[:, 2] - n + items.edits[mine[:, 1]] + 1)
        part = np.cumsum(count) // WINDOWS
        for p in np.unique(part):
            some, left = mine[part == p], count[part == p]
            start, owner = spread(some[:, 2], left), np.repeat(np.arange(len(some)), left)
            end = np.minimum(start + n, words.first[some[:, 0] + 1][owner])
            kinds, of = np.unique(some[:, 1], return_inverse=True)
            met = np.zeros(len(some), bool)
            for r in range(plan[1]):
                walk = Walk(r, int(n), plan[0])
                first = items.first[kinds]
                item_keys = walk.keys(items.words, first, first + n, 0)
                hit = walk.keys(hashes, start, end, 1 << 63) == item_keys[of[owner]]
                if hit.any():
                    met[owner[hit]] = True
                    stay = ~met[owner]
                    start, end, owner = start[stay], end[stay], owner[stay]
                    if not len(start):
                        break
            yield from some[met].tolist()


def verify(items: Items, words: Words, hashes: np.ndarray, plans: dict) -> list[tuple[int, tuple]]:
    """(row, (item id, distance, first word, words, the item's words)) of the documents of a slice whose windows share a key with an item."""
    best: dict[tuple[int, int], tuple] = {}
    for row, item, low, high in embedded(items, words, hashes, plans):
        pattern, text = items.words[items.first[item] : items.first[item] + items.size[item]], hashes[low:high]
        if within(pattern.tolist(), text.tolist(), int(items.edits[item])):
            distance, i, j = best_stretch(pattern, text)
            key, value = (row, int(items.ids[item])), (distance, low - int(words.first[row]) + i, j - i, int(items.size[item]))
            if key not in best or value < best[key]:
                best[key] = value
    return [(row, (item, *value)) for (row, item), value in best.items()]


def op8_edit_leaks(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
