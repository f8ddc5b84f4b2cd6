"""N-gram Jaccard join by parity sketches.

A document's set of shingles is XOR-hashed into a bit sketch: every shingle flips one
bit of one of P parts. Sketches that differ in d bits come from sets that differ in at
least d shingles, so sets with a symmetric difference of at most D agree in at least
P - D parts (pigeonhole). A part is wide, 2**32 bits, and holds few set bits; it is kept
as the XOR of their hashes. P and D follow from the size band: sizes double from band to
band, and a set near its band's lower end also takes part in the band below.

Of its parts a document offers only the D + 1 that fewest documents share (any fixed
order of parts will do for that: the last in it of P - D common parts is among the first
D + 1 of both). Parts that no other document has can be left out, and with them nearly
all documents without a partner. Sets that are equal are one class, with one member that
takes part. Candidates are verified exactly.

Pairs are not listed within groups. Of the documents that offer a part, each is checked
against the group's first. Where a group still spans several components afterwards, its
members are compared by a second, larger bit sketch, which grows with the set; of the
pairs of different components that may be linked the group names a spanning forest, less
than one pair a member. These are verified, components merged, and groups with a pair
that turned out wrong go on with at most 16, 256, ... pairs a member that are still open,
until every pair that may link two components is known not to. So no link between
components is lost, and pairs are only named between components that are near but not linked.
Large groups are dealt to tasks in tiles of ``TILE`` members: those of the group's largest
component meet only the others.

Links need 100 * |intersection| >= 75 * |union|. Words are runs of bytes other than
space and 0x09-0x0D, lower case in A-Z; a shingle is five of them, or all if fewer.

Defined cases: a null or empty text has no words, no shingles, no links; a very long text is
one set like any other, its sketch and parts grow with it; a null doc_id belongs to no
component; rows that share a doc_id are one node, linked by the text of any of them; equal
texts (ties) are one class; an empty table gives an empty result; other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgene.llm._graph import components
from loomgene.llm._store import BLOCK_BYTES, Tidy, answer, ask, finish, materialize, release, shuffle_partitions, to_blocks, with_returns
from loomgene.llm._words import Routes, expand, mix, narrow, sequences, slices, spread, squeeze

SHINGLE = 5
LEAST_PARTS = 96
LEAST_BITS = 1024
SETS, PARTS = 1, 2
VERIFY_GROUP = 64
TILE = 2048
COUNT_CAP = 255  # counts above order alike; the order of parts stays one and the same everywhere


class Sets:
    """Distinct shingles of each row, sorted: ``shingles`` with ``first`` offsets."""

    def __init__(self, column: pa.Array):
        parts, sizes = [], []
        for lo, hi, words in slices(column, True):
            h = words.hashes()
            size = np.diff(words.first)
            grams = sequences(h, SHINGLE)
            start = np.flatnonzero(words.doc[: len(grams)] == words.doc[SHINGLE - 1 :]) if len(grams) else np.zeros(0, np.int64)
            short = np.flatnonzero((size > 0) & (size < SHINGLE))
            rest = np.array([sequences(h[words.first[i] : words.first[i + 1]], int(size[i]))[0] for i in short], np.uint64)
            value = np.r_[grams[start], mix(rest ^ np.uint64(0xA0761D6478BD642F))]
            doc = np.r_[words.doc[start], short]
            order = np.argsort(value)
            order = order[np.argsort(doc[order], kind="stable")]
            value, doc = value[order], doc[order]
            fresh = np.r_[True, (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])] if len(value) else np.zeros(0, bool)
            parts.append(value[fresh])
            sizes.append(np.bincount(doc[fresh], minlength=hi - lo))
        self.shingles = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        self.size = np.concatenate(sizes).astype(np.int64) if sizes else np.zeros(0, np.int64)
        self.first = np.r_[0, np.cumsum(self.size)].astype(np.int64)

    def prints(self) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of each whole set."""
        out = []
        for salt in (0x8EBC6AF09C88C6E3, 0x589965CC75374CC3):
            total = np.r_[np.uint64(0), np.cumsum(mix(self.shingles ^ np.uint64(salt)))].astype(np.uint64)
            out.append(mix(total[self.first[1:]] - total[self.first[:-1]] + self.size.astype(np.uint64)))
        return out[0], out[1]

    def bits(self, rows: np.ndarray) -> list[bytes]:
        """Bit sketches: each shingle flips one of two to four times as many bits as the set has shingles, LEAST_BITS at least."""
        size = self.size[rows]
        width = np.maximum(LEAST_BITS, 4 << np.floor(np.log2(np.maximum(size, 1))).astype(np.int64))
        out: list[bytes] = [b""] * len(rows)
        for w in np.unique(width):
            mine = np.flatnonzero(width == w)
            step = max(1, (1 << 18) // int(w))
            for lo in range(0, len(mine), step):
                part = mine[lo : lo + step]
                owner = np.repeat(np.arange(len(part)), size[part])
                value = self.shingles[spread(self.first[rows[part]], size[part])]
                bit = (mix(value ^ np.uint64(0x1D8E4E27C47D124F)) & np.uint64(w - 1)).astype(np.int64)
                flips = np.bincount(owner * w + bit, minlength=len(part) * w) & 1
                for i, row in zip(part, np.packbits(flips.astype(np.uint8).reshape(len(part), w), axis=1)):
                    out[i] = row.tobytes()
        return out

    def of(self, i: int) -> np.ndarray:
        return self.shingles[self.first[i] : self.first[i + 1]]


class Sketches:
    """Non-empty parts of the sketches of ``rows``: scheme, owner (place in rows), part key; and how many parts each offers."""

    def __init__(self, sets: Sets, rows: np.ndarray):
        size = sets.size[rows]
        low = 1 << np.floor(np.log2(np.maximum(size, 1))).astype(np.int64)
        below = np.flatnonzero((3 * size < 4 * low) & (low > 1))
        self.row = np.r_[rows, rows[below]]
        lower = np.r_[np.zeros(len(rows), bool), np.ones(len(below), bool)]
        low = np.r_[low, low[below] // 2]
        size = sets.size[self.row]
        # A smaller partner's scheme: there this set is the larger one, and the other is below the band's end.
        self.offers = np.where(lower, (size + 2 * low - 1) // 7, size // 3) + 1
        self.parts = np.maximum(LEAST_PARTS, low)
        self.band = low
        count = size
        owner = np.repeat(np.arange(len(self.row)), count)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + sets.first[self.row][owner]
        value = sets.shingles[at]
        cell = ((mix(value ^ np.uint64(0xE7037ED1A0B428DB)) >> np.uint64(32)) * self.parts[owner].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        base = np.cumsum(self.parts) - self.parts
        code = base[owner] + cell
        order = np.argsort(code)
        code, value = code[order], value[order]
        head = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, np.int64)
        folded = np.bitwise_xor.reduceat(value, head) if len(head) else value
        self.owner = np.searchsorted(base, code[head], "right") - 1
        self.cell = code[head] - base[self.owner]
        self.key = mix(folded ^ self.name(self.owner, self.cell))

    def name(self, owner: np.ndarray, cell: np.ndarray) -> np.ndarray:
        return mix((self.band[owner].astype(np.uint64) << np.uint64(32)) + cell.astype(np.uint64))

    def offered(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(owner, key, rank) of the parts that each document offers and that another document shares."""
        order = np.lexsort((self.key, counts, self.owner))
        held = np.bincount(self.owner, minlength=len(self.row))
        rank = np.arange(len(order)) - np.repeat(np.cumsum(held) - held, held)
        chosen = order[(rank < self.offers[self.owner[order]]) & (counts[order] > 1)]
        place = np.empty(len(order), np.int64)
        place[order] = rank
        owner, key, ranks = [self.owner[chosen]], [self.key[chosen]], [place[chosen]]
        # With fewer parts than it must offer, a set goes on with empty ones, in their order.
        for i in np.flatnonzero(held < self.offers):
            empty = np.setdiff1d(np.arange(self.parts[i]), self.cell[self.owner == i])[: self.offers[i] - held[i]]
            owner.append(np.full(len(empty), i))
            key.append(self.name(np.full(len(empty), i), empty))
            ranks.append(held[i] + np.arange(len(empty)))
        return np.concatenate(owner), np.concatenate(key), np.concatenate(ranks)


def _doc_ids(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    column = rows.column("doc_id").cast(pa.int64())
    return np.asarray(column.fill_null(0)), ~np.asarray(column.is_null())


def _reply_sets(_blocks, payloads):
    """Of each set, the least document that has it."""
    sent = [expand(p) for p in payloads]
    a, b, ids = (np.concatenate([s[i] for s in sent]) for i in range(3))
    order = np.lexsort((ids, b, a))
    new = np.r_[True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])]
    least = np.empty(len(a), np.int64)
    least[order] = ids[order][new][np.cumsum(new) - 1]
    ends = np.cumsum([len(s[0]) for s in sent])
    return [squeeze(least[e - len(s[0]) : e]) for s, e in zip(sent, ends)], SETS


def _reply_parts(_blocks, payloads):
    """Of each part, how many documents have it."""
    sent = [expand(p)[0] for p in payloads]
    keys = np.concatenate(sent)
    order = np.argsort(keys)
    new = np.r_[True, keys[order][1:] != keys[order][:-1]]
    group = np.cumsum(new) - 1
    counts = np.empty(len(keys), np.uint8)
    counts[order] = np.minimum(np.bincount(group), COUNT_CAP)[group]
    ends = np.cumsum([len(s) for s in sent])
    return [squeeze(counts[e - len(s) : e]) for s, e in zip(sent, ends)], PARTS


def _low(keys: np.ndarray) -> np.ndarray:
    """What is left of a key when its bucket is known. Keys that fall together only add candidates."""
    return (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def shared_parts(docs: DataFrame, buckets: int | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of documents (doc_id, n_shingles, class_id, and text and bit sketch of those that offer parts) and rows of offered parts (bucket, payload)."""
    n = buckets or shuffle_partitions(docs.sparkSession)
    blocks = to_blocks(docs.select("doc_id", "text"), block_bytes=block_bytes)

    def ask_sets(_block, rows, _returns):
        sets = Sets(rows.column("text"))
        ids, real = _doc_ids(rows)
        a, b = sets.prints()
        picked = np.flatnonzero((sets.size > 0) & real)
        for bucket, at in Routes(a[picked], n):
            mine = picked[at]
            yield bucket, SETS, squeeze(a[mine], b[mine], ids[mine])

    def classes(sets: Sets, rows, returns) -> tuple[np.ndarray, np.ndarray]:
        """class_id of each row, and the rows that take part: one of each class here."""
        ids, real = _doc_ids(rows)
        picked = np.flatnonzero((sets.size > 0) & real)
        least = ids.copy()
        least[picked] = Routes(sets.prints()[0][picked], n).back({b: expand(v)[0] for b, v in returns.get(SETS, {}).items()}, np.int64)
        own = picked[least[picked] == ids[picked]]
        return least, own

    def ask_parts(_block, rows, returns):
        sets = Sets(rows.column("text"))
        sketches = Sketches(sets, classes(sets, rows, returns)[1])
        for bucket, mine in Routes(sketches.key, n):
            yield bucket, PARTS, squeeze(_low(sketches.key[mine]))

    known = answer(ask(blocks, ask_sets), _reply_sets)
    told = with_returns(blocks, known, "sets")
    counted = answer(ask(told, ask_parts), _reply_parts)

    def settle(_block, rows, returns):
        sets = Sets(rows.column("text"))
        ids, real = _doc_ids(rows)
        least, own = classes(sets, rows, returns)
        sketches = Sketches(sets, own)
        counts = Routes(sketches.key, n).back({b: expand(v)[0] for b, v in returns.get(PARTS, {}).items()}, np.uint8)
        owner, key, rank = sketches.offered(counts)
        row = sketches.row[owner]
        offering = np.zeros(rows.num_rows, bool)
        offering[row] = True
        m = rows.num_rows
        posts = [(bucket, squeeze(_low(key[mine]), ids[row[mine]], narrow(sets.size[row[mine]]), narrow(rank[mine]))) for bucket, mine in Routes(key, n)]
        k = len(posts)
        text = rows.column("text").cast(pa.string())
        sketch = np.full(m, None)
        picked = np.flatnonzero(offering)
        sketch[picked] = sets.bits(picked)
        columns = [
            pa.concat_arrays([rows.column("doc_id").cast(pa.int64()), pa.nulls(k, pa.int64())]),
            pa.concat_arrays([pa.array(sets.size, pa.int64()), pa.nulls(k, pa.int64())]),
            pa.concat_arrays([pa.array(least, pa.int64(), mask=~real), pa.nulls(k, pa.int64())]),
            pa.concat_arrays([pa.compute.if_else(pa.array(offering), text, pa.scalar(None, pa.string())), pa.nulls(k, pa.string())]),
            pa.array([*sketch, *[None] * k], pa.binary()),
            pa.array([None] * m + [b for b, _ in posts], pa.int32()),
            pa.array([None] * m + [p for _, p in posts], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "class_id", "text", "sketch", "bucket", "payload"])

    return finish(with_returns(told, counted, "parts"), settle, "doc_id long, n_shingles long, class_id long, text string, sketch binary, bucket int, payload binary")


def _fits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 3 * np.maximum(a, b) <= 4 * np.minimum(a, b)


def star_pairs(posts: DataFrame) -> DataFrame:
    """Each document that offers a part, with the first document that offers it."""

    def pair(table: pa.Table) -> pa.Table:
        sent = [expand(p) for p in table.column("payload").to_pylist()]
        key, ids, size, rank = (np.concatenate([s[i] for s in sent]) for i in range(4))
        order = np.lexsort((ids, key))
        key, ids, size, rank = key[order], ids[order], size[order].astype(np.int64), rank[order].astype(np.int64)
        head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        lead = np.repeat(head, np.diff(np.r_[head, len(key)]))
        keep = (ids[lead] != ids) & _fits(size[lead], size) & (np.maximum(rank[lead], rank) <= (size[lead] + size) // 7)
        pairs = np.unique(np.stack([ids[lead][keep], ids[keep]]), axis=1) if keep.any() else np.zeros((2, 0), np.int64)
        release()
        return pa.table({"a": pairs[0].astype(np.int64), "b": pairs[1].astype(np.int64)})

    return posts.groupBy("bucket").applyInArrow(pair, "a long, b long").distinct()


def offers(posts: DataFrame) -> DataFrame:
    """(key, id): each document with each part that it offers."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, payload in zip(batch.column("bucket").to_pylist(), batch.column("payload").to_pylist()):
                key, ids = (x.astype(np.int64) for x in expand(payload)[:2])
                yield pa.RecordBatch.from_arrays([pa.array((bucket << 32) + key), pa.array(ids)], names=["key", "id"])

    return posts.select("bucket", "payload").mapInArrow(Tidy(unpack), "key long, id long").distinct()


def open_groups(rows: DataFrame, labels: DataFrame, tile: int = TILE) -> DataFrame:
    """(key, pair, side, id, component, lead): members of the groups that span components, dealt to tiles.

    Groups with the same members are taken once. Members outside the largest component meet all, in tiles by twos; those
    in it meet only the others. A group of up to ``tile`` members on either side is one tile (side 0).
    """
    named = rows.join(labels.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    each = named.groupBy("key", "component").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("mark"))
    spans = each.groupBy("key").agg(F.count("*").alias("parts"), F.sum("n").alias("members"), F.max(F.struct("n", "component")).alias("top"), F.bit_xor("mark").alias("mark")).filter("parts > 1")
    alone = spans.groupBy("members", "mark").agg(F.min(F.struct("key", "top")).alias("g"))
    tiles = lambda n: F.ceil(n / F.lit(tile)).cast("int")
    groups = alone.select(F.col("g.key").alias("key"), F.col("g.top.component").alias("lead"), tiles(F.col("members") - F.col("g.top.n")).alias("small"), tiles(F.col("g.top.n")).alias("large"))
    joined = named.join(groups, "key")
    one = F.col("small") + F.col("large") <= 2
    t = F.pmod(F.xxhash64("id", F.lit(7)), F.when(F.col("component") == F.col("lead"), F.col("large")).otherwise(F.col("small"))).cast("int")
    place = lambda pair, side: F.struct(pair.cast("long").alias("pair"), side.cast("int").alias("side"))
    zero, width = F.lit(0), F.col("small") + F.col("large")
    outside = F.transform(
        F.sequence(zero, width - 1),
        lambda u: place(F.least(t, u) * width + F.greatest(t, u), F.when(u == t, zero).when(u > t, F.lit(1)).otherwise(F.lit(2))),
    )
    inside = F.transform(F.sequence(zero, F.col("small") - 1), lambda u: place(u * width + F.col("small") + t, F.lit(2)))
    dealt = F.when(one, F.array(place(zero, zero))).when(F.col("component") == F.col("lead"), inside).otherwise(outside)
    return joined.withColumn("at", F.explode(dealt)).select("key", "at.pair", "at.side", "id", "component", "lead")


def fold(sketches: list[bytes]) -> np.ndarray:
    """Sketches of one width, the least of theirs: the halves of a parity sketch, XORed, are the sketch of half the width."""
    width = min(map(len, sketches))
    out = []
    for x in sketches:
        row = np.frombuffer(x, np.uint64)
        while 8 * len(row) > width:
            row = row[: len(row) // 2] ^ row[len(row) // 2 :]
        out.append(row)
    return np.stack(out)


def named_pairs(ids, size, label, side, lead, sketch, failed, most: int) -> tuple[list[tuple[int, int]], bool]:
    """Pairs of places that join members of different labels, of all that fit by size and sketch and didn't fail; and whether there may be more.

    With ``most`` = 0 a spanning forest of them, else up to so many for each member outside the label ``lead``.
    """
    order = np.argsort(size, kind="stable")
    size, label = size[order], label[order].copy()
    left = len(np.unique(label))
    out, more = [], most == 0
    for i in np.flatnonzero(label != lead):
        if left == 1:
            break
        # Partners are a third larger or smaller at most.
        lo, hi = np.searchsorted(size, [-(-3 * size[i] // 4), 4 * size[i] // 3 + 1])
        j = np.arange(lo, hi)
        j = j[label[j] != label[i]]
        if side is not None:
            s = side[order[j]]
            j = j[(s == 0) | (s != side[order[i]])]
        if not len(j):
            continue
        row = sketch[order[i]]
        near = np.concatenate([np.bitwise_count(sketch[order[c]] ^ row).sum(axis=1, dtype=np.int64) for c in np.array_split(j, 1 + len(j) * len(row) // (1 << 19))])
        j = j[near <= (size[i] + size[j]) // 7]
        if len(j) and (not_linked := failed.get(int(ids[order[i]]))):
            j = j[~np.isin(ids[order[j]], not_linked)]
        if most:
            out += [(int(order[i]), int(order[k])) for k in j[:most]]
            more |= len(j) > most
            continue
        for other, first in zip(*np.unique(label[j], return_index=True)):
            out.append((int(order[i]), int(order[j[first]])))
            label[label == other] = label[i]
            left -= 1
    return out, more


def open_pairs(groups: DataFrame, sketches: DataFrame, failed: DataFrame | None, most: int = 0) -> DataFrame:
    """(key, a, b, low, high, more): pairs of documents that may link the components low and high, as in ``named_pairs``."""
    slots = 8 * shuffle_partitions(groups.sparkSession)
    wide = groups.join(sketches.withColumnRenamed("doc_id", "id"), "id").withColumn("slot", F.pmod(F.xxhash64("key", "pair"), F.lit(slots)))
    if failed is None:
        wide = wide.withColumn("failed", F.lit(None).cast("array<long>"))
    else:
        ways = failed.unionByName(failed.select(F.col("b").alias("a"), F.col("a").alias("b")))
        wide = wide.join(ways.groupBy(F.col("a").alias("id")).agg(F.collect_set("b").alias("failed")), "id", "left")
    columns = ("key", "pair", "side", "id", "component", "lead", "n_shingles")

    def cross(table: pa.Table) -> pa.Table:
        key, pair, side, ids, label, lead, size = (np.asarray(table.column(c)) for c in columns)
        order = np.lexsort((ids, pair, key))
        new = (key[order][1:] != key[order][:-1]) | (pair[order][1:] != pair[order][:-1])
        out = []
        for at in np.split(order, np.flatnonzero(new) + 1):
            if (label[at] == label[at[0]]).all():
                continue
            held = table.take(pa.array(at))
            sketch = fold(held.column("sketch").to_pylist())
            wrong = {i: x for i, x in zip(held.column("id").to_pylist(), held.column("failed").to_pylist()) if x}
            apart = side[at] if side[at].any() else None
            pairs, more = named_pairs(ids[at], size[at], label[at], apart, lead[at[0]], sketch, wrong, most)
            for i, j in pairs:
                (a, la), (b, lb) = sorted([(ids[at[i]], label[at[i]]), (ids[at[j]], label[at[j]])])
                out.append((key[at[0]], a, b, min(la, lb), max(la, lb), int(more)))
        release()
        return pa.table({c: pa.array(list(x), pa.int64()) for c, x in zip(("key", "a", "b", "low", "high", "more"), zip(*out) if out else [[]] * 6)})

    return wide.select("slot", *columns, "sketch", "failed").groupBy("slot").applyInArrow(cross, "key long, a long, b long, low long, high long, more long")


def merge(labels: DataFrame, linked: DataFrame) -> DataFrame:
    """Labels (node, component) after components (low, high) were found to be linked."""
    found = components(linked.select(F.col("low").alias("a"), F.col("high").alias("b")))
    step = found.select(F.col("node").alias("component"), F.col("component").alias("to"))
    moved = labels.join(step, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return moved.unionByName(found.join(labels, "node", "left_anti"))


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that are linked. A document with many partners is dealt to many groups, each with its text once."""
    slots = 8 * shuffle_partitions(pairs.sparkSession)
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / VERIFY_GROUP).cast("int").alias("groups"))
    dealt = pairs.join(many, "a").withColumn("slot", F.pmod(F.xxhash64("a", F.pmod(F.xxhash64("b"), F.col("groups"))), F.lit(slots)))
    right = dealt.join(texts.withColumnRenamed("doc_id", "b"), "b").select("slot", "a", F.col("b").alias("id"), "text")
    left = dealt.select("slot", "a").distinct().join(texts.withColumnRenamed("doc_id", "a"), "a").select("slot", "a", F.col("a").alias("id"), "text")

    def check(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        sets = Sets(table.column("text"))
        a, ids = np.asarray(table.column("a")), np.asarray(table.column("id"))
        lead: dict[int, list[int]] = {}
        for i in np.flatnonzero(a == ids):
            lead.setdefault(int(a[i]), []).append(int(i))
        out = set()
        for i in np.flatnonzero(a != ids):
            y = sets.of(int(i))
            for k in lead[int(a[i])]:
                x = sets.of(k)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= 75 * (len(x) + len(y) - both):
                    out.add((int(a[i]), int(ids[i])))
                    break
        del sets
        release()
        return pa.table({c: pa.array(list(x), pa.int64()) for c, x in zip("ab", zip(*sorted(out)) if out else [[]] * 2)})

    return left.unionByName(right).groupBy("slot").applyInArrow(check, "a long, b long")


def linked_components(posts: DataFrame, sketches: DataFrame, texts: DataFrame, same: DataFrame, tile: int = TILE) -> DataFrame:
    """(node, component) of all documents with a link, or with an equal set (``same``: pairs a, b)."""
    links = materialize(verify(star_pairs(posts), texts), "links")
    labels = materialize(components(links.unionByName(same)), "labels")
    rows, failed, most = materialize(offers(posts), "offers"), None, 0
    while True:
        open_ = materialize(open_pairs(open_groups(rows, labels, tile), sketches, failed, most), "open")
        if open_.isEmpty():
            return labels
        if failed is None:
            # At first one pair of two components will do: most are linked.
            tried = open_.groupBy("low", "high").agg(F.min(F.struct("a", "b")).alias("p")).select("p.a", "p.b", "low", "high")
        else:
            tried = open_.groupBy("a", "b").agg(F.min("low").alias("low"), F.min("high").alias("high"))
        tried = materialize(tried, "tried")
        good = materialize(verify(tried.select("a", "b"), texts), "links")
        wrong = tried.select("a", "b").join(good, ["a", "b"], "left_anti")
        failed = materialize(wrong if failed is None else failed.unionByName(wrong), "failed")
        labels = materialize(merge(labels, tried.join(good, ["a", "b"], "left_semi")), "labels")
        # Groups whose named pairs are all in one component by now, or were all that fit, have nothing left to compare.
        most = 16 * most or 16
        for end in ("low", "high"):
            open_ = open_.join(labels.select(F.col("node").alias(end), F.col("component").alias(f"{end}_now")), end, "left")
        still = open_.filter((F.coalesce("low_now", "low") != F.coalesce("high_now", "high")) & (F.col("more") > 0)).select("key").distinct()
        rows = materialize(rows.join(still, "key", "left_semi"), "offers")
        if rows.isEmpty():
            return labels


def near_duplicates(docs: DataFrame, buckets: int | None = None, block_bytes: int = BLOCK_BYTES, tile: int = TILE) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id."""
    table = materialize(shared_parts(docs, buckets, block_bytes), "parts")
    posts = table.filter("payload IS NOT NULL").select("bucket", "payload")
    offering = table.filter("text IS NOT NULL")
    # Rows that share an id are one node, which all their texts stand for.
    texts, sketches = offering.select("doc_id", "text"), offering.select("doc_id", "n_shingles", "sketch")
    same = table.filter("doc_id <> class_id").select(F.col("class_id").alias("a"), F.col("doc_id").alias("b"))
    labels = linked_components(posts, sketches, texts, same, tile)
    rows = table.filter("payload IS NULL").select("doc_id", "n_shingles")
    return rows.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def op5_parity_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
