"""Removal of repeated word windows by prefix-partitioned suffix trees.

A window is ``WINDOW`` consecutive words of one document. Words covered by a window
whose word sequence also starts earlier (smaller doc_id, or earlier in the same
document) are removed; windows are judged on the input.

The suffixes that enter the trees are those that start at a window's least
``PREFIX``-word sequence, by hash: equal windows have it at the same place, so a tree
over these suffixes, with the words before them, finds every repeat. A suffix's prefix
decides its bucket. Suffixes whose prefix occurs once in the corpus, or that lie in an
exact copy of a whole text, are settled before and make no entry. In a bucket, groups
of one prefix are sorted to trees; a group that is too large for memory is split by
the words that follow, as far as all windows of the group contain them. Nodes of
sufficient depth, refined by the words to the left, are the repeats.

Words are compared by 64-bit hashes; two windows that differ are taken as equal only
if all their differing words collide at once.

Defined cases: a null text has no words; a text of fewer than ``WINDOW`` words keeps
all of them; a very long text is read whole, in the slices of its block; of equal windows (ties)
the one of the smallest doc_id, then place, stays; rows that share a doc_id are separate documents, in the order of their
blocks; a null doc_id comes first; an empty table gives an empty result; other columns
are kept, those named n_words, n_removed or kept are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomgene.llm._store import BLOCK_BYTES, answer, ask, finish, shuffle_partitions, to_blocks, with_returns
from loomgene.llm._words import Routes, expand, mix, narrow, sequences, slices, spread, squeeze

WINDOW = 20
PREFIX = 10
TREE_SUFFIXES = 60_000
COPIES, REPEATED, VERDICTS = 0, 1, 2


def _ids(rows: pa.RecordBatch) -> np.ndarray:
    column = rows.column(rows.schema.names.index("doc_id")).cast(pa.int64())
    return np.asarray(column.fill_null(np.iinfo(np.int64).min) if column.null_count else column)


class Fingerprints:
    """Of each text with a window: two hashes of its whole word sequence."""

    def __init__(self, rows: pa.RecordBatch, window: int):
        parts = []
        for lo, _, words in slices(rows.column("text")):
            h = words.hashes()
            out = []
            for source in (h, mix(h ^ np.uint64(0x5851F42D4C957F2D))):
                total = np.zeros(len(h) + 1, np.uint64)
                local = np.arange(len(h), dtype=np.uint64) - words.first[words.doc].astype(np.uint64)
                np.cumsum(mix(source + local * np.uint64(0x9E3779B97F4A7C15)), out=total[1:])
                out.append(mix(total[words.first[1:]] - total[words.first[:-1]]))
            n = np.diff(words.first)
            mine = np.flatnonzero(n >= window)
            parts.append((lo + mine, out[0][mine], out[1][mine]))
        self.row, self.a, self.b = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))


class Suffixes:
    """The suffixes of a block that stand for its windows, document by document."""

    def __init__(self, rows: pa.RecordBatch, window: int, prefix: int, skip: np.ndarray):
        self.words, parts, base = [], [], 0
        reach = window - prefix
        for lo, _, words in slices(rows.column("text")):
            h = words.hashes()
            self.words.append(h)
            n = len(h) - window + 1
            if n > 0:
                start = np.flatnonzero((words.doc[:n] == words.doc[window - 1 :]) & ~skip[lo + words.doc[:n]])
                grams = sequences(h, prefix)
                least, at = grams[:n].copy(), np.zeros(n, np.uint8)
                for j in range(1, reach + 1):
                    other = grams[j : n + j]
                    less = other < least
                    least[less] = other[less]
                    at[less] = j
                place = start + at[start]
                head = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (np.diff(start) != 1)])
                size = np.diff(np.r_[head, len(start)]) if len(start) else head[:0]
                head = head[: len(size)]
                first = start[head]
                doc = words.doc[first]
                # (row, first window's start in its document, windows, words from there to the suffix, hash of the prefix, place in words)
                parts.append((lo + doc, first - words.first[doc], size, place[head] - first, grams[place[head]], base + first))
            base += len(h)
        self.words = np.concatenate(self.words) if self.words else np.zeros(0, np.uint64)
        empty = [np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.int64)]
        self.row, self.start, self.size, self.left, self.key, self.at = (np.concatenate(x) for x in zip(*parts)) if parts else empty


def _copies(_blocks: list[int], payloads: list[bytes]) -> tuple[list[bytes | None], int]:
    """Of each text, whether an equal one comes earlier."""
    sent = [expand(p) for p in payloads]
    a, b, ids = (np.concatenate([s[i] for s in sent]) for i in range(3))
    block = np.repeat(np.array(_blocks, np.int64), [len(s[0]) for s in sent])
    row = np.concatenate([s[3] for s in sent])
    order = np.lexsort((row, block, ids, b, a))
    later = np.zeros(len(a), np.uint8)
    later[order[1:]] = (a[order[1:]] == a[order[:-1]]) & (b[order[1:]] == b[order[:-1]])
    return _cut(later, [len(s[0]) for s in sent]), COPIES


def _cut(values: np.ndarray, sizes: list[int]) -> list[bytes | None]:
    """Each block's part, where it says anything."""
    ends = np.cumsum(sizes)
    return [squeeze(narrow(v)) if v.any() else None for v in (values[e - n : e] for e, n in zip(ends, sizes))]


def _repeated(_blocks: list[int], payloads: list[bytes]) -> tuple[list[bytes | None], int]:
    """Of each prefix, whether it occurs again anywhere."""
    sent = [expand(p)[0] for p in payloads]
    keys = np.concatenate(sent)
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    again = np.zeros(len(keys), np.uint8)
    again[order[1:]] |= same
    again[order[:-1]] |= same
    return _cut(again, [len(s) for s in sent]), REPEATED


def tree_verdicts(key, size, left, words, lengths, rank, window: int, prefix: int) -> np.ndarray:
    """For each suffix a bit per window: set if the same window comes earlier by ``rank``.

    ``words`` holds, suffix after suffix, the words of all its windows; ``left`` of them stand before the suffix.
    """
    reach = window - prefix
    start = np.cumsum(lengths) - lengths
    out = np.zeros(len(key), np.uint64)
    origin = start + left  # where the suffix itself begins
    end = start + lengths

    def word(rows: np.ndarray, step: int) -> np.ndarray:
        """The word ``step`` places from the suffix's begin; 0 outside of what its windows cover."""
        at = origin[rows] + step
        ok = (at >= start[rows]) & (at < end[rows])
        return np.where(ok, words[np.where(ok, at, 0)], np.uint64(0))

    def grow(rows: np.ndarray) -> None:
        """Sort the suffixes of whole prefix groups; runs that share enough words are the deep nodes."""
        right = np.stack([word(rows, step) for step in range(prefix, window)])
        order = np.lexsort((*right[::-1], key[rows]))
        rows, right = rows[order], right[:, order]
        differ = np.r_[True, key[rows[1:]] != key[rows[:-1]]]
        before = np.zeros(len(rows), np.uint64)
        nodes = {window - reach: np.cumsum(differ)}  # depth -> node of each suffix
        for depth in range(prefix + 1, window + 1):
            column = right[depth - prefix - 1]
            differ = differ | np.r_[True, column[1:] != column[:-1]]
            nodes[depth] = np.cumsum(differ)
        for o in range(reach + 1):
            if o:
                before = mix(before * np.uint64(0xD1342543DE82EF95) + word(rows, -o))
            mine = np.flatnonzero((left[rows] >= o) & (left[rows] - o < size[rows]))
            if len(mine) < 2:
                continue
            node, side = nodes[window - o][mine], before[mine]
            if not o:
                side = np.zeros(len(mine), np.uint64)
            by = np.lexsort((rank[rows[mine]], side, node))
            same = (node[by[1:]] == node[by[:-1]]) & (side[by[1:]] == side[by[:-1]])
            late = rows[mine[by[1:][same]]]
            out[late] |= np.uint64(1) << (left[late] - o).astype(np.uint64)

    # Variable-length prefixes: groups of one prefix, packed up to the memory bound.
    order = np.argsort(key, kind="stable")
    heads = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]]) if len(order) else np.zeros(0, np.int64)
    ends = np.r_[heads[1:], len(order)]
    a = 0
    for i, e in enumerate(ends):
        if i + 1 == len(ends) or ends[i + 1] - heads[a] > TREE_SUFFIXES:
            rows = order[heads[a] : e]
            if len(rows) <= TREE_SUFFIXES:
                grow(rows)
            else:
                # One prefix alone is too large: windows are split by their own further words, a tree per place of the prefix in them.
                split(rows, key, size, left, origin, words, rank, out, window, reach)
            a = i + 1
    return out


def split(rows, key, size, left, origin, words, rank, out, window: int, reach: int) -> None:
    """The windows of one prefix, for each of its places a sort by the whole window in parts that fit in memory."""
    for o in range(reach + 1):
        mine = rows[(left[rows] >= o) & (left[rows] - o < size[rows])]
        whole = np.zeros(len(mine), np.uint64)
        check = np.zeros(len(mine), np.uint64)
        for step in range(window):
            w = words[origin[mine] - o + step]
            whole = mix(whole * np.uint64(0xD1342543DE82EF95) + w)
            check = mix(check + w * np.uint64(0x9E3779B97F4A7C15))
        by = np.lexsort((rank[mine], check, whole))
        same = (whole[by[1:]] == whole[by[:-1]]) & (check[by[1:]] == check[by[:-1]])
        late = mine[by[1:][same]]
        out[late] |= np.uint64(1) << (left[late] - o).astype(np.uint64)


def remove_repeats(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, buckets: int | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All columns of ``docs`` with n_words, n_removed and kept, the words left, joined by one space."""
    if not 0 < prefix <= window <= prefix + 63:
        raise ValueError("the prefix must be shorter than the window")
    n = buckets or shuffle_partitions(docs.sparkSession)
    docs = docs.drop(*[c for c in ("n_words", "n_removed", "kept") if c in docs.columns])
    blocks = to_blocks(docs, block_bytes=block_bytes)

    def copy_mask(rows: pa.RecordBatch, returns) -> np.ndarray:
        mask = np.zeros(rows.num_rows, bool)
        if returns.get(COPIES):
            prints = Fingerprints(rows, window)
            mask[prints.row] = Routes(prints.a, n).back({b: expand(v)[0] for b, v in returns[COPIES].items()}, np.uint8) > 0
        return mask

    def firsts(suffixes: Suffixes, flagged: np.ndarray, rows: pa.RecordBatch):
        """Entries that go on: of equal ones in a block the first; and for the others, which entry they equal."""
        picked = np.flatnonzero(flagged)
        lengths = suffixes.size[picked] + window - 1
        flat = suffixes.words[spread(suffixes.at[picked], lengths)]
        ends = np.cumsum(lengths)
        local = np.arange(len(flat)) - np.repeat(ends - lengths, lengths)
        total = np.r_[np.uint64(0), np.cumsum(mix(flat + local.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))].astype(np.uint64)
        whole = mix(total[ends] - total[ends - lengths])
        side = suffixes.key[picked] ^ mix(suffixes.left[picked].astype(np.uint64) * np.uint64(64) + suffixes.size[picked].astype(np.uint64))
        ids = _ids(rows)[suffixes.row[picked]]
        order = np.lexsort((suffixes.start[picked], suffixes.row[picked], ids, side, whole))
        fresh = np.r_[True, (whole[order][1:] != whole[order][:-1]) | (side[order][1:] != side[order][:-1])] if len(order) else np.zeros(0, bool)
        return picked, picked[np.sort(order[fresh])], np.setdiff1d(picked, picked[order[fresh]])

    def ask_copies(_block, rows, _returns):
        prints = Fingerprints(rows, window)
        ids = _ids(rows)
        for b, mine in Routes(prints.a, n):
            yield b, COPIES, squeeze(prints.a[mine], prints.b[mine], ids[prints.row[mine]], narrow(prints.row[mine]))

    def ask_prefixes(_block, rows, returns):
        suffixes = Suffixes(rows, window, prefix, copy_mask(rows, returns))
        for b, mine in Routes(suffixes.key, n):
            yield b, REPEATED, squeeze(suffixes.key[mine])

    def flags(suffixes: Suffixes, returns) -> np.ndarray:
        return Routes(suffixes.key, n).back({b: expand(v)[0] for b, v in returns.get(REPEATED, {}).items()}, np.uint8) > 0

    def ask_trees(_block, rows, returns):
        suffixes = Suffixes(rows, window, prefix, copy_mask(rows, returns))
        _, sent, _ = firsts(suffixes, flags(suffixes, returns), rows)
        ids = _ids(rows)
        for b, at in Routes(suffixes.key[sent], n):
            mine = sent[at]
            lengths = suffixes.size[mine] + window - 1
            flat = suffixes.words[spread(suffixes.at[mine], lengths)]
            yield b, VERDICTS, squeeze(suffixes.key[mine], ids[suffixes.row[mine]], narrow(suffixes.row[mine]), narrow(suffixes.start[mine]), narrow(suffixes.size[mine]), narrow(suffixes.left[mine]), flat)

    def reply_trees(block_ids, payloads):
        sent = [expand(p) for p in payloads]
        key, ids = (np.concatenate([s[i] for s in sent]) for i in (0, 1))
        row, start, size, left = (np.concatenate([s[i] for s in sent]).astype(np.int64) for i in (2, 3, 4, 5))
        words = np.concatenate([s[6] for s in sent])
        counts = [len(s[0]) for s in sent]
        block = np.repeat(np.array(block_ids, np.int64), counts)
        # Earlier is: smaller doc_id, then place of the row, then start. Windows of one suffix keep their distance from it.
        rank = np.empty(len(key), np.int64)
        rank[np.lexsort((start + left, row, block, ids))] = np.arange(len(key))
        return _cut(tree_verdicts(key, size, left, words, size + window - 1, rank, window, prefix), counts), VERDICTS

    copies = answer(ask(blocks, ask_copies), _copies)
    repeated = answer(ask(with_returns(blocks, copies), ask_prefixes), _repeated)
    known = copies.unionByName(repeated)
    verdicts = answer(ask(with_returns(blocks, known), ask_trees), reply_trees)

    def settle(_block, rows, returns):
        copied = copy_mask(rows, returns)
        suffixes = Suffixes(rows, window, prefix, copied)
        _, sent, same = firsts(suffixes, flags(suffixes, returns), rows)
        bits = np.zeros(len(suffixes.key), np.uint64)
        bits[sent] = Routes(suffixes.key[sent], n).back({b: expand(v)[0] for b, v in returns.get(VERDICTS, {}).items()}, np.uint64)
        bits[same] = ~np.uint64(0)
        n_words, n_removed, kept = [], [], []
        edge = np.zeros(len(suffixes.words) + window + 1, np.int32)
        for j in range(int(suffixes.size.max()) if len(suffixes.size) else 0):
            at = suffixes.at[((bits >> np.uint64(j)) & np.uint64(1)).astype(bool) & (suffixes.size > j)] + j
            np.add.at(edge, at, 1)
            np.add.at(edge, at + window, -1)
        covered = np.cumsum(edge)[: len(suffixes.words)] > 0
        base = 0
        for lo, hi, words in slices(rows.column("text")):
            keep = ~(covered[base : base + len(words)] | copied[lo + words.doc])
            base += len(words)
            left = np.flatnonzero(keep)
            data = np.r_[words.data, np.uint8(32)]
            lengths = words.ends[left] - words.starts[left] + 1
            index = spread(words.starts[left], lengths)
            ends = np.cumsum(lengths)
            index[ends - 1] = len(words.data)
            text = data[index].tobytes()
            count = np.bincount(words.doc[left], minlength=hi - lo)
            bound = np.r_[0, ends][np.r_[0, np.cumsum(count)]]
            total = np.diff(words.first)
            n_words += total.tolist()
            n_removed += (total - count).tolist()
            kept += [text[a : max(a, b - 1)].decode() for a, b in zip(bound[:-1], bound[1:])]
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=[*rows.schema.names, "n_words", "n_removed", "kept"])

    schema = StructType(list(docs.schema.fields)).add("n_words", "long").add("n_removed", "long").add("kept", "string")
    return finish(with_returns(blocks, known.unionByName(verdicts)), settle, schema)


def op9_repeat_trees(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, CAST(greatest(len(w) - 18, 1) AS BIGINT))) AS i FROM t),
x AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 19), ' ') AS g FROM s),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS n FROM x),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM r WHERE n > 1),
p AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id),
k AS (SELECT t.doc_id, len(w) AS n, len(coalesce(gone, [])) AS m, gone, w FROM t LEFT JOIN p USING (doc_id)),
u AS (SELECT doc_id, unnest(w) AS v, generate_subscripts(w, 1) AS i FROM t),
j AS (SELECT u.doc_id, string_agg(v, ' ' ORDER BY u.i) AS kept FROM u ANTI JOIN c ON u.doc_id = c.doc_id AND u.i = c.i GROUP BY u.doc_id)
SELECT k.doc_id, CAST(n AS BIGINT) AS n_words, CAST(m AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM k LEFT JOIN j USING (doc_id)"""
