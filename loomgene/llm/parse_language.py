"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is completed to a table that
parses any text greedily into longest matches: a missing transition ends a phrase.
The language whose text needs the fewest phrases, times the log of its training
length, wins. Texts are parsed in blocks of ``CHUNK`` letters side by side, all
languages at once, as if each block began a phrase; then every block is parsed again from
the state in which the one before it ends, until both parses meet, mostly after a few
letters. So a text's phrases are those of one parse from its first letter to its last.

Learning is from a bounded sample: of each language the ``SAMPLE_DOCS`` labelled
rows of smallest id hash give ``SAMPLE_CHARS`` characters each. Prediction reads
whole texts, and nothing else.

Defined cases: a null text or one without a letter is ``und`` with score 0, and so
is every text if nothing could be learned; rows without label or text teach nothing;
equal costs go to the first language in code-point order; a null doc_id counts as
an empty string for the fold; repeated rows are each predicted; a very long text is parsed
whole; of more than ``MAX_LANGUAGES`` labels those with the most rows are learned, of equal
ones the first by name; an empty table gives an empty result; columns that clash with the
result's are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomgene.llm._store import Tidy, held
from loomgene.llm._words import LOWER, buffers

SAMPLE_DOCS = 80
SAMPLE_CHARS = 300
MAX_LANGUAGES = 200
CHUNK = 256
SLICE = 1 << 20
#: States held at once while lanes are joined.
PANEL = 1 << 22
#: A block is clearly foreign if another language needs this share less than its label's.
CLEAR = 0.15


def id_crc(column: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def letters(data: np.ndarray) -> np.ndarray:
    """Lower-case letters as they are, bytes of other scripts as they are, all else 32; accented Latin-1 capitals lowered."""
    out = LOWER[data]
    low = (out < 97) | ((out > 122) & (out < 128))
    out[low] = 32
    if len(out) > 1:
        capital = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        out[capital] += 0x20
    return out


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the minimal automaton of all substrings."""
    after: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(after)
        after.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in after[p]:
            after[p][c] = new
            p = link[p]
        if p >= 0:
            q = after[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(after)
                after.append(dict(after[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and after[p].get(c) == q:
                    after[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return after


class Parser:
    """Completed automata of all languages in one table: entry = next row's offset * 4 + phrases ended."""

    def __init__(self, samples: dict[str, list[str]]):
        texts = {}
        for lang in sorted(samples):
            raw = letters(np.frombuffer("\n".join(samples[lang]).encode(), np.uint8))
            raw = raw[~((raw == 32) & np.r_[False, raw[:-1] == 32])]
            if len(raw) > 1:
                texts[lang] = raw.tobytes()
        self.langs = list(texts)
        seen = sorted({b for t in texts.values() for b in t})
        self.classes = np.full(256, len(seen), np.uint8)  # the last but one class: never seen
        self.classes[seen] = np.arange(len(seen))
        width = self.width = len(seen) + 2
        self.pad = width - 1
        tables, self.roots, base = [], [], 0
        for text in texts.values():
            after = suffix_automaton(text)
            n = len(after)
            table = np.empty((n, width), np.int64)
            root = np.full(width, base * width * 4 + 2, np.int64)
            for c, to in after[0].items():
                root[self.classes[c]] = (base + to) * width * 4 + 1
            table[:] = root
            rows = [s for s, t in enumerate(after) for _ in t]
            table[rows, self.classes[[c for t in after for c in t]]] = (base + np.array([to for t in after for to in t.values()])) * width * 4
            table[0][table[0] == base * width * 4 + 2] -= 1  # at the root no phrase is open
            table[:, self.pad] = (base + np.arange(n)) * width * 4
            tables.append(table.astype(np.int32) if (base + n) * width * 4 < 2**31 else table)
            self.roots.append(base * width)
            base += n
        kind = np.int32 if base * width * 4 < 2**31 else np.int64
        self.table = np.concatenate(tables).astype(kind).ravel() if tables else np.zeros(0, kind)
        self.start = np.array(self.roots, kind)[:, None]
        self.weight = np.array([math.log2(len(t)) for t in texts.values()])

    def phrases(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Phrases per language and document."""
        count, owner, _ = self.blocks(data, offsets)
        return self._per_document(count, owner, len(offsets) - 1)

    def _per_document(self, count: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        return np.array([np.bincount(owner, weights=c, minlength=n) for c in count]).astype(np.int64).reshape(len(self.langs), n)

    def blocks(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases that end in each block, per language; each block's document; its number of letters."""
        n = len(offsets) - 1
        if not len(data) or not self.langs:
            return np.zeros((len(self.langs), 0), np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        plain = letters(data)
        doc = np.repeat(np.arange(n), np.diff(offsets))
        keep = ~((plain == 32) & np.r_[False, (plain[:-1] == 32) & (doc[1:] == doc[:-1])])
        plain, doc = self.classes[plain[keep]], doc[keep]
        sizes = np.bincount(doc, minlength=n)
        at = np.arange(len(plain)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        lanes = -(-sizes // CHUNK)
        lane = np.repeat(np.cumsum(lanes) - lanes, sizes) + at // CHUNK
        grid = np.full((CHUNK, int(lanes.sum())), self.pad, np.uint8)
        grid[at % CHUNK, lane] = plain
        owner, size = np.repeat(np.arange(n), lanes), np.bincount(lane, minlength=grid.shape[1])
        count, end = self._lanes(grid, owner)
        last = np.flatnonzero(np.r_[owner[1:] != owner[:-1], True]) if len(owner) else np.zeros(0, np.int64)
        count[:, last] += (end != self.start)[:, last]  # the phrase that the text's end cuts off
        return count, owner, size

    def _lanes(self, grid: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases that end in each lane, and the state at its end, by language; a lane goes on from the state of the one before it."""
        step = max(1, PANEL // (CHUNK * len(self.langs)))
        parts, before = [], None
        for lo in range(0, grid.shape[1], step):
            going_on = before is not None and owner[lo] == owner[lo - 1]
            parts.append(self._panel(grid[:, lo : lo + step], owner[lo : lo + step], before if going_on else None))
            before = parts[-1][1][:, -1:]
        return tuple(np.concatenate(x, axis=1) for x in zip(*parts)) if parts else (np.zeros((len(self.langs), 0), np.int32),) * 2

    def _panel(self, grid: np.ndarray, owner: np.ndarray, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """As ``_lanes`` for some lanes; the first goes on from the state ``before``, if given."""
        wide = grid.shape[1]
        state = np.repeat(self.start, wide, axis=1)
        count = np.zeros(state.shape, np.int32)
        trail = np.empty((len(grid), *state.shape), state.dtype)
        sums = np.empty((len(grid), *state.shape), np.int16)
        for t, row in enumerate(grid):
            step = self.table[state + row]
            count += step & 3
            state = step >> 2
            trail[t], sums[t] = state, count
        end = state.copy()
        follows = np.r_[[0] if before is not None else [], np.flatnonzero(owner[1:] == owner[:-1]) + 1].astype(np.int64)
        lang, lane = (x.ravel() for x in np.meshgrid(np.arange(len(self.langs)), follows, indexing="ij"))
        entered = np.repeat(self.start, wide, axis=1)  # the state in which each lane was last entered
        while True:
            now = end[lang, lane - 1]
            if before is not None:
                now = np.where(lane == 0, before[lang, 0], now)
            new = now != entered[lang, lane]
            lang, lane, now = lang[new], lane[new], now[new]
            if not len(lane):
                return count, end
            entered[lang, lane] = now
            at, seen = np.arange(len(lane)), np.zeros(len(lane), np.int32)
            for t, row in enumerate(grid):
                step = self.table[now + row[lane[at]]]
                seen += step & 3
                now = step >> 2
                met = now == trail[t, lang[at], lane[at]]
                if met.any():
                    # From here on both parses are one.
                    i, j = lang[at[met]], lane[at[met]]
                    count[i, j] = seen[met] + sums[-1, i, j] - sums[t, i, j]
                    end[i, j] = trail[-1, i, j]
                    at, seen, now = at[~met], seen[~met], now[~met]
                    if not len(at):
                        break
            count[lang[at], lane[at]], end[lang[at], lane[at]] = seen, now
            # Only the lanes behind those that were parsed again can be entered in another state.
            behind = (lane + 1 < wide) & (owner[np.minimum(lane + 1, wide - 1)] == owner[lane])
            lang, lane = lang[behind], lane[behind] + 1

    def predict(self, column: pa.Array, labels: list[str | None] | None = None) -> tuple[list[str], list[float], np.ndarray]:
        """Language and score of each text; and the share of its letters in blocks that clearly aren't in its label's language (0 for labels not learned)."""
        data, offsets = buffers(column)
        n = len(offsets) - 1
        cost = np.zeros((len(self.langs), n))
        letter = np.zeros(n, bool)
        foreign = np.zeros(n)
        place = {lang: i for i, lang in enumerate(self.langs)}
        label = np.array([place.get(x, -1) for x in labels or [None] * n], np.int64)
        lo = 0
        while lo < n:
            hi = min(n, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE, "right")) - 1))
            part, bounds = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            count, owner, size = self.blocks(part, bounds)
            cost[:, lo:hi] = self._per_document(count, owner, hi - lo)
            if labels is not None and len(owner):
                each = count * self.weight[:, None]
                mine = label[lo:hi][owner]
                least, own = each.min(axis=0), each[mine, np.arange(len(mine))]
                clear = (mine >= 0) & (least < own) & (least <= (1 - CLEAR) * own)
                foreign[lo:hi] = np.bincount(owner, size * clear, hi - lo) / np.maximum(1, np.bincount(owner, size, hi - lo))
            ascii_letter = np.r_[0, np.cumsum((LOWER[part] >= 97) & (LOWER[part] <= 122))]
            letter[lo:hi] = ascii_letter[bounds[1:]] > ascii_letter[bounds[:-1]]
            lo = hi
        for i in np.flatnonzero(~letter):
            letter[i] = any(map(str.isalpha, data[offsets[i] : offsets[i + 1]].tobytes().decode(errors="ignore")))
        if not self.langs:
            return ["und"] * n, [0.0] * n, foreign
        cost *= self.weight[:, None]
        best = cost.argmin(axis=0)
        least = cost[best, np.arange(n)]
        rest = np.partition(cost, 1, axis=0)[1] if len(self.langs) > 1 else np.full(n, np.inf)
        score = np.where(rest > 0, 1 - least / np.where(rest > 0, rest, 1), 0.0)
        return [self.langs[b] if ok else "und" for b, ok in zip(best, letter)], [float(s) if ok else 0.0 for s, ok in zip(score, letter)], foreign


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS, languages: int = MAX_LANGUAGES) -> dict[str, list[str]]:
    """language -> sample texts. At most languages * sample_docs * sample_chars characters reach the driver."""
    rows = docs.filter((F.pmod(id_crc(), F.lit(4)) != 2) & F.col("lang").isNotNull() & F.col("text").rlike("[^\\x00-@\\[-`{-\\x7F]"))
    cut = rows.select("lang", F.xxhash64("doc_id").alias("h"), F.substring("text", 1, sample_chars).alias("cut"))
    ranked = cut.withColumn("n", F.row_number().over(W.partitionBy("lang").orderBy("h", "cut"))).filter(F.col("n") <= sample_docs)
    found: dict[str, list[str]] = {}
    for row in ranked.orderBy("lang", "n").limit(languages * sample_docs + 1).toLocalIterator():
        found.setdefault(row["lang"], []).append(row["cut"])
    if len(found) <= languages and sum(map(len, found.values())) <= languages * sample_docs:
        return found
    most = rows.groupBy("lang").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "lang").limit(languages)
    found = {}
    for row in ranked.join(F.broadcast(most.select("lang")), "lang").orderBy("lang", "n").toLocalIterator():
        found.setdefault(row["lang"], []).append(row["cut"])
    return found


def identify(docs: DataFrame, samples: dict[str, list[str]] | None = None, label: str | None = None) -> DataFrame:
    """All columns of ``docs`` with held_out, lang_pred and score, and with ``label``, a column, foreign; columns of these names are replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs) if samples is None else samples)
    clash = [c for c in ("held_out", "lang_pred", "score", *(["foreign"] if label else [])) if c in docs.columns]
    rows = docs.drop(*clash).withColumn("held_out", F.pmod(id_crc(), F.lit(4)) == 2)
    place = rows.columns.index("text")
    tag = rows.columns.index(label) if label else None

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples = sent.value
        key = hash(tuple((k, *v) for k, v in sorted(samples.items())))
        parser = held(("parser", key), lambda: Parser(samples))
        for batch in batches:
            langs, scores, foreign = parser.predict(batch.column(place), None if tag is None else batch.column(tag).to_pylist())
            more = {"lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64())} | ({"foreign": pa.array(foreign, pa.float64())} if label else {})
            yield pa.RecordBatch.from_arrays([*batch.columns, *more.values()], names=[*batch.schema.names, *more])

    schema = StructType(list(rows.schema.fields)).add("lang_pred", "string").add("score", "double")
    schema = schema.add("foreign", "double") if label else schema
    return rows.mapInArrow(Tidy(predict), schema)


def op2_parse_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    samples = learn(docs)
    return identify(docs.select("doc_id", "text"), samples).select("doc_id", "held_out", "lang_pred", "score")
