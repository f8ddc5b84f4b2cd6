"""Line dedup by a log-template tree.

Lines of at least ``MIN_TOKENS`` tokens go down a tree of fixed depth: by their number
of tokens and their leading tokens, those with digits masked. In a leaf, lines that
agree in at least ``SIMILARITY`` of their tokens share a template, in which the tokens
that differ are variable fields. A template that occurs in at least ``MIN_DOCS``
documents recurs: its lines are dropped from all documents but the first (the one of
smallest doc_id). Shorter lines, where the queries let them take part, recur if they are
equal token by token, digits included, in as many documents.

Digests of all lines tell which leaves have enough documents; only the lines of those are
sent, found again in the texts by a bitmap of leaves. Equal lines are counted before they meet in a leaf, so the share of a line in the
corpus doesn't matter there. A leaf's lines come sorted, a batch at a time; only its
templates are held. Where they are many, a line is compared with those that share one of
its rarest tokens: to agree in 75 % of f tokens a template must have one of any f // 4 + 1
of them (pigeonhole), so this leaves out none, and a leaf's size doesn't change results.

Defined cases: a null text has no lines and stays null; lines of fewer than ``min_tokens`` tokens are
never dropped, nor lines of fewer than ``MIN_TOKENS`` tokens without a letter;
lines are parted by line feeds; very long texts and lines are taken whole; in a leaf, lines are taken by falling document count
and then by their tokens, so results don't depend on the order of input; rows that share
a doc_id are one document; null counts as one id, before all others; an empty table
gives an empty result; other columns are kept, those named n_lines, n_dropped or kept
are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomgene.llm._store import Tidy, discard, materialize

MIN_TOKENS = 4
LEADING = 3
SIMILARITY = 0.75
MIN_DOCS = 20
#: Templates that a leaf compares one by one; of the others blocks of this size or more are indexed. Results don't depend on it.
PLAIN = 256
#: Bits of the map of leaves whose lines are sent, by the first bits of their digests, in pieces of 2^15. A full map lets all lines through; results don't depend on it.
MAP_BITS = 25
PIECE_BITS = 15
FIELD = "<*>"
_DIGIT = regex.compile(r"\S*[0-9]\S*")
_NO_ID = -(2**63)


def masked(line: str) -> str:
    """The line's tokens with one space between them; those with digits are variable."""
    return _mask(" ".join(line.split()))


def _mask(plain: str) -> str:
    return _DIGIT.sub(FIELD, plain) if any(map(str.isdigit, plain)) else plain


def _digest(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - 2**63


def _texts(batch: pa.RecordBatch, *places: int, rows: int = 256) -> Iterator[tuple]:
    """Rows of a batch as Python values, a few at a time."""
    for a in range(0, batch.num_rows, rows):
        yield from zip(*(batch.column(i).slice(a, rows).to_pylist() for i in places))


def _reduced(line: str, min_tokens: int) -> str | None:
    """The line as it is compared: masked, or if it is short token by token; None if it can't be dropped."""
    out = " ".join(line.split())
    size = out.count(" ") + 1 if out else 0
    if size >= MIN_TOKENS:
        return _mask(out) if size >= min_tokens else None
    return out if size >= min_tokens and any(map(str.isalpha, out)) else None


def _document_lines(text: str | None, min_tokens: int) -> set[str]:
    """The lines of a text that can be dropped, as they are compared."""
    return {x for x in (_reduced(line, min_tokens) for line in text.split("\n")) if x is not None} if text else set()


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc"), F.col("text").cast("string").alias("text"))


def _leaf(plain: str) -> int:
    return _digest("\x1f".join([str(plain.count(" ")), *plain.split(" ", LEADING)[:LEADING]]))


def occurrences(docs: DataFrame, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """(doc, line, leaf): each masked line of a document once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(doc, _digest(x), _leaf(x)) for doc, text in _texts(batch, 0, 1) for x in _document_lines(text, min_tokens)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc", "line", "leaf"])

    return _keyed(docs).mapInArrow(Tidy(run), "doc long, line long, leaf long")


def _place(leaf: int) -> int:
    return (leaf + 2**63) >> (64 - MAP_BITS)


def leaf_map(leaves: DataFrame) -> bytes:
    """A bit for each place that a leaf (leaf) falls on, made in pieces by the executors; of fixed size, whatever the number of leaves."""
    size = 1 << PIECE_BITS
    at = F.shiftrightunsigned("leaf", 64 - MAP_BITS).bitwiseXOR(F.lit(1 << (MAP_BITS - 1)))

    def fill(table: pa.Table) -> pa.Table:
        bits = np.zeros(size, np.uint8)
        bits[table.column("at").to_numpy() % size] = 1
        return pa.table({"piece": table.column("piece")[:1], "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    places = leaves.select(at.alias("at")).distinct().select(F.shiftright("at", PIECE_BITS).alias("piece"), "at")
    out = bytearray(1 << (MAP_BITS - 3))
    for r in places.groupBy("piece").applyInArrow(fill, "piece long, bits binary").collect():
        out[r["piece"] * size // 8 : (r["piece"] + 1) * size // 8] = r["bits"]
    return bytes(out)


def distinct_lines(docs: DataFrame, min_tokens: int = MIN_TOKENS, leaves: bytes | None = None) -> DataFrame:
    """(leaf, line, masked, docs): each masked line of the corpus, with its number of documents; with a ``leaf_map`` only lines whose leaf may be in it.

    A document that comes as several rows counts for each here, which only lets more leaves through. Leaves of too few documents only cost time.
    """
    sent = docs.sparkSession.sparkContext.broadcast(leaves)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for (text,) in _texts(batch, 1):
                for plain in _document_lines(text, min_tokens):
                    leaf = _leaf(plain)
                    if held is not None and not held[(at := _place(leaf)) >> 3] >> (at & 7) & 1:
                        continue
                    rows.append((_digest(plain), leaf, plain))
                    size += len(plain)
                if size > 1 << 20:
                    yield _lines(rows)
                    rows, size = [], 0
            if rows:
                yield _lines(rows)

    found = _keyed(docs).mapInArrow(Tidy(run), "line long, leaf long, masked string")
    return found.groupBy("leaf", "line").agg(F.min("masked").alias("masked"), F.count("*").alias("docs"))


def _lines(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["line", "leaf", "masked"])


class Leaf:
    """Templates of one leaf, grown line by line. A template's name is its first line."""

    def __init__(self, width: int):
        self.width = width
        self.number: dict[str, int] = {FIELD: 0}
        self.templates = np.zeros((0, width), np.int32)
        self.names: list[int] = []
        self.indexed = 0
        #: (sorted keys of token and place, templates that began with them), each block more than twice the next.
        self.blocks: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, line: int, text: str) -> int:
        """The template that the line joins or begins."""
        number = self.number
        tokens = np.array([number.setdefault(t, len(number)) for t in text.split(" ")], np.int32)
        least = SIMILARITY * max(1, int((tokens != 0).sum()))
        n = len(self.names)
        if n:
            at = self._candidates(tokens)
            found = self.templates[:n] if at is None else self.templates[at]
            # A variable field agrees with nothing, so templates don't grow ever wider.
            same = ((found == tokens) & (tokens != 0)).sum(axis=1)
            fields = (found == 0).sum(axis=1)
            if len(same) and same[best := int(np.lexsort((-fields, same))[-1])] >= least:
                best = best if at is None else int(at[best])
                self.templates[best][self.templates[best] != tokens] = 0
                return self.names[best]
        if n == len(self.templates):
            self.templates = np.vstack([self.templates, np.zeros((max(16, n), self.width), np.int32)])
        self.templates[n] = tokens
        self.names.append(line)
        if n + 1 - self.indexed == PLAIN:
            self._index()
        return line

    def _index(self) -> None:
        rows = self.templates[self.indexed : len(self.names), LEADING:]
        row, place = np.nonzero(rows)
        keys, owner = rows[row, place].astype(np.int64) * self.width + place, (row + self.indexed).astype(np.int32)
        self.indexed = len(self.names)
        while True:
            order = np.argsort(keys, kind="stable")
            keys, owner = keys[order], owner[order]
            if not self.blocks or len(self.blocks[-1][0]) > 2 * len(keys):
                break
            more, whose = self.blocks.pop()
            keys, owner = np.r_[more, keys], np.r_[whose, owner]
        self.blocks.append((keys, owner))

    def _candidates(self, tokens: np.ndarray) -> np.ndarray | None:
        """Templates that may agree well enough, in order; None for all. Leading tokens are the leaf's and tell nothing."""
        place = np.flatnonzero(tokens[LEADING:])
        fixed = int((tokens != 0).sum())
        probes = fixed - math.ceil(SIMILARITY * fixed) + 1
        if not self.blocks or len(place) < probes:
            return None
        keys = tokens[LEADING:][place].astype(np.int64) * self.width + place
        spans = [(np.searchsorted(block, keys, "left"), np.searchsorted(block, keys, "right")) for block, _ in self.blocks]
        rarest = np.argsort(sum(hi - lo for lo, hi in spans), kind="stable")[:probes]
        found = [owner[lo[i] : hi[i]] for (lo, hi), (_, owner) in zip(spans, self.blocks) for i in rarest]
        return np.unique(np.concatenate([*found, np.arange(self.indexed, len(self.names), dtype=np.int32)]))


def leaf_templates(lines: list[tuple[int, str, int]]) -> list[tuple[int, int]]:
    """(line, template) for the (line, masked text, documents) of one leaf."""
    leaf = Leaf(len(lines[0][1].split(" ")))
    return [(line, leaf.add(line, text)) for line, text, _ in sorted(lines, key=lambda x: (-x[2], x[1]))]


def templates_of(lines: DataFrame) -> DataFrame:
    """(line, template) of the distinct lines (line, leaf, masked, docs).

    No join on the leaf may stand below the exchange: Spark would take the exchange out, and adaptive execution then parts a leaf's lines.
    """

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, grown = None, {}
        for batch in batches:
            found = []
            for leaf, line, text in _texts(batch, 0, 1, 2):
                if leaf != at:
                    at, grown = leaf, {}
                width = text.count(" ") + 1  # differs within a leaf if digests collide
                if width not in grown:
                    grown[width] = Leaf(width)
                found.append((line, grown[width].add(line, text)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["line", "template"])

    rows = lines.select("leaf", "line", "masked", "docs").repartition("leaf")
    rows = rows.sortWithinPartitions("leaf", F.desc("docs"), "masked").select("leaf", "line", "masked")
    return rows.mapInArrow(Tidy(grow), "line long, template long")


def recurring_lines(docs: DataFrame, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """(doc, line): lines to drop; as often as rows share a doc.

    What recurs is written before the join, so that both of its sides are plain exchanges: a template that is in a large
    share of the documents can then be split by adaptive execution, or its short table broadcast if that is small.
    """
    found = materialize(occurrences(docs, min_tokens), "occurrences")
    leaves = leaf_map(found.groupBy("leaf").agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_DOCS).select("leaf"))
    lines = materialize(distinct_lines(docs, min_tokens, leaves), "lines")
    named = materialize(templates_of(lines), "templates")
    uses = materialize(found.join(named, "line").select("doc", "line", "template"), "uses")
    for table in (found, lines, named):
        discard(table)
    counts = uses.select("template", "doc").distinct().groupBy("template").agg(F.count("*").alias("n"), F.min("doc").alias("first"))
    recurring = materialize(counts.filter(F.col("n") >= MIN_DOCS).select("template", "first"), "recurring")
    return uses.join(recurring, "template").filter(F.col("doc") != F.col("first")).select("doc", "line")


def drop_recurring(docs: DataFrame, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """All columns of ``docs`` with n_lines, n_dropped and kept, the text without its recurring lines."""
    docs = docs.drop(*[c for c in ("n_lines", "n_dropped", "kept") if c in docs.columns])
    gone = recurring_lines(docs, min_tokens).groupBy("doc").agg(F.collect_set("line").alias("__gone"))
    keyed = docs.withColumn("__doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)))
    joined = keyed.join(gone.withColumnRenamed("doc", "__doc"), "__doc", "left").drop("__doc")
    names = docs.columns
    place = names.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, dropped, kept = [], [], []
            for text, gone in _texts(batch, place, len(names)):
                lines = text.split("\n") if text is not None else []
                left = lines
                if gone:
                    gone = set(gone)
                    left = [x for x in lines if (plain := _reduced(x, min_tokens)) is None or _digest(plain) not in gone]
                total.append(len(lines))
                dropped.append(len(lines) - len(left))
                kept.append(text if len(left) == len(lines) else "\n".join(left))
            columns = [c for c, name in zip(batch.columns, batch.schema.names) if name != "__gone"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())], names=[*names, "n_lines", "n_dropped", "kept"])

    schema = StructType(list(docs.schema.fields)).add("n_lines", "long").add("n_dropped", "long").add("kept", "string")
    return joined.mapInArrow(Tidy(cut), schema)


def op6_line_templates(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_recurring(docs, min_tokens=1).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
