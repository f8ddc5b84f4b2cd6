"""Byte-pair encoding and decoding through a distinct-word table.

Texts are split into words; the distinct words of all texts are gathered by hash
bucket and each is encoded once; the ids go back to the blocks of texts that asked
for them and are joined by position. Decoding joins ids to the pieces of the
vocabulary, a table of fixed size.

Texts travel once, packed; words travel as the distinct words of a block.

Defined cases: a null or empty text has no ids and decodes to an empty text; special
tokens that stand in a text are encoded as such; repeated rows are each encoded; a very long
text is a block of its own and read whole, its ids decoded in parts; an
empty table gives an empty result; other columns are kept, those named ids or decoded
are replaced.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomgene.llm._store import BLOCK_BYTES, decode_block, gather_returns, held, release, shuffle_partitions, to_blocks
from loomgene.llm._words import expand, narrow, spread, squeeze

DECODE_IDS = 1 << 17
#: Fixed value: the word pattern of byte-level vocabularies of this kind.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Vocabulary:
    def __init__(self, text: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        spec = json.loads(text)
        spec["truncation"] = spec["padding"] = None
        self.tokenizer = Tokenizer.from_str(json.dumps(spec))
        self.words = regex.compile(PATTERN)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        names = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        vocab = spec["model"]["vocab"]
        # Byte-level vocabularies write bytes that are no printable Latin-1 sign as code points from 256 on.
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        other = [b for b in range(256) if b not in set(plain)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
        pieces = {i: bytes(byte_of[c] for c in piece) for piece, i in vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        size = max(pieces, default=-1) + 1
        held = [pieces.get(i, b"") for i in range(size)]
        self.piece_length = np.array([len(p) for p in held], np.int64)
        self.piece_start = np.cumsum(self.piece_length) - self.piece_length
        self.piece_bytes = np.frombuffer(b"".join(held), np.uint8)

    def split(self, text: str) -> list[str]:
        if self.cut is None or not any(s in text for s in self.special):
            return self.words.findall(text)
        out: list[str] = []
        for part in self.cut.split(text):
            if part in self.special:
                out.append(part)
            else:
                out += self.words.findall(part)
        return out

    def encode(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """Texts of consecutive runs of ids, a part of the runs at a time."""
        out, lo, n = [], 0, len(bounds) - 1
        while lo < n:
            hi = min(n, max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + DECODE_IDS, "right")) - 1))
            part = ids[bounds[lo] : bounds[hi]]
            lengths = self.piece_length[part]
            data = self.piece_bytes[spread(self.piece_start[part], lengths)].tobytes()
            ends = np.r_[0, np.cumsum(lengths)][bounds[lo : hi + 1] - bounds[lo]]
            out += [data[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:])]
            lo = hi
        return out


def _vocabulary(text: str) -> Vocabulary:
    return held(("vocabulary", hash(text)), lambda: Vocabulary(text))


class Numbers(dict):
    """Words numbered in order of their first place."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


def _distinct(vocabulary: Vocabulary, texts) -> tuple[Numbers, list[np.ndarray]]:
    """Distinct words of a block; and of each text the numbers of its words."""
    distinct = Numbers()
    places = []
    for text in texts:
        words = vocabulary.split(text.as_py()) if text.is_valid else []
        places.append(np.fromiter(map(distinct.__getitem__, words), np.int32, len(words)))
    return distinct, places


def _buckets(distinct: dict[str, int], n: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    raw = [w.encode() for w in distinct]
    bucket = np.fromiter((zlib.crc32(w) % n for w in raw), np.int64, len(raw))
    order = np.argsort(bucket, kind="stable")
    return raw, bucket, order


def encode_texts(docs: DataFrame, tokenizer_path: str, buckets: int | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All columns of ``docs`` with ids (unsigned 32-bit little-endian integers, packed) and decoded (the text they stand for)."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as file:
        sent = spark.sparkContext.broadcast(file.read())
    n = buckets or shuffle_partitions(spark)
    docs = docs.drop(*[c for c in ("ids", "decoded") if c in docs.columns])
    blocks = to_blocks(docs, block_bytes=block_bytes)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(sent.value)
        for batch in batches:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                distinct, _ = _distinct(vocabulary, decode_block(payload).column("text"))
                raw, bucket, order = _buckets(distinct, n)
                first = np.searchsorted(bucket[order], np.arange(n + 1))
                rows = []
                for b in np.flatnonzero(np.diff(first)):
                    mine = [raw[i] for i in order[first[b] : first[b + 1]]]
                    rows.append((block, int(b), squeeze(narrow(np.array([len(w) for w in mine])), np.frombuffer(b"".join(mine), np.uint8))))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.binary()))], names=["block", "bucket", "payload"])
        release()

    def encode(table: pa.Table) -> pa.Table:
        vocabulary = _vocabulary(sent.value)
        known: dict[bytes, int] = {}
        wanted = []
        for payload in table.column("payload").to_pylist():
            lengths, data = expand(payload)
            raw, ends = data.tobytes(), np.cumsum(lengths.astype(np.int64)).tolist()
            wanted.append(np.fromiter((known.setdefault(raw[a:b], len(known)) for a, b in zip([0, *ends[:-1]], ends)), np.int64, len(ends)))
        words = [w.decode() for w in known]
        ids = []
        for a in range(0, len(words), 20_000):
            ids += vocabulary.encode(words[a : a + 20_000])
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        starts = np.cumsum(lengths) - lengths
        flat = np.fromiter((x for i in ids for x in i), np.int64, int(lengths.sum()))
        back = [squeeze(narrow(lengths[w]), narrow(flat[spread(starts[w], lengths[w])])) for w in wanted]
        out = pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "payload": pa.array(back, pa.binary())})
        del known, words, ids, flat
        release()
        return out

    asked = blocks.mapInArrow(ask, "block long, bucket int, payload binary")
    returned = gather_returns(asked.groupBy("bucket").applyInArrow(encode, "block long, bucket int, payload binary"))

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(sent.value)
        for batch in batches:
            for payload, returns in zip(batch.column("payload"), batch.column("returns")):
                rows = decode_block(payload)
                distinct, places = _distinct(vocabulary, rows.column("text"))
                _, bucket, order = _buckets(distinct, n)
                first = np.searchsorted(bucket[order], np.arange(n + 1))
                lengths = np.zeros(len(distinct), np.int64)
                got = {r["bucket"]: expand(r["back"]) for r in (returns.as_py() or [])}
                for b, (sizes, _) in got.items():
                    lengths[order[first[b] : first[b + 1]]] = sizes
                starts = np.cumsum(lengths) - lengths
                flat = np.zeros(int(lengths.sum()), np.int64)
                for b, (_, ids) in got.items():
                    mine = order[first[b] : first[b + 1]]
                    flat[spread(starts[mine], lengths[mine])] = ids
                place = np.concatenate(places)
                ends = np.r_[0, np.cumsum([len(doc) for doc in places])].astype(np.int64)
                ids = flat[spread(starts[place], lengths[place])]
                bounds = np.r_[0, np.cumsum(lengths[place])][ends]
                packed = ids.astype("<u4").tobytes()
                out = [packed[4 * a : 4 * b] for a, b in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(out, pa.binary()), pa.array(vocabulary.decode(ids, bounds), pa.string())], names=[*rows.schema.names, "ids", "decoded"])
        release()

    schema = StructType(list(docs.schema.fields)).add("ids", "binary").add("decoded", "string")
    return blocks.join(returned, "block", "left").mapInArrow(assemble, schema)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op10_bpe_table(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(encode_texts(docs, default_tokenizer()))
