"""Language-model scoring with a Katz back-off bigram model.

The model's counts live in hash partitions: a unigram table by word and a bigram
table by context, both built and looked up in one exchange each. Counts up to ``K`` are
discounted by Good-Turing; a context's freed mass goes to the words it was never
followed by, in proportion to the unigram model, with weights that normalise exactly;
the unigram model gives its own freed mass to the unknown word. A token's probability
is found recursively: bigram, else back-off weight times unigram, else unknown.

Contexts of more than ``hot`` tokens are dealt to buckets by their followers too; the
sums that their back-off weights need are small, and at most ``HOT_PIECES`` in number.

Where Good-Turing has no valid discount (a count of counts is zero, or the estimate
leaves (0, 1)), 0.5 is taken off each count up to K; a context all of whose followers
occur more than K times gets one more count, which is the mass it gives away.

Defined cases: a null text is empty and has the end token only; without training
documents every token is unknown with probability 1; a null doc_id counts as an empty
string for the fold; repeated rows are separate documents; a very long text is read whole,
a slice of words at a time unless it alone is longer; equal counts (ties) need no order; an empty table gives an
empty result; other columns are kept, those of the result's names are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomgene.llm._store import BLOCK_BYTES, answer_and_tell, ask, finish, shuffle_partitions, to_blocks, with_returns, with_told
from loomgene.llm._words import Routes, expand, mix, narrow, slices, spread, squeeze
from loomgene.llm.parse_language import id_crc

K = 5
HOT_LEAST, HOT_PIECES = 1 << 18, 1 << 16
WORDS, WORD_STATS, PAIRS, PAIR_STATS, HOT = 1, 2, 3, 4, 5
START, END = np.uint64(0x51ED270B7F4A7C15), np.uint64(0x2545F4914F6CDD1D)
RESULT = {"n_tokens": "long", "n_known": "long", "train_tokens": "long", "base_score": "double", "score": "double"}


class Tokens:
    """The tokens of a block: local number of each word, end tokens in place, contexts, document and fold."""

    def __init__(self, rows: pa.RecordBatch):
        hashes, doc, sizes = [], [], []
        for lo, hi, words in slices(rows.column("text"), True):
            hashes.append(words.hashes())
            doc.append(lo + words.doc)
            sizes.append(np.diff(words.first))
        n = rows.num_rows
        size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        total = int(size.sum()) + n
        self.doc = np.repeat(np.arange(n), size + 1)
        ends = np.cumsum(size + 1) - 1
        stream = np.full(total, END, np.uint64)
        inner = np.ones(total, bool)
        inner[ends] = False
        if hashes:
            stream[inner] = np.concatenate(hashes)
        self.words, self.at = np.unique(stream, return_inverse=True)
        heads = np.r_[0, ends[:-1] + 1].astype(np.int64) if n else ends
        self.context = np.empty(total, np.int64)
        self.context[1:] = self.at[:-1]
        self.context[heads] = len(self.words)  # the start, as a last context
        self.train = ~np.asarray(rows.column("held_out").fill_null(False))[self.doc] if n else np.zeros(0, bool)
        self.count = np.bincount(self.at[self.train], minlength=len(self.words))


class Pairs:
    """Distinct bigrams of a block, by context; each with its route."""

    def __init__(self, tokens: Tokens, counts: np.ndarray, hot: int, buckets: int):
        width = len(tokens.words) + 1
        code, self.at = np.unique(tokens.context * width + tokens.at, return_inverse=True)
        self.context, self.word = code // width, code % width
        self.train = np.bincount(self.at[tokens.train], minlength=len(code))
        hashes = np.r_[tokens.words, START]
        # A start stands before as many tokens as there are ends.
        size = np.r_[counts, counts[np.flatnonzero(tokens.words == END)]] if len(tokens.words) else np.zeros(1, np.int64)
        self.size = size[self.context]
        self.hot = self.size > hot
        pieces = np.maximum(1, -(-self.size // max(1, hot))).astype(np.uint64)
        key = mix(hashes[self.context] ^ np.uint64(0x632BE59BD9B4E019))
        split = mix(hashes[self.word]) % pieces
        self.routes = Routes(np.where(self.hot, mix(key + split), key), buckets)


def discounts(counts: np.ndarray) -> np.ndarray:
    """d_0 .. d_K from the counts of counts n_1 .. n_(K+1); d_0 is not used."""
    n = np.r_[0.0, counts.astype(float)]
    out = np.r_[1.0, (np.arange(1, K + 1) - 0.5) / np.arange(1, K + 1)]
    if (n[1:] > 0).all():
        cut = (K + 1) * n[K + 1] / n[1]
        r = np.arange(1, K + 1)
        d = ((r + 1) * n[2:] / (r * n[1:-1]) - cut) / (1 - cut) if cut < 1 else np.zeros(K)
        if (d > 0).all() and (d < 1).all():
            out[1:] = d
    return out


class Unigrams:
    def __init__(self, told: list[bytes]):
        total = np.zeros(K + 3, np.int64)
        for payload in told:
            total += expand(payload)[0]
        self.tokens, self.types, self.counts = int(total[0]), int(total[1]), total[2:]
        self.d = discounts(self.counts)
        freed = float(((1 - self.d[1:]) * np.arange(1, K + 1) * self.counts[:K]).sum())
        self.size = self.tokens + (freed <= 0)
        self.unknown = (freed if freed > 0 else 1.0) / self.size if self.size else 1.0

    def mass(self, count: np.ndarray) -> np.ndarray:
        """Discounted counts: probabilities times size."""
        return count * self.d[np.where(count <= K, count, 0)]

    def probability(self, count: np.ndarray) -> np.ndarray:
        return np.where(count > 0, self.mass(count) / max(1, self.size), self.unknown)

    @property
    def hot(self) -> int:
        return max(HOT_LEAST, self.tokens // HOT_PIECES)


def score_texts(docs: DataFrame, buckets: int | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All columns of ``docs``, which has held_out, with n_tokens, n_known, train_tokens, base_score and score (log10)."""
    n = buckets or shuffle_partitions(docs.sparkSession)
    docs = docs.drop(*[c for c in RESULT if c in docs.columns])
    blocks = to_blocks(docs, block_bytes=block_bytes)

    def ask_words(_block, rows, _returns):
        tokens = Tokens(rows)
        for b, mine in Routes(mix(tokens.words), n):
            yield b, WORDS, squeeze(tokens.words[mine], narrow(tokens.count[mine]))

    def reply_words(_blocks, payloads):
        sent = [expand(p) for p in payloads]
        sizes = [len(s[0]) for s in sent]
        words, at = np.unique(np.concatenate([s[0] for s in sent]), return_inverse=True)
        counts = np.bincount(at, weights=np.concatenate([s[1] for s in sent]).astype(float), minlength=len(words)).astype(np.int64)
        rank = np.empty(len(words), np.int64)
        rank[np.argsort(-counts, kind="stable")] = np.arange(len(words))
        ends = np.cumsum(sizes)
        back = [squeeze(narrow(counts[x]), narrow(rank[x])) for x in (at[e - k : e] for e, k in zip(ends, sizes))]
        stats = np.r_[counts.sum(), (counts > 0).sum(), np.bincount(counts[counts <= K + 1], minlength=K + 2)[1:]].astype(np.int64)
        return back, WORDS, [(WORD_STATS, squeeze(stats))]

    def known(tokens: Tokens, returns) -> tuple[np.ndarray, np.ndarray]:
        """Count and number of each word of the block; numbers are small for frequent words, and 0 is the start's."""
        routes = Routes(mix(tokens.words), n)
        got = {b: expand(v) for b, v in returns[WORDS].items()}
        counts = routes.back({b: v[0] for b, v in got.items()}, np.int64)
        return counts, routes.back({b: v[1] for b, v in got.items()}, np.int64) * n + routes.bucket + 1

    def ask_pairs(_block, rows, returns):
        tokens = Tokens(rows)
        counts, numbers = known(tokens, returns)
        pairs = Pairs(tokens, counts, Unigrams(returns[-WORD_STATS]).hot, n)
        numbers = np.r_[numbers, 0]
        for b, mine in pairs.routes:
            context = pairs.context[mine]
            head = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
            size = np.diff(np.r_[head, len(mine)])
            yield b, PAIRS, squeeze(narrow(numbers[context[head]]), narrow(size), narrow(pairs.hot[mine[head]].astype(np.int64)), narrow(numbers[pairs.word[mine]]), narrow(pairs.train[mine]), narrow(counts[pairs.word[mine]]))

    def reply_pairs(_blocks, payloads):
        sent = [expand(p) for p in payloads]
        heads, sizes, hot = (np.concatenate([s[i] for s in sent]).astype(np.int64) for i in range(3))
        context = np.repeat(heads, sizes)
        word, train, seen = (np.concatenate([s[i] for s in sent]).astype(np.int64) for i in (3, 4, 5))
        order = np.lexsort((word, context))
        new = np.r_[True, (word[order][1:] != word[order][:-1]) | (context[order][1:] != context[order][:-1])]
        at = np.empty(len(order), np.int64)
        at[order] = np.cumsum(new) - 1
        first = order[new]
        count = np.bincount(at, weights=train.astype(float)).astype(np.int64)
        # Per context, what its back-off weight needs: counts of counts, counts of its followers' own counts, and the sum of the larger of those.
        owner = context[first]
        names, spot = np.unique(owner, return_inverse=True)
        followers = np.flatnonzero(count > 0)
        low = followers[count[followers] <= K]
        table = np.bincount(spot[low] * K + count[low] - 1, minlength=len(names) * K).reshape(-1, K)
        own = seen[first]
        small = followers[own[followers] <= K]
        follow = np.bincount(spot[small] * K + own[small] - 1, minlength=len(names) * K).reshape(-1, K)
        large = followers[own[followers] > K]
        mass = np.bincount(spot[large], weights=own[large].astype(float), minlength=len(names)).astype(np.int64)
        place = np.searchsorted(names, heads)
        back, a, h = [], 0, 0
        for s in sent:
            k, m = len(s[3]), len(s[0])
            r = count[at[a : a + k]]
            ctx = place[h : h + m]
            unseen = np.zeros(m, bool)
            unseen[np.repeat(np.arange(m), s[1])[r == 0]] = True
            tight = (table[ctx].sum(axis=1) == 0) & (hot[h : h + m] == 0)
            mine = ctx[unseen & (hot[h : h + m] == 0)]
            back.append(squeeze(narrow(r), tight.astype(np.uint8), narrow(table[mine].ravel()), narrow(follow[mine].ravel()), narrow(mass[mine])))
            a, h = a + k, h + m
        stats = np.bincount(count[count <= K + 1], minlength=K + 2)[1:].astype(np.int64)
        told = [(PAIR_STATS, squeeze(stats))]
        pieces = np.unique(place[hot == 1])
        if len(pieces):
            told.append((HOT, squeeze(narrow(names[pieces]), table[pieces].ravel(), follow[pieces].ravel(), mass[pieces])))
        return back, PAIRS, told

    words = answer_and_tell(ask(blocks, ask_words), reply_words)
    counted = with_told(with_returns(blocks, words, "words"), words, "word_stats")
    pairs = answer_and_tell(ask(counted, ask_pairs), reply_pairs)
    complete = with_told(with_returns(counted, pairs, "pairs"), pairs, "pair_stats")

    def score(_block, rows, returns):
        tokens = Tokens(rows)
        counts, numbers = known(tokens, returns)
        unigrams = Unigrams(returns[-WORD_STATS])
        pairs = Pairs(tokens, counts, unigrams.hot, n)
        d = discounts(sum((expand(p)[0] for p in returns[-PAIR_STATS]), np.zeros(K + 1, np.int64)))
        numbers = np.r_[numbers, 0]
        p_word = unigrams.probability(counts)
        r = np.zeros(len(pairs.word), np.int64)
        beta = np.zeros(len(tokens.words) + 1)
        gamma = np.zeros(len(tokens.words) + 1)
        tight = np.zeros(len(tokens.words) + 1, bool)
        size = np.zeros(len(tokens.words) + 1, np.int64)
        size[pairs.context] = pairs.size
        freed = (1 - d[1:]) * np.arange(1, K + 1)
        gained = unigrams.d[1:] * np.arange(1, K + 1)

        def weigh(contexts, table, follow, mass):
            beta[contexts] = table @ freed
            gamma[contexts] = (mass + follow @ gained) / max(1, unigrams.size)

        got = returns.get(PAIRS, {})
        for b, mine in pairs.routes:
            own, tense, table, follow, mass = expand(got[b])
            r[mine] = own
            context = pairs.context[mine]
            head = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
            part = context[head]
            tight[part[tense > 0]] = True
            unseen = np.zeros(len(head), bool)
            unseen[(np.cumsum(np.r_[True, context[1:] != context[:-1]]) - 1)[own == 0]] = True
            weigh(part[unseen & ~pairs.hot[mine[head]]], table.reshape(-1, K).astype(float), follow.reshape(-1, K).astype(float), mass.astype(float))
        hot = [expand(p) for p in returns.get(-HOT, [])]
        if hot:
            names = np.concatenate([x[0] for x in hot]).astype(np.int64)
            keys, at = np.unique(names, return_inverse=True)
            sums = []
            for i in (1, 2, 3):
                values = np.concatenate([x[i].reshape(len(x[0]), -1) for x in hot]).astype(float)
                total = np.zeros((len(keys), values.shape[1]))
                np.add.at(total, at, values)
                sums.append(total)
            mine = np.unique(pairs.context[pairs.hot])
            spot = np.searchsorted(keys, numbers[mine])
            tight[mine] = sums[0][spot].sum(axis=1) == 0
            weigh(mine, sums[0][spot], sums[1][spot], sums[2][spot, 0])
        # A context that frees nothing has one more count, and frees that.
        base = size + tight
        beta = np.where(tight, 1.0, beta) / np.maximum(1, base)
        weight = beta / np.maximum(1 - gamma, 1e-300)
        unseen = r == 0
        with np.errstate(divide="ignore"):
            seen = np.log10(np.where(unseen, 1.0, r * d[np.where(r <= K, r, 0)]) / np.maximum(1, base[pairs.context]))
            back = np.log10(np.where(size[pairs.context] > 0, weight[pairs.context], 1.0)) + np.log10(p_word[pairs.word])
        log_p = np.where(unseen, back, seen)
        docs_n = rows.num_rows
        total, types = unigrams.tokens, unigrams.types
        base_log = np.log10((counts + 0.1) / (total + 0.1 * (types + 1)))
        columns = [
            pa.array(np.bincount(tokens.doc, minlength=docs_n), pa.int64()),
            pa.array(np.bincount(tokens.doc, weights=(counts > 0)[tokens.at], minlength=docs_n).astype(np.int64), pa.int64()),
            pa.array(np.full(docs_n, total), pa.int64()),
            pa.array(np.bincount(tokens.doc, weights=base_log[tokens.at], minlength=docs_n), pa.float64()),
            pa.array(np.bincount(tokens.doc, weights=log_p[pairs.at], minlength=docs_n), pa.float64()),
        ]
        return pa.RecordBatch.from_arrays([*rows.columns, *columns], names=[*rows.schema.names, *RESULT])

    schema = StructType(list(docs.schema.fields))
    for name, kind in RESULT.items():
        schema = schema.add(name, kind)
    return finish(complete, score, schema)


def op4_katz_model(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_texts(docs.select("doc_id", "text", (F.pmod(id_crc(), F.lit(10)) == 0).alias("held_out"))).drop("text")
