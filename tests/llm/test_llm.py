"""Text operators against brute force, and on awkward rows: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgene.llm import bpe_table, edit_leaks, katz_model, license_rules, line_templates, parity_join, parse_language, repeat_trees, shuffle_shards, va_search
from loomgene.llm._graph import components
from loomgene.llm.queries import ORACLE_SQL, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, score double, ids string, block long, payload string"


def make_docs(n=60, seed=3):
    rng = random.Random(seed)
    voc = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(300)]
    say = lambda k: " ".join(rng.choice(voc) for _ in range(k))
    hot = say(26)
    texts = [say(rng.randrange(1, 90)) for _ in range(n)]
    texts += [hot + " " + say(rng.randrange(5)) for _ in range(12)] + [say(10) + " " + hot + "\n" + say(10) for _ in range(8)]
    base = say(80).split()
    for _ in range(15):
        copy = list(base)
        for _ in range(rng.randrange(3)):
            copy[rng.randrange(80)] = rng.choice(voc)
        texts.append(" ".join(copy).title() if rng.random() < 0.3 else " ".join(copy))
    texts += [texts[2]] * 6 + ["", "   \n\t ", None, "a", "A b", "x y z w", "x y z w", "1 2 3", "Ünïcode ß 漢字 <|endoftext|> 'll  \n\n x", "la " * 120, " ".join(voc) + " " + say(4000)]
    rows = [(i, t, rng.choice(["en", "fr", None]), None, None, "k", 1.0, "x", 5, "p") for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def rows():
    return make_docs()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def twice(spark, rows):
    """Repeated rows, and rows without an id."""
    return spark.createDataFrame(rows + rows[:20] + [(None, *r[1:]) for r in rows[:5]], SCHEMA)


def brute_removed(texts):
    words = {i: WORD.findall(t or "") for i, t in texts.items()}
    seen, gone = set(), defaultdict(set)
    for i in sorted(words):
        for s in range(len(words[i]) - 19):
            window = tuple(words[i][s : s + 20])
            if window in seen:
                gone[i].update(range(s, s + 20))
            seen.add(window)
    return {i: (len(w), len(gone[i]), " ".join(x for k, x in enumerate(w) if k not in gone[i])) for i, w in words.items()}


@pytest.mark.parametrize("limit", [60_000, 5])
def test_repeats_equal_brute_force(docs, rows, none, twice, limit, monkeypatch):
    monkeypatch.setattr(repeat_trees, "TREE_SUFFIXES", limit)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in repeat_trees.remove_repeats(docs).collect()}
    assert got == brute_removed({r[0]: r[1] for r in rows})
    assert repeat_trees.remove_repeats(none).count() == 0
    again = repeat_trees.remove_repeats(twice)
    assert again.count() == len(rows) + 25 and again.columns.count("kept") == 1


def test_tree_verdicts_split_equals_trees():
    rng = np.random.default_rng(1)
    n, window, prefix = 300, 20, 10
    text = rng.integers(0, 2, 400).astype(np.uint64)
    left = rng.integers(0, 11, n)
    size = left + 1 - rng.integers(0, 2, n) * (left > 0)
    at = rng.integers(11, 370, n)
    lengths = size + window - 1
    flat = np.concatenate([text[a - b : a - b + k] for a, b, k in zip(at, left, lengths)])
    key = np.array([hash(text[a : a + prefix].tobytes()) & (2**62 - 1) for a in at], np.uint64)
    args = (key, size.astype(np.int64), left.astype(np.int64), flat, lengths.astype(np.int64), np.arange(n))
    whole = repeat_trees.tree_verdicts(*args, window, prefix)
    old, repeat_trees.TREE_SUFFIXES = repeat_trees.TREE_SUFFIXES, 1
    try:
        assert (whole == repeat_trees.tree_verdicts(*args, window, prefix)).all() and whole.any()
    finally:
        repeat_trees.TREE_SUFFIXES = old


def brute_components(texts):
    sets = {}
    for i, t in texts.items():
        w = WORD.findall((t or "").translate(ASCII_LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}


def test_links_equal_brute_force(docs, rows, none, twice):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in parity_join.near_duplicates(docs).collect()}
    assert got == brute_components({r[0]: r[1] for r in rows})
    assert parity_join.near_duplicates(none).count() == 0
    again = parity_join.near_duplicates(twice).collect()
    assert len(again) == len(rows) + 25 and all(r["component_id"] is None for r in again if r["doc_id"] is None)


def test_links_near_the_threshold(spark):
    rng = random.Random(8)
    rows = []
    for n in (6, 9, 14, 25, 60, 130, 260):
        for k in range(14):
            base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
            other = list(base)
            for _ in range(rng.randrange(0, max(2, n // 18 + 2))):
                other[rng.randrange(len(other))] = f"v{rng.randrange(10**6)}"
            other += [f"t{rng.randrange(10**6)}" for _ in range(rng.randrange(0, 1 + n // 4))]
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(other))]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in parity_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(dict(rows))


@pytest.mark.parametrize("tile", [4, 2048])
def test_links_between_members_of_one_group(spark, monkeypatch, tile):
    """Clusters of texts near the threshold, whose first member isn't linked with all: pairs of others must be found."""
    rng, texts = random.Random(21), []
    for n in (40, 90, 700):
        base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        for _ in range(24):
            copy = list(base)
            for _ in range(rng.randrange(0, max(3, n // 28))):
                copy[rng.randrange(n)] = f"v{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    work = []
    plain = parity_join.verify
    monkeypatch.setattr(parity_join, "verify", lambda pairs, held: work.append(pairs.count()) or plain(pairs, held))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in parity_join.near_duplicates(docs, tile=tile).collect()}
    assert got == brute_components(dict(enumerate(texts)))
    assert len(work) > 1 and work[1] > 0


def test_larger_sketches_fold_to_smaller_ones(spark):
    rng = random.Random(2)
    sets = parity_join.Sets(__import__("pyarrow").array([" ".join(f"w{rng.randrange(10**6)}" for _ in range(n)) for n in (100, 300, 1500, 6000)]))
    wide = parity_join.Sets.bits(sets, np.arange(4))
    assert [8 * len(x) for x in wide] == [1024, 1024, 4096, 16384]
    assert (parity_join.fold(wide[2:])[1] == parity_join.fold([wide[3], wide[2]])[0]).all()


def test_rows_of_one_id_are_linked_by_any_text(spark):
    say = lambda k, n=30: " ".join(f"{k}{i}" for i in range(n))
    rows = [(1, say("a")), (1, say("b")), (2, say("b") + " more"), (3, say("a") + " more"), (4, say("c")), (None, say("a"))]
    got = {(r["doc_id"], r["component_id"]) for r in parity_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4), (None, None)}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 201)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(1, 61)} == {1} and {got[k] for k in range(100, 140)} == {100} and got[201] == 200
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_katz(texts, held):
    k = katz_model.K
    tokens = {i: [*WORD.findall((t or "").translate(ASCII_LOWER)), None] for i, t in texts.items()}
    train = [i for i in tokens if not held(i)]
    c = Counter(w for i in train for w in tokens[i])
    after = defaultdict(Counter)
    for i in train:
        for v, w in zip([0, *tokens[i]], tokens[i]):
            after[v][w] += 1
    cut = lambda n: katz_model.discounts(np.array([n[r] for r in range(1, k + 2)]))
    du, db = cut(Counter(c.values())), cut(Counter(x for f in after.values() for x in f.values()))
    kept = lambda d, r: (d[r] if r <= k else 1.0) * r
    total = sum(c.values())
    freed = total - sum(kept(du, x) for x in c.values())
    size = total + (freed <= 1e-12)
    unknown = (freed if freed > 1e-12 else 1.0) / size
    one = lambda w: kept(du, c[w]) / size if c[w] else unknown

    def p(v, w):
        if v not in after:
            return one(w)
        f = after[v]
        tight = all(x > k for x in f.values())
        base = sum(f.values()) + tight
        if w in f:
            return kept(db, f[w]) / base
        return (1 - sum(kept(db, x) for x in f.values()) / base) / (1 - sum(map(one, f))) * one(w)

    scores = {i: sum(math.log10(p(v, w)) for v, w in zip([0, *t], t)) for i, t in tokens.items()}
    base = {i: sum(math.log10((c[w] + 0.1) / (total + 0.1 * (len(c) + 1))) for w in t) for i, t in tokens.items()}
    return tokens, c, total, scores, base, p


@pytest.mark.parametrize("hot", [None, 3])
def test_katz_equals_brute_force(docs, rows, hot, monkeypatch):
    if hot:
        monkeypatch.setattr(katz_model, "HOT_LEAST", hot)
        monkeypatch.setattr(katz_model, "HOT_PIECES", 1 << 40)
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    found = katz_model.score_texts(docs.withColumn("held_out", F.pmod(parse_language.id_crc(), F.lit(10)) == 0)).collect()
    tokens, c, total, scores, base, p = brute_katz({r[0]: r[1] for r in rows}, held)
    for r in found:
        i = r["doc_id"]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens[i]), sum(c[w] > 0 for w in tokens[i]), total)
        assert abs(r["score"] - scores[i]) < 1e-6 * max(1, abs(scores[i])) and abs(r["base_score"] - base[i]) < 1e-6 * max(1, abs(base[i]))
    for v in [0, "la", tokens[3][0]]:
        assert abs(sum(p(v, w) for w in c) + p(v, "never seen") - 1) < 1e-9


def test_katz_awkward_rows(none, twice, spark):
    assert katz_model.score_texts(none.withColumn("held_out", F.lit(False))).count() == 0
    assert katz_model.score_texts(twice.withColumn("held_out", F.lit(False))).filter("score IS NULL OR isnan(score)").count() == 0
    untrained = katz_model.score_texts(spark.createDataFrame([(1, "a b")], "doc_id long, text string").withColumn("held_out", F.lit(True))).first()
    assert untrained["score"] == 0 and untrained["n_known"] == 0


def test_bpe_equals_the_library(docs, rows, none, twice):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(bpe_table.default_tokenizer())
    texts = {r[0]: r[1] or "" for r in rows}
    for r in bpe_table.encode_texts(docs, bpe_table.default_tokenizer()).collect():
        ids = tok.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids and r["decoded"] == tok.decode(ids, skip_special_tokens=False) == texts[r["doc_id"]]
    assert bpe_table.encode_texts(none, bpe_table.default_tokenizer()).count() == 0
    out = bpe_table.encode_texts(twice, bpe_table.default_tokenizer())
    assert out.count() == len(rows) + 25 and out.columns.count("ids") == 1
    one = bpe_table.digests(out.filter("doc_id = 0")).first()
    assert one["ids_sha256"] == hashlib.sha256(np.array(tok.encode(texts[0], add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()


def test_language_held_out_accuracy(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    found = parse_language.op2_parse_language(spark, data).join(docs.select("doc_id", "lang"), "doc_id")
    row = found.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a"), F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    assert row["a"] >= 0.95 and 0 <= row["lo"] <= row["hi"] <= 1


def test_language_awkward_rows(docs, rows, none, twice):
    got = {r["doc_id"]: r["lang_pred"] for r in parse_language.identify(docs).collect()}
    for r in rows:
        letters = any(map(str.isalpha, r[1] or ""))
        assert (got[r[0]] == "und") == (not letters)
    assert parse_language.identify(none).count() == 0 and parse_language.identify(twice).count() == len(rows) + 25
    assert {r["lang_pred"] for r in parse_language.identify(docs, {}).collect()} == {"und"}


def test_pipeline_drops_wrong_labels_and_keeps_mixed_texts(spark, data):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang")
    known = [r for r in docs.orderBy("doc_id").collect() if r["text"] and r["lang"] and len(r["text"]) >= 600]
    langs = sorted({r["lang"] for r in known})
    # Ids of the held-out fold, so that wrong labels teach nothing.
    ids = iter(i for i in range(10**6, 2 * 10**6) if zlib.crc32(str(i).encode()) % 4 == 2)
    wrong, right, mixed = {}, {}, {}
    for a, b in list(zip(known, known[1:]))[:40]:
        wrong[next(ids)] = (a["text"], langs[langs.index(a["lang"]) - 1])
        right[next(ids)] = (a["text"], a["lang"])
        mixed[next(ids)] = (a["text"][:300] + " " + b["text"][:300], a["lang"])
    rows = [(i, *x) for found in (wrong, right, mixed) for i, x in found.items()]
    left = {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs.unionByName(spark.createDataFrame(rows, docs.schema)), data).collect()}
    assert len(left & set(wrong)) <= 1 and set(right) <= left and set(mixed) <= left


def test_phrases_equal_a_plain_parse():
    parser = parse_language.Parser({"a": ["the cat sat on the mat and the cat"], "b": ["le chat et le rat"]})
    text = b"the rat sat on a chat, zzz"
    plain = parse_language.letters(np.frombuffer(text, np.uint8)).tobytes()
    plain = re.sub(rb" +", b" ", plain)
    for k, sample in enumerate([b"the cat sat on the mat and the cat", b"le chat et le rat"]):
        n, i = 0, 0
        while i < len(plain):
            j = i + 1
            while j <= len(plain) and plain[i:j] in sample:
                j += 1
            i = max(i + 1, j - 1)
            n += 1
        assert parser.phrases(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[k, 0] == n


@pytest.mark.parametrize("sample, panel", [(40, 1 << 22), (400, 1 << 22), (400, 2304)])
def test_phrases_of_long_texts_equal_a_plain_parse(sample, panel, monkeypatch):
    """Many lanes, among them copies of the learned text, so that matches run over several lanes' edges."""
    monkeypatch.setattr(parse_language, "PANEL", panel)
    rng = random.Random(sample)
    say = lambda k: " ".join("".join(rng.choice("abcd") for _ in range(rng.randrange(1, 5))) for _ in range(k))
    learned = {"a": [say(sample)], "b": [say(sample) for _ in range(3)], "c": ["ab " * 900]}
    parser = parse_language.Parser(learned)
    texts = [say(900), "", learned["a"][0] * 3, "x", learned["c"][0] * 2 + say(20), say(61) + "漢字" + say(300), "ab " * 700, learned["b"][2] + learned["b"][1]]
    raw = [t.encode() for t in texts]
    got = parser.phrases(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(x) for x in raw])])
    known = {}
    for name, parts in learned.items():
        squeezed = re.sub(rb" +", b" ", parse_language.letters(np.frombuffer("\n".join(parts).encode(), np.uint8)).tobytes())
        known[name] = squeezed
    for d, text in enumerate(raw):
        line = re.sub(rb" +", b" ", parse_language.letters(np.frombuffer(text, np.uint8)).tobytes()) if text else b""
        for k, name in enumerate(parser.langs):
            i = phrases = 0
            while i < len(line):
                n = 1
                while i + n < len(line) and line[i : i + n + 1] in known[name]:
                    n += 1
                i, phrases = i + n, phrases + 1
            assert got[k][d] == phrases, (name, d)


def test_predictions_equal_brute_force(spark):
    rng = random.Random(1)
    say = lambda s, k: " ".join("".join(rng.choice(s) for _ in range(5)) for _ in range(k))
    samples = {"x": [say("abcde", 60)], "y": [say("defgh", 70)], "z": [say("aeiou", 50)]}
    texts = [say(s, k) for s in ("abcde", "defgh", "aeiou", "abcdefgh") for k in (1, 5, 200)] + ["123", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in parse_language.identify(docs, samples).collect():
        text = texts[r["doc_id"]]
        if not text or not any(map(str.isalpha, text)):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        cost = {}
        for name, (known,) in samples.items():
            i = phrases = 0
            while i < len(text):
                n = 1
                while i + n < len(text) and text[i : i + n + 1] in known:
                    n += 1
                i, phrases = i + n, phrases + 1
            cost[name] = phrases * math.log2(len(known))
        first, second = sorted(cost.values())[:2]
        assert cost[r["lang_pred"]] == pytest.approx(first) and r["score"] == pytest.approx(1 - first / second)


def test_more_labels_than_languages_learn_the_commonest(spark):
    rows = [(i, f"some words of text {i}", f"l{min(i // 4, 20)}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = parse_language.learn(docs, sample_docs=3, languages=5)
    assert len(found) == 5 and "l20" in found and all(len(x) <= 3 for x in found.values())


def test_line_templates(spark, none, twice):
    boiler = "Page {} of this site was last seen today"
    rows = [(i, f"own words number{'x' * i} stay here always\n{boiler.format(i)}\nok\nThe very same footer line everywhere") for i in range(30)] + [(99, None), (98, "")]
    got = {r["doc_id"]: r for r in line_templates.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0]["n_dropped"] == 0 and got[0]["kept"] == rows[0][1]
    for i in range(1, 30):
        assert (got[i]["n_lines"], got[i]["n_dropped"]) == (4, 2) and got[i]["kept"].split("\n")[1] == "ok"
    assert got[99]["kept"] is None and got[98]["kept"] == ""
    assert line_templates.drop_recurring(none).count() == 0
    assert line_templates.drop_recurring(twice).count() == twice.count()


def recurring_by_rule(texts, least, similarity=0.75, leading=3, docs=20):
    """(doc, line number) of lines to drop, by the rules as written down: no hashes, no index, no Spark."""
    mask = lambda line: " ".join("<*>" if any(c.isdigit() for c in t) else t for t in line.split())
    having = defaultdict(set)
    for d, text in texts.items():
        for line in (text or "").split("\n"):
            if len(line.split()) >= least:
                having[mask(line)].add(d)
    leaves = defaultdict(list)
    for line in having:
        tokens = line.split(" ")
        leaves[len(tokens), *tokens[:leading]].append(line)
    joined = {}
    for lines in leaves.values():
        grown = []
        for line in sorted(lines, key=lambda x: (-len(having[x]), x)):
            tokens, best = line.split(" "), None
            for t in grown:
                same = sum(a == b != "<*>" for a, b in zip(t["tokens"], tokens))
                key = (same, -t["tokens"].count("<*>"))
                if same >= similarity * max(1, sum(x != "<*>" for x in tokens)) and (best is None or key > best[0]):
                    best = key, t
            if best is None:
                best = None, {"tokens": tokens, "docs": set()}
                grown.append(best[1])
            t = best[1]
            t["tokens"] = [a if a == b else "<*>" for a, b in zip(t["tokens"], tokens)]
            t["docs"] |= having[line]
            joined[line] = t
    drop = set()
    for d, text in texts.items():
        for k, line in enumerate((text or "").split("\n")):
            t = joined.get(mask(line))
            if t is not None and len(line.split()) >= least and len(t["docs"]) >= docs and d != min(t["docs"]):
                drop.add((d, k))
    return drop


def test_line_templates_equal_brute_force(spark):
    """Random templates with fields of digits and words, ties in counts, repeated and very long lines."""
    rng = random.Random(17)
    words = ["".join(rng.choice("abcdef") for _ in range(3)) for _ in range(12)]
    shapes = [[rng.choice(words) for _ in range(rng.randrange(4, 10))] for _ in range(25)] + [[rng.choice(words) for _ in range(4_000)]]
    texts = {}
    for d in range(90):
        lines = []
        for shape in rng.sample(shapes, 9):
            line = list(shape)
            for _ in range(rng.randrange(3)):
                line[rng.randrange(len(line)) if rng.random() < 0.2 else rng.randrange(3, len(line))] = rng.choice([str(rng.randrange(50)), rng.choice(words), "x" + str(d)])
            lines.append(rng.choice(["", "  "]) + " ".join(line))
        texts[d] = "\n".join(lines + lines[:1] + ["", "ab"])
    texts[90], texts[91] = None, ""
    want = recurring_by_rule(texts, 4)
    assert 150 < len(want) < sum(len(t.split("\n")) for t in texts.values() if t) - 200
    docs = spark.createDataFrame([(d, t, "mine", 5) for d, t in texts.items()], "doc_id long, text string, line string, leaf long").repartition(5)
    for r in line_templates.drop_recurring(docs).collect():
        text = texts[r["doc_id"]]
        lines = text.split("\n") if text is not None else []
        kept = [x for k, x in enumerate(lines) if (r["doc_id"], k) not in want]
        assert r["kept"] == (None if text is None else "\n".join(kept)) and (r["n_lines"], r["n_dropped"]) == (len(lines), len(lines) - len(kept)) and r["line"] == "mine"


def test_leaf_templates_generalise():
    lines = [(k, f"user {name} logged in from host {name}x at noon", 5 - k) for k, name in enumerate(["ann", "bob", "cid"])] + [(9, "user gave up all hope of ever being seen again", 1)]
    found = dict(line_templates.leaf_templates([x for x in lines if x[1].count(" ") == 8]))
    assert found[0] == found[1] == found[2] == 0
    assert len(dict(line_templates.leaf_templates([(1, "a b c d", 1), (2, "e f g h", 1)]))) == 2


def test_short_lines_recur_verbatim_in_the_query(spark, tmp_path):
    rows = [(i, f"And ornd.\nPart {i}\n---\n\nAll  rights reserved.\n版权所有\nseen once {'x' * (i + 1)}") for i in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in line_templates.op6_line_templates(spark, str(tmp_path)).collect()}
    assert got[0]["n_dropped"] == 0
    for i in range(1, 30):
        left = f"Part {i}\n---\n\nseen once {'x' * (i + 1)}"
        assert got[i]["n_dropped"] == 3 and got[i]["kept_sha256"] == hashlib.sha256(left.encode()).hexdigest()


def plain_templates(lines):
    """The template of each line, by comparing it with all templates so far."""
    found, out = [], {}
    for line, text, _ in sorted(lines, key=lambda x: (-x[2], x[1])):
        tokens = text.split(" ")
        fixed = max(1, sum(t != "<*>" for t in tokens))
        rank = [(sum(a == b != "<*>" for a, b in zip(tokens, t)), -t.count("<*>"), i) for i, (_, t) in enumerate(found)]
        if rank and max(rank)[0] >= 0.75 * fixed:
            name, t = found[max(rank)[2]]
            t[:] = [a if a == b else "<*>" for a, b in zip(tokens, t)]
        else:
            found.append((name := line, tokens))
        out[line] = name
    return out


def test_leaf_templates_by_index_equal_a_plain_comparison(monkeypatch):
    monkeypatch.setattr(line_templates, "PLAIN", 3)
    rng = random.Random(8)
    for width in (4, 5, 7, 9, 14):
        texts = {" ".join(["a", "<*>", "b"] + [rng.choice(["<*>", *"uvwxyz"]) if rng.random() < 0.6 else f"t{rng.randrange(40)}" for _ in range(width - 3)]) for _ in range(500)}
        lines = [(i, text, rng.randrange(1, 4)) for i, text in enumerate(sorted(texts))]
        assert dict(line_templates.leaf_templates(lines)) == plain_templates(lines)


@pytest.mark.parametrize("names", [4000, 4001])
def test_a_template_recurs_whatever_the_size_of_its_leaf(spark, names):
    docs = spark.range(names).selectExpr("id as doc_id", "concat('Posted in the ', translate(string(id), '0123456789', 'abcdefghij'), ' section today\nown words of ', uuid()) as text")
    got = line_templates.drop_recurring(docs).groupBy(F.col("kept").contains("section").alias("there")).count().collect()
    assert {r["there"]: r["count"] for r in got} == {True: 1, False: names - 1}


def test_adaptive_execution_does_not_part_a_leaf(spark):
    """Where a join on the leaf was planned as a sort-merge join and then broadcast, as on large tables, each task had a part of a leaf, with templates of its own."""
    own = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m"}
    before = {k: spark.conf.get(k, None) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        lines = spark.range(0, 400, 1, 8).selectExpr("id as line", "id div 1000 as leaf", "concat('Posted in the ', translate(string(id), '0123456789', 'abcdefghij'), ' section today') as masked", "1L as docs")
        found = line_templates.templates_of(lines)
        got = found.groupBy("template").count().collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    # A table as small as this one isn't parted for certain, so the plan is held as well.
    assert [r["count"] for r in got] == [400] and "Join" not in found._jdf.queryExecution().analyzed().toString()


def test_only_lines_of_leaves_with_enough_documents_are_sent(spark, monkeypatch):
    written = {}

    def noted(df, label):
        out = materialize(df, label)
        written[label] = out.count()
        return out

    materialize = line_templates.materialize
    monkeypatch.setattr(line_templates, "materialize", noted)
    own = lambda i, k: f"{'pqrstuvwxyz'[k]}{'ab'[i % 2]}{'cdefghij'[i // 2 % 8]}{'klm'[i // 16]} words of one document alone"
    rows = [(i, "\n".join([f"Seen on page {i} of {'abc'[i % 3]}x today", *[own(i, k) for k in range(10)]])) for i in range(40)]
    got = {r["doc_id"]: r["kept"] for r in line_templates.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: text if i == 0 else text.split("\n", 1)[1] for i, text in rows}
    assert written["lines"] <= 3 + 2 and written["templates"] == 3


def test_a_leaf_map_has_the_places_of_its_leaves_alone(spark):
    rng = random.Random(4)
    leaves = [-(2**63), -1, 0, 2**63 - 1, *(rng.randrange(-(2**63), 2**63) for _ in range(300))]
    held = line_templates.leaf_map(spark.createDataFrame([(x,) for x in leaves], "leaf long"))
    at = [line_templates._place(x) for x in leaves]
    assert len(held) == 1 << line_templates.MAP_BITS - 3 and all(held[p >> 3] >> (p & 7) & 1 for p in at)
    assert sum(map(int.bit_count, held)) == len(set(at))
    assert not any(line_templates.leaf_map(spark.createDataFrame([], "leaf long")))


def plant(rng, item, k, voc):
    words = item.split()
    for _ in range(k):
        at, how = rng.randrange(len(words)), rng.random()
        if how < 0.4:
            words[at] = rng.choice(voc)
        elif how < 0.7:
            words.insert(at, rng.choice(voc))
        else:
            del words[at]
    return " ".join(words)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_leaks_reach_the_target_recall(spark):
    rng = random.Random(6)
    voc = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]
    items = [(i, " ".join(rng.choice(voc) for _ in range(rng.randrange(12, 50)))) for i in range(40)] + [(50, None), (51, ""), (None, "x y z")]
    rows = [(n, i, " ".join(rng.choice(voc) for _ in range(30)) + " " + plant(rng, items[i][1], rng.randrange(int(0.2 * len(items[i][1].split())) + 1), voc) + ". " + " ".join(rng.choice(voc) for _ in range(30))) for n, i in enumerate(list(range(40)) * 5)]
    clean = [(1000 + n, None, " ".join(rng.choice(voc) for _ in range(200))) for n in range(50)]
    awkward = [(2000, None, None), (2001, None, ""), (None, 0, items[0][1]), (2002, 0, items[0][1].upper())]
    docs = spark.createDataFrame([(r[0], r[2]) for r in rows + clean + awkward], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = edit_leaks.find_leaks(docs, bench).collect()
    got = {(r["doc_id"], r["item_id"]) for r in found}
    assert sum((n, i) in got for n, i, _ in rows) >= 0.97 * len(rows)
    assert not any(d is not None and 1000 <= d < 1050 for d, _ in got) and (None, 0) in got and (2002, 0) in got
    texts = {r[0]: r[2] for r in rows}
    for r in found[:40]:
        if r["doc_id"] in texts:
            words = re.findall(r"\w+", texts[r["doc_id"]].lower())[r["start_word"] : r["start_word"] + r["n_words"]]
            assert edit_distance(dict(items)[r["item_id"]].split(), words) == r["distance"]
    assert {(r["doc_id"], r["item_id"]) for r in edit_leaks.find_leaks(docs, bench, block_bytes=2000).collect()} == got
    assert edit_leaks.find_leaks(docs.limit(0), bench).count() == 0 and edit_leaks.find_leaks(docs, bench.limit(0)).count() == 0


@pytest.mark.parametrize("size", [20, 60, 120, 200])
def test_every_leak_at_the_largest_distance_is_found(spark, size):
    rng = random.Random(size)
    voc = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]
    items = [(i, " ".join(rng.choice(voc) for _ in range(size))) for i in range(5)]
    fill = lambda: " ".join(rng.choice(voc) for _ in range(30))
    rows = [(n, f"{fill()} {plant(rng, items[n % 5][1], size // 5, voc)} {fill()}") for n in range(60)]
    found = edit_leaks.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(n, n % 5) for n, _ in rows} <= {(r["doc_id"], r["item_id"]) for r in found.collect()}


def test_leaks_equal_brute_force_on_awkward_rows(spark):
    """Repeated items and rows, ties, a very long text, clashing columns; distances by brute force over all stretches."""
    rng = random.Random(12)
    voc = ["".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(400)]
    say = lambda k: " ".join(rng.choice(voc) for _ in range(k))
    items = [(i, say(rng.randrange(1, 25)), "x") for i in range(12)] + [(3, "other words of item three", "x"), (20, say(3), "y"), (21, None, "y")]
    items += [(22, items[0][1], "z"), items[1]]
    rows = [(n, say(rng.randrange(25)) + " " + plant(rng, items[n % 12][1], rng.randrange(6), voc) + " " + say(rng.randrange(25)), 1, "q") for n in range(80)]
    rows += [(100, f"{items[4][1]} {say(5)} {items[4][1]}", 2, "q"), (101, say(60_000) + " " + items[7][1] + " " + say(2_000), 2, "q"), rows[0], (None, items[5][1], 0, "q"), (102, None, 0, None)]
    found = edit_leaks.find_leaks(spark.createDataFrame(rows, "doc_id long, text string, item_id long, distance string"), spark.createDataFrame(items, "item_id long, text string, doc_id string"))
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in found.collect()}
    want = {}
    for doc, text, *_ in rows:
        if doc == 101 or not text:
            continue
        words = text.split()
        for item, t, _ in items:
            if t:
                p, row = t.split(), [0] * (len(words) + 1)
                for i, x in enumerate(p, 1):
                    last, row = row, [i]
                    for j, y in enumerate(words, 1):
                        row.append(min(last[j - 1] + (x != y), last[j] + 1, row[-1] + 1))
                if min(row) <= int(0.2 * len(p) + 1e-9):
                    want[doc, item] = min(want.get((doc, item), 99), min(row))
    assert {k: v for k, v in got.items() if k[0] != 101} == want and got[101, 7] == 0


def test_leaks_need_few_repetitions():
    plans = [edit_leaks.repetitions(n, 0.2) for n in (5, 25, 100, 400)]
    assert all(p and p[1] <= edit_leaks.MAX_REPEATS for p in plans) and plans[0][0] >= plans[-1][0] == 1
    assert all(edit_leaks.plan_size(n) >= n for n in range(1, 900))


def test_within_equals_best_stretch():
    rng = np.random.default_rng(4)
    for _ in range(300):
        a, b = rng.integers(0, 4, rng.integers(1, 90)), rng.integers(0, 4, rng.integers(0, 120))
        d = edit_leaks.best_stretch(a, b)[0]
        assert edit_leaks.within(a.tolist(), b.tolist(), d) and not edit_leaks.within(a.tolist(), b.tolist(), d - 1)


def test_best_stretch_equals_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(40):
        a, b = rng.integers(0, 4, rng.integers(1, 9)), rng.integers(0, 4, rng.integers(1, 14))
        d, i, j = edit_leaks.best_stretch(a, b)
        assert d == min(edit_distance(a.tolist(), b[x:y].tolist()) for x in range(len(b) + 1) for y in range(x, len(b) + 1)) == edit_distance(a.tolist(), b[i:j].tolist())


def test_search_equals_brute_force_with_ties(spark):
    """Every row is a candidate of every other row's query, also where rows share an id."""
    rng = np.random.default_rng(5)
    vectors = rng.normal(0, 0.2, (300, 8))
    vectors[50:120] = vectors[0]
    vectors[200:260] = 0
    rows = [(int(i), [float(x) for x in v], "extra") for i, v in enumerate(vectors)] + [(300, None, ""), (301, [float("nan")] * 8, ""), (302, [None] * 8, ""), (303, [], ""), (304, [1.0, 2.0], ""), (None, [0.1] * 8, ""), (7, [9.0] * 8, ""), (305, [float("inf")] * 8, "")]
    rows += [(100, [0.3] * 8, ""), (50, rows[50][1], ""), (400, [1e16] + [0.0] * 7, ""), (401, [-3e11] + [1.0] * 7, ""), (402, [1.0] * 700, ""), (500, [2.0] * 700, ""), (450, [0.0] + [-2.0] * 7, "")]
    names = "vec_id long, embedding array<double>, score string, query long, row string"
    df = spark.createDataFrame([(*r, 1, "r") for r in rows], names).repartition(3)
    ints = [(i, [math.floor(256 * x) for x in v]) for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = Counter()
    for n, (q, v) in enumerate(ints):
        if q % 50 == 0:
            others = [(sum(x * y for x, y in zip(v, w)), i) for m, (i, w) in enumerate(ints) if m != n and len(w) == len(v)]
            want.update((q, k + 1, i, s) for k, (s, i) in enumerate(sorted(others, key=lambda x: (-x[0], x[1]))[:5]) if abs(s) < 2**63)
    got = Counter(map(tuple, va_search.top_k(df.filter("vec_id <> 400 OR vec_id IS NULL"), F.col("vec_id") % 50 == 0, block_queries=2).collect()))
    without = Counter()
    for n, (q, v) in enumerate(ints):
        if q % 50 == 0 and q != 400:
            others = [(sum(x * y for x, y in zip(v, w)), i) for m, (i, w) in enumerate(ints) if m != n and len(w) == len(v) and i != 400]
            without.update((q, k + 1, i, s) for k, (s, i) in enumerate(sorted(others, key=lambda x: (-x[0], x[1]))[:5]))
    assert got == without
    big = Counter(map(tuple, va_search.top_k(df, F.col("vec_id") == 450).collect()))
    assert big == Counter({k: n for k, n in want.items() if k[0] == 450})
    assert va_search.top_k(df.limit(0), F.lit(True)).count() == 0


def test_search_fails_on_scores_beyond_64_bits(spark):
    df = spark.createDataFrame([(1, [1e15, 1e15]), (2, [1e15, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        va_search.top_k(df, F.lit(True)).collect()
    with pytest.raises(Exception, match="64 bits"):
        va_search.top_k(spark.createDataFrame([(1, [1e300])], "vec_id long, embedding array<double>"), F.lit(True)).collect()


def test_shards(spark, docs, rows, none, twice, tmp_path):
    out = shuffle_shards.assign_shards(docs, 7, bucket_rows=16).collect()
    sizes = Counter(r["shard"] for r in out)
    assert len(out) == len(rows) and max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 7
    for s in sizes:
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sizes[s]))
    texts = {r[0]: (r[1] or "").encode() for r in rows}
    assert all((r["size"], r["text_crc32"]) == (len(texts[r["doc_id"]]) + 16, zlib.crc32(texts[r["doc_id"]])) for r in out)
    again = shuffle_shards.assign_shards(docs.repartition(5), 7, bucket_rows=16).collect()
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in out} == {(r["doc_id"], r["shard"], r["slot"]) for r in again}
    assert [r["doc_id"] for r in sorted(out, key=lambda r: (r["slot"], r["shard"]))] != sorted(texts)
    assert shuffle_shards.assign_shards(none).count() == 0 and shuffle_shards.assign_shards(twice).count() == len(rows) + 25
    path = str(tmp_path / "shards")
    shuffle_shards.write_shards(twice, path, 3)
    back = spark.read.parquet(path)
    assert back.count() == len(rows) + 25 and back.select("shard").distinct().count() == 3 and "text" in back.columns


def test_shards_hold_whole_records_whatever_the_partitions(spark, docs, none, tmp_path, monkeypatch):
    """Slot by slot the same records for other partitions, hot groups of equal rows spread over buckets, clashing names kept."""
    monkeypatch.setattr(shuffle_shards, "HOT_ROWS", 10)
    monkeypatch.setattr(shuffle_shards, "COPIES_PER_ROW", 16)
    rows = docs.select("doc_id", "text", "lang", F.lit("mine").alias("shard"), F.lit(1).alias("Slot"))
    same = spark.range(300).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one text").alias("text"), F.lit(None).cast("string").alias("lang"), F.lit("mine").alias("shard"), F.lit(1).alias("Slot"))
    rows = rows.unionByName(same).unionByName(rows.limit(0))
    found = []
    for k, parts in enumerate((2, 7)):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            out = shuffle_shards.write_shards(rows.repartition(parts), str(tmp_path / f"s{k}"), 5, bucket_rows=16)
            assert out.columns == ["doc_id", "text", "lang", "shard", "Slot", "slot_", "shard_"]
            found.append(sorted(map(tuple, out.collect()), key=repr))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0] == found[1] and {r[3] for r in found[0]} == {"mine"}
    sizes = Counter(r[-1] for r in found[0])
    assert len(found[0]) == rows.count() and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r[-2] for r in found[0] if r[-1] == s) == list(range(sizes[s]))
    assert Counter(r[:3] for r in found[0]) == Counter((r["doc_id"], r["text"], r["lang"]) for r in rows.collect())
    placed = shuffle_shards.placed_records(rows, 1, 16, 1 << 30).filter("__record.doc_id IS NULL").groupBy("__bucket").count().collect()
    assert len(placed) > 10 and max(r["count"] for r in placed) < 40
    assert shuffle_shards.write_shards(none, str(tmp_path / "none"), 3).count() == 0


def test_places_of_a_bucket_are_uniform(spark):
    """Chi-square of the place of each of 8 records over seeds, against a uniform permutation."""
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(8)], "doc_id long, text string").cache()
    seen, runs = np.zeros((8, 8)), 40
    for seed in range(runs):
        for r in shuffle_shards.assign_shards(docs, 1, seed=seed).collect():
            seen[r["doc_id"], r["slot"]] += 1
    assert seen.sum() == 8 * runs and ((seen - runs / 8) ** 2 / (runs / 8)).sum() < 95  # 49 degrees of freedom


def test_licences(spark, none):
    mit = "MIT License\n\nCopyright (c) 2020 A.\n\n" + ". ".join(s for n, s in license_rules.SENTENCES if n in ("MitGrant", "MitNotice", "AsIsSoftware", "AuthorsNotLiable")) + "."
    rows = [(1, mit), (2, "Hello.\nReleased under the MIT License.\nBye"), (3, "Licensed under the Apache License, Version 2.0."), (4, "SPDX-License-Identifier: MPL-2.0\ncode"), (5, None), (6, ""), (7, "All rights reserved. All rights reserved."), (8, "licensed under nothing")]
    got = {r["doc_id"]: (r["licences"], r["n_known"]) for r in license_rules.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("MIT", 5), 2: ("MIT", 1), 3: ("Apache-2.0", 1), 4: ("MPL-2.0", 1), 5: ("NONE", 0), 6: ("NONE", 0), 7: ("NOT-OPEN-RIGHTS-RESERVED", 2), 8: ("NONE", 0)}
    assert license_rules.scan_licenses(none).count() == 0


def test_licence_lines_below_other_lines(spark, none):
    """Titles and table rows without a full stop, wrapped sentences, comment signs, long texts, repeated rows, clashing columns."""
    bsd = dict((s, n) for n, s in license_rules.SENTENCES)
    wrapped = next(s for s, n in bsd.items() if n == "BsdGrant").split()
    body = "# " + " ".join(wrapped[:9]) + "\n#  " + " ".join(wrapped[9:]) + ":\n# 1. " + ".\n# 2. ".join(s for s, n in bsd.items() if n in ("BsdSource", "BsdBinary")) + "."
    rows = [
        (1, "| a | b |\nLicensed under CC BY-NC 4.0.\nmore"), (2, "A title\nAll rights reserved\nCopyright 2020 B"), (3, "Title without a stop\n" + body),
        (4, "x " * 200_000 + "\nMIT License\n" + "y " * 200_000), (5, "MIT License and more words"), (5, "MIT License and more words"), (None, "see\nSPDX-License-Identifier: BSD-3-Clause\nend"),
        (6, "GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n"),
        (7, "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.\n\nThis program is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\nGNU General Public License for more details.\n\nYou should have received a copy of the GNU General Public License\nalong with this program.  If not, see <https://www.gnu.org/licenses/>."),
        (8, "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
        (9, "MIT License\nMIT License\nISC License"), (10, "|||\n\n|"), (11, "one.two\nthree"),
    ]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, ids int, licences string")
    out = license_rules.scan_licenses(docs).collect()
    got = Counter((r["doc_id"], r["licences"], r["n_known"]) for r in out)
    assert got == Counter([(1, "CC-BY-NC-4.0", 1), (2, "NOT-OPEN-RIGHTS-RESERVED", 1), (3, "BSD-2-Clause", 3), (4, "MIT", 1), (5, "NONE", 0), (5, "NONE", 0), (None, "BSD-3-Clause", 1), (6, "GPL-2.0", 1), (7, "GPL-3.0-or-later", 4), (8, "LGPL-2.1-or-later", 2), (9, "ISC;MIT", 3), (10, "NONE", 0), (11, "NONE", 0)])
    assert {r["doc_id"]: r["n_sentences"] for r in out if r["doc_id"] in (10, 11)} == {10: 0, 11: 2}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(name, spark, duck, data):
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    want = duck.sql(ORACLE_SQL[name])
    assert columns == sorted(want.columns)
    key = lambda found: sorted(tuple(map(repr, r)) for r in found)
    assert key(df.select(*columns).collect()) == key(want.project(",".join(f'"{c}"' for c in columns)).fetchall())


def test_pipeline(spark, data):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_duplicates", "decontaminate", "tokenize"]
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, data)
        assert out.columns == docs.columns
        at = corpus_pipeline.materialize(out, name)
    kept = at.count()
    assert 0 < kept < docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, at, data).count() == kept
    left = parity_join.near_duplicates(at)
    assert left.filter("doc_id <> component_id").count() == 0 and edit_leaks.find_leaks(at, spark.read.parquet(f"{data}/benchmark.parquet")).count() == 0


def test_stages_take_small_batches_and_results_do_not_depend_on_them(spark, data):
    """By default a whole partition went to a worker at once, and filled an executor with its copies."""
    import pyarrow as pa

    import corpus_pipeline

    key = corpus_pipeline.BATCH_KEY
    before = spark.conf.get(key, None)
    sizes = lambda: [r[0] for r in spark.range(0, 4000, 1, 1).selectExpr("repeat('x', 10000) as x").mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in bs), "n long").collect()]
    try:
        spark.conf.unset(key)
        assert max(sizes()) > 30 << 20
        want = plain(corpus_pipeline.run(spark, data))
        assert max(sizes()) < corpus_pipeline.BATCH_BYTES + 200_000
        spark.conf.set(key, "60000")
        assert plain(corpus_pipeline.run(spark, data)) == want and len(want) > 50 and spark.conf.get(key) == "60000"
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


AWKWARD = "doc_id long, text string, lang string, score double, held_out boolean, lang_pred string, foreign double, kept string, n_lines long, n_dropped long, n_leaks long, __leaks string, component_id string, n_chars int"


def awkward(spark, rows):
    return spark.createDataFrame([(i, t, lang, 0.25, True, "p", 2.0, "k", 7, 8, 9, "l", "c", len(t or "")) for i, t, lang in rows], AWKWARD)


def plain(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


@pytest.fixture
def bench_dir(spark, tmp_path):
    spark.createDataFrame([(1, "seven sharp pins stuck in one red pillow case tonight"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages_keep_all_columns_and_empty_tables(spark, bench_dir):
    import corpus_pipeline

    rows = [(i, f"the quick brown fox number {w} ran over a lazy dog and slept in the sun", "en") for i, w in enumerate("one two three".split())]
    docs = awkward(spark, rows[:1] + [(5, "totally different words stand here in this second long line of text", "en"), (None, "and a third one without any id at all, which is still a document", None)])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, bench_dir)
        assert out.columns == docs.columns and plain(out) == plain(docs), name
        assert stage(spark, docs.limit(0), bench_dir).count() == 0
    assert corpus_pipeline.tokenize(spark, docs.limit(0), bench_dir).count() == 0 and corpus_pipeline.tokenize(spark, docs, bench_dir).count() == 3


def test_near_duplicate_stage_without_or_with_repeated_ids(spark, bench_dir):
    import corpus_pipeline

    say = lambda k, n=30: " ".join(f"{k}{i}" for i in range(n))
    rows = [(1, say("a")), (4, say("a") + " more"), (None, say("a")), (None, say("b")), (None, say("b")), (None, say("b") + " more"), (2, say("c")), (2, say("d")), (2, say("d")), (7, say("d")), (8, None), (8, None), (None, ""), (None, ""), (9, say("e", 3000)), (10, say("e", 3000))]
    docs = awkward(spark, [(i, t, "en") for i, t in rows])
    got = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, bench_dir).collect())
    b = [t for i, t in got if i is None and t]
    assert len(b) == 1 and b[0].startswith(say("b"))
    del got[None, b[0]]
    assert got == {(1, say("a")): 1, (2, say("c")): 1, (7, say("d")): 1, (8, None): 2, (None, ""): 2, (9, say("e", 3000)): 1}


def test_decontaminate_stage_judges_each_row(spark, bench_dir):
    import corpus_pipeline

    item = "seven sharp pins stuck in one red pillow case tonight"
    rows = [(None, "x " + item), (None, "clean words only"), (3, item.upper() + "!"), (3, "clean again"), (4, None), (5, ""), (6, "w " * 50_000 + item.replace("one", "two")), (6, "y")]
    out = corpus_pipeline.decontaminate(spark, awkward(spark, [(i, t, "en") for i, t in rows]), bench_dir)
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == Counter(rows[k] for k in (1, 3, 4, 5, 7))


def test_line_stage_equals_brute_force_on_equal_lines(spark, bench_dir):
    """Lines that recur verbatim and share no other template, in at least 20 documents, are cut from all but the first."""
    import corpus_pipeline

    rng = random.Random(4)
    hot = [f"{w} lines come back here and there" for w in ("some", "other", "all")] + ["ok then", "=====", "漢字"]
    rows = []
    for i in range(80):
        own = [" ".join("".join(rng.choice("abcdefghijk") for _ in range(6)) for _ in range(rng.randrange(4, 9))) for _ in range(rng.randrange(3))]
        rows.append((i if i % 9 else None, "\n".join(own + [h for h in hot if rng.random() < 0.6])))
    rows += rows[:6] + [(200, "a very long line " * 30_000), (201, None), (202, "")]
    ids = lambda i: -1 if i is None else i
    having = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            having[line].add(ids(i))
    cut = lambda i, line: line in hot and any(map(str.isalpha, line)) and len(having[line]) >= 20 and ids(i) != min(having[line])
    want = Counter()
    for i, t in rows:
        lines = t.split("\n") if t is not None else []
        left = [x for x in lines if not cut(i, x)]
        if len(left) == len(lines) or "".join(left).strip():
            want[i, None if t is None else "\n".join(left), len(t or "") if len(left) == len(lines) else len("\n".join(left))] += 1
    out = corpus_pipeline.line_dedup(spark, awkward(spark, [(i, t, "en") for i, t in rows]), bench_dir)
    assert Counter((r["doc_id"], r["text"], r["n_chars"]) for r in out.collect()) == want
