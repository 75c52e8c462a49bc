"""Operators against brute force, libraries or SQL, with the cases each docstring defines."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from celltrail.llm import best_fit_packing as packing
from celltrail.llm import html_extraction as pages
from celltrail.llm import language_id as languages
from celltrail.llm import license_scan as licences
from celltrail.llm import multiset_fingerprint as prints
from celltrail.llm import ngram_jaccard as jaccard
from celltrail.llm import sentencepiece_fst as pieces
from celltrail.llm import suffix_dedup as dedup
from celltrail.llm import topk_search as search
from celltrail.llm import toxicity

P = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, rejected boolean"


def prose(rnd, n, words=("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau".split())):
    return " ".join(rnd.choice(words) + str(rnd.randint(0, 60)) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Texts with nulls, blanks, copies, near copies, shared passages, long and periodic texts."""
    rnd = random.Random(7)
    base, passage = prose(rnd, 150), prose(rnd, 90)
    texts = [None, "", "   ", "one", "two words", "Two Words", base, base, base.upper(), "ha " * 900, "ha " * 700, prose(rnd, 9000)]
    for k in range(25):
        words = base.split()
        words[rnd.randint(0, 149)] = f"edit{k}"
        texts.append(" ".join(words))
    texts += [prose(rnd, rnd.randint(5, 60)) + " " + passage + " " + prose(rnd, rnd.randint(0, 60)) for _ in range(12)]
    texts += [prose(rnd, rnd.randint(1, 200)) for _ in range(40)]
    rows = [(k * 3, t) for k, t in enumerate(texts)] + [(18, base)]  # a repeated row
    return rows


@pytest.fixture(scope="module")
def table(spark, corpus, tmp_path_factory):
    """A folder with the corpus as documents, extra columns of clashing names included."""
    path = tmp_path_factory.mktemp("tables")
    rows = [(d, t, "en", "s", len(t or ""), 0.5, True) for d, t in corpus]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("empty")
    spark.createDataFrame([], DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return str(path)


def test_empty_tables(spark, empty):
    from celltrail.llm.registry import QUERIES

    for name, query in QUERIES.items():
        assert query(spark, empty).count() == 0, name


def sets_of(rows, words):
    out = {}
    for k, (_, t) in enumerate(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[k] = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    return out


def components(rows, over, words):
    sets = sets_of(rows, words)
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= over * len(sets[i] | sets[j]):
                a, b = find(rows[i][0]), find(rows[j][0])
                root[max(a, b)] = min(a, b)
    return [(d, len(sets[k]), find(d)) for k, (d, _) in enumerate(rows)]


@pytest.mark.parametrize("over,words,few,block,long", [(90, 3, 64, 1024, 1000), (80, 5, 64, 1024, 1000), (90, 3, 4, 8, 1000), (90, 3, 64, 1024, 120), (80, 5, 64, 1024, 60)])
def test_jaccard_components(spark, table, corpus, monkeypatch, over, words, few, block, long):
    monkeypatch.setattr(jaccard, "LONG", long)  # the last two send the larger sets through neighbours
    monkeypatch.setattr(jaccard, "FEW", few)  # the last case sends all through chains and several blocks
    monkeypatch.setattr(jaccard, "BLOCK", block)
    jaccard._pairs.cache_clear()
    found = jaccard.joined(spark.read.parquet(f"{table}/documents.parquet"), jaccard.Similarity(over, 100, words)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == sorted(components(corpus, over, words))


def test_similar_long_sets_share_neighbours():
    """Sets at the very threshold, what differs between them put where it parts the most, always share a key."""
    for over in (90, 80):
        s, rng = jaccard.Similarity(over, 100, 3), np.random.default_rng(over)
        for n in (1000, 1111, 2503):
            for share in (0.0, 0.5, 1.0):
                union = np.arange(1, int(n / (over / 100)) + 1, dtype=np.uint64)
                spare = len(union) - -(-over * len(union) // 100)  # elements that are not common
                for trial in range(8):
                    odd = np.arange(0, 2 * spare, 2) + 1 if trial == 0 else rng.choice(len(union), spare, replace=False)
                    mine = rng.random(spare) < share
                    a, b = np.delete(union, odd[mine]), np.delete(union, odd[~mine])
                    assert 100 * len(np.intersect1d(a, b)) >= over * len(union)
                    assert abs(int(s.size_class(np.array([len(a)]))[0]) - int(s.size_class(np.array([len(b)]))[0])) <= 1
                    p, q = (x[: int(s.neighbours(np.array([len(x)]))[0])] for x in (a, b))
                    assert set(zip(p[:-1].tolist(), p[1:].tolist())) & set(zip(q[:-1].tolist(), q[1:].tolist()))


def test_jaccard_keys_of_long_texts_grow_with_them(spark):
    rng = np.random.default_rng(0)
    rows = [(k, n, rng.integers(0, 2**63, 10).tobytes(), rng.integers(0, 2**63, int(0.21 * n)).tobytes()) for k, n in enumerate((30_000, 60_000, 300_000))]
    df = spark.createDataFrame(rows, "node long, n long, rare binary, often binary")
    counts = {r.node: r["count"] for r in jaccard.keys(df, jaccard.Similarity(90, 100, 3)).groupBy("node").count().collect()}
    assert all(counts[k] < 0.25 * n for k, n, *_ in rows)


def test_suffix_array():
    rnd = random.Random(3)
    for _ in range(200):
        a = np.array([rnd.randint(1, rnd.choice([1, 2, 6])) for _ in range(rnd.randint(1, 50))])
        assert dedup.suffix_array(a).tolist() == sorted(range(len(a)), key=lambda i: a[i:].tolist())


class Taken:
    """Stands for a table and hands out what would run on it."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run


def traced(f):
    """What ``f`` returns, and MB that it held at once beyond what stood before."""
    tracemalloc.start()
    out = f()
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return out, most


def test_suffix_dedup_holds_little_at_once():
    """A worker's share: anchors of a batch of 2 MB, and a full buffer of contexts, most of which repeat."""
    rng = np.random.default_rng(1)
    words = ["".join(map(chr, rng.integers(97, 123, rng.integers(2, 9)))) for _ in range(20_000)]
    texts = [" ".join(words[i] for i in rng.integers(0, len(words), 330)) for _ in range(1000)]
    one = pa.array(np.arange(1000))
    batch = pa.RecordBatch.from_arrays([one, one, one, pa.array(texts)], names=["h1", "h2", "weight", "text"])
    run = dedup.anchored(Taken(), dedup.PASSAGE)
    list(run(iter([batch])))  # fills the tables of powers
    rows, most = traced(lambda: list(run(iter([batch]))))
    data, offsets = dedup.utf8(batch.column(3))
    assert sum(r.num_rows for r in rows) == len(dedup.anchors(data, offsets, dedup.PASSAGE)[0]) > 1000
    assert most < 60

    contexts = []
    for k in range(2500):
        base = texts[k // 25].encode()
        at = int(rng.integers(0, 300))
        contexts.append(base[at : at + 598] + bytes([97 + k % 26]))
    found, most = traced(lambda: dedup.repeated_windows(contexts, 200))
    seen = Counter(hash(t[i : i + 200]) for t in contexts for i in range(len(t) - 199))
    assert all(hit.tolist() == [seen[hash(t[i : i + 200])] > 1 for i in range(len(hit))] for t, hit in zip(contexts, found, strict=True))
    assert most < 80


def removed_by_hand(rows, length):
    count, texts = Counter(), [(t or "").encode() for _, t in rows]
    for t in texts:
        count.update(t[i : i + length] for i in range(len(t) - length + 1))
    out = []
    for (d, _), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((d, len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("many,shares", [(1500, 2048), (1, 2048), (1500, 1), (1, 5)])
def test_suffix_dedup(spark, table, corpus, monkeypatch, many, shares):
    monkeypatch.setattr(dedup, "MANY", many)  # one: all go by window hashes
    monkeypatch.setattr(dedup, "SHARES", shares)  # how much of a table makes a key hot
    found = dedup.op5_suffix_dedup(spark, table).collect()
    assert sorted(tuple(r) for r in found) == removed_by_hand(corpus, dedup.LONG.length)


def test_anchors_of_equal_low_bits():
    """Hashes that differ only where a place would be kept are told apart all the same."""
    rng = np.random.default_rng(1)
    value = (np.uint64(5) << np.uint64(40)) + rng.integers(0, 4, 300).astype(np.uint64)
    start = np.arange(280)
    assert dedup.leftmost_least(value, start, 20).tolist() == [s + int(np.argmin(value[s : s + 20])) for s in start]


def test_packing_round_trip(spark, table, corpus):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = []
    for d, t in corpus:
        ids = whole.encode(t or "", add_special_tokens=False).ids + [0]
        head = len(ids) % 2048 or 2048
        cuts = [(0, min(head, len(ids)))] + [(s, 2048) for s in range(head, len(ids), 2048)]
        want += [(d, k, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())) for k, (s, n) in enumerate(cuts)]
    rows = packing.op2_best_fit_packing(spark, table).collect()
    assert sorted(tuple(r)[:5] for r in rows) == sorted(want)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= -(-sum(r.length for r in rows) // 2048) + 1


def test_packing_of_a_very_long_word():
    """A text without a break is tokenised as a whole, in time that grows with it."""
    tok = packing.tokenizer(P.path("byte_bpe_50k.json"))
    rnd = random.Random(2)
    for text in ("a" * 200_000, "".join(rnd.choice("abcdefgh") for _ in range(200_000)), "x" * 50_000 + " é " + "y" * 50_000):
        ids, per = tok.encode([text, "", text[:10]])
        assert ids[: per[0]].tolist() == tok.whole.encode(text, add_special_tokens=False).ids and per[1] == 0


def test_packing_plan_uses_every_piece():
    rng = np.random.default_rng(0)
    for mean in (3.0, 5.5, 7.0):
        lengths = np.clip(rng.lognormal(mean, 1, 3000).astype(int), 1, 2048)
        made = packing.plan(np.bincount(lengths, minlength=2049))
        used = Counter()
        for items, k in made:
            assert sum(items) <= 2048
            for x in items:
                used[x] += k
        assert used == Counter(lengths.tolist())
        assert sum(k for _, k in made) <= 1.03 * lengths.sum() / 2048 + 1


def test_packing_plan_looks_beyond_a_pair_it_cannot_take():
    """(7, 3) would fill the sequence of 17 beside 7, but the only 7 is in it already; (5, 5) fills it too."""
    made = packing.plan(np.bincount([7, 6, 5, 5, 3], minlength=18))
    assert sorted(x for items, k in made for x in items * k) == [3, 5, 5, 6, 7]
    assert [7, 5, 5] in [items for items, _ in made]


def test_packing_tokenizer_matches_library():
    tok = packing.tokenizer(P.path("byte_bpe_50k.json"))
    rnd = random.Random(1)
    parts = ["a", "'", "s", "ll", "re", " ", "  ", "\n", "\t", "1", "é", "É", "!", "…", "日", "'ve", " ", "<|endoftext|>", "x", "\r\n"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(600)] + [""]
    ids, per = tok.encode(texts)
    for t, got in zip(texts, np.split(ids, np.cumsum(per)[:-1]), strict=True):
        assert got.tolist() == tok.whole.encode(t, add_special_tokens=False).ids, t


def test_sentencepiece_matches_library():
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), pieces.transducer(path)
    rnd = random.Random(2)
    parts = ["a", "the", "in", "  ", " ", "\n", "é", "日", "😀", "ing", "1", "\t", "É", "qq", "straße"]
    for t in ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25))) for _ in range(800)] + ["", "hello world", "x" * 200]:
        ids = np.frombuffer(own.encode(t), np.uint32).tolist()
        assert ids == library.encode(t), t
        assert own.decode(ids) == t


def test_sentencepiece_query(spark, table, corpus):
    rows = {r.doc_id: r for r in pieces.op8_sentencepiece_fst(spark, table).collect()}
    assert all(r.exact for r in rows.values())
    assert rows[0].n_ids == 0


@pytest.mark.parametrize("merges", [True, False])
def test_shortest_path_of_all(merges):
    """The path taken is the lightest of all paths of the composed graph, enumerated; a merge model has one of finite weight."""
    model = pieces.Model(P.path("piece_bpe_32k.model"))
    model.merges = merges
    t = pieces.Encoder(model)
    rnd = random.Random(4)
    words = ["▁there", "▁straße", "▁日x", "▁▁a", "ing", "▁thethe", *("".join(rnd.choice("▁aeinrst") for _ in range(rnd.randint(1, 8))) for _ in range(60))]

    def paths(word, at, before):
        if at == len(word):
            yield 0.0, ()
        for end, ids, w in t.arcs(word, at) if at < len(word) else ():
            step = t.step(before, ids)
            if step < math.inf:
                for rest, more in paths(word, end, ids[0] if merges and len(ids) == 1 and ids[0] in t.known else -1):
                    yield step + (0.0 if merges else w) + rest, (*ids, *more)

    for word in words:
        every = list(paths(word, 0, -1))
        best = min(w for w, _ in every)
        assert tuple(t.shortest(word)) in [p for w, p in every if w <= best + 1e-9]
        assert not merges or len(every) == 1


def test_normaliser_is_a_transducer():
    model = pieces.Model(P.path("piece_bpe_32k.model"))
    texts = ["", " ", "a", " a", "a  b ", "  a  b  c ", "\na b", "a\tb  "]
    for front in (True, False):
        for collapse in (True, False):
            model.front, model.collapse = front, collapse
            for text in texts:
                plain = re.sub(" +", " ", text).strip(" ") if collapse else text
                due = ("▁" if front and plain else "") + plain.replace(" ", "▁")
                assert pieces.normaliser(model).applied(text) == due, (front, collapse, text)


def test_language_accuracy_and_cases(spark, tmp_path):
    rnd = random.Random(5)
    sounds = {"aa": ("lo", "mi", "ra", "te"), "bb": ("schk", "ung", "ver", "ei"), "cc": ("qué", "ñol", "ción", "ar")}
    rows = [(k, " ".join("".join(rnd.choice(sounds[g]) for _ in range(3)) for _ in range(rnd.randint(4, 60))), g) for k in range(400) for g in [rnd.choice(list(sounds))]]
    rows += [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 !! \u00b2 \u00bd \u2460", "bb"), (1003, "lomira", None), (1004, "lomira " * 30_000, "aa"), (1005, "12 " * 20_000 + "lomira", "aa"), (None, "lomira", "aa"), (0, rows[0][1], rows[0][2])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in languages.op3_language_id(spark, str(tmp_path)).collect()}
    assert [found[k].lang_pred for k in (1000, 1001, 1002, 1004, 1005)] == ["und"] * 3 + ["aa"] * 2
    held = [(found[d], g) for d, _, g in rows if zlib.crc32(str(d).encode()) % 4 == 2 and d < 1000]
    assert all(r.held_out for r, _ in held)
    assert sum(r.lang_pred == g for r, g in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in found.values())


def test_toxicity_accuracy_and_cases(spark, tmp_path):
    rnd = random.Random(6)
    rows, labels = [], []
    for k in range(900):
        words = prose(rnd, rnd.randint(8, 80)).split()
        bad = rnd.random() < 0.3
        if bad:
            for _ in range(rnd.randint(2, 4)):
                words.insert(rnd.randint(0, len(words)), rnd.choice(["grumbly", "snarkful", "vexq" + rnd.choice(["or", "um", "ix"])]))
        rows.append((k, " ".join(words)))
        labels.append((k, 1, int(bad)))
    rows += [(2000, None), (2001, ""), (None, "alpha")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    found = {r.doc_id: r for r in toxicity.op1_toxicity(spark, str(tmp_path)).collect()}
    truth = {k: t for k, _, t in labels}
    held = [r for d, r in found.items() if d in truth and r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(r.score is not None and r.predicted == int(r.score >= 0.7) for r in found.values())


def test_language_sample(spark, monkeypatch):
    """Texts teach beyond their heads; rows without an id are sampled like others, and equal rows once."""
    monkeypatch.setattr(languages, "SAMPLE_ROWS", 50)
    rnd = random.Random(9)
    sounds, head = {"aa": ("lo", "mi", "ra", "te"), "bb": ("schk", "ung", "ver", "ei")}, "boilerplate header words " * 50
    body = lambda g: " ".join("".join(rnd.choice(sounds[g]) for _ in range(3)) for _ in range(400))
    rows = [(None, head + body(g), g) for g in ("aa", "bb") for _ in range(300)] + [(7, head + body("aa"), "aa")] * 900
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    learned = languages.learn(df)
    assert [learned.predict(body(g))[::2] for g in ("aa", "bb") * 5] == [("aa", False), ("bb", False)] * 5
    collected, collect = [], type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: collected.append(collect(self)) or collected[-1])
    languages.learn(df)
    assert all(len(found) <= 2 * 2 * 50 * 1.4 for found in collected)


def kneser_ney(texts):
    """Log-probability of a word under each class, from dictionaries; texts: (text, toxic)."""
    order, shared, discount = toxicity.ORDER, toxicity.SHARED, toxicity.DISCOUNT

    def steps(word):
        marked = b"\0" * order + b"\1" + word.encode() + b"\0"
        return [marked[i - order + 1 : i + 1] for i in range(order + 1, len(marked))]

    seen = [Counter(), Counter()]
    for text, y in texts:
        for word in text.split():
            seen[y].update(steps(word))
    tables = []
    for y in (0, 1):
        levels = []
        for k in range(order):
            of = seen[0] + seen[1] if k < shared else seen[y]
            c = of if k + 1 == order else Counter(g[1:] for g in {g[order - k - 2 :] for g in of})
            total, kinds = Counter(), Counter()
            for g, n in c.items():
                total[g[:-1]] += n
                kinds[g[:-1]] += 1
            levels.append((c, total, kinds))
        tables.append(levels)

    def log(word, y):
        out = 0.0
        for g in steps(word):
            p = 1 / 256
            for k, (c, total, kinds) in enumerate(tables[y]):
                own = g[order - k - 1 :]
                if n := total[own[:-1]]:
                    p = max(c[own] - discount, 0) / n + min(1, discount * kinds[own[:-1]] / n) * p
            out += np.log(p)
        return out

    return log


def test_toxicity_counts_every_gram_by_itself(spark, monkeypatch):
    """More distinct grams than a table of 2^17 slots holds: none shares its count with another."""
    monkeypatch.setattr(toxicity, "HELD", 40_000)
    rnd = random.Random(8)
    random_words = lambda n: " ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(8)) for _ in range(n))
    rows = [(k, random_words(150), 0) for k in range(250)] + [(300 + k, random_words(30) + " grumbly snarkful", 1) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model, _ = toxicity.learn(df)
    log = kneser_ney([(t, y) for _, t, y in rows])
    probes = ["grumbly", "snarkful", "grumble", "vexing", "a", *rows[0][1].split()[:20], *random_words(20).split()]
    words = toxicity.words_of(*toxicity.lowered(pa.array([" ".join(probes)])))
    ratio, _ = model.ratios(words)
    assert len(model.keys[-1][0]) > 1 << 17
    assert ratio[words.code] == pytest.approx([log(w, 1) - log(w, 0) for w in probes], abs=1e-3)


def test_toxicity_of_long_words_and_clashing_labels(spark):
    """A word of any length is one word; of labels that differ toxic counts; a clashing column is an error."""
    words = toxicity.words_of(*toxicity.lowered(pa.array(["ab " + "x" * 100_000 + " ab", None, ""])))
    assert sorted(words.length.tolist()) == [2, 100_000] and words.text.tolist() == [0, 0, 0]
    row, gram = toxicity.grams(words)
    assert len(row) == 100_004
    docs = spark.createDataFrame([(k, f"alpha {k}") for k in range(6)], "doc_id long, text string")
    labels = spark.createDataFrame([(3, 0), (3, 1), (4, 0), (4, 0), (None, 1)], "doc_id long, toxic int")
    found = {r.doc_id: r.toxic for r in toxicity.labelled(docs, labels).collect()}
    assert found.get(3, 1) == 1 and found.get(4, 0) == 0 and None not in found


def test_columns_of_clashing_names(spark, tmp_path):
    """A result's column takes the place of a caller's of the same name; columns that operators use inside may stand in the input."""
    inside = ["_words", "_found", "_text", "_html", "_ids", "_Row", "h1", "h2", "anchor", "whole", "found"]
    rows = [(k, f"mit license number {k} of many", *[f"{c}{k}" for c in inside], 5.0) for k in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in inside) + ", own double")
    path = P.path("piece_bpe_32k.model")
    languages_ = languages.learn(spark.createDataFrame([(1, "number of many", "en"), (2, "qué ñol", "es")], "doc_id long, text string, lang string"))
    model, curve = toxicity.learn(spark.createDataFrame([(1, "a b", 0), (2, "c", 1)], "doc_id long, text string, toxic int"))
    made = {
        "own": [
            lambda d: languages.predicted(d, languages_, into="own"), lambda d: toxicity.scored(d, model, curve, into="own"),
            lambda d: pieces.encoded(d, path, into="own"), lambda d: licences.scanned(d, into="own"),
        ],
        "text": [lambda d: pieces.encoded(d, path, into="text"), lambda d: licences.scanned(d, into="text")],
    }
    for into, each in made.items():
        for make in each:
            out = make(df)
            assert sorted(out.columns) == sorted(df.columns)
            found = {r.doc_id: r for r in out.collect()}
            assert all(found[r[0]][c] == r[2 + k] for r in rows for k, c in enumerate(inside)) and all(r[into] != 5.0 and r[into] is not None for r in found.values())
    back = pieces.decoded(pieces.encoded(df, path, into="own"), path, ids_col="own", into="own")
    assert {r.doc_id: r.own for r in back.collect()} == {r[0]: r[1] for r in rows}
    html = df.withColumnRenamed("own", "n_chars").withColumn("html", licences.F.concat(licences.F.lit("<article><h1>title</h1><p>"), "text", licences.F.lit(", told at some length.</p></article>")))
    assert all(r.n_chars == len(r.text) and r["_html"].startswith("_html") for r in pages.extracted(html, pages.trained()).collect())


def test_shared_folder_of_a_cluster():
    """Without a folder that all machines share, a cluster is an error, not a folder of one machine."""
    from types import SimpleNamespace as Of

    from celltrail.llm import _common

    unset = Of(getCheckpointDir=lambda: Of(isDefined=lambda: False))
    spark = lambda master: Of(conf=Of(get=lambda *_: None), sparkContext=Of(master=master, _jsc=Of(sc=lambda: unset)))
    with pytest.raises(RuntimeError):
        _common.shared_dir(spark("spark://host:7077"))
    assert _common.shared_dir(spark("local[2]")).startswith("file:")


def test_toxicity_of_one_class(spark):
    rows = spark.createDataFrame([(1, "a b", 0), (2, "c", 0)], "doc_id long, text string, toxic int")
    model, curve = toxicity.learn(rows)
    assert [r._toxicity for r in toxicity.scored(rows, model, curve).collect()] == [0.0, 0.0]


def test_fingerprints(spark, table, corpus):
    rows = prints.op4_multiset_fingerprint(spark, table).collect()
    assert len(rows) == len(corpus)
    order = sorted(((d, t or "") for d, t in corpus), key=lambda r: (r[0], r[1]))
    want = []
    for k, (d, t) in enumerate(order):
        after, half = order[(k + 1) % len(order)][1], len(t) // 2
        want.append((d, len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()))
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in rows) == sorted(want)
    by_text = {}
    for r in rows:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        by_text.setdefault(dict(corpus)[r.doc_id] or "", set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    assert len({next(iter(v)) for v in by_text.values()}) == len(by_text)
    copies = [r for r in rows if r.doc_id == 18]
    assert all(r.near_next == 1.0 for r in copies)


def test_fingerprints_tell_likeness_by_themselves(spark, table, corpus, monkeypatch):
    """Likeness is computed from two fingerprints alone, and is near that of the multisets of clauses; ranges do not matter."""
    from pyspark.sql import functions as F

    rnd = random.Random(21)
    clauses = [prose(rnd, 4) + rnd.choice(".,;!?") for _ in range(300)]
    rows = [(k, " ".join(rnd.choices(clauses[: 40 + k], k=rnd.randint(1, 60)))) for k in range(150)] + [(150, "x, " * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    v = prints.vectors(df, "doc_id").select("doc_id", prints.digest(F.struct(*prints.VECTOR)).alias("f"))
    a, b = v.select(F.col("doc_id").alias("a"), F.col("f").alias("fa")), v.select(F.col("doc_id").alias("b"), F.col("f").alias("fb"))
    near = a.join(b, (a.a < b.b) & (b.b <= a.a + 3)).select("a", "b", prints.likeness(prints.parsed(F.col("fa")), prints.parsed(F.col("fb"))).alias("near")).collect()
    count = {d: Counter(re.split(prints.CLAUSE, t)) for d, t in rows}
    gaps = []
    for r in near:
        x, y = count[r.a], count[r.b]
        square = lambda c: sum(n * n for n in c.values())
        apart = sum((x[k] - y[k]) ** 2 for k in {*x, *y})
        gaps.append(abs(r.near - (1 - apart / (square(x) + square(y)))))
    assert max(gaps) < 0.45 and sum(gaps) / len(gaps) < 0.09
    whole = sorted(prints.op4_multiset_fingerprint(spark, table).collect(), key=str)
    for each in (1, 2000):
        monkeypatch.setattr(prints, "RANGE_BYTES", each)
        assert sorted(prints.op4_multiset_fingerprint(spark, table).collect(), key=str) == whole
    own = {r.fingerprint: r for r in whole}
    by = spark.createDataFrame([(r.fingerprint, r.edited_fingerprint, r.near_edited) for r in own.values()], "f string, g string, near double")
    assert by.filter(F.abs(prints.likeness(prints.parsed(F.col("f")), prints.parsed(F.col("g"))) - F.col("near")) > 1e-9).count() == 0


def test_fingerprints_are_homomorphic(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1, "a, b.\nc d"), (2, "x\ny; z"), (3, "x\ny; z\na, b.\nc d")], "k long, text string")
    v = prints.vectors(rows, "k").select("k", F.struct("strong", "wide", "paragraphs", "clauses").alias("v"))
    wide = v.groupBy().pivot("k", [1, 2, 3]).agg(F.first("v"))
    row = wide.select(
        prints.digest(prints.merged(F.col("1"), F.col("2"))).alias("both"), prints.digest(F.col("3")).alias("whole"),
        prints.digest(prints.removed(F.col("3"), F.col("2"))).alias("less"), prints.digest(F.col("1")).alias("first"),
    ).first()
    assert row.both == row.whole and row.less == row["first"]
    again = v.select(prints.digest(F.col("v")).alias("f")).select("f", prints.digest(prints.parsed(F.col("f"))).alias("g")).collect()
    assert all(r.f == r.g for r in again)


def test_licences_match_sql(spark, tmp_path):
    rnd = random.Random(8)
    words = "mit license apache general public gnu version 2 3 0 licensed under the all rights reserved cc by nc lesser and".split()
    rows = [(k, rnd.choice([" ", "-", "\n"]).join(rnd.choice([w, w.upper(), w.title()]) for w in rnd.choices(words, k=rnd.randint(0, 60)))) for k in range(300)]
    rows += [(900, None), (901, ""), (902, "permission is hereby granted free of charge to any person using a copy of this software"), (903, "MİT license K"), (904, "mit license " * 30_000), (904, "mit license " * 30_000)]
    rows += [(910 + k, "So: " + " ".join(t.words).upper() + ". End") for k, t in enumerate(licences.TEMPLATES)]
    rows += [(960 + k, " ".join(w if rnd.random() < 0.9 else "other" for w in t.words)) for k, t in enumerate(licences.NOTICES)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = licences.op9_license_scan(spark, str(tmp_path))
    with duckdb.connect() as c:
        c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        want = c.sql(licences.oracle_sql())
        names = sorted(want.columns)
        assert sorted(map(str, (tuple(r[n] for n in names) for r in found.collect()))) == sorted(map(str, want.select(*names).fetchall()))


@pytest.mark.parametrize("chunk,block", [(1 << 15, 1024), (40, 2)])
def test_topk_matches_sql(spark, tmp_path, monkeypatch, chunk, block):
    monkeypatch.setattr(search, "CHUNK", chunk)
    monkeypatch.setattr(search, "BLOCK", block)
    rng = np.random.default_rng(4)
    hot = rng.standard_normal(8).tolist()
    rows = [(k, (hot if k % 3 == 0 else (rng.standard_normal(8) * rng.choice([0.1, 1, 3])).tolist())) for k in range(400)]
    rows += [(500, None), (600, [1.0, None] + [0.0] * 6), (700, [float("nan")] * 8), (800, [float("inf")] + [0.0] * 7), (900, [0.0] * 8)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = sorted(tuple(r) for r in search.op10_topk_search(spark, str(tmp_path)).collect())
    with duckdb.connect() as c:
        c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
        want = sorted(c.sql(search.ORACLE_SQL).fetchall())
    assert found == want


def test_topk_of_any_finite_components(spark):
    """Every query has all its candidates, whatever the size of finite components."""
    rng = random.Random(3)
    rows = [(k, [rng.choice([-1, 1]) * 10.0 ** rng.choice([-300, -3, 0, 3, 150, 200, 300]) for _ in range(4)]) for k in range(12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {}
    for r in search.searched(df, lambda i: i < 12, k=20).collect():
        found.setdefault(r.query_id, []).append((r.score, r.vec_id))
    whole = [[math.floor(1024 * x) for x in v] for _, v in rows]
    cut = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    for q, got in found.items():
        assert sorted(got) == sorted((cut(sum(a * b for a, b in zip(whole[q], whole[c], strict=True))), c) for c in range(12) if c != q)
    assert len(found) == 12


def test_topk_stops_when_nothing_can_reach_the_threshold(spark, monkeypatch):
    """Of lengths that fall fast only the first chunks are sent; of equal ones all are."""
    monkeypatch.setattr(search, "CHUNK", 50)
    monkeypatch.setattr(search, "BLOCK", 16)
    rng = np.random.default_rng(5)
    v = rng.standard_normal((600, 6))
    for lengths in (0.99 ** np.arange(600), np.ones(600)):
        x = v / np.linalg.norm(v, axis=1, keepdims=True) * lengths[:, None] * 100
        df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "vec_id long, embedding array<double>")
        sent, searched = [], search._searched
        monkeypatch.setattr(search, "_searched", lambda cells, *more, sent=sent, searched=searched: (sent.append(cells.filter("side = 1").count()), searched(cells, *more))[1])
        found = search.searched(df, lambda i: i % 20 == 0, k=5).collect()
        monkeypatch.setattr(search, "_searched", searched)
        w = np.floor(1024 * x)
        due = {(q, c) for q in range(0, 600, 20) for c in sorted((c for c in range(600) if c != q), key=lambda c: (-(w[c] @ w[q]), c))[:5]}
        assert {(r.query_id, r.vec_id) for r in found} == due
        assert sum(sent) < 400 if lengths[-1] < 1 else sum(sent) == 1200  # two blocks


def test_topk_of_huge_components(spark):
    rows = [(0, [1e12, 1.0]), (1, [1e12, 3.0]), (2, [1e12, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = search.searched(df, lambda i: i == 0, k=2).collect()
    assert [(r.rank, r.vec_id, r.score) for r in found] == [(1, 1, (1 << 63) - 1), (2, 2, (1 << 63) - 1)]


def test_html_blocks_and_training():
    found = pages.blocks_of('<div class="ad x">no</div><article><p>a&amp;b <b>c</b><br>d<p>e  f<script>x="</p>"</script></article>tail')
    assert [b.text for b in found] == ["no", "a&b c", "d", "e f", "tail"]
    assert pages.blocks_of("") == [] and pages.blocks_of("a < b")[0].text == "a < b"
    net = pages.trained()
    held = pages.examples(80, 12345)
    marks = net.label([v for v, _ in held])
    assert np.mean(np.concatenate([m == t for m, (_, t) in zip(marks, held, strict=True)])) > 0.97


def test_html_reads_in_linear_time():
    """Tags, quotes and comments that never end are looked for once."""
    import time

    for piece in ("<b ", "<a href=\"", "<a x='", "<!-- ", "<", "&amp", "<p><b>", "<a b=\"'", "</p"):
        took = []
        for n in (20_000, 80_000):
            began = time.perf_counter()
            pages.blocks_of('x" y> ' + piece * n + "'")
            took.append(time.perf_counter() - began)
        assert took[1] < 12 * took[0] + 0.5, (piece, took)


def test_html_cases():
    texts = lambda page: [b.text for b in pages.blocks_of(page)]
    assert texts("<html><head><title>t</title><meta x><body><p>no head end</p></body></html>") == ["no head end"]
    assert texts("<head><title>t</title><style>s</style><div>open head</div>") == ["open head"]
    assert texts("<p>the area <math><mi>a</mi><mo>+</mo><mi>b</mi><annotation>x</annotation></math> is <svg><title>t</title><text>12 m</text></svg> wide") == ["the area a+b is 12 m wide"]
    assert texts('<p title="a > b">one</p><p title=\'"\'>two<p x="un closed>three</p>') == ["one", "two", "three"]
    assert texts("<![CDATA[gone]]><p>1 < 2 &lt; 3</p><!-- gone <p>gone</p> --><p>&#8364;&nbsp;5</p><script>if (a < b) '<p>'</script>") == ["1 < 2 < 3", "€ 5"]
    assert texts("<P>A<BR/>B</P><hr><pre>x\n y</pre>") == ["A", "B", "x y"]


def test_html_pages_of_other_layouts():
    """Pages written by hand, in layouts that the training grammar does not make."""
    prose = "The river rose by half a metre overnight, and the lower road was closed until noon. Nobody was hurt, the mayor said."
    more = "Farmers had moved their cattle to the hill the day before. The water is expected to fall again by Friday."
    layouts = [
        f"<body><div id=wrapper><div id=masthead><a href=/>The Valley Post</a> <a href=/in>Sign in</a></div><div class=story-body><h1>River floods the lower road</h1><p>{prose}</p><p>{more}</p></div><div id=footer>© 2023 Valley Post. <a href=/t>Terms</a></div></div></body>",
        f"<html><body><header><nav><a href=/a>Home</a><a href=/b>News</a></nav></header><main><section class=entry><h2>River floods the lower road</h2><p>{prose}<p>{more}</section></main><aside class=sidebar><h3>Related</h3><ul><li><a href=/1>Snow</a><li><a href=/2>Wind</a></ul></aside><footer><p>© Valley Post</p></footer></body></html>",
        f"<body><ul class=menu><li><a href=/>Start</a></li><li><a href=/w>Weather</a></li></ul><article><h1>River floods the lower road</h1><p>{prose}</p><p>{more}</p></article><section id=comments><h3>Comments</h3><div class=comment><b>ann</b><p>Thank you for the news, stay safe.</p></div></section></body>",
    ]
    found = pages.extract(layouts, pages.trained())
    for text in found:
        assert prose in text and more in text and "River floods the lower road" in text
        assert not any(x in text for x in ("Sign in", "Terms", "Related", "Snow", "Valley Post", "Weather", "Thank you"))


def test_html_gradients():
    rng = np.random.default_rng(0)
    net = pages.Labeller(3)
    x, mask = pages.padded([rng.standard_normal((n, pages.WIDTH)).astype(np.float32) for n in (3, 5)])
    y = rng.random(mask.shape) > 0.5
    _, grads = net.gradients(x, mask, y)
    for name in ("fx", "bh", "fb", "o"):
        flat = net.weights[name].reshape(-1)
        k = int(np.argmax(np.abs(grads[name])))
        old, eps = flat[k], 1e-2
        flat[k] = old + eps
        up, _ = net.gradients(x, mask, y)
        flat[k] = old - eps
        down, _ = net.gradients(x, mask, y)
        flat[k] = old
        assert (up - down) / (2 * eps) == pytest.approx(float(grads[name].reshape(-1)[k]), rel=0.05, abs=1e-4)


def test_html_query(spark, tmp_path):
    body = "<html><body><nav><ul><li><a href='/'>home</a></li></ul></nav><article><h1>Title here</h1><p>First part of it, long enough.</p><p>Second &eacute;.</p></article><footer>&copy; me</footer></body></html>"
    rows = [(1, "u", body), (2, "u", None), (3, "u", "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = {r.page_id: r for r in pages.op6_html_extraction(spark, str(tmp_path)).collect()}
    assert found[1].text == "Title here\n\nFirst part of it, long enough.\n\nSecond é."
    assert found[1].n_chars == len(found[1].text) and found[2].text == "" and found[3].n_chars == 0


def test_utf8_slices():
    from celltrail.llm._common import utf8

    data, offsets = utf8(pa.array(["xx", "é", None, "abc"]).slice(1, 3))
    assert bytes(data) == "éabc".encode() and offsets.tolist() == [0, 2, 2, 5]
