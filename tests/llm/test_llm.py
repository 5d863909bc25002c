"""The operators against brute force, SQL and libraries, and on awkward inputs."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ensemblespark.llm import bpe, chat, embedding_dedup, lm, mixing, near_dedup, quality, queries, rules, token_counts, toxicity
from ensemblespark.llm import hashing as H

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
DOCS = "doc_id long, text string, lang string, source string, n_chars long, uid string, row string, words string, size int, key string, score string"


def prose(seed, n=120):
    rng = random.Random(seed)
    return " ".join(rng.choice(["the", "of", "and", "river", "stone", "walks", "bright", "under", "seven", "moon", "glass", "quiet"]) + rng.choice(["", "", "er", "ing", "."]) for _ in range(n))


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    """A data folder with nulls in every column, empty and very long texts, ties, repeats, extra columns."""
    rows = [(i, prose(i), "en", f"s{i % 3}", 600) for i in range(30)]
    rows += [(30, None, "en", "s1", None), (31, "", None, None, 0), (32, " \n\t ", "de", "s2", 4), (None, prose(40), None, "s0", 5), (None, None, None, None, None)]
    rows += [(33, prose(1), "en", "s1", 600), (1, prose(1), "en", "s1", 600), (34, "word " * 60_000, "en", "s2", None), (35, prose(2) + " more", "en", "s0", 7), (36, "ünï 漢字 🙂 é", "fr", "s0", 9)]
    at = str(tmp_path_factory.mktemp("awkward"))
    extra = [(*r, "u", "r", "w", 1, "k", "s") for r in rows]
    spark.createDataFrame(extra, DOCS).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(30)] + [(1, 0, 1), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    turns = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (2, 2, "user", None), (3, 0, "user", "a"), (4, None, None, None), (None, 0, "user", "a"), (None, 0, "user", "z"), (None, 0, "user", "z"), (5, 0, "user", "q"), (5, 0, "user", "q")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{at}/conversations.parquet")
    vec = [(0, [1.0, 0.0], 1), (1, [1.0, 0.01], 1), (2, [1.0, 0.0], 2), (3, None, 1), (4, [0.0, 0.0], 1), (5, [float("nan"), 1.0], 1), (6, [1.0, None], 1), (7, [1.0, 0.0], None), (8, [1.0, 0.0, 0.0], 1), (9, [0.0, 1.0], 1), (None, [1.0, 0.0], 1), (0, [1.0, 0.0], 1)]
    spark.createDataFrame(vec, "vec_id long, embedding array<float>, label int").write.parquet(f"{at}/embeddings.parquet")
    asked = [(0, prose(1)), (1, None), (2, ""), (3, "Word word 漢字"), (None, "the river"), (3, "Word word 漢字"), (3, "glass"), (4, " .,- ")]
    spark.createDataFrame([(*r, 1, "q") for r in asked], "item_id long, text string, doc_id int, query string").write.parquet(f"{at}/benchmark.parquet")
    return at


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("empty"))
    for name, kind in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("conversations", "conv_id long, turn long, role string, text string"), ("embeddings", "vec_id long, embedding array<float>, label int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], kind).write.parquet(f"{at}/{name}.parquet")
    return at


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_empty_tables(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).collect() == []


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in ("op1_chat_formatting", "op10_embedding_near_dedup", "op12_lexical_search", "op13_exact_top_k")])
def test_awkward_documents_keep_their_rows(spark, awkward, name):
    want = collections.Counter(r.doc_id for r in spark.read.parquet(f"{awkward}/documents.parquet").select("doc_id").collect())
    got = queries.QUERIES[name](spark, awkward).collect()
    assert collections.Counter(r.doc_id for r in got) == want


def test_pipeline_on_awkward_and_empty(spark, awkward, empty):
    assert corpus_pipeline.run(spark, empty).collect() == []
    docs = spark.read.parquet(f"{awkward}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, awkward)
        assert out.columns == docs.columns
        out.collect()
    assert corpus_pipeline.run(spark, awkward).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


@pytest.mark.parametrize("name", list(queries.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings", "benchmark"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got = queries.QUERIES[name](spark, DATA)
    cur = con.execute(queries.SQL[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(got.columns)
    key = lambda rows: sorted(repr([round(v, 5) if isinstance(v, float) else v for v in r]) for r in rows)
    assert key([[r[c] for c in cols] for r in got.collect()]) == key(cur.fetchall())


def test_chat_snapshots(spark, awkward):
    got = {(r.conv_id, r.n_turns, r.n_copies) for r in chat.collapse(spark.read.parquet(f"{awkward}/conversations.parquet")).collect()}
    assert got == {(2, 3, 1), (4, 1, 1), (None, 1, 2), (5, 2, 1)}


def test_token_counts(spark):
    pieces = ["▁", "▁a", "▁ab", "b", "bc", "abcd", "c", "▁abcde"]
    machine = token_counts.LongestMatch.of(pieces)

    def greedy(word):
        at = n = 0
        while at < len(word):
            size = next((k for k in range(len(word) - at, 0, -1) if word[at : at + k] in pieces), 0)
            n += 1 if size else len(word[at].encode())
            at += size or 1
        return n

    for n in range(6):
        for w in itertools.product("abcdeé", repeat=n):
            assert machine.length("▁" + "".join(w)) == greedy("▁" + "".join(w))


def test_bpe_equals_the_library(spark):
    import public_tokenizers as P
    import regex
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    rng = random.Random(3)
    texts = ["".join(rng.choice("aab  \n'é日🙂0123!.<|endoftext|>") for _ in range(rng.randint(0, 200))) for _ in range(200)] + ["a" * 3000, " " * 999, "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in bpe.encode(docs, path, P.PATTERN).collect():
        text = texts[r.doc_id] or ""
        assert list(r.ids) == enc.encode_ordinary(text) and bytes(r.decoded) == text.encode()
    for r in bpe.encode(docs, path, P.PATTERN, digest=True).collect():
        ids = enc.encode_ordinary(texts[r.doc_id] or "")
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and r.n_tokens == len(ids)
    assert {r.doc_id: bytes(r.decoded) for r in bpe.decode(bpe.encode(docs, path, P.PATTERN), path).collect()} == {i: (t or "").encode() for i, t in enumerate(texts)}
    assert regex.findall(P.PATTERN, "") == []


def test_bpe_remembers_pieces_met_again(monkeypatch):
    import public_tokenizers as P
    import tiktoken

    monkeypatch.setattr(bpe, "PIECES", 20)
    monkeypatch.setattr(bpe, "PAIRS", 30)
    ranks = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    encoder = bpe.Encoder(bpe.Vocabulary(ranks))
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    plain, asked = encoder.bytes, collections.Counter()

    def bytes_(text):
        asked[text if isinstance(text, str) else text.decode("latin-1")] += 1
        return plain(text)

    monkeypatch.setattr(encoder, "bytes", bytes_)
    rng = random.Random(4)
    for _ in range(500):
        new = "".join(rng.choice("aeioénstrh日") for _ in range(rng.randint(6, 12)))
        for piece in (new, " oftenwor"):
            assert list(encoder.known.get(piece) or encoder.piece(piece)) == enc.encode_ordinary(piece)
        assert len(encoder.known) <= 20
    assert asked[" oftenwor"] == 1


def test_bpe_holds_few_texts_at_a_time(spark):
    import public_tokenizers

    spark.conf.set(bpe.BATCH, 10_000)
    try:
        docs = spark.range(2_500).select(F.col("id").alias("doc_id"), F.lit("so few").alias("text"))
        encoded = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digest=True)
        sizes = docs.coalesce(1).mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").collect()
        assert encoded.count() == 2_500 and max(r.n for r in sizes) <= bpe.ROWS
    finally:
        spark.conf.unset(bpe.BATCH)


def test_lm_base_and_probabilities(spark, awkward):
    docs = spark.read.parquet(f"{awkward}/documents.parquet").collect()
    toks = [[*WORD.findall((r.text or "").translate(LOWER)), None] for r in docs]
    held = [r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2 for r in docs]
    count = collections.Counter(t for ts, h in zip(toks, held, strict=True) if not h for t in ts)
    n, v = sum(count.values()), len(count)
    want = sorted((len(ts), sum(count[t] > 0 for t in ts), round(sum(math.log10((count[t] + 1) / (n + v + 1)) for t in ts), 6)) for ts in toks)
    got = lm.op5_lm_scoring(spark, awkward).collect()
    assert sorted((r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert all(r.train_tokens == n and r.score < 0 for r in got)
    assert sum(r.held_out for r in got) == sum(held)


class BruteLM:
    """The automaton over whole counts, in plain Python: its states, arcs and failure arcs."""

    def __init__(self, texts, held):
        self.texts = [[*WORD.findall((t or "").translate(LOWER)), None] for t in texts]
        self.c = [None, collections.Counter(), collections.Counter(), collections.Counter()]
        for ts, h in zip(self.texts, held, strict=True):
            if not h:
                padded = ["<", *ts]
                for k in (1, 2, 3):
                    self.c[k].update(zip(*((ts if k == 1 else padded)[i:] for i in range(k)), strict=False))
        self.total, ones, twos = sum(self.c[1].values()), sum(c == 1 for c in self.c[1].values()), sum(c == 2 for c in self.c[1].values())
        self.d = min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5

    def n(self, state):
        return self.c[len(state)][state] if state != ("<",) else self.c[1][None,]

    def arc(self, state, w):
        """The weight of the arc of w if the state has one."""
        c = self.c[len(state) + 1][(*state, w)]
        if not state:
            return (c - self.d) / self.total if c else None
        return (c + lm.MU[len(state) - 1] * self.p(state[1:], w)) / (self.n(state) + lm.MU[len(state) - 1]) if c else None

    def fail(self, state):
        return lm.MU[len(state) - 1] / (self.n(state) + lm.MU[len(state) - 1])

    def p(self, state, w):
        p = 1.0
        while (arc := self.arc(state, w)) is None:
            if not state:
                return p * self.d * len(self.c[1]) / self.total
            p, state = p * self.fail(state), state[1:]
        return p * arc

    def score(self, ts):
        state, sum_ = ("<",), 0.0
        for w in ts:
            sum_ += math.log10(self.p(state, w))
            state = (*state, w)[-2:]
        return sum_


def test_lm_scores_equal_the_automaton(spark, awkward):
    rows = spark.read.parquet(f"{awkward}/documents.parquet").select("doc_id", "text").collect()
    held = [r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2 for r in rows]
    model = BruteLM([r.text for r in rows], held)
    want = sorted((r.doc_id or -1, model.score(ts)) for r, ts in zip(rows, model.texts, strict=True))
    got = sorted((r.doc_id or -1, r.score) for r in lm.op5_lm_scoring(spark, awkward).collect())
    assert [i for i, _ in got] == [i for i, _ in want] and [s for _, s in got] == pytest.approx([s for _, s in want], rel=1e-9)


def test_lm_states_sum_to_one():
    texts = [prose(i, 40) for i in range(20)] + ["the river", "the the the", ""]
    model = BruteLM(texts, [False] * len(texts))
    kinds = list(model.c[1])
    for state in [("<",), ("the",), ("<", "the"), ("the", "the"), ("the", "river"), ("never", "seen"), *random.Random(2).sample(list(model.c[2]), 30)]:
        if state[-1] is not None:
            assert sum(model.p(state, w) for (w,) in kinds) + model.p(state, "?unseen?") == pytest.approx(1)


def test_lm_counts_rare_ngrams_in_every_phase(spark):
    """Over 1e6 training tokens, n-grams that occur once or twice still count, however the work is cut."""
    texts = [prose(i) for i in range(60)] + ["the river walks " * 450_000, "", None, "never seen words walks", "the the river once", "the the river once more"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("held_out", F.col("doc_id") % 5 == 2)
    model = BruteLM(texts, [i % 5 == 2 for i in range(len(texts))])
    want = [model.score(ts) for ts in model.texts]
    for parts, phases in ((1, (1, 1, 1)), (3, (2, 3, 5))):
        got = {r.doc_id: r.score for r in lm.score(docs.repartition(parts), phases).collect()}
        assert [got[i] for i in range(len(texts))] == pytest.approx(want, rel=1e-9)


def brute_groups(texts):
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    weight = lambda s: sum(len(set(x)) for x in s)
    group = list(range(len(texts)))
    for _ in range(len(texts)):
        for a, b in itertools.combinations(range(len(texts)), 2):
            if sets[a] and sets[b] and 5 * weight(sets[a] & sets[b]) >= 4 * weight(sets[a] | sets[b]) and group[a] != group[b]:
                low = min(group[a], group[b])
                group[a] = group[b] = low
    return group


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(5)
    texts = []
    for i in range(40):
        words = [f"w{rng.randint(0, 500)}" for _ in range(rng.choice([3, 40, 150]))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            copy = list(words)
            for _ in range(rng.choice([0, 1, 2, 5])):
                copy[rng.randrange(len(copy))] = f"x{rng.randint(0, 10**6)}"
            texts.append(" ".join(copy))
    for i in range(6):  # passages that repeat
        p, q = (" ".join(f"r{rng.randint(0, 300)}" for _ in range(60)) for _ in range(2))
        texts += [f"{p} {p} {p} {q}", f"{p} {q}", f"{(p + ' ') * 30}{q}", f"{p} " + "la " * (5 * i) + q, "la " * 40 + p[:20]]
    texts += ["", None, "only", "only", "ONLY"]
    ids = [i if i % 7 else None for i in range(len(texts))]
    want = brute_groups(texts)
    words = [tuple(WORD.findall((t or "").translate(LOWER))) for t in texts]
    same = collections.Counter(words)
    expect = []
    for i, t in enumerate(texts):
        least = min((ids[j] for j in range(len(texts)) if want[j] == want[i] and ids[j] is not None), default=None)
        expect.append((ids[i], least if words[i] else ids[i], same[words[i]] if words[i] else 1, t or ""))
    for parts, cores in ((1, 1), (5, 7)):  # files read in other orders and splits give the same groups
        docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(parts)
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", str(cores))
        got = near_dedup.groups(docs)
        known = docs.select(F.coalesce("text", F.lit("")).alias("text"), *near_dedup.text_key()).distinct()
        rows = got.join(known, ["t1", "t2"]).collect()
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
        assert collections.Counter((r.doc_id, r.component_id, r.n_same, r.text) for r in rows) == collections.Counter(expect)
        kept = collections.Counter(r.component_id for r in rows if r.kept)
        assert all(n == 1 for c, n in kept.items() if c is not None) and all(r.doc_id == r.component_id for r in rows if r.kept)
        assert sum(kept.values()) == len(set(want))


def test_near_duplicates_found_at_the_limit(spark):
    """Recall of pairs whose similarity is 0.80 to 0.83, each alone; and pairs just below are not linked."""
    rng = random.Random(9)
    rows, alike = [], 0
    for i in range(300):
        words = [f"a{i}w{j}" for j in range(100)]
        other = list(words)
        edits = 2 + (i % 3 == 0)  # an edit changes five windows of 96
        for e in range(edits):
            other[10 + 30 * e] = f"x{i}e{e}"
        alike += 5 * (96 - 5 * edits) >= 4 * (96 + 5 * edits)
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    rng.shuffle(rows)
    got = near_dedup.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = sum(r.component_id != r.doc_id for r in got)
    assert 0.95 * alike <= found <= alike and alike == 200


def test_near_duplicates_with_repeated_passages(spark):
    """A passage written once, twice or four hundred times over is the same set of shingles: nearly all pairs are found."""
    rows, n = [], 0
    for times in (2, 8, 40, 400):
        for i in range(50):
            p, q = ([f"{c}{times}i{i}w{j}" for j in range(100)] for c in "pq")
            rows += [(n, " ".join(p * times + q)), (n + 1, " ".join(p + q))]
            n += 2
    got = {r.doc_id: r.component_id for r in near_dedup.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == i for i in range(0, n, 2))
    for at in range(0, n, 100):
        assert sum(got[i + 1] == i for i in range(at, at + 100, 2)) >= 48


def test_block_comparison_equals_pairs(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**62, 60)
    sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(44, 60), replace=False), rng.integers(0, 2**62, rng.integers(0, 9))])) for _ in range(120)]
    sets = [np.unique(s & ~7 | (s >> 3) % 5 + 1) for s in sets]
    common = np.array([[near_dedup.weights(np.intersect1d(a, b)).sum() for b in sets] for a in sets])
    assert (near_dedup._dense_common(sets)[~np.eye(120, dtype=bool)] == common[~np.eye(120, dtype=bool)]).all()
    size = common.diagonal()
    linked = 5 * common >= 4 * (size[:, None] + size[None, :] - common)
    assert 0.05 < linked.mean() < 0.9
    for n in (20, 120):
        found = near_dedup.links_within(list(range(n)), [0.1] * n, [0] * n, sets[:n])
        assert all(linked[i, j] for i, j in found)
        root = list(range(n))
        for _ in root:
            root = [min(root[j] for j in range(n) if linked[i, j]) for i in range(n)]
        tree = list(range(n))
        for _ in tree:
            for i, j in found:
                tree[i] = tree[j] = min(tree[i], tree[j])
        assert tree == root


def test_prob_minhash_estimates_probability_jaccard():
    a, b = {x: 1.0 + x % 3 for x in range(60)}, {x: 1.0 + x % 2 for x in range(20, 80)}
    exact = sum(1 / sum(max(a.get(y, 0) / a[x], b.get(y, 0) / b[x]) for y in a.keys() | b.keys()) for x in a.keys() & b.keys())
    m = 4000
    sign = [near_dedup.prob_minhash(np.zeros(len(s), int), H.mix(np.array(list(s), np.uint64)), np.array(list(s.values())), 1, m)[0] for s in (a, b)]
    assert np.mean(sign[0] == sign[1]) == pytest.approx(exact, abs=0.03)


def test_vectors_equal_brute_force(spark, awkward):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 16))
    x = np.concatenate([base, base[:20] + rng.normal(size=(20, 16)) * 0.15, np.repeat(base[:1], 30, 0) + rng.normal(size=(30, 16)) * 0.2, base[:3]]).astype(np.float32)
    label = [int(i % 2) for i in range(60)] + [i % 2 for i in range(20)] + [0] * 30 + [0, 1, 0]
    rows = spark.createDataFrame([(i, x[i].tolist(), label[i]) for i in range(len(x))], "vec_id long, embedding array<float>, label int")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = (u @ u.T >= 0.93) & (np.array(label)[:, None] == np.array(label)[None, :]) & ~np.eye(len(x), dtype=bool)
    root = list(range(len(x)))
    for _ in root:
        root = [min([root[i], *[root[j] for j in np.flatnonzero(near[i])]]) for i in range(len(x))]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.links(rows).collect()}
    assert got == {i: (int(near[i].sum()), root[i], root[i] == i) for i in range(len(x))}
    odd = collections.Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.op10_embedding_near_dedup(spark, awkward).collect())
    assert odd == collections.Counter([(0, 3, 0, True), (0, 3, 0, True), (1, 3, 0, False), (None, 3, 0, False), (2, 0, 2, True), *[(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9)]])


def test_vectors_found_where_the_window_is_small(spark):
    """Recall of isolated pairs in a label of 3,000 vectors, 75 times the window; and counts over several blocks."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(2_400, 64))
    pairs = rng.choice(2_400, 300, replace=False)
    u = x[pairs] / np.linalg.norm(x[pairs], axis=1, keepdims=True)
    r = rng.normal(size=u.shape)
    r -= (r * u).sum(1, keepdims=True) * u
    cosine = rng.uniform(0.932, 0.96, 300)[:, None]
    family = 1e160 * (u[:1] + 0.01 * rng.normal(size=(300, 64)) / 8)
    v = np.concatenate([x, cosine * u + np.sqrt(1 - cosine**2) * r / np.linalg.norm(r, axis=1, keepdims=True), family])
    old = embedding_dedup.BLOCK
    embedding_dedup.BLOCK = 64
    got = {r.vec_id: r for r in embedding_dedup.links(spark.createDataFrame([(i, row.tolist(), 1) for i, row in enumerate(v)], "vec_id long, embedding array<double>, label int")).collect()}
    embedding_dedup.BLOCK = old
    assert sum(got[2_400 + i].component_id == p for i, p in enumerate(pairs)) >= 0.98 * 300
    assert all(got[2_700 + i].n_links >= 300 for i in range(300)) and got[pairs[0]].n_links >= 300


def test_mix_meets_targets(spark):
    got = mixing.op7_mixing(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "source"), "doc_id").toPandas()
    assert (got.taken <= 2 * got["size"]).all() and got.target.max() <= 2 * got.source_size.max()
    by = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), most=("size", "max"), own=("source_size", "first"))
    assert ((by.taken - by.target).abs() <= by.most).all()
    assert by.target.sum() == pytest.approx(1.5 * by.own.sum())


class BruteToxicity:
    """Both classes' models of word pairs over spelling, in plain Python."""

    def __init__(self, docs):
        order, d = toxicity.ORDER, toxicity.DISCOUNT
        raw = [[collections.Counter() for _ in range(order + 1)] for _ in (0, 1)]
        self.pair = [collections.Counter(), collections.Counter()]
        for text, label in docs:
            ws = self.split(text)
            self.pair[label].update(zip([None, *ws], ws))
            for w in ws:
                b = b" " + w + b" "
                for k in range(1, order + 1):
                    raw[label][k].update(b[i - k + 1 : i + 1] for i in range(max(1, k - 1), len(b)))
        self.c = []
        for c in (0, 1):
            own = [None]
            for k in range(1, order + 1):
                more = collections.Counter(g[1:] for g in raw[c][k + 1]) if k < order else None
                keep = lambda g, k=k: k == order or (k > 1 and g[:1] == b" ")
                every = set(raw[0][k]) | set(raw[1][k])
                own.append({g: raw[c][k][g] if keep(g) else more[g] for g in every})
            self.c.append(own)
        for k in range(1, toxicity.SHARED_ORDER + 1):
            both = {g: self.c[0][k][g] + self.c[1][k][g] for g in self.c[0][k]}
            self.c[0][k] = self.c[1][k] = both

    @staticmethod
    def split(text):
        return re.findall(rb"(?:[0-9A-Za-z]|[\x80-\xff])+", (text or "").translate(LOWER).encode())

    def byte(self, c, context, x):
        """Probability of a byte after up to ORDER - 1 bytes of its word."""
        d = toxicity.DISCOUNT
        table = self.c[c][1]
        total = max(sum(table.values()), 1)
        p = max(table.get(x, 0) - d, 0) / total + (1 - sum(max(n - d, 0) for n in table.values()) / total) / 256
        for k in range(2, min(len(context) + 1, toxicity.ORDER) + 1):
            head = context[len(context) - k + 1 :]
            after = [n for g, n in self.c[c][k].items() if g[:-1] == head]
            if head not in self.c[c][k - 1]:
                break
            if sum(after):
                p = max(self.c[c][k].get(head + x, 0) - d, 0) / sum(after) + d * sum(n > 0 for n in after) / sum(after) * p
        return p

    def word(self, c, w):
        b = b" " + w + b" "
        return math.prod(self.byte(c, b[max(0, i - toxicity.ORDER + 1) : i], b[i : i + 1]) for i in range(1, len(b)))

    def of_pairs(self, pair, v, w, lower):
        ns = [n for (x, _), n in pair.items() if x == v]
        d = toxicity.PAIR_DISCOUNT
        return max(pair[v, w] - d, 0) / sum(ns) + d * len(ns) / sum(ns) * lower if ns else lower

    def after(self, c, v, w):
        return self.of_pairs(self.pair[c], v, w, self.of_pairs(self.pair[0] + self.pair[1], v, w, self.word(c, w)))


def test_toxicity_equals_brute_force_models():
    docs = [(prose(i, 12), 0) for i in range(6)] + [("you vile toad. You Vile toad!", 1), ("vile toad, é walks", 1), ("", 1), (None, 0)]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([t for t, _ in docs]), pa.array([c for _, c in docs], pa.int32())], names=["text", "label"])
    grams = pa.Table.from_batches(list(toxicity._grams(iter([batch]))))
    levels, tallies = [], []
    for k in range(1, toxicity.ORDER + 1):
        own = [(int(np.int64(g).view(np.uint64)), a, b) for kk, g, a, b in zip(*(grams.column(c).to_pylist() for c in ("k", "gram", "n0", "n1"))) if kk == k]
        own.sort()
        levels.append(np.array([x[0] for x in own], np.uint64))
        tallies.append(np.array([x[1:] for x in own], float).T)
    pairs = pa.Table.from_batches(list(toxicity._pairs(iter([batch])))).combine_chunks()
    get = lambda c: pairs.column(c).to_numpy()
    model = toxicity.KneserNey(levels, tallies, 0.3, toxicity.Pairs(get("pair").view(np.uint64), get("first").view(np.uint64), np.stack([get("n0"), get("n1")]).astype(float)))
    brute = BruteToxicity(docs)
    texts = ["vile toad", "a river toad walks", "zzz", "you you", "Vile", "the stone é"]
    x, n = model.features(pa.array([*texts, "", None]))
    for i, t in enumerate(texts):
        ws = brute.split(t)
        d = [math.log(brute.after(1, v, w)) - math.log(brute.after(0, v, w)) for v, w in zip([None, *ws], ws)]
        assert x[i, 1] == pytest.approx(sum(d) / len(d), abs=2e-5) and x[i, 2] == pytest.approx(max(sum(d[k:]) for k in range(len(d))) / toxicity.WINDOW, abs=2e-5)
    assert (x[-2:, 1:] == 0).all() and n[-2:].tolist() == [0, 0]
    for c in (0, 1):
        for context in (b" ", b" v", b" vi", b"ile", b"zz", b" the"):
            assert sum(brute.byte(c, context, bytes([x])) for x in range(256)) == pytest.approx(1)
        for v in ("vile", "you", None):
            v = v and v.encode()
            seen = {w for x, w in brute.pair[0] + brute.pair[1] if x == v}
            other = b"qqqqq"  # all words not seen after v share what is left in the same proportion
            share = brute.after(c, v, other) / brute.word(c, other)
            assert sum(brute.after(c, v, w) for w in seen) + share * (1 - sum(brute.word(c, w) for w in seen)) == pytest.approx(1)


def test_machine_equals_pairs_one_by_one():
    """The linear-time score against the sum over all pairs of columns."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    x = quality.inputs(pa.array([prose(1, 30), "one two two", "", None]), pa.array([100, None, 0, None], pa.float64()))
    k = x.dense.shape[1]
    m = quality.Machine(rng.normal(size=k), rng.uniform(1, 2, k), 0.3, rng.normal(size=quality.BUCKETS), rng.normal(size=(quality.BUCKETS, quality.FACTORS)), rng.normal(size=k), rng.normal(size=(k, quality.FACTORS)), np.array([0.0, 1.0]))
    d = np.clip((x.dense - m.shift) / m.scale, -6, 6)
    for i, got in enumerate(m.raw(x)):
        mine = x.row == i
        columns = [(v, m.w[c], m.v[c]) for c, v in zip(x.column[mine], x.value[mine])] + list(zip(d[i], m.u, m.z))
        want = 0.3 + sum(v * w for v, w, _ in columns) + sum(a[0] * b[0] * (a[2] @ b[2]) for a, b in itertools.combinations(columns, 2))
        assert got == pytest.approx(want)


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    for v in np.unique(score):
        rank[score == v] = rank[score == v].mean()
    k = label.sum()
    return (rank[label == 1].sum() - k * (k + 1) / 2) / (k * (len(label) - k))


@pytest.mark.parametrize(("query", "label", "accuracy", "ranking"), [(quality.op8_quality_classifier, "quality", 0.9, 0.9), (toxicity.op3_toxicity, "toxic", 0.87, 0.8)])
def test_held_out_accuracy_and_ranking(spark, query, label, accuracy, ranking):
    """A constant score ranks at 0.5."""
    at = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{at}/labels.parquet")
    got = query(spark, at).where("held_out").join(truth, "doc_id").toPandas()
    assert (got.predicted == got[label]).mean() >= accuracy and auc(got.score.to_numpy(), got[label].to_numpy()) >= ranking
    assert got.score.between(0, 1).all()


def test_rules_keep_good_documents(spark):
    at = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{at}/labels.parquet")
    got = rules.op4_quality_rules(spark, at).where("not base_failed").join(truth, "doc_id").toPandas()
    assert got[got.quality == 1].kept.mean() > 0.99
