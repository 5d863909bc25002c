"""Fill-in-the-middle, lexical search and vector search against plain versions and on awkward inputs."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest

from ensemblespark.llm import fill_middle, lexical, vector_search
from ensemblespark.llm import hashing as H

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def plain_fim(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = UNIT.findall(text)
    assert "".join(units) == text
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_middle_equals_plain_version(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["a", "é", "漢", "🙂", " ", "  ", "\n", "\t", "\x0b", "\x00", "ÿ", "<", "P>", "<P", "S>", " ", " ", "x" * 50]) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    rows = list(enumerate(texts)) + [(1000, None), (1001, ""), (1002, " "), (1003, "word " * 300_000), (None, "a b c"), (None, None), (5, texts[5]), (1004, "x <S> y"), (1005, "y" * 6_000_000)]
    docs = spark.createDataFrame([(*r, "o", 1) for r in rows], "doc_id long, text string, output string, n int").repartition(3)
    got = fill_middle.restore(fill_middle.transform(docs)).collect()
    assert {r.form for r in got} == {"plain", "spm", "psm"}
    key = lambda rows: sorted(rows, key=repr)
    assert key([(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in got]) == key([(i, *plain_fim(i, t), t or "") for i, t in rows])


def test_fill_middle_rates(spark):
    docs = spark.createDataFrame([(i, f"a b c{i} d e") for i in range(50)], "doc_id long, text string")
    assert {r.form for r in fill_middle.transform(docs, rate=0).collect()} == {"plain"}
    assert {r.form for r in fill_middle.transform(docs, rate=100, spm_rate=0).collect()} == {"psm"}
    made = fill_middle.restore(fill_middle.transform(docs, rate=100, spm_rate=100, seed=7)).collect()
    assert {r.form for r in made} == {"spm"} and all(r.restored == f"a b c{r.doc_id} d e" for r in made)


def plain_search(docs, items, top):
    """Every document scored for every item."""
    terms = {i: collections.Counter(TERM.findall((t or "").translate(LOWER))) for i, (_, t) in enumerate(docs)}
    terms = {i: c for i, c in terms.items() if c}
    n_all, terms_all = len(terms), sum(sum(c.values()) for c in terms.values())
    df = collections.Counter(w for c in terms.values() for w in c)
    out = []
    for item, text in dict.fromkeys(items):
        asked = collections.Counter(TERM.findall((text or "").translate(LOWER)))
        scored = []
        for i, c in terms.items():
            m = 100 - 25 + (25 * sum(c.values()) * n_all) // terms_all
            score = sum(k * math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[w] + 1))) * ((1000000000 * c[w]) // (1000 * c[w] + 12 * m)) for w, k in asked.items() if c[w])
            if score > 0:
                scored.append((-score, docs[i][0] is None, docs[i][0] or 0))
        for rank, (score, unknown, doc) in enumerate(sorted(scored)[:top], 1):
            out.append((item, rank, None if unknown else doc, -score))
    return sorted(out, key=repr)


def corpus(seed, n, words=400):
    rng = random.Random(seed)
    zipf = [1 / (i + 1) for i in range(words)]
    pick = lambda k: " ".join(f"{'W' if rng.random() < 0.1 else 'w'}{i}" for i in rng.choices(range(words), zipf, k=k))
    return [(i, pick(rng.choice([1, 3, 20, 80]))) for i in range(n)], [(i, pick(rng.choice([1, 2, 8, 30]))) for i in range(25)]


@pytest.mark.parametrize(("segment", "step", "terms", "top"), [(1 << 24, 1024, 500_000, 20), (3000, 7, 500_000, 3), (20_000, 64, 60, 20)])
def test_lexical_equals_plain_version(spark, monkeypatch, segment, step, terms, top):
    docs, items = corpus(1, 900)
    docs += [(2000, None), (2001, ""), (2002, " .-\n"), (None, docs[0][1]), (3, docs[3][1]), (2003, "w1 w2 " * 5000), (2004, "漢字 é w7")]
    items += [(50, None), (51, ""), (52, "unknownword"), (None, "w3 w9"), (3, items[3][1]), (53, "漢字 É"), (54, "w1 " * 40)]
    own = spark.createDataFrame([(*r, "s", 2) for r in docs], "doc_id long, text string, terms string, n int").repartition(3)
    asked = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, query int")
    monkeypatch.setattr(lexical, "SEGMENT", segment)
    monkeypatch.setattr(lexical, "STEP", step)
    monkeypatch.setattr(H, "SLICE", min(H.SLICE, segment))
    # Spark's workers don't see a patch, so the segments are made and searched here, task by task.
    import pyarrow as pa

    batch = lambda rows, names, kinds: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
    kinds = [pa.int64(), pa.string()]
    rows = [batch(docs[i : i + 100], ["doc_id", "text"], kinds) for i in range(0, len(docs), 100)]
    index = [x for part in (rows[:4], rows[4:]) for x in [list(lexical._indexing(iter(part)))]]
    assert sum(len(x) for x in index) == 2 if segment > 1e6 else sum(len(x) for x in index) > 4
    got = lexical.search(lexical.build(own), asked, top, terms).collect()
    want = plain_search(docs, items, top)
    assert sorted([(r.item_id, r.rank, r.doc_id, r.score) for r in got], key=repr) == want
    # and with many small segments
    class Fixed:
        def __init__(self, value):
            self.value = value

    distinct = list(dict.fromkeys(items))
    queries = lexical.Queries.of(pa.Table.from_batches(list(lexical._query_terms(iter([batch([(i, *x) for i, x in enumerate(distinct)], ["query", "item_id", "text"], [pa.int64(), *kinds])])))))
    n_all, terms_all = (sum(x.column(c)[0].as_py() for part in index for x in part) for c in ("n_docs", "n_terms"))
    df = np.zeros(len(queries.hashes), np.int64)
    for part in index:
        for x in lexical._document_counts(Fixed(queries))(iter(part)):
            df[x.column("term").to_numpy()] += x.column("df").to_numpy()
    weight = np.array([math.floor(1000 * math.log((2 * n_all + 2) / (2 * d + 1))) if d else 0 for d in df.tolist()])
    found = [r for part in index for x in lexical._searching(Fixed(queries), Fixed(weight), n_all, terms_all, top)(iter(part)) for r in x.to_pylist()]
    mine = []
    for q in {r["query"] for r in found}:
        best = sorted((r for r in found if r["query"] == q), key=lambda r: (-r["score"], r["doc_id"] is None, r["doc_id"] or 0))[:top]
        mine += [(r["item_id"], k, r["doc_id"], r["score"]) for k, r in enumerate(best, 1)]
    assert sorted(mine, key=repr) == want


def test_hybrid_skips(monkeypatch):
    """With a full list of best documents, long lists of low bound don't bring up documents."""
    n = 50_000
    segment = lexical.Segment.__new__(lexical.Segment)
    segment.n_docs, segment.docs, segment.known = n, np.arange(n), np.ones(n, bool)
    rng = np.random.default_rng(3)
    common = lexical.List.of(np.arange(n), rng.integers(1, 10, n))
    rare = lexical.List.of(np.sort(rng.choice(n, 200, False)), np.full(200, 1000))
    looked = []
    own = lexical.List.lookup
    monkeypatch.setattr(lexical.List, "lookup", lambda self, wanted: looked.append(len(wanted)) or own(self, wanted))
    best = lexical.Best(20)
    lexical.hybrid([common, rare], segment, best)
    total = common.scores.copy()
    total[rare.docs] += 1000
    order = np.lexsort((np.arange(n), -total))[:20]
    assert best.rows[0].tolist() == total[order].tolist() and best.rows[2].tolist() == order.tolist()
    assert sum(looked) <= 200


def plain_top(rows, top=5, every=50):
    ok = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    own = [(i, vec, [math.floor(256 * float(np.float32(x))) for x in v]) for i, (vec, v) in enumerate(rows) if ok(v)]
    out = []
    for i, q, v in own:
        if q is not None and q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), c is None, c or 0) for j, c, w in own if j != i)
            out += [(q, k, None if unknown else c, -s) for k, (s, unknown, c) in enumerate(scored[:top], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("components", [8_000_000, 40])
def test_top_k_equals_plain_version(spark, components):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.choice([-1.0, -0.3, 0.001, 0.002, 0.4, 1.5], 8)]) for i in range(700)]
    rows += [(i, [0.0] * 8) for i in range(700, 760)] + [(800, [1.0] * 3), (801, []), (802, None), (803, [1.0, None]), (804, [float("nan")]), (850, [float("inf")] * 8), (None, [1.5] * 8), (None, None), (50, rows[50][1]), (51, rows[51][1]), (900, [2.0] * 9), (950, [])]
    frame = spark.createDataFrame([(*r, "u", 3) for r in rows], "vec_id long, embedding array<float>, uid string, score int").repartition(5)
    own = vector_search.integer_rows(frame)
    got = vector_search.top_k(own, own.where("vec_id % 50 = 0"), components=components).collect()
    assert sorted([(r.query_id, r.rank, r.vec_id, r.score) for r in got], key=repr) == plain_top(rows)


def test_top_k_few_and_large(spark):
    few = vector_search.integer_rows(spark.createDataFrame([(0, [1.0]), (1, [2.0]), (50, [3.4e38])], "vec_id long, embedding array<float>"))
    got = vector_search.top_k(few, few.where("vec_id % 50 = 0")).collect()
    assert {(r.query_id, r.vec_id) for r in got} == {(0, 1), (0, 50), (50, 0), (50, 1)}


def test_top_k_blocks(monkeypatch):
    """Blocks smaller than k, ties across blocks."""
    import pyarrow as pa

    monkeypatch.setattr(vector_search, "BLOCK", 3)
    monkeypatch.setattr(vector_search, "GROUP", 2)
    rows = [(i, [1.0, float(i % 2), 0.0]) for i in range(40)]
    table = pa.table({"uid": pa.array(range(40)), "vec_id": pa.array([r[0] for r in rows]), "v": pa.array([[int(256 * x) for x in r[1]] for r in rows], pa.list_(pa.int64()))})

    class Fixed:
        value = vector_search.Sparse.of(table.filter([i % 10 == 0 for i in range(40)]))

    got = [r for x in vector_search._searching(Fixed, 5)(iter(table.to_batches(max_chunksize=7))) for r in x.to_pylist()]
    assert sorted((r["query_id"], k, r["vec_id"], r["score"]) for q in (0, 10, 20, 30) for k, r in enumerate(sorted((r for r in got if r["query_id"] == q), key=lambda r: (-r["score"], r["vec_id"])), 1)) == sorted(plain_top(rows, every=10))
