"""Each stage of the pipeline against a plain version of its decision, on awkward documents."""

import collections
import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ensemblespark.llm import bpe, mixing, quality, rules
from tests.llm.test_llm import DOCS, brute_groups, prose


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(8)
    rows = [(i, prose(i, rng.choice([60, 120, 400])), rng.choice(["en", "de", None]), f"s{i % 3}", 600) for i in range(60)]
    rows += [(100 + i, rows[i][1] + " and more", "en", "s1", 5) for i in range(8)] + [(200 + i, rows[i][1].upper(), "en", "s0", 6) for i in range(4)]
    rows += [(300, None, "en", "s1", None), (301, "", None, None, 0), (302, " \n\t ", "de", "s2", 4), (None, prose(90), None, "s0", 5), (None, None, None, None, None), (303, "word " * 20_000, "en", "s2", None), (304, "la " * 30, "fr", None, 9), (305, "#*$%& " * 80, "en", "s2", 9)]
    twice = [(5, rows[5][1], "en", "s7", 1), (5, rows[5][1], "en", "s7", 2), (5, rows[5][1], "aa", "s9", 3)]
    at = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame([(*r, "u", "r", "w", k, "k", "s") for k, r in enumerate(rows + twice)], DOCS).repartition(4).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def rows_of(df):
    return collections.Counter(tuple(r) for r in df.collect())


def test_stages_decide_as_plain_versions(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    # The classifier keeps the rows that it scores as good, each scored by itself.
    machine = quality.train(docs, spark.read.parquet(f"{corpus}/labels.parquet"))
    number = F.monotonically_increasing_id()
    numbered = docs.withColumn("number", number).cache()
    scored = quality.score(numbered.select(F.col("number").alias("doc_id"), "text", "n_chars"), machine)
    good = {r.doc_id for r in scored.collect() if r.predicted == 1}
    want = collections.Counter(tuple(r)[:-1] for r in numbered.collect() if r.number in good)
    assert rows_of(stage["quality classifier"](spark, docs, corpus)) == want and 0 < sum(want.values()) < docs.count()
    # The rules keep the rows whose text and language pass.
    passed = {(r.text, r.lang) for r in rules.judge(docs.select("text", "lang")).where("kept").select("t1", "t2", "lang").distinct().join(docs.select("text", *rules.text_key()).distinct(), ["t1", "t2"]).collect()}
    want = collections.Counter(tuple(r) for r in docs.collect() if (r.text or "", r.lang) in {(t or "", x) for t, x in passed})
    assert rows_of(stage["quality rules"](spark, docs, corpus)) == want
    # Of each group of near-duplicates the least id stays; of rows equal in id and text the least as text.
    rows = docs.collect()
    groups = collections.defaultdict(list)
    for r, g in zip(rows, brute_groups([r.text for r in rows]), strict=True):
        groups[g].append(r)
    got = collections.defaultdict(list)
    for r in stage["MinHash near-dedup"](spark, docs, corpus).collect():
        got[r.doc_id].append(r)
    kept = collections.Counter(min(((r.doc_id is None, r.doc_id or 0) for r in g)) for g in groups.values())
    assert collections.Counter((i is None, i or 0) for i, v in got.items() for _ in v) == kept
    assert got[5][0].lang == "aa"  # the least of three rows equal in id and text
    assert rows_of(stage["MinHash near-dedup"](spark, docs.repartition(7), corpus)) == rows_of(stage["MinHash near-dedup"](spark, docs.repartition(2), corpus))
    # The mix takes each row as often as its plan says.
    planned = mixing.keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source", F.struct("*").alias("whole")))
    taken = mixing.apply(planned.drop("text", "doc_id"), mixing.plan(planned.select("source", "size", "key")))
    want = collections.Counter({tuple(r.whole): r.times for r in taken.collect() if r.times > 0})
    assert rows_of(stage["mixing sources"](spark, docs, corpus)) == want
    # The last stage encodes as the library does.
    import public_tokenizers as P
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    ids = [(r.doc_id, enc.encode_ordinary(r.text or ""), r.text or "") for r in rows]
    want = collections.Counter((i, len(x), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, x, t in ids)
    assert rows_of(stage["byte-level BPE"](spark, docs, corpus)) == want
