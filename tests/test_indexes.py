"""Stored indexes against the exact ways they stand in for."""

import random

from pyspark.sql import functions as F

from lodestone.operators import dense, index, lexical, vector_index


def corpus(spark, n=700):
    r = random.Random(6)
    words = [f"w{k}" for k in range(60)]
    texts = {k: " ".join(r.choices(words, weights=[1 / (j + 1) for j in range(60)], k=r.randint(0, 40))) for k in range(n)}
    for k in range(100, 140):
        texts[k] += " Rare rare"
    texts[3] = None
    return spark.createDataFrame(list(texts.items()), "doc long, text string").coalesce(2)


def test_stored_index_equals_bm25(spark, tmp_path):
    d = corpus(spark)
    q = spark.createDataFrame([(1, "rare w1 w1"), (2, "w0 w2 w59"), (3, "absent"), (4, None), (5, "w3")], "q int, text string")
    for k in range(3):
        index.add(d.where(f"doc % 3 = {k}"), str(tmp_path), str(k), key="doc", block=16)
    index.add(d.where("doc % 3 = 1"), str(tmp_path), "1", key="doc", block=16)  # a batch written again is one batch
    ix = index.open_index(spark, str(tmp_path))
    key = lambda rows: sorted((r.q, r["rank"], r.doc, r.score) for r in rows)
    for top in (5, 1000):
        want = lexical.bm25(d, q, doc="doc", query="q", top=top).collect()
        for seed in (1, 100):
            assert key(index.search(ix, q, doc="doc", query="q", top=top, seed=seed).collect()) == key(want)
    assert index.totals(ix).head()[0] == 700


def test_stored_index_leaves_blocks_out(spark, tmp_path):
    d = corpus(spark)
    index.add(d, str(tmp_path), "all", key="doc", block=16)
    ix, q = index.open_index(spark, str(tmp_path)), spark.createDataFrame([(1, "rare w1")], "q int, text string")
    _, every = index.bounds(ix, q, query="q")
    _, opened = index.opened_blocks(ix, q, query="q", top=5)
    assert opened.count() * 4 < every.count()
    scans = [line for line in every._jdf.queryExecution().toString().splitlines() if "ReadSchema" in line]
    assert scans and not any("docs:" in line for line in scans)  # bounds come without the postings lists


def test_index_of_nothing(spark, tmp_path):
    d = spark.createDataFrame([(1, ""), (2, None)], "doc long, text string")
    index.add(d, str(tmp_path), "a", key="doc")
    ix = index.open_index(spark, str(tmp_path))
    assert index.search(ix, spark.createDataFrame([(1, "x")], "q int, text string"), doc="doc", query="q").count() == 0
    assert tuple(index.totals(ix).head()) == (2, 0.0)


def test_stored_index_makes_no_pairs_to_shuffle(spark, tmp_path, monkeypatch):
    d = corpus(spark)
    q = spark.createDataFrame([(k, f"w{k} w{k + 1} rare w{k}") for k in range(9)], "q int, text string")
    for k in range(2):
        index.add(d.where(f"doc % 2 = {k}"), str(tmp_path), str(k), key="doc", block=16)
    ix = index.open_index(spark, str(tmp_path))
    found = index.search(ix, q, doc="doc", query="q", top=7)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan  # no row for each question and document: they are scored where they lie
    want = sorted(lexical.bm25(d, q, doc="doc", query="q", top=7).collect())
    assert sorted(found.collect()) == want and len(want) == 63
    monkeypatch.setattr(lexical, "TILE", 2)
    monkeypatch.setattr(lexical, "PAIRS", 50)
    assert sorted(index.search(ix, q, doc="doc", query="q", top=7).collect()) == want


def test_stored_maxima(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "RUN", 5)  # steps end within blocks
    index.add(corpus(spark), str(tmp_path), "a", key="doc", block=16)
    ix = index.open_index(spark, str(tmp_path))
    each = ix.documents.select("block", "dl", F.explode(F.arrays_zip("term", "tf")).alias("x")).select("block", "x.term", "x.tf", "dl")
    each = each.unionByName(ix.documents.select("block", F.lit("").alias("term"), F.lit(1).alias("tf"), "dl"))
    want = each.groupBy("block", "term").agg(F.count(F.lit(1)), F.max("tf"), F.min("dl"), F.sum("dl")).collect()
    assert sorted(map(tuple, want)) == sorted(map(tuple, ix.blocks.drop("batch").collect()))
    sizes = [r["count"] for r in ix.documents.groupBy("block").count().collect()]
    assert sum(sizes) == 700 and max(sizes) == 16 and len(sizes) == 44
    held = {r.key: dict(zip(r.term, r.tf)) for r in ix.documents.collect()}
    assert held[3] == {} and held[100]["rare"] == 2


def test_stored_index_merges_repeated_ids(spark, tmp_path):
    rows = [(k, f"w{k % 5} w{k % 3} w{k % 7} w9") for k in range(90)]
    rows += [(3, "w3 w0 w3 w1"), (4, "w9"), (4, "w4 w4 w4 w4 w4 w4"), (None, "w1 w2"), (None, "w1 w1")]  # of one length and of several, far from the first
    d = spark.createDataFrame(rows, "doc long, text string").coalesce(1)
    q = spark.createDataFrame([(1, "w3 w0"), (2, "w4"), (3, "w1 w9")], "q int, text string")
    index.add(d.where("doc is null or doc % 2 = 1"), str(tmp_path), "a", key="doc", block=8)
    index.add(d.where("doc % 2 = 0"), str(tmp_path), "b", key="doc", block=8)
    ix = index.open_index(spark, str(tmp_path))
    key = lambda rows: sorted((r.q, r["rank"], r.doc or -1, r.score) for r in rows)
    for top in (1, 4, 200):
        assert key(index.search(ix, q, doc="doc", query="q", top=top, seed=1).collect()) == key(lexical.bm25(d, q, doc="doc", query="q", top=top).collect())


def clustered(spark, n=400):
    r = random.Random(2)
    centres = [[r.gauss(0, 1) for _ in range(8)] for _ in range(10)]
    rows = [(k, [x + r.gauss(0, 0.1) for x in centres[k % 10]], k % 3) for k in range(n)]
    return spark.createDataFrame([*rows, (n, None, 0), (n + 1, [], 0)], "id long, vector array<double>, label int")


def test_vector_index(spark, tmp_path):
    d = clustered(spark)
    q = d.where("id % 40 = 0 and id < 400").select(F.col("id").alias("q"), "vector")
    vector_index.write(d, str(tmp_path), vector_index.fit(d, 10), key="id")
    assert spark.read.parquet(f"{tmp_path}/vectors").count() == 400
    exact = dense.top_k(d.where("size(vector) > 0"), q, 5, doc="id", query="q")
    rows = lambda x: sorted((r.q, r["rank"], r.id, r.score) for r in x.collect())
    assert rows(vector_index.search(spark, str(tmp_path), q, 5, 10, doc="id", query="q")) == rows(exact)
    few = vector_index.search(spark, str(tmp_path), q, 5, 2, doc="id", query="q")
    assert vector_index.recall(few, exact, query="q", doc="id").head().recall >= 0.9
    assert len(few.inputFiles()) >= 1 and few.select("q").distinct().count() == 10
    one = vector_index.search(spark, str(tmp_path), q.where("q = 0"), 5, 1, doc="id", query="q", where="label = 1")
    assert all(r.id % 3 == 1 for r in one.collect()) and "PartitionFilters: [" in one._jdf.queryExecution().toString()


def test_vector_index_of_nothing(spark, tmp_path):
    d = clustered(spark)
    assert vector_index.fit(d.where("id >= 400"), 4) == []
    vector_index.write(d, str(tmp_path), vector_index.fit(d, 4), key="id")
    q = d.where("id >= 400").select(F.col("id").alias("q"), "vector")
    assert vector_index.search(spark, str(tmp_path), q, 5, 2, doc="id", query="q").count() == 0


def test_terms_in_tiles(spark):
    texts = spark.createDataFrame([(1, "abcabd"), (2, ""), (3, None), (4, "xyz ab")], "k int, low string")
    terms = spark.createDataFrame([(t,) for t in ["ab", "abc", "", "z", None, "q", "ab", "bca"]], "term string")
    want = {(k, t) for k, x in ((1, "abcabd"), (2, ""), (4, "xyz ab")) for t in ("ab", "abc", "", "z", "q", "bca") if t in x}
    for tile in (1, 2, 5, 100):
        got = lexical.containing(texts, terms, key="k", low="low", term="term", tile=tile).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert lexical.containing(texts, terms.limit(0), key="k", low="low", term="term").count() == 0


def test_broadcasts_are_proven_without_persisting(spark):
    small = spark.range(3)
    assert lexical.bounded(small) is small
    made = spark.range(1 << 24).where("id < 5").select("id", F.rpad(F.lit("x"), 50, "x").alias("pad"))
    assert lexical.estimated_bytes(made) > 10 << 20
    hinted = lexical.bounded(made)
    assert "ResolvedHint (strategy=broadcast)" in hinted._jdf.queryExecution().analyzed().toString() and hinted.count() == 5
    assert "ResolvedHint" not in lexical.bounded(made, 3)._jdf.queryExecution().analyzed().toString()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0
