"""Work that must not grow faster than its input: copies of boxes, pairs of fingerprints, batches of long texts."""

import time

import pytest
from pyspark.sql import functions as F

from lodestone.operators import figures

MANY = 120_000


@pytest.fixture
def page(spark):
    """A page of MANY figures and as many captions, in three places each."""
    n = spark.range(MANY).select("id", (F.col("id") % 3).alias("k"), F.lit(1).alias("page"))
    fig = n.select(F.col("id").alias("fig_id"), "page", F.lit(0.0).alias("l"), (F.col("k") / 10).alias("t"), F.lit(0.5).alias("r"), (F.col("k") / 10 + 0.3).alias("b"))
    cap = n.select(F.col("id").alias("cap_id"), "page", F.col("id").alias("block_no"), F.lit(0.1).alias("cl"), (F.col("k") / 10 + 0.35).alias("ct"), F.lit(0.45).alias("cr"), (F.col("k") / 10 + 0.4).alias("cb"))
    return fig, cap


def scaled(d, names):
    return d.select(*[(F.col(c) * 1000).alias(c) if c in names else F.col(c) for c in d.columns])


def timed(make):
    began = time.time()
    rows = make()
    assert time.time() - began < 60  # all pairs are 14 billion
    return rows


def test_caption_boxes_of_many_copies(page):
    fig, cap = (scaled(d, ("l", "t", "r", "b", "cl", "ct", "cr", "cb")) for d in page)
    out = timed(lambda: figures.caption_boxes(cap, fig.drop("fig_id"), ["page"]).groupBy("kind", "l", "t", "r", "b").count().collect())
    assert {(r.kind, r.l, r.t, r.r, r["count"]) for r in out} == {("figure", 0.0, 0.0, 500.0, MANY // 3)}
    assert sorted(round(r.b) for r in out) == [300, 400, 500]


def test_first_captions_of_many_copies(page):
    fig, cap = page
    joined = timed(lambda: figures.caption_join(fig, cap, ["page"]).groupBy("t", "cap_id").count().collect())
    # the caption of the next place up begins within reach of a box too, and the first block wins
    assert {(round(r.t, 1), r.cap_id, r["count"]) for r in joined} == {(0.0, 0, MANY // 3), (0.1, 1, MANY // 3), (0.2, 2, MANY // 3)}
    near = timed(lambda: figures.caption_near(scaled(fig, "ltrb"), scaled(cap, ("cl", "ct", "cr", "cb")), ["page"], within=60.0).groupBy("t", "cap_id").count().collect())
    assert {(round(r.t), r.cap_id, r["count"]) for r in near} == {(0, 0, MANY // 3), (100, 0, MANY // 3), (200, 1, MANY // 3)}


def test_outside_covers_of_many_copies(page):
    fig, _ = page
    covers = fig.where("t < 0.05").select("page", F.col("l").alias("ol"), F.lit(0.0).alias("ot"), F.lit(0.01).alias("orr"), F.lit(0.2).alias("ob"))
    apart = fig.select("fig_id", "page", "l", "t", "r", "b")
    assert timed(lambda: figures.outside_covers(apart, covers, ["page"], share=0.5).count()) == MANY
    assert timed(lambda: figures.outside_covers(apart, covers.withColumn("orr", F.lit(0.5)), ["page"], share=0.5).count()) == MANY * 2 // 3


def test_parents_share_the_lists_of_their_pages(spark):
    p = spark.createDataFrame([(1, 1, [1, 2]), (1, 2, [2, 1, 1]), (1, 3, [3]), (1, 4, None), (2, 5, [1]), (1, 6, [1]), (1, 6, [2])], "doc long, parent long, pages array<int>")
    f = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 2, "b"), (1, 4, "c")], "doc long, page int, name string")
    seen = []

    def derived(held):
        seen.append(held)
        return {"names": F.array_join(F.transform(held, lambda x: x["name"]), ",")}

    out = figures.figures_of_parents(p, f, doc="doc", parent="parent", pages="pages", page="page", figure=["name"], derived=derived)
    assert seen and out.columns == ["doc", "parent", "pages", "names"]
    assert sorted((r.doc, r.parent, r.names) for r in out.collect()) == [(1, 1, "a,b"), (1, 2, "a,b"), (1, 3, ""), (1, 4, ""), (1, 6, "a,b"), (1, 6, "a,b"), (2, 5, "")]


def fingerprints(spark):
    rows = [(i, [((i * 7 + k * k * (i % 13 + 1)) % 29) / 29.0 for k in range(64)]) for i in range(400)]
    rows += [(1000, [0.5] * 64), (1001, rows[3][1]), (1050, rows[3][1][:32]), (1100, None)]  # flat, a copy, another size, none
    return figures.fingerprints(spark.createDataFrame(rows, "id long, grid array<float>"), "grid").select("id", F.struct("dhash", "ahash", "thumb", "hist").alias("fp"))


def test_fingerprint_pairs_equal_expressions(spark):
    fp = fingerprints(spark)
    q = fp.where("id % 50 = 0")
    from lodestone.functions import vectors as vec

    a, b = F.col("q.fp"), F.col("f.fp")
    plain = q.alias("q").join(fp.alias("f"), F.col("q.id") != F.col("f.id")).select(
        F.col("q.id").alias("query_id"), F.col("f.id").alias("fig_id"), vec.bit_similarity(a["dhash"], b["dhash"]).alias("d"), vec.bit_similarity(a["ahash"], b["ahash"]).alias("a"),
        vec.cross_correlation(a["thumb"], b["thumb"]).alias("n"), vec.correlation(a["hist"], b["hist"]).alias("h"),
    )
    cell = lambda r: (r.query_id, r.fig_id, *(None if x is None else round(x, 9) for x in (r.d, r.a, r.n, r.h)))
    pairs = figures.fingerprint_pairs(q, fp)
    assert "NestedLoop" not in figures.fingerprint_pairs(q.where("id < 1000"), fp.where("id < 1000"))._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(cell, pairs.collect()), key=str) == sorted(map(cell, plain.collect()), key=str)


def test_visual_matches_in_tiles(spark, monkeypatch):
    fp = fingerprints(spark)
    q = fp.where("id % 50 = 0")
    row = lambda r: (r.query_id, r["rank"], r.fig_id, r.similarity)
    whole = sorted(map(row, figures.visual_matches(q, fp, top=5).collect()))
    monkeypatch.setattr(figures, "TILE", 3)
    monkeypatch.setattr(figures, "STEP", 7)
    assert sorted(map(row, figures.visual_matches(q, fp, top=5).collect())) == whole
    assert len({r[0] for r in whole}) >= 9 and (0, 1) in {r[:2] for r in whole}


def test_pair_stats_equal_all_pairs(spark):
    from lodestone.functions import vectors as vec
    from lodestone.operators import guardrails

    rows = [(i, [((i * 31 + k * k * 7) % 17) / 17.0 - 0.4 for k in range(8)]) for i in range(90)]
    rows += [(30, [0.1] * 8), (91, None), (100, [0.5, None]), (120, [0.5, 0.25]), (121, [1.0, 0.5]), (None, [0.3] * 8)]  # a repeated id, gaps, another length
    v = spark.createDataFrame(rows, "vec_id long, vector array<float>")
    q = v.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), "vector")
    pairs = v.join(q.withColumnRenamed("vector", "qv"), F.col("query_id") != F.col("vec_id")).select(vec.dot(F.col("qv"), F.col("vector")).alias("x"))
    out = guardrails.pair_stats(v, q, key="vec_id", query="query_id")
    assert out.first() == guardrails.similarity_stats(pairs, "x").first()
    few = guardrails.pair_stats(v.where("vec_id < 2"), q.where("query_id < 2"), key="vec_id", query="query_id").first()
    assert tuple(few) == (1, 0.42, 0.09)
    none = guardrails.pair_stats(v.limit(0), q.limit(0), key="vec_id", query="query_id").first()
    assert tuple(none) == (0, 0.42, 0.09)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bm25_makes_no_pairs_to_shuffle(spark, monkeypatch):
    import math
    import re
    from collections import Counter

    from lodestone.operators import lexical

    texts = [" ".join(f"w{(i * k) % 11}" for k in range(1, 4 + i % 9)) for i in range(60)] + ["", None]
    rows = list(enumerate(texts)) + [(3, "w1 w1 w2"), (3, texts[3]), (7, "w5 w0")]  # repeated ids, of one and of several lengths
    asked = [(k, f"w{k} w{k + 1} w{k} other") for k in range(7)] + [(9, "nothing"), (10, None)]
    d, q = spark.createDataFrame(rows, "doc long, text string"), spark.createDataFrame(asked, "q long, text string")
    words = lambda t: re.findall(r"\w+", (t or "").lower())
    mean = sum(len(words(t)) for _, t in rows) / len(rows)
    held = Counter((i, len(words(t)), w) for i, t in rows for w in words(t))
    df, want = Counter(w for _, _, w in held), Counter()
    for k, t in asked:
        for w, m in Counter(words(t)).items():
            for (i, dl, x), f in held.items():
                if x == w:
                    want[k, i] += m * math.log(1 + (len(rows) - df[w] + 0.5) / (df[w] + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * dl / mean))
    for tile, pairs in ((4096, 1_000_000), (2, 5)):
        monkeypatch.setattr(lexical, "TILE", tile)
        monkeypatch.setattr(lexical, "PAIRS", pairs)
        got = {(r.q, r.doc): r.score for r in lexical.bm25(d, q, doc="doc", query="q", top=100).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)
    unique = spark.createDataFrame(rows[:62], "doc long, text string")
    assert "Aggregate" not in plan(lexical.bm25(unique, q, doc="doc", query="q"))  # scores are made where a document lies


def test_best_keeps_ties_and_nan():
    import numpy as np
    import pyarrow as pa

    from lodestone.operators.best import Best

    rng = np.random.default_rng(3)
    s = rng.integers(0, 5, (500, 4)).astype(float)
    s[77, 1] = np.nan
    for ids in (rng.permutation(500), np.array([f"d{k:03}" for k in rng.permutation(500)])):
        best = Best(4, 6)
        best.limit = 40
        for lo in range(0, 500, 37):
            best.add(s[lo : lo + 37], pa.array(ids[lo : lo + 37]), least=0.0)
        got = [(r["q"], r["d"]) for b in best.batches(pa.array([0, 1, 2, 3]), ["q", "d", "s"]) for r in b.to_pylist()]
        want = [(q, ids[k]) for q in range(4) for k in sorted(range(500), key=lambda k, q=q: (-np.inf if np.isnan(s[k, q]) else -s[k, q], ids[k]))[:6]]
        assert sorted(got) == sorted(want)


def test_texts_are_embedded_where_they_are_searched(spark):
    from lodestone.operators import dense

    d = spark.createDataFrame([(i, f"word{i % 7} and word{i % 5}") for i in range(700)] + [(700, None)], "doc long, text string")
    q = d.where("doc < 9").select(F.col("doc").alias("q"), dense.embedder(32)("text").alias("vector"))
    fused = dense.top_k(d, q, 4, doc="doc", query="q", content="text", reader=dense.hashed(32))
    plain = dense.top_k(d.select("doc", dense.embedder(32)("text").alias("vector")), q, 4, doc="doc", query="q")
    assert fused.collect() == plain.collect() and "ArrowEvalPython" not in plan(fused)


def test_many_page_ranges_share_tasks(spark, tmp_path, monkeypatch):
    from lodestone.sources import paged

    for k in range(40):
        (tmp_path / f"f{k:02}.txt").write_text("".join(f"{k}.{n}\n" for n in range(1 + k % 7)))
    reader = paged.PageRanges(str(tmp_path), paged.TextPages(1), per_task=2)
    alone = [row for p in reader.partitions() for row in reader.read(p)]
    monkeypatch.setattr(paged, "TASKS", 6)
    together = reader.partitions()
    assert len(alone) == sum(1 + k % 7 for k in range(40)) and len(together) <= 6
    assert [row for p in together for row in reader.read(p)] == alone
    assert max(sum(r.last - r.first + 1 for r in p.ranges) for p in together) <= len(alone) // 6 + 3


def test_chunks_come_in_short_batches(spark):
    from lodestone.operators import chunking

    text = "one two three. " * 40
    d = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("f").alias("filename"), F.lit(text).alias("text"))
    node = lambda kind, content, page: F.struct(F.lit(kind).alias("type"), content.alias("content"), F.lit(page).alias("page"))
    nodes = d.select("doc_id", F.lit(None).cast("string").alias("title"), F.array(node("header", F.lit("H"), 1), node("text", F.col("text"), 2)).alias("nodes"))
    for df in (chunking.recursive_chunks(d, 100, 10), chunking.parent_child_chunks(nodes, 20, 60)):
        assert "MapInPandas" not in plan(df)  # whole batches as pandas rows
        counts = {r["count"] for r in df.groupBy("doc_id").count().collect()}
        assert len(counts) == 1 and df.select("doc_id").distinct().count() == 500
    assert chunking.parent_child_chunks(nodes.limit(0)).collect() == [] == chunking.recursive_chunks(d.where("doc_id < 0")).collect()


def test_regions_of_many_small_pages(spark, monkeypatch):
    import random

    import numpy as np

    from lodestone.operators import layout

    rng = random.Random(5)
    for _ in range(60):
        boxes = np.array([(x, y, x + rng.random() * 3, y + rng.random() * 3) for x, y in ((rng.random() * 20, rng.random() * 20) for _ in range(rng.randrange(1, 40)))])
        few = layout.touching(boxes, 0.2)
        monkeypatch.setattr(layout, "FEW", -1)
        swept = layout.touching(boxes, 0.2)
        monkeypatch.undo()
        assert few == swept
    rows = spark.range(4000).select((F.col("id") % 2000).alias("page"), (F.col("id") >= 2000).cast("int").alias("box_id"), F.lit("text").alias("kind"), F.lit("a").alias("text"), F.lit(0).alias("l"), F.lit(0).alias("t"), F.lit(1).alias("r"), F.lit(1).alias("b"))
    out = layout.regions(rows, ["page"])
    assert "FlatMapGroupsInPandas" not in plan(out)  # a pandas frame for each page
    assert {(r.region, r.n_boxes, r.text) for r in out.collect()} == {(0, 2, "a\na")} and out.count() == 2000
