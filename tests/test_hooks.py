"""Model hooks: loaded once, tried again, followed by the next model; lenient replies."""

import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lodestone.operators import dense, fusion, hooks
from lodestone.sources import files


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import this file


def absent():
    raise ImportError("no such model")


def flaky(fails, error="status 500"):
    """A model that fails its first calls in a worker."""

    def load():
        left = [fails]

        def run(inputs):
            if left[0]:
                left[0] -= 1
                raise RuntimeError(error)
            return [f"said {x}" for x in inputs]

        return run

    return load


def lengths():
    return lambda inputs: [[float(len(x)), 3.0] for x in inputs]


def test_called_tries_again_and_passes_on():
    assert hooks.called([("a", absent), ("b", flaky(1))], ["x"], wait=0, scope="t1") == ("b", ["said x"])
    assert hooks.called([("a", flaky(5)), ("b", flaky(0))], ["x"], retries=2, wait=0, scope="t2") == ("b", ["said x"])
    assert hooks.called([("short", lambda: lambda inputs: [])], ["x", "y"], wait=0, scope="t3") == (None, [None, None])
    assert hooks.called([("a", flaky(1, "bad key"))], ["x"], wait=0, again=hooks.server_error, scope="t4") == (None, [None])
    assert hooks.called([], ["x"]) == (None, [None])


def test_a_model_is_loaded_once_and_asked_in_batches(spark):
    def load():
        seen = {"loads": 0}
        seen["loads"] += 1
        return lambda inputs: [f"{seen['loads']}:{len(inputs)}" for _ in inputs]

    d = spark.createDataFrame([(k, None if k == 4 else f"t{k}") for k in range(10)], "k int, t string").coalesce(1)
    got = d.select("k", hooks.hook([("m", load)], "string", batch=4, scope="once")("t").alias("r")).orderBy("k").collect()
    assert [r.r.value for r in got] == ["1:4"] * 4 + [None] + ["1:4"] * 4 + ["1:1"] and got[4].r.model is None


def test_embedding_chain(spark):
    d = spark.createDataFrame([(1, "one two"), (2, None), (3, "")], "k int, t string")
    got = {r.k: r for r in hooks.embed(d, "t", [("gone", absent), ("all-MiniLM-L6-v2", lengths)], scope="e1").collect()}
    assert {r.embedder for r in got.values()} == {"all-MiniLM-L6-v2"}
    assert got[1].vector == pytest.approx([7 / 58**0.5, 3 / 58**0.5]) and got[2].vector == got[3].vector == [0.0, 1.0]
    plain = {r.k: r.v for r in d.select("k", dense.embedder()("t").alias("v")).collect()}
    none = {r.k: (r.embedder, r.vector) for r in hooks.embed(d, "t", [("gone", absent)], scope="e2").collect()}
    assert all(none[k][0] == "hash" and none[k][1] == pytest.approx(plain[k]) for k in plain)
    prefix = "Represent this sentence for searching relevant passages: "
    first = hooks.embed(d, "t", [("BAAI/bge-base-en-v1.5", lengths)], scope="e3").where("k = 1").head().vector
    passage = hooks.embed(d, "t", [("BAAI/bge-base-en-v1.5", lengths)], kind="passage", scope="e3").where("k = 1").head().vector
    assert first[0] / first[1] == pytest.approx((7 + len(prefix)) / 3) and passage[0] / passage[1] == pytest.approx(7 / 3)


def test_reranker_falls_back_on_the_distance(spark):
    d = spark.createDataFrame([(1, 10, "q", "long text", 0.9), (1, 11, "q", "t", 0.1)], "q int, doc int, question string, text string, distance double")

    def order(models, scope):
        scored = hooks.logits(d, models, scope=scope)
        best = fusion.rerank(scored, query="q", doc="doc", logit=F.coalesce("logit", 1.5 * (1.0 - F.col("distance"))))
        return [r.doc for r in best.orderBy("final_rank").collect()]

    assert order([("cross", lambda: lambda pairs: [float(len(t)) for _, t in pairs])], "r1") == [10, 11]
    assert order([("cross", absent)], "r2") == [11, 10]


def test_generator(spark):
    d = spark.createDataFrame([(1, "p", "extract")], "k int, prompt string, extract string")
    one = lambda models, scope: hooks.generate(d, "prompt", models, F.col("extract"), wait=0, scope=scope).select("answer", "generator").head()
    assert tuple(one([("local", flaky(1))], "g1")) == ("said p", "local")
    assert tuple(one([("local", flaky(1, "status 401")), ("next", flaky(0))], "g2")) == ("said p", "next")
    assert tuple(one([("local", absent)], "g3")) == ("extract", "fallback")


def test_crop_replies(spark):
    replies = ['Sure: {"type": "CHART", "description": "bars"} done', "just prose", '{"type": "PHOTO"}', '{"description": "d", "extra": {"a": 1}}', "{broken", "{broken}", None]
    d = spark.createDataFrame([(k, r) for k, r in enumerate(replies)], "k int, r string").orderBy("k")
    got = [tuple(x.c) for x in d.select("k", hooks.crop_class(F.col("r")).alias("c")).orderBy("k").collect()]
    assert got == [("chart", "bars"), ("diagram", "just prose"), ("photo", '{"type": "PHOTO"}'), ("diagram", "d"), ("diagram", "{broken"), ("diagram", hooks.NO_DESCRIPTION), ("diagram", hooks.NO_DESCRIPTION)]


def test_described_images(spark):
    d = spark.createDataFrame([(1, bytearray(b"abc")), (2, None)], "k int, image binary")
    say = lambda word: lambda: lambda inputs: [f" {word} {len(x)} " for x in inputs]
    got = {r.k: tuple(r.described) for r in hooks.describe_images(d, "image", [("no", absent), ("ocr", say("text"))], [("a", say("seen")), ("b", absent), ("c", say("also"))], scope="d1").collect()}
    assert got == {1: ("text 3", "[a]: seen 3\n[c]: also 3", "Text detected in image:\ntext 3\n\nVisual Analysis & Details:\n[a]: seen 3\n[c]: also 3"), 2: ("", "", "")}
    none = hooks.describe_images(d, "image", [], [("b", absent)], scope="d2").where("k = 1").head().described
    assert tuple(none) == ("", "", hooks.NOTHING)
    crops = hooks.classify_crops(d, "image", [("v", lambda: lambda inputs: ['{"type": "TABLE", "description": "t"}'] * len(inputs))], scope="c1").orderBy("k").collect()
    assert [(r.type, r.description) for r in crops] == [("table", "t"), ("diagram", hooks.NO_DESCRIPTION)]


def test_alpha_on_white(spark):
    rows = [(1, 4, bytearray([10, 20, 30, 255, 10, 20, 30, 0])), (2, 1, bytearray([7, 9])), (3, 3, bytearray([1, 2, 3])), (4, 3, None)]
    got = {r.k: (r.channels, r.data and list(r.data)) for r in files.on_white(spark.createDataFrame(rows, "k int, channels int, data binary")).collect()}
    assert got == {1: (3, [10, 20, 30, 255, 255, 255]), 2: (3, [7, 7, 7, 9, 9, 9]), 3: (3, [1, 2, 3]), 4: (3, None)}


def test_model_sentences_expand_long_questions(spark):
    from lodestone.operators import prompts

    q = "how do the pumps cool down"
    rows = [(q, "pump\ncooling cycle"), (q, None), (q, "I am ready to provide it"), (q, "x"), ("pumps", "pump cooling"), (q, "y" * 400), ("give me a summary of all this", "other words")]
    d = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, q string, s string")
    got = [r[0] for r in d.orderBy("k").select(prompts.expand_query(F.col("q"), F.col("s"))).collect()]
    assert got[:6] == [f"{q} pump cooling cycle", q, q, q, "pumps", f"{q} {'y' * 150}"] and got[6].startswith("give me a summary of all this document summary")


def test_markdown_of_odd_cells(spark):
    from lodestone.operators import prompts

    d = spark.createDataFrame([("t", 2, None, "b"), ("t", 1, "x\ny", " a ")], "t string, n int, p string, q string")
    assert prompts.markdown_rows(d, "t", "n", ["p", "q"]).head().markdown == "| p | q |\n| --- | --- |\n| x y | a |\n|  | b |"
