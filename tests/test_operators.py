"""Fixtures with hand-worked results, and sequential operators against plain models."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import scoring as sc
from lodestone.functions import text as tx
from lodestone.operators import chat, chunking, claims, dense, fusion, guardrails, lexical

CHUNKS = [
    ("in", "Parental leave lasts twenty weeks and is fully paid for every employee.", 0.74, 1),
    ("in", "The vacation policy grants thirty days each year to every employee.", 0.68, 2),
]


def ground(spark, question, answer):
    a = spark.createDataFrame([("in", question, answer)], "k string, q string, a string")
    c = spark.createDataFrame(CHUNKS, "k string, text string, score double, rank int")
    return guardrails.grounding(a, c, key="k", question="q", answer="a", text="text", score="score", rank="rank").head()


def test_grounded_answer(spark):
    r = ground(spark, "How long is parental leave?", "Parental leave lasts twenty weeks.")
    assert (r.is_grounded, r.confidence, r.n_citations) == (True, 0.8521, 2)


@pytest.mark.parametrize("answer", ["I could not find any information about rockets in the uploaded documents.", "There is no mention of that topic.", "This appears to be a random string of letters."])
def test_refusing_answer(spark, answer):
    r = ground(spark, "Who won the rocket race?", answer)
    assert (r.is_grounded, r.confidence, r.n_citations) == (False, 0.0, 0)


def test_no_chunks(spark):
    a = spark.createDataFrame([("x", "q", "a")], "k string, q string, a string")
    c = spark.createDataFrame([], "k string, text string, score double, rank int")
    assert not guardrails.grounding(a, c, key="k", question="q", answer="a", text="text", score="score", rank="rank").head().is_grounded


def test_filter_reasons(spark):
    rows = [
        (1, "growth rates", "growth rates rise", 0.1, 1), (1, "growth rates", "nothing", 0.36, 2), (1, "growth rates", "only growth", 0.1, 3),
        (2, "zebra crossing", "plain", 0.39, 1), (2, "zebra crossing", "plain", 0.20, 2),
    ]
    d = spark.createDataFrame(rows, "q int, question string, text string, score double, n int")
    kept = guardrails.relevance_filter(d, query="q", question="question", text="text", score="score", order="n", cut=0.35)
    assert [(r.q, r.n, r.reason, round(r.kept_score, 2)) for r in kept.orderBy("q", "n").collect()] == [(1, 1, "exact", 0.7), (1, 2, "score", 0.36), (1, 3, "lexical", 0.55), (2, 1, "score", 0.39)]
    strict = guardrails.relevance_filter(d.where("q = 2"), query="q", question="question", text="text", score="score", order="n", cut=0.42)
    assert [(r.n, r.reason) for r in strict.collect()] == [(1, "fallback")]


def test_calibration(spark):
    d = spark.createDataFrame([(0.2, False), (0.2, True), (0.615, False), (0.9, True)], "s double, l boolean")
    assert [r[0] for r in d.select(sc.calibrate(F.col("s"), F.col("l"))).collect()] == [0.0, 0.15, 0.5, 1.0]


def test_rrf_prefers_both_lists(spark):
    d = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "q int, d int, rank int")
    s = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "q int, d int, rank int")
    out = fusion.reciprocal_rank(d, s, query="q", doc="d").orderBy("rank").collect()
    assert [r.d for r in out] == [11, 10, 12] and out[0].rrf == pytest.approx(1 / 61 + 1 / 62, abs=1e-8)


def test_bm25_repeated_query_words_count(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, "blue fox"), (3, "")], "d int, text string")
    q = spark.createDataFrame([(1, "red"), (2, "red red"), (3, "nothing")], "q int, text string")
    got = {r.q: r.score for r in lexical.bm25(docs, q, doc="d", query="q").collect()}
    assert set(got) == {1, 2} and got[2] == pytest.approx(2 * got[1], abs=1e-5)


def test_dense_embedding_agrees_with_expressions(spark):
    docs = spark.createDataFrame([(1, "Alpha beta alpha"), (2, ""), (3, None)], "d long, text string")
    sparse = {(r.d, r.slot): r.value for r in dense.hash_embedding(docs, "d", dim=16).collect()}
    whole = {r.d: r.v for r in docs.select("d", dense.embedder(16)("text").alias("v")).collect()}
    for d, v in whole.items():
        assert all(sparse.get((d, i), 0.0) == pytest.approx(x, abs=1e-12) for i, x in enumerate(v))


def test_pool_spans(spark):
    d = spark.createDataFrame([([[1.0, 0.0], [0.0, 1.0], [3.0, 4.0]], [(0, 2), (5, 9), (1, 1)])], "v array<array<double>>, s array<struct<start:int,end:int>>")
    got = dense.pool_spans(d, "v", "s").head().pooled
    assert got[0] == pytest.approx([0.5**0.5, 0.5**0.5]) and got[1] == pytest.approx([0.6, 0.8]) and got[2] == pytest.approx([0.0, 1.0])


def test_claims(spark):
    text = "Hello there, this greeting states nothing at all. The engine reached 45 frames per second, and the latency fell below ten milliseconds. Short one."
    d = spark.createDataFrame([(1, text)], "k int, a string")
    assert [r.claim for r in claims.claims(d, "k", "a").orderBy("claim_no").collect()] == ["The engine reached 45 frames per second", "the latency fell below ten milliseconds."]


def test_history_and_delete(spark):
    t = spark.createDataFrame([(1, i, f"t{i}") for i in range(15)], "c int, turn int, text string")
    assert [r.turn for r in chat.last_turns(t, "c", "turn", 12).orderBy("position").collect()] == list(range(3, 15))
    assert chat.history_text(t, "c", "turn", "text").head().history == "t13\nt14"


def test_sessions(spark):
    s = spark.createDataFrame([("a", ["x"], 1, 10), ("b", ["x"], 2, 1), ("c", [], 3, 10)], "session_id string, files array<string>, modified_at int, expires_at int")
    assert [r.session_id for r in chat.list_sessions(s).collect()] == ["b"]
    assert chat.default_session(s, F.lit(5)).head().session_id == "c"
    assert chat.clear_except(s, "a")[1].head().removed == 2
    tok = s.withColumn("token_sha256", F.sha2(F.lit("t"), 256))
    asked = spark.createDataFrame([("a", "t"), ("a", "u"), ("b", "t"), ("z", "t")], "session_id string, token string")
    assert {(r.session_id, r.token): r.valid for r in chat.validate(tok, asked, F.lit(5)).collect()} == {("a", "t"): True, ("a", "u"): False, ("b", "t"): False, ("z", "t"): False}


def test_sanitise(spark):
    d = spark.createDataFrame([("As an AI, I cannot show images here.\nResult . Look at '/api/sessions/a/images/b.png' now",)], "a string")
    assert d.select(tx.sanitise(F.col("a"))).head()[0] == "Result. Look at  now"


def plain_pack(pieces, size, overlap):
    """Model: a list of held pieces, flushed when the next would not fit, popped from the front down to the overlap."""
    out, held = [], []
    for p in pieces:
        if held and sum(map(len, held)) + len(p) > size:
            out.append("".join(held).strip())
            while held and sum(map(len, held)) > overlap:
                held = held[1:]
        held = held + [p]
    out.append("".join(held).strip())
    return [x for x in out if x]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab .\n", min_size=1, max_size=9), max_size=30), st.integers(10, 30), st.integers(0, 9))
def test_pack_model(pieces, size, overlap):
    assert chunking.pack(pieces, size, overlap) == plain_pack(pieces, size, overlap)


@settings(max_examples=80, deadline=None)
@given(st.text("abc .?!\n", max_size=400), st.integers(12, 60))
def test_split_properties(text, size):
    got = chunking.split(text, size, size // 5)
    assert all(c == c.strip() and c for c in got) and all(len(c) <= size + size // 5 for c in got)
    seen = re.sub(r"\s+", "", "".join(got))
    assert set(re.sub(r"\s+", "", text)) <= set(seen)


def test_chunk_ids(spark):
    text = "\n\n".join(" ".join(random.Random(k).choices(["alpha", "beta", "gamma."], k=14)) for k in range(4))
    d = spark.createDataFrame([(1, "f.txt", text)], "doc_id long, filename string, text string")
    got = chunking.recursive_chunks(d, 60, 20).orderBy("chunk_index").collect()
    assert len(got) > 1 and got[0].chunk_id == "f.txt_chunk_0" and {r.total_chunks for r in got} == {len(got)}
    paged = spark.createDataFrame([(1, "f.pdf", "", ["one two [Image URL: /x.png]", " ", "three"])], "doc_id long, filename string, text string, pages array<string>")
    rows = chunking.recursive_chunks(paged, 60, 20, pages="pages").orderBy("chunk_index").collect()
    assert [(r.chunk_id, r.page_number, r.image_url) for r in rows] == [("f.pdf_p1_c0", 1, "/x.png"), ("f.pdf_p3_c1", 3, "")]


def test_parents_and_children():
    nodes = [("header", "Intro", 1)] + [("paragraph", "word " * 150, 1)] * 4 + [("header", "Next", 2), ("paragraph", "short", 2)]
    parents = chunking.parents_of(nodes, "T", child_target=192, parent_target=1536)
    assert [t for t, _ in parents] == ["Intro", "Next"]
    kids = chunking.children_of(parents[0][1], 192)
    assert len(kids) >= 4 and all(n <= 192 + 187 for _, n in kids)


def plain_clean(raw):
    kept = []
    for line in (x.strip() for x in raw.splitlines() if x.strip()):
        if kept and line.lower() == kept[-1].lower() or kept[-4:].count(line) >= 2:
            continue
        kept.append(line)
    text = "\n".join(kept)
    return text if len(text) > 5 else None


def test_clean_description(spark):
    r = random.Random(8)
    raw = ["\n".join(r.choice(["Alpha", "alpha", "beta ", "gamma", ""]) for _ in range(12)) for _ in range(60)] + ["I'm unable to see this image", "ok"]
    d = spark.createDataFrame(list(enumerate(raw)), "i int, t string")
    got = [x.c for x in d.select("i", tx.clean_description(F.col("t")).alias("c")).orderBy("i").collect()]
    assert got[:60] == [plain_clean(t) for t in raw[:60]] and got[60:] == [None, None]


def test_uuid5(spark):
    import uuid

    d = spark.createDataFrame([("a",), ("chunk_7",), ("ü",)], "n string")
    got = [r[0] for r in d.select(tx.uuid5(str(uuid.NAMESPACE_DNS), F.col("n"))).collect()]
    assert got == [str(uuid.uuid5(uuid.NAMESPACE_DNS, n)) for n in ("a", "chunk_7", "ü")]


def test_upsert_keeps_the_last_of_repeated_keys(spark):
    from lodestone.sources import store

    old = spark.createDataFrame([(1, 9), (2, 8)], "id int, v int")
    new = spark.createDataFrame([(1, v) for v in range(5)] + [(3, 0)], "id int, v int")
    for parts in (1, 2, 3, 5):
        got = sorted(map(tuple, store.upsert(old, new.repartition(parts), "id").collect()))
        assert got == [(1, 4), (2, 8), (3, 0)]


def test_session_life(spark):
    s = spark.createDataFrame([("a", "x", ["f"], 5, 10, "strict"), ("b", "y", ["g"], 6, 99, "loose")], "session_id string, token_sha256 string, files array<string>, modified_at int, expires_at int, strictness string")
    now = F.lit(50)
    more = chat.create_session(s, spark.createDataFrame([("c", "secret", "balanced"), ("a", "other", "strict")], "session_id string, token string, strictness string"), now)
    assert sorted((r.session_id, r.expires_at, r.strictness) for r in more.collect()) == [("a", 10, "strict"), ("b", 99, "loose"), ("c", 50 + 86400, "balanced")]
    assert chat.validate(more, spark.createDataFrame([("c", "secret")], "session_id string, token string"), now).head().valid
    live, rest = chat.rehydrate(more, spark.createDataFrame([("a",), ("b",)], "session_id string"), now)
    assert [tuple(r) for r in live.collect()] == [("b", "y", ["g"], 6, 99, "loose")] and {r.session_id for r in rest.collect()} == {"b", "c"}
    assert {r.session_id for r in chat.delete_sessions(more, live).collect()} == {"a", "c"}


def test_containing_terms(spark):
    d = spark.createDataFrame([(1, "information on forms"), (2, ""), (3, None), (4, "café form")], "id long, low string")
    t = spark.createDataFrame([("form",), ("café",), ("on f",), ("zzz",), ("orm",)], "term string")
    got = sorted(map(tuple, lexical.containing(d, t, key="id", low="low", term="term").collect()))
    assert got == sorted((i, w) for i, x in ((1, "information on forms"), (4, "café form")) for w in ("form", "café", "on f", "orm") if w in x)


def test_answer_events(spark):
    from lodestone.plans.answering import answer_events

    long = "The reactor core reached seven hundred degrees on Monday."
    rows = [(1, "What happened?", long, ["Nothing here.", long], ["/i/a.png", "/i/b.png"], None), (2, "Why?", "x", ["x"], None, "NO_CANDIDATES_RETRIEVED"), (3, "And?", long, ["Nothing here."], None, None)]
    best = spark.createDataFrame(rows, "id long, question string, ctx string, contexts array<string>, figs array<string>, reason string")
    got = answer_events(best, query="id", question="question", context="ctx", reason="reason", contexts="contexts", figures="figs").orderBy("id", "position").collect()
    kinds = {k: [(r.type, r.payload) for r in got if r.id == k] for k in (1, 2, 3)}
    assert [t for t, _ in kinds[2]] == ["status", "status", "refusal"]
    assert [t for t, _ in kinds[1]] == ["status", "status", "model_selected", "figure", "figure", *["token"] * 9, "status", "attribution", "done"]
    assert [p for t, p in kinds[1] if t == "figure"] == ["/i/a.png", "/i/b.png"]
    assert [float(p) for k in (1, 3) for t, p in kinds[k] if t == "attribution"] == [1.0, 0.0]
