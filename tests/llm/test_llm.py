"""Training-data operators against brute force, round trips and held-out accuracy, on small tables with awkward rows."""

import hashlib
import json
import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from lodestone.llm import common, exact_dedup, html_extract, jaccard_join, mixing, packing, registry, secrets, token_store, topk_search, toxicity, url_filter
from lodestone.llm.common import WordIds, tokenizer_path

DOCS = T.StructType().add("doc_id", "long").add("text", "string").add("lang", "string").add("source", "string").add("n_chars", "long").add("score", "double").add("row", "string")
WORDS = [f"w{i}" for i in range(400)]


def docs(spark, texts, sources=None, start=0):
    """A documents table with columns whose names operators use themselves."""
    rows = [(start + i, t, None, (sources or ["s"] * len(texts))[i], None, 1.0, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def awkward():
    r = random.Random(5)
    long = " ".join(r.choices(WORDS, k=30000)) + "."
    return [None, "", " \n\t ", "one", "Hello, World! It's 42.", "naïve CAFÉ ﬁne Ünï Straße…", "a\u00a0b\u2028c\u0301 d", long, "One two three four five six. " * 40, "<|endoftext|> x<|startoftext|>y", "Hello, World! It's 42.", "É", "x" * 5000]


# --- 1, 5: token ids ----------------------------------------------------------------------------------------------


def plain_ids(texts):
    t = Tokenizer.from_file(tokenizer_path())
    return [np.array(e.ids, "<u4") for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_word_ids_equal_whole_text_ids():
    r = random.Random(3)
    alphabet = "aAbzéÉßñçÀ0129'’.,;:!?-_… \n\t\u00a0\u0301中👍\u2028<|>"
    texts = [x for x in awkward() if x] + ["".join(r.choices(alphabet, k=r.randint(1, 60))) for _ in range(1500)]
    w = WordIds(tokenizer_path(), most=50, most_known=300)
    ids, ends, _ = w.batch([t.encode() for t in texts])
    for got, want in zip(np.split(ids, ends[:-1]), plain_ids(texts), strict=True):
        assert got.tolist() == want.tolist()


@pytest.mark.parametrize("bits", [64, 3])
def test_word_ids_of_words_that_share_a_hash(bits, monkeypatch):
    """Equal hashes are verified: words that a polynomial hash confuses, and all words under a hash of a few bits."""
    full = common.word_hashes
    monkeypatch.setattr(common, "word_hashes", lambda *a: full(*a) & np.uint64((1 << bits) - 1))
    texts = [thue_morse(n, a, b) for n in (1024, 2048, 4096, 8192) for a, b in ("ab", "ba")] + [x for x in awkward() if x]
    w = WordIds(tokenizer_path())
    for part in (texts[:5], texts[3:], texts):  # later batches meet words that are known already
        ids, ends, _ = w.batch([t.encode() for t in part])
        for got, want in zip(np.split(ids, ends[:-1]), plain_ids(part), strict=True):
            assert got.tolist() == want.tolist()


@pytest.mark.parametrize("texts", [awkward(), []])
def test_token_store_round_trip(spark, tmp_path, texts):
    d = docs(spark, texts)
    path = f"file://{tmp_path}/store"
    token_store.write_store(d, path)
    got = {r.doc_id: r for r in token_store.read_store(spark, path).collect()}
    at = 0
    for i, ids in enumerate(plain_ids(texts)):
        raw = ids.tobytes() + (1).to_bytes(4, "little")
        assert (got[i].start, got[i].n_tokens, bytes(got[i].ids)) == (at, len(raw) // 4, raw)
        at += len(raw) // 4
    assert len(got) == len(texts)
    if texts:
        assert [r.doc_id for r in token_store.read_store(spark, path, [4]).collect()] == [4]


def test_token_store_dictionary_shrinks_short_documents(spark, tmp_path):
    r = random.Random(1)
    texts = [" ".join(r.choices(["alpha", "beta", "gamma", "delta"], k=30)) for _ in range(300)]
    token_store.write_store(docs(spark, texts), f"file://{tmp_path}/store")
    plain = sum(len(zstandard.compress(x.astype("<u2").tobytes())) for x in plain_ids(texts))
    block = spark.read.parquet(f"{tmp_path}/store/blocks").agg(F.sum(F.length("payload"))).head()[0]
    meta = spark.read.parquet(f"{tmp_path}/store/dictionary").head()
    assert meta.dict_sha256 == hashlib.sha256(bytes(meta.dictionary)).hexdigest() and len(meta.dictionary) and block < plain


def cost(window, length):
    return 0 if length & (length - 1) == 0 else window - length


def test_best_cuts_is_optimal():
    r = random.Random(0)
    for _ in range(300):
        window = r.choice([8, 16])
        places = sorted({*r.sample(range(1, 60), r.randint(4, 20)), *range(window, 61, window), 60})
        pen = [r.choice([0, 2, 5]) for _ in places]
        at, best = [0, *places], {0: 0}
        ends = packing.best_cuts(places, pen, window)
        for j, p in enumerate(places):
            best[p] = pen[j] + min(best[q] + cost(window, p - q) for q in at[: j + 1] if p - q <= window)
        got = sum(pen[places.index(b)] + cost(window, b - a) for a, b in zip([0, *ends[:-1]], ends, strict=True))
        assert got == best[60] and all(b - a <= window for a, b in zip([0, *ends[:-1]], ends, strict=True))


@pytest.mark.parametrize("stretch", [2_000_000, 6000])
def test_packing_keeps_every_id_once(spark, stretch, monkeypatch):
    texts = awkward() + ["Some sentence here. " * 900]
    monkeypatch.setattr(packing, "STRETCH", stretch)
    rows = packing.pack(docs(spark, texts).coalesce(1)).collect()
    want = {i: np.append(x, np.uint32(2)).astype("<u4").tobytes() for i, x in enumerate(plain_ids(texts))}
    have, seqs = {}, {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == len(have.get(r.doc_id, b"")) // 4 and r.length == len(r.ids) // 4 > 0
        have[r.doc_id] = have.get(r.doc_id, b"") + bytes(r.ids)
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert have == want and all(r.doc_tokens == len(want[r.doc_id]) // 4 for r in rows)
    for s in seqs.values():
        s.sort()
        assert [o for o, _ in s] == [sum(n for _, n in s[:k]) for k in range(len(s))] and sum(n for _, n in s) <= 4096
    assert packing.pack(docs(spark, [])).count() == 0


# --- 2: HTML ------------------------------------------------------------------------------------------------------

PAGE = '<html><head><title>T</title><script>"<p>no</p>"</script></head><body><nav><ul><li><a href="/">Home</a></li><li><a href="/b">News</a></li></ul></nav><div class="ad">Buy now.</div><article><h1>Big &amp; small</h1><p><b>First  line<br>goes on here.<p>Second &eacute;&#233; part with <i>more</i> text, and more of it.</article><div id="comments"><h3>Comments</h3><p>I agree with this.</p></div><form><input><button>Go</button></form><footer>&copy; x</footer>'


def test_html_extract(spark):
    rows = [(1, PAGE), (2, None), (3, ""), (4, "<p>" * 3000 + "deep"), (5, "<script>x"), (6, "a < b & c"), (1, PAGE), (7, "<div class='<p>" * 50)]
    d = spark.createDataFrame(rows, "page_id long, html string").withColumn("text", F.lit(1))
    got = [(r.page_id, r.main_text) for r in html_extract.extract(d).collect()]
    assert [t for i, t in got if i == 1] == ["Big & small First line goes on here. Second éé part with more text, and more of it."] * 2
    assert dict(got)[2] == "" == dict(got)[3] == dict(got)[5]
    assert html_extract.extract(d.limit(0)).count() == 0


def test_html_held_out_pages():
    seeds = range(900_000, 900_120)
    pages = [html_extract.generated(s) for s in seeds]
    got = html_extract.main_text([p for p, _ in pages])
    assert np.mean([g == " ".join(" ".join(k.split()) for k in kept) for g, (_, kept) in zip(got, pages, strict=True)]) > 0.85


def test_html_decoding_is_consistent():
    source, _ = html_extract.generated(4242)
    nodes = html_extract.parse(source)
    r = np.random.default_rng(0)
    for _ in range(20):
        keep = html_extract.decode(nodes, r.normal(size=len(nodes)))
        assert all(not k or n.parent < 0 or keep[n.parent] for k, n in zip(keep, nodes, strict=True))


# --- 3: exact dedup -----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("bits", [64, 3])
def test_exact_dedup(spark, bits):
    base = awkward()
    texts = base + [base[7], base[7][:-1] + "!", "One", "one", None]
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(docs(spark, texts), id_bits=bits).collect()}
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(t or "", []).append(i)
    assert len(got) == len(texts)
    for t, ids in groups.items():
        for i in ids:
            assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (max(ids), len(ids), i == max(ids), hashlib.sha256(t.encode()).hexdigest())
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0


# --- 4: toxicity --------------------------------------------------------------------------------------------------


def toxic_table(spark, n=900):
    r = random.Random(2)
    texts, labels = [], []
    for i in range(n):
        w = r.choices(WORDS, k=r.randint(5, 60))
        if i % 5 == 0:
            for _ in range(r.randint(1, 3)):
                w[r.randrange(len(w))] = r.choice(["idiot", "m0ron", "you", "zork" + r.choice("abcdefgh"), "S.T.U.P.I.D"]) if r.random() < 0.5 else "zorkling"
        texts.append(" ".join(w))
        labels.append((i, None, int(i % 5 == 0)))
    return docs(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_held_out(spark):
    d, labels = toxic_table(spark)
    got = {r.doc_id: r for r in toxicity.score(d, toxicity.train(d, labels)).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(got[i].tox_score >= 0.5) == (i % 5 == 0) for i in held]) > 0.95
    assert all(0 <= r.tox_score <= 1 and r.tox_predicted == int(r.tox_score >= 0.7) for r in got.values())


def test_toxicity_never_learns_from_held_out_labels(spark):
    d, labels = toxic_table(spark, 300)
    flipped = labels.withColumn("toxic", F.when(toxicity._part() == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ([round(r.tox_score, 9) for r in toxicity.score(d, toxicity.train(d, x)).orderBy("doc_id").collect()] for x in (labels, flipped))
    assert a == b


def test_toxicity_awkward(spark):
    d = docs(spark, awkward() + ["you idiot"])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.score(d, toxicity.train(d, none)).orderBy("doc_id").collect()
    assert got[-1].tox_predicted == 1 and got[0].tox_predicted == 0 and got[0].row == "x"
    assert toxicity.score(docs(spark, []), toxicity.Model()).count() == 0


# --- 6: URLs ------------------------------------------------------------------------------------------------------


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://ORG/a", "http://org", "https://Blog.Example.ORG/es/1?x", "http://example.org/es", "http://example.org/en/12#a", "http://notexample.org/es/1", "http://a.com/fr/?q", "http://a.com/de/", "http://xorg/", "ftp://h/p://q"]
    got = url_filter.judge(spark.createDataFrame([(i, u, "v") for i, u in enumerate(urls)], "page_id int, url string, verdict2 string")).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule) for r in got] == [
        ("", "", None), ("", "", None), ("", "", None), ("org", "/a", "org/"), ("org", "", None), ("blog.example.org", "/es/1", "example.org/es/"), ("example.org", "/es", "org/"),
        ("example.org", "/en/12", "example.org/en/1"), ("notexample.org", "/es/1", "org/"), ("a.com", "/fr/", "com/fr/"), ("a.com", "/de/", "com/de/"), ("xorg", "/", None), ("h", "/p://q", None),
    ]
    assert [r.verdict for r in got if r.rule] == ["allow", "block", "allow", "block", "allow", "allow", "block"]


def test_url_model():
    w, b = url_filter.model()
    p = lambda h: 1 / (1 + np.exp(-(w[g := url_filter.grams(h, "/en/7")].sum() / np.sqrt(len(g)) + b)))
    assert min(p("www.spam-casino.example.com"), p("pills.example.net")) > 0.5 > max(p("library.example.com"), p("therstone.example.net"))


# --- 7: Jaccard ---------------------------------------------------------------------------------------------------


def brute_classes(texts, percent=75):
    sets = []
    for t in texts:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def near_texts():
    r = random.Random(9)
    texts = awkward() + ["A b c d", "a B C d", "a b c e", "x", "X"]
    passage = " ".join(r.choices(WORDS, k=60))
    for n in (8, 30, 120):
        base = r.choices(WORDS, k=n)
        for edits in (0, 0, 1, 1, 2, 3, 5, 8, 12):
            w = list(base)
            for _ in range(edits):
                w[r.randrange(n)] = r.choice(WORDS)
            texts.append(" ".join(w))
    texts += [passage + " " + " ".join(r.choices(WORDS, k=r.choice([3, 5, 8, 20, 80]))) for _ in range(40)]
    hub = r.choices(WORDS, k=60)
    for _ in range(90):
        w = list(hub)
        w[r.randrange(60)] = r.choice(WORDS)
        texts.append(" ".join(w))
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize("limits", [{}, {"GROUP": 4, "QUERIES_PER_TASK_GROUP": 3, "CHUNK_TOKENS": 500, "BROADCAST_PAIRS": 0}, {"GROUP": 9, "GROUP_TOKENS": 100, "CELL": 2, "PARTS": 3, "FAMILY": 75}])
def test_jaccard_classes(spark, limits, monkeypatch):
    for k, v in limits.items():
        monkeypatch.setattr(jaccard_join, k, v)
    texts = near_texts()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_classes(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_classes(texts)


def test_jaccard_empty(spark):
    assert jaccard_join.jaccard_classes(docs(spark, [])).count() == 0
    assert [tuple(r) for r in jaccard_join.jaccard_classes(docs(spark, [None, "", " "])).orderBy("doc_id").collect()] == [(0, 0, 0), (1, 0, 1), (2, 0, 2)]


def thue_morse(n, a, b):
    return "".join(b if i.bit_count() & 1 else a for i in range(n))


def test_jaccard_awkward_rows(spark):
    """Null and repeated doc_ids, repeated rows, and long words that polynomial hashes confuse."""
    same = "one two three four five six"
    rows = [(None, same), (7, same), (7, same), (7, "other text of the same id here"), (None, None), (None, "alone without an id at all"), (3, thue_morse(4096, "a", "b")), (4, thue_morse(4096, "b", "a"))]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("mine"))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_classes(d).collect()), key=str)
    assert got == sorted([(None, 2, 7), (7, 2, 7), (7, 2, 7), (7, 3, 7), (None, 0, None), (None, 2, None), (3, 1, 3), (4, 1, 4)], key=str)


def test_components_of_a_path(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "u long, v long")
    got = {r.node: r.comp for r in jaccard_join.components(e).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


# --- 8: secrets ---------------------------------------------------------------------------------------------------


def test_secrets(spark):
    r = random.Random(4)
    key = "".join(r.choices("ABCDEFGHJKMNPQRSTUVWXYZabcdefghjkmnpqrstuvwxyz23456789", k=40))
    texts = [
        None, "", "é PASSWORD = 'abcdef123456' token: short passwd=x", "AKIAABCDEFGHIJKLMN0 AKIASHORT", "see 0123456789abcdef and 0123456789abcde",
        f"key {key} end", "mail aaaa1111bbbb2222cccc@x.example https://example.com/a1b2c3d4e5f6a7b8", "id 123e4567-e89b-12d3-a456-426614174000 " + "D41D8CD98F00B204E9800998ECF8427E", "secret=token=abcdefghijklmnop",
    ]
    got = {r_.doc_id: r_ for r_ in secrets.scan(docs(spark, texts)).collect()}
    assert [(got[i].n_assign, got[i].n_access, got[i].n_hex) for i in range(9)] == [(0, 0, 0)] * 2 + [(1, 0, 0), (0, 1, 0), (0, 0, 1), (0, 0, 0), (0, 0, 2), (0, 0, 0), (1, 0, 0)]
    assert got[2].spans == "assign:2:26" and got[2].base_sha256 == hashlib.sha256(b"assign:2:26").hexdigest() and got[0].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[5].spans == "random:4:44" and got[7].spans == "" and "random" not in got[6].spans
    assert got[8].spans == "assign:0:29"


def test_secrets_leave_prose_alone(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    assert secrets.scan(d).where("spans like '%random%'").count() <= 2


def brute_secrets(text):
    """The base patterns of the contract by one scan each, and the token test spelt out."""
    import re

    out = []
    for kind, pattern, ok in (
        ("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 12),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
        ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 16),
    ):
        at = 0
        while m := re.compile(pattern, re.ASCII).search(text, at):
            at = m.end()
            if ok(m):
                out.append((m.start(), ("assign", "access", "hex").index(kind), kind, m.end()))
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(out)]


def test_secrets_against_brute_force(spark, sf):
    r = random.Random(8)
    bits = ["token", "SECRET", "api_key", "apikey", "passwd", "=", ":", " ", "'", '"', "AKIA", "ABCDEFGH012345", "deadbeefdeadbeef", "abc", "xY9+/", "é", "0123456789abcdef0"]
    texts = ["".join(r.choices(bits, k=r.randint(1, 12))) for _ in range(1500)] + [None, "", "token=" + "x" * 100_000, "AKIA" * 20_000]
    d = docs(spark, texts).select("doc_id", "text").unionByName(spark.read.parquet(f"{sf}/documents.parquet").select((F.col("doc_id") + 10_000).alias("doc_id"), "text"))
    d = d.unionByName(d.limit(1).select(F.lit(None).cast("long").alias("doc_id"), F.lit("secret: abcdefghijklmnop").alias("text")))
    want, got = {x.doc_id: brute_secrets(x.text or "") for x in d.collect()}, secrets.scan(d).collect()
    assert len(got) == len(want) and any(x.doc_id is None for x in got)
    for x in got:
        base = want[x.doc_id]
        assert x.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [sum(s.startswith(k) for s in base) for k in ("assign", "access", "hex")] == [x.n_assign, x.n_access, x.n_hex]
        assert [s for s in x.spans.split(",") if s and not s.startswith("random")] == base
    assert secrets.scan(docs(spark, [])).count() == 0


# --- 9: mixing ----------------------------------------------------------------------------------------------------


def brute_targets(sizes, weights=mixing.WEIGHTS, most=mixing.MOST):
    """The target rule, round by round."""
    w = [weights[k % len(weights)] for k in range(len(sizes))]
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while free:
        share = left / sum(w[k] for k in free)
        over = [k for k in sorted(free) if share * w[k] > most * sizes[k]]
        for k in over or free:
            out[k] = float(most * sizes[k]) if over else share * w[k]
            left -= out[k]
        free = free - set(over) if over else set()
    return out


@pytest.mark.parametrize("sizes", [[100, 100, 100], [10, 1000, 0, 50], [0, 0], [1, 1, 10_000, 3, 5, 900, 40, 2], [5], []])
def test_targets(spark, sizes):
    words = spark.createDataFrame([(f"0{k:03}", n) for k, n in enumerate(sizes)], "skey string, words long").repartition(3)
    got = [(r.skey, r.place, r.target) for r in mixing.targets(mixing._in_order(words)).orderBy("skey").collect()]
    assert [(k, p) for k, p, _ in got] == [(f"0{k:03}", k) for k in range(len(sizes))]
    assert [t for _, _, t in got] == pytest.approx(brute_targets(sizes))
    assert sum(t for _, _, t in got) <= sum(sizes) + 1e-6 and all(t <= 3 * n + 1e-9 for (_, _, t), n in zip(got, sizes, strict=True))


def test_hypergeometric_of_large_and_small_numbers(monkeypatch):
    rng = np.random.default_rng(1)
    good, bad, draw = 7 * 10**9, 3 * 10**9, 10**6
    got = np.array([mixing.hypergeometric(rng, good, bad, draw) for _ in range(4000)], float)
    assert abs(got.mean() - 0.7 * draw) < 40 and abs(got.std() / (draw * 0.21 * (1 - draw / (good + bad))) ** 0.5 - 1) < 0.05
    monkeypatch.setattr(mixing, "MOST_ITEMS", 0)  # the same code on a case whose chances can be counted
    got = Counter(mixing.hypergeometric(rng, 6, 9, 5) for _ in range(20000))
    for k in range(6):
        assert abs(got[k] / 20000 - math.comb(6, k) * math.comb(9, 5 - k) / math.comb(15, 5)) < 0.015
    q = mixing.split_quotas([7, 0, 100, 3], 8)
    assert q.sum(0).tolist() == [7, 0, 100, 3] and q.min() >= 0


def test_split_quotas_by_given_sums():
    sums = [10, 0, 25, 5]
    q = mixing.split_quotas([30, 9, 0, 1], 4, sums=sums)
    assert q.sum(1).tolist() == sums and q.sum(0).tolist() == [30, 9, 0, 1]


def test_split_quotas():
    q = mixing.split_quotas([7, 0, 100, 3], 8)
    assert q.sum(0).tolist() == [7, 0, 100, 3] and q.min() >= 0 and q.sum(1).max() - q.sum(1).min() <= 8
    assert (q == mixing.split_quotas([7, 0, 100, 3], 8)).all()


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000])
def test_rank_is_a_permutation(n):
    assert sorted(mixing.rank_of(np.arange(n), n, 77).tolist()) == list(range(n))


def mixing_docs(spark):
    r = random.Random(6)
    texts = [None, "", " "] + [" ".join(r.choices(WORDS, k=r.choice([1, 5, 50, 400]))) for _ in range(200)]
    sources = [r.choice(["a", "b", "", "z", None, "a", "a"]) for _ in texts]
    return texts, sources, docs(spark, texts, sources)


@pytest.mark.parametrize("bucket", [mixing.BUCKET, 2])
def test_mixing_against_brute_force(spark, bucket, monkeypatch):
    """Blocks in permuted order, one source and epoch after the other, until the target's words are taken; shards by the tree's quotas."""
    monkeypatch.setattr(mixing, "BUCKET", bucket)
    _, _, d = mixing_docs(spark)
    placed, taken = mixing.draws(d, shards=5, block_words=64)
    rows, by_source, want, shards = placed.collect(), {}, Counter(), Counter()
    plans = {r.skey: r for r in mixing.plan_sources(placed.groupBy("skey").agg(F.sum("size").alias("words")), shards=5, block_words=64).collect()}
    for r in rows:
        by_source.setdefault(r.skey, []).append(r)
    for skey, own in by_source.items():
        stream = [None] * own[0].source_size
        for r in own:
            for k in range(r["size"]):
                assert stream[r.start + k] is None
                stream[r.start + k] = r.row
        p, left, number = plans[skey], min(round(own[0].target), 3 * len(stream)), 0
        for e in range(4):
            blocks = sorted(range(p.n), key=lambda b: int(mixing.rank_of(np.array([b]), p.n, p.key + e)[0]))
            for b in blocks:
                words = stream[64 * b : 64 * b + min(64, left)]
                if not left:
                    break
                left -= len(words)
                want.update(words)
                shards.update({(r, next(s for s, n in enumerate(p.upto) if number < n)): c for r, c in Counter(words).items()})
                number += 1
        assert not left and p.upto[-1] == number
    got, got_shards = Counter(), Counter()
    for r in taken.collect():
        got[r.row] += r.word_to - r.word_from
        got_shards[r.row, r.shard] += r.word_to - r.word_from
    assert got == want and got_shards == shards


def test_the_tree_decides_what_is_drawn(spark, monkeypatch):
    _, _, d = mixing_docs(spark)
    plan = lambda seed: sorted(map(tuple, mixing.draws(d, block_words=64)[1].select("row", "epoch", "shard", "word_from").collect()))
    before = plan(0)
    real = mixing.split_quotas
    monkeypatch.setattr(mixing, "split_quotas", lambda q, n, seed=1, sums=None: real(q, n, seed + 1, sums))
    assert plan(0) != before
    monkeypatch.setattr(mixing, "split_quotas", lambda q, n, *a: np.zeros((n, len(q)), "i8"))
    assert plan(0) == []


def test_mixing_draws(spark):
    texts, sources, d = mixing_docs(spark)
    placed, taken = mixing.draws(d, shards=5, block_words=64)
    size = {r.row: r for r in placed.collect()}
    assert len(size) == len(texts) and all(r["size"] == len((texts[r.doc_id] or "").split()) for r in size.values())
    words, spans, by_shard = Counter(), set(), Counter()
    for r in taken.collect():
        assert 0 <= r.word_from < r.word_to <= size[r.row]["size"] and 0 <= r.shard < 5
        assert (r.row, r.epoch, r.word_from) not in spans
        spans.add((r.row, r.epoch, r.word_from))
        words[r.row] += r.word_to - r.word_from
        by_shard[r.shard] += 1
    per = Counter()
    for k, r in size.items():
        assert words[k] <= 3 * r["size"]
        per[r.skey] += words[k]
    for r in size.values():
        assert abs(per[r.skey] - r.target) <= 1
    again = mixing.draws(d, shards=5, block_words=64)[1]
    assert sorted(map(tuple, again.drop("row").collect())) == sorted(map(tuple, taken.drop("row").collect())) and len(by_shard) == 5


def test_mixed_documents(spark):
    texts, _, d = mixing_docs(spark)
    d = d.select("doc_id", "text", "lang", "source", "n_chars")
    got = mixing.mixed(d, block_words=64).collect()
    assert {r.doc_id for r in got} and all(set(r.text.split()) <= set(texts[r.doc_id].split()) and r.n_chars == len(r.text) for r in got)
    whole, _ = mixing.draws(d, block_words=64)
    assert abs(sum(len(r.text.split()) for r in got) - whole.agg(F.sum("size")).head()[0]) <= 5
    assert mixing.mixed(d.limit(0)).count() == 0


# --- 10: top-k ----------------------------------------------------------------------------------------------------


def test_topk(spark):
    r = np.random.default_rng(1)
    vecs = [r.normal(size=8).tolist() for _ in range(150)] + [[0.5] * 8] * 60 + [None, [float("nan")] * 8, [None] * 8, [float("inf")] + [0.0] * 7, [], [1.0, 2.0]]
    d = spark.createDataFrame([(i, v, 1) for i, v in enumerate(vecs)], "vec_id long, embedding array<float>, rank int").repartition(4)
    got = {}
    for x in topk_search.top_k(d, F.col("vec_id") % 10 == 0, 7, tile=5).collect():
        got.setdefault(x.query_id, {})[x["rank"]] = (x.vec_id, x.score)
    ok = {i: np.floor(64 * np.float32(v).astype(float)).astype(int) for i, v in enumerate(vecs) if v and None not in v and np.isfinite(np.array(v, float)).all()}
    for q in [i for i in ok if i % 10 == 0]:
        want = sorted(((int(ok[q] @ v), i) for i, v in ok.items() if i != q and len(v) == len(ok[q])), key=lambda x: (-x[0], x[1]))[:7]
        assert [got.get(q, {})[k + 1] for k in range(len(want))] == [(i, s) for s, i in want]
    assert topk_search.top_k(d.limit(0), F.col("vec_id") % 10 == 0).count() == 0


# --- Registered queries -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracles(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.sql(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    a, b = registry.QUERIES[name](spark, sf).toPandas(), con.sql(registry.ORACLES[name]).df()
    key = sorted(a.columns)
    assert sorted(map(str, a[key].values.tolist())) == sorted(map(str, b[key].values.tolist()))


def test_every_operator_has_a_query():
    assert {int(n[2:].split("_")[0]) for n in registry.QUERIES} == set(range(1, 11))


def test_pipeline(spark, sf):
    import corpus_pipeline as c

    assert [n for n, _ in c.STAGES] == ["toxicity", "exact_dedup", "jaccard_join", "mixing", "packing"]
    d = spark.read.parquet(f"{sf}/documents.parquet")
    kept = c.drop_equal(spark, d, sf)
    last = {}
    for r in d.collect():
        last[r.text] = max(r.doc_id, last.get(r.text, -1))
    assert {r.doc_id for r in kept.collect()} == set(last.values()) and kept.columns == d.columns
    texts = [r.text for r in d.orderBy("doc_id").collect()]
    near = c.drop_near(spark, d, sf)
    assert {r.doc_id for r in near.collect()} == {root for _, root in brute_classes(texts)}
    out = c.run(spark, sf)
    assert json.loads(json.dumps(out.columns)) == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 0


# --- brute force for the fitted operators, and awkward tables ---------------------------------------------------------


def test_isotonic_pools_equal_scores():
    from lodestone.llm.boosting import Isotonic

    assert Isotonic().fit(np.full(10, 0.5), np.eye(10)[3])(np.array([0.5])).tolist() == [0.1]
    for y in ([0, 1, 0, 1], [1, 1, 0, 0], [0, 0, 1, 1]):
        assert Isotonic().fit(np.full(4, 0.3), np.array(y))(np.array([0.3])).tolist() == [0.5]
    r = np.random.default_rng(2)
    score, y = r.integers(0, 8, 60) / 8, r.integers(0, 2, 60)
    order, values = r.permutation(60), np.unique(score)
    fit = Isotonic().fit(score, y)(values)
    assert np.allclose(fit, Isotonic().fit(score[order], y[order])(values)) and (np.diff(fit) >= -1e-12).all()
    # least squares among non-decreasing step functions, by the min-max formula
    total = lambda a, b: y[(score >= values[a]) & (score <= values[b])]
    want = [max(min(total(i, j).mean() for j in range(k, len(values))) for i in range(k + 1)) for k in range(len(values))]
    pools = Isotonic().fit(score, y)
    assert set(np.round(pools.y, 9)) == set(np.round(want, 9))


def test_toxicity_against_one_text_at_a_time(spark, sf):
    """The query's scores are those of the model on each text alone; equal texts get equal scores; held-out rows teach nothing."""
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(d, labels)
    got = {r.doc_id: r for r in registry.QUERIES["op4_toxicity"](spark, sf).collect()}
    for r in d.collect():
        want = float(model.score([r.text or ""])[0])
        assert got[r.doc_id].score == pytest.approx(want, abs=1e-12) and got[r.doc_id].predicted == int(want >= 0.7)
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    other = toxicity.train(d, labels.withColumn("toxic", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, 1 - F.col("toxic")).otherwise(F.col("toxic"))))
    texts = [r.text or "" for r in d.limit(40).collect()] + [""]
    assert other.score(texts).tolist() == model.score(texts).tolist()
    clash = d.limit(5).withColumns({"tox_score": F.lit("mine"), "row": F.lit(1)})
    assert dict(toxicity.score(clash, model).dtypes)["tox_score"] == "double" and toxicity.score(d.limit(0), model).count() == 0


def test_url_filter_against_brute_force(spark, sf):
    """Rules and model, one url at a time."""
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
    weights, bias = url_filter.model()
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.ORG/es/x?y#z", "x://org?/", "http://a.com/fr/" + "p" * 50_000, "a://b://c.com/de/", "http://example.org/en/1", "http://notexample.org/en/1", "http://com/de", "http://com/de/"]
    rows = [(i, u, "mine") for i, u in enumerate(urls)] + [(1000 + r.page_id, r.url, "mine") for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    d = spark.createDataFrame(rows + rows[:3], "page_id long, url string, host string")
    got = url_filter.judge(d).collect()
    assert len(got) == len(rows) + 3 and url_filter.judge(d.limit(0)).count() == 0
    for r in got:
        rest = (r.url or "").partition("://")[2]
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:].split("?")[0].split("#")[0]
        fits = [x for x in rules if (host == x[0] or host.endswith("." + x[0])) and path.startswith(x[1])]
        best = max(fits, key=lambda x: len(x[0] + x[1]), default=None)
        p = None
        if not best:
            seen = {zlib.crc32(f"{m}{s[i : i + n]}".encode()) % url_filter.SLOTS for m, s in (("h", f"<{host}>"), ("p", f"<{path.lower()}>")) for n in (3, 4, 5) for i in range(len(s) - n + 1)}
            p = 1 / (1 + math.exp(-(sum(float(weights[g]) for g in seen) / math.sqrt(max(len(seen), 1)) + float(bias))))
        verdict = best[2] if best else "block" if p >= 0.5 else "allow"
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, best and best[0] + best[1], verdict)
        assert r.blocked_probability == (p if p is None else pytest.approx(p, abs=1e-5))


def test_html_decoding_against_enumeration():
    """Of all labellings in which a kept node's parent is kept, the decoded one has the largest sum of log-odds."""
    import itertools

    r = random.Random(3)
    for _ in range(60):
        source = "".join(r.choice(("<div>", "<p>", "</p>", "</div>", "a ", "b. ", "<ul><li>x</li></ul>")) for _ in range(r.randint(1, 9)))
        nodes = html_extract.parse(source)
        if len(nodes) > 11:
            continue
        margin = [r.gauss(0, 1) for _ in nodes]
        keep = html_extract.decode(nodes, margin)
        best = -math.inf
        for bits in itertools.product((False, True), repeat=len(nodes) - 1):
            y = [nodes[0].chars > 0, *bits]
            if all(not y[k] or y[n.parent] and n.chars for k, n in enumerate(nodes) if k):
                best = max(best, sum(m for m, b in zip(margin[1:], y[1:], strict=True) if b))
        assert sum(m for m, b in zip(margin[1:], keep[1:], strict=True) if b) == pytest.approx(best)


def test_html_awkward_pages(spark):
    deep, wide = "<div>" * 3000 + "deep text here." + "</div>" * 3000, "<body><article>" + "<p>word one.</p>" * 3000
    d = spark.createDataFrame([(1, None, "x"), (1, "", "x"), (2, deep, "x"), (3, wide, "x"), (3, wide, "x")], "page_id long, html string, main_text string")
    got = html_extract.extract(d).collect()
    assert len(got) == 5 and [r.main_text for r in got if r.page_id == 1] == ["", ""]
    assert len({r.main_text for r in got if r.page_id == 3}) == 1 and html_extract.extract(d.limit(0)).count() == 0


def test_topk_large_components_and_repeated_ids(spark):
    r = random.Random(5)
    rows = [(i, [r.choice((-1, 1)) * r.choice((0.4, 3.7, 1e9, 2.5e16, 1e300)) for _ in range(4)]) for i in range(40)]
    rows += [(20, [1.0, 2.0, 3.0, 4.0]), (7, rows[7][1]), (None, [1.0] * 4), (5, None), (6, [float("nan")] * 4)]
    got = [tuple(x) for x in topk_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(1)), F.col("vec_id") % 20 == 0, 5, tile=1).collect()]
    whole = [(i, [math.floor(64 * x) if abs(64 * x) < 2**53 else int(64 * x) for x in v]) for i, v in rows if i is not None and v and not any(map(math.isnan, v))]
    want = []
    for q in (0, 20):
        v = min(v for i, v in whole if i == q)
        s = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in whole if i != q)
        want += [(q, k + 1, i, max(-(2**63), min(2**63 - 1, -x))) for k, (x, i) in enumerate(s[:5])]
    assert sorted(got) == want


@pytest.mark.parametrize("sign", [1, -1])
def test_topk_scores_near_the_ends_of_a_long(spark, sign):
    """Exact scores from 2^60 to 2^66 either way, ranked apart though several show the same long."""
    sizes = [2.0**k for k in (54, 55, 56, 57, 57, 58, 59, 60)]
    rows = [(0, [sign * 2.0**-6, 0.0])] + [(k + 1, [x, 0.0]) for k, x in enumerate(sizes)]
    got = topk_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, 8).orderBy("rank").collect()
    exact = sorted((-sign * 64 * int(x), k + 1) for k, x in enumerate(sizes))
    assert [(r.vec_id, r.score) for r in got] == [(k, max(-(2**63), min(2**63 - 1, -x))) for x, k in exact]


def test_null_ids_are_kept(spark):
    d = spark.createDataFrame([(None, "some text here."), (3, None), (None, None), (3, "some text here."), (3, "some text here.")], "doc_id long, text string").withColumns({"source": F.lit("s"), "skey": F.lit(1), "size": F.lit("x")})
    n = len(plain_ids(["some text here."])[0]) + 1
    lengths = Counter()
    for r in packing.pack(d).collect():
        lengths[r.doc_id, r.doc_tokens] += r.length
    assert lengths == {(None, n): n, (3, 1): 1, (None, 1): 1, (3, n): 2 * n}
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(d).collect()}
    assert got == {(None, 3, 3, False), (3, 3, 2, True), (None, 3, 2, False), (3, 3, 3, True)}
    placed, _ = mixing.draws(d)
    assert sorted((r.doc_id is None, r["size"]) for r in placed.collect()) == [(False, 0), (False, 3), (False, 3), (True, 0), (True, 3)]
    assert mixing.mixed(d).columns == d.columns


def test_token_store_puts_null_ids_last(spark, tmp_path):
    d = spark.createDataFrame([(None, "b b"), (9, "a"), (-4, None), (None, "c")], "doc_id long, text string")
    path = f"file://{tmp_path}/store"
    token_store.write_store(d, path)
    got = sorted(token_store.read_store(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [-4, 9, None, None] and [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    assert [r.doc_id for r in token_store.read_store(spark, path, [9, 0]).collect()] == [9]


def test_pipeline_drops_rows_not_ids(spark, sf):
    import corpus_pipeline as c

    long = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()
    near, nearer = " ".join(long), " ".join(long + ["more"])
    rows = [(5, "A"), (9, "A"), (5, "B unique"), (None, "A"), (7, "C"), (7, "C"), (None, "D"), (None, "D"), (None, None), (None, ""), (5, near), (7, nearer), (None, near + " extra"), (8, near)]
    d = spark.createDataFrame([(i, t, None, None, None, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, _row string").repartition(4)
    equal = common.materialise(c.drop_equal(spark, d, sf))
    want = [(9, "A"), (5, "B unique"), (7, "C"), (None, "D"), (None, ""), (8, near), (7, nearer), (None, near + " extra")]
    key = lambda x: (str(x[0]), x[1] or "")
    assert sorted(((r.doc_id, r.text or "") for r in equal.collect()), key=key) == sorted(want, key=key)
    kept = c.drop_near(spark, equal, sf)
    assert kept.columns == list(c.COLUMNS)
    want = [x for x in want if x[1] not in (near, near + " extra")]
    assert sorted(((r.doc_id, r.text or "") for r in kept.collect()), key=key) == sorted(want, key=key)
    assert [stage(spark, d.limit(0), sf).count() for _, stage in c.STAGES] == [0] * 5


def test_toxicity_learns_a_repeated_id_once(spark, sf):
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    again = d.unionByName(d).unionByName(d)
    assert toxicity.train(again, labels).odds == toxicity.train(d, labels).odds


def test_pipeline_against_stages_by_brute_force(spark, sf):
    """Every stage on what its predecessor kept: scores one by one, equal texts, classes by all pairs, words of the mix, packed ids."""
    import corpus_pipeline as c

    columns = list(c.COLUMNS)
    d = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.train(d, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = [r for r in d.select(*columns).collect() if model.score([r.text or ""])[0] < 0.7]
    last = {r.text or "": max(x.doc_id for x in rows if (x.text or "") == (r.text or "")) for r in rows}
    rows = sorted((r for r in rows if last[r.text or ""] == r.doc_id), key=lambda r: r.doc_id)
    rows = [r for r, (_, root) in zip(rows, brute_classes([r.text for r in rows]), strict=True) if rows[root].doc_id == r.doc_id]
    got = d
    for _, stage in c.STAGES[:3]:
        got = common.materialise(stage(spark, got, sf))
        assert got.columns == columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows))
    mix = common.materialise(c.mix(spark, got, sf))
    size, taken = {r.doc_id: len((r.text or "").split()) for r in rows}, Counter()
    for r in mix.collect():
        own = next(x for x in rows if x.doc_id == r.doc_id)
        assert r.text in own.text or all(w in own.text.split() for w in r.text.split())
        taken[r.doc_id] += len(r.text.split())
    sources = sorted({r.source for r in rows}, key=lambda s: (s is None, s))
    sums = [sum(size[r.doc_id] for r in rows if r.source == s) for s in sources]
    for s, t in zip(sources, brute_targets(sums), strict=True):
        assert abs(sum(taken[r.doc_id] for r in rows if r.source == s) - t) <= 1
    packed = c.pack(spark, mix, sf).collect()
    ids = Counter()
    for x in plain_ids([r.text for r in mix.collect()]):
        ids[len(x) + 1] += 1
    whole = Counter()
    for r in packed:
        whole[r.doc_tokens] += r.length
    assert whole == {n: n * k for n, k in ids.items()}
    assert max(r.offset + r.length for r in packed) <= packing.WINDOW
