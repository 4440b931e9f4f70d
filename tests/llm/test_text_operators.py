"""Fill-in-middle, token counts and the source audit against brute force, with awkward rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from tests.llm.test_llm import awkward, docs
from tokenizers import Regex, Tokenizer, pre_tokenizers

from lodestone.llm import fill_middle, source_audit, token_counts
from lodestone.llm.common import tokenizer_path

# --- 11: fill in middle -------------------------------------------------------------------------------------------


def fim(doc_id, text):
    """The contract, word by word: (n, form, prefix_chars, middle_chars, output)."""
    text = text or ""
    units = re.findall(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+", text)
    n, digest = len(units), hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark):
    r = random.Random(7)
    parts = ["a", "é", "😀", "中", " ", "\n", "\t", " ", "\x1c", "<P", "<S", "<", ">", "P>", "S>", "M>", "b́"]
    texts = awkward() + [" " * 300 + "x", "x" + "\n" * 300, "a <P> b", "<M>", "x<S>"] + ["".join(r.choices(parts, k=r.randint(1, 40))) for _ in range(400)]
    out = fill_middle.fill_in_middle(docs(spark, texts))
    rows = out.withColumn("back", fill_middle.restored(out.output, out.form)).collect()
    assert len(rows) == len(texts) and {x.form for x in rows} == {"plain", "psm", "spm"}
    for x in rows:
        assert (x.n, x.form, x.prefix_chars, x.middle_chars, x.output) == fim(x.doc_id, texts[x.doc_id])
        assert x.back == (texts[x.doc_id] or "")


def test_fill_in_middle_of_odd_tables(spark):
    d = docs(spark, ["one two three"] * 2).selectExpr("cast(null as long) doc_id", "text", "1 as n", "'x' as form", "'y' as output", "2 as cut")
    assert [(x.n, x.form, x.prefix_chars, x.middle_chars, x.output) for x in fill_middle.fill_in_middle(d).collect()] == [fim(None, "one two three")] * 2
    assert fill_middle.fill_in_middle(docs(spark, [])).collect() == []


def test_units_of_stretches_are_those_of_the_text():
    split = pre_tokenizers.Split(Regex(fill_middle.UNIT), "isolated")
    r = random.Random(3)
    for _ in range(300):
        text = "".join(r.choices("aé😀 \n\t", weights=[3, 2, 1, 3, 1, 1], k=r.randint(0, 60)))
        want = [e for _, (_, e) in split.pre_tokenize_str(text)]
        assert [fill_middle.unit_ends(text, split, k).tolist() for k in (1, 2, 7, 1000)] == [want] * 4


# --- 12: token counts ---------------------------------------------------------------------------------------------


def test_token_counts(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "TERMS", 50)  # most pre-tokens are misses
    r = random.Random(9)
    alphabet = [chr(k) for k in range(0x260)] + list("'stremvlld  \n\t aB1") * 15 + ["<|endoftext|>", "　", " ", "中", "😀", "́"]
    texts = awkward() + ["".join(r.choices(alphabet, k=r.randint(1, 40))) for _ in range(2000)]
    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    rows = token_counts.count_tokens(docs(spark, texts), limit=100).collect()
    assert len(rows) == len(texts)
    for x in rows:
        text = texts[x.doc_id] or ""
        n = len(t.encode(text, add_special_tokens=False).ids)
        assert (x.n_bytes, x.n_tokens, x.over_limit) == (len(text.encode()), n, n > 100)


def test_token_counts_in_stretches_and_small_caches():
    lengths = token_counts.Lengths(tokenizer_path("byte_bpe_50k.json"))
    lengths.misses.most = 3
    r = random.Random(4)
    for _ in range(300):
        text = "".join(r.choices(["a", "é", "'s", " ", "  ", "\n", "1", "中", "\u0085", "."], k=r.randint(0, 50)))
        n = len(lengths.tokenizer.encode(text, add_special_tokens=False).ids)
        assert [lengths.count(text, k) for k in (1, 2, 9, 1000)] == [n] * 4


def test_token_counts_of_odd_tables(spark):
    d = docs(spark, ["one two"] * 3).selectExpr("cast(null as long) doc_id", "text", "1 as n_tokens", "2 as n_bytes", "'x' as pre")
    assert [(x.doc_id, x.n_bytes, x.over_limit) for x in token_counts.count_tokens(d).collect()] == [(None, 7, False)] * 3
    assert token_counts.count_tokens(docs(spark, [])).collect() == []


# --- 13: source audit ---------------------------------------------------------------------------------------------


def brute_audit(rows, least=10, top=10):
    small = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    count, frequency, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(small))
        sources[lang].add(source)
        count[lang, source].update(terms)
        frequency[lang].update(set(terms))
    out = set()
    for lang, names in sources.items():
        kept = [t for t, n in frequency[lang].items() if n >= least]
        v, whole = len(kept), Counter()
        for s in names:
            whole.update(count[lang, s])

        def share(c, kept=kept, v=v):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * v) for t in kept}

        f = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = {s: share(count[lang, s]) for s in names}, share(whole)
        for s in names:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in names if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, item, value, k) for k, (item, value) in enumerate(items[:most], 1)}
    return out


@pytest.mark.parametrize("stretch, salts", [(1 << 23, 16), (200, 3)])
def test_source_audit(spark, stretch, salts):
    r = random.Random(11)
    words = ["the", "The", "é", "É", "naïve", "x1y", "a-b", "中文", "😀", "Straße", "don't", *"abcdefgh"]
    rows = [(t, "en", "s1") for t in awkward()]
    for k in range(300):
        lang, source = r.choice(["en", "en", "de", None, ""]), r.choice(["s1", "s1", "s2", None, "", "é", "Z"])
        rows.append((None if k % 50 == 0 else r.choice(["", " ", "|", "A"]).join(r.choices(words, k=r.randint(0, 30))), lang, source))
    rows += [("solo", "xx", "only"), ("few words", "yy", "s1"), (None, "yy", "s2"), ("", "yy", None)]
    d = spark.createDataFrame([(1, *x, 0, "v") for x in rows], "doc_id long, text string, lang string, source string, value long, term string").repartition(5)
    got = source_audit.audit(d, stretch=stretch, salts=salts).collect()
    assert len(got) == len(set(got)) and set(map(tuple, got)) == brute_audit(rows)


def test_source_audit_of_an_empty_table(spark):
    assert source_audit.audit(docs(spark, [])).collect() == []


def test_shares_of_counts_beyond_64_bits():
    counts, n = np.array([0, 10**13, 4 * 10**17], "i8"), 9 * 10**17
    assert source_audit.shares(counts, n, 5).tolist() == [1 + 10**9 * (c + 2) // (n + 10) for c in counts.tolist()]


@pytest.mark.parametrize("size", [1, 2, 3, 1000])
def test_run_lengths_over_batches(size):
    import pyarrow as pa

    keys = sorted(random.Random(2).choices(["", "a", "b", "é", "zz"], k=50))
    whole = pa.RecordBatch.from_arrays([pa.array(keys), pa.array(range(50), pa.int64())], ["k", "n"])
    runs = [x for b in source_audit.run_lengths((whole.slice(i, size) for i in range(0, 50, size)), ("k",), ("n",)) for x in b.to_pylist()]
    assert runs == [{"k": k, "n": sum(i for i, x in enumerate(keys) if x == k)} for k in sorted(set(keys))]
