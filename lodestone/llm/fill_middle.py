"""Fill-in-middle transformation (operator 11).

A Split pre-tokenizer of the tokenizers library, whose regex matches are isolated, cuts a text into units; nothing is
trained. Every character is white space or not, so the matches cover the text, and the ends of the units are its offset
array in code points. Its length gives n; two hashed ranks in it give the cuts between prefix, middle and suffix. Only n
and the two cuts come back from Python: slices, output and the text restored from it are columns of the JVM.

Texts above STRETCH code points are cut in stretches. A stretch ends where a unit must end, between a character that is no
white space and one that is, so the units are those of the whole text.

Defined cases: null text counts as empty; an empty text has no units and stays plain; a null doc_id hashes as an empty
string; rows that repeat a doc_id are cut alike where their texts are; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import table

UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
EDGE = re.compile(r"[^\x20\x09-\x0D][\x20\x09-\x0D]")
#: Code points that are cut at a time.
STRETCH = 1_000_000
#: Marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
SEED, MIDDLE_PERCENT, SPM_PERCENT = "42", 50, 80


def unit_ends(text: str, split, stretch: int = STRETCH) -> array:
    """Ends of the units in code points, ascending."""
    from tokenizers import PreTokenizedString

    ends, at = array("q"), 0
    while at < len(text):
        edge = EDGE.search(text, at + stretch - 1) if len(text) - at > stretch else None
        to = edge.start() + 1 if edge else len(text)
        part = text[at:to]
        held = PreTokenizedString(part)
        split.pre_tokenize(held)
        # of a text in ASCII, the bytes are the code points, and counting them is quicker
        ends.extend([at + u[1][1] for u in held.get_splits(offset_referential="original", offset_type="byte" if part.isascii() else "char")])
        at = to
    return ends


def _cut(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """n, and the ends of prefix and middle, of (text, h1, h2)."""
    from tokenizers import Regex, pre_tokenizers

    split = pre_tokenizers.Split(Regex(UNIT), "isolated")
    for texts, first, second in batches:
        rows = []
        for text, h1, h2 in zip(texts, first, second, strict=True):
            ends = unit_ends(text, split)
            n = len(ends)
            lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
            rows.append((n, ends[lo - 1] if lo else 0, ends[hi - 1] if hi else 0))
        yield pd.DataFrame(rows, columns=["n", "prefix", "upto"])


def fill_in_middle(docs: DataFrame, *, seed: str = SEED, middle_percent: int = MIDDLE_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """doc_id, n, form (plain, psm or spm), prefix_chars, middle_chars, output."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    number = lambda k: F.conv(F.substring("digest", 8 * k - 7, 8), 16, 10).cast("long")
    d = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), digest.alias("digest"))
    d = d.select("doc_id", "text", *(number(k).alias(f"h{k}") for k in (1, 2, 3, 4)))
    text, p, s, m = F.col("text"), *(F.lit(x) for x in MARKS)
    plain = (text == "") | F.contains(text, p) | F.contains(text, s) | F.contains(text, m) | (F.col("h3") % 100 >= middle_percent)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm")
    d = d.withColumns({"form": form, "cut": F.pandas_udf(_cut, "n long, prefix long, upto long")("text", "h1", "h2")})
    a, b = F.col("cut.prefix").cast("int"), F.col("cut.upto").cast("int")
    prefix, middle, suffix = F.substring(text, F.lit(1), a), F.substring(text, a + 1, b - a), F.substring(text, b + 1, F.length(text))
    output = F.when(F.col("form") == "plain", text).when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    cut = F.col("form") != "plain"
    return d.select("doc_id", F.col("cut.n").alias("n"), "form", F.when(cut, F.col("cut.prefix")).alias("prefix_chars"), F.when(cut, F.col("cut.upto") - F.col("cut.prefix")).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. A slice holds no mark, so the first of each mark is the one that was put there."""
    p, s, m = MARKS

    def parts(first: str, second: str) -> list[Column]:
        i = F.position(F.lit(second), output, F.lit(len(first) + 1))
        j = F.position(F.lit(m), output, i + len(second))
        one = F.substring(output, F.lit(len(first) + 1), i - len(first) - 1)
        two = F.substring(output, i + len(second), j - i - len(second))
        return [one, two, F.substring(output, j + len(m), F.length(output))]

    prefix, suffix, middle = parts(p, s)
    suffix2, prefix2, middle2 = parts(s, p)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix2, middle2, suffix2)).otherwise(output)


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document transformed, with digests of its output and of the text restored from that."""
    out = fill_in_middle(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op11_fill_middle": op11_fill_middle}
ORACLES = {
    "op11_fill_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || doc_id) AS h, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
k AS (SELECT *, len(u) AS n, ('0x' || h[1:8])::UBIGINT::BIGINT % (len(u) + 1) AS a, ('0x' || h[9:16])::UBIGINT::BIGINT % (len(u) + 1) AS b,
        ('0x' || h[17:24])::UBIGINT::BIGINT % 100 AS x, ('0x' || h[25:32])::UBIGINT::BIGINT % 100 AS y FROM d),
f AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR x >= 50 THEN 'plain' WHEN y < 80 THEN 'spm' ELSE 'psm' END AS form,
        array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(u[greatest(a, b) + 1:], '') AS s FROM k)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM f"""
}
