"""URL filters (operator 6): explicit rules first, then logistic regression on hashed character n-grams of host and path.

The model is trained on a small labelled URL table that a rule spells out below (topic words in common host patterns;
unwanted topics are blocked, ordinary ones allowed), by full-batch gradient steps, so fits agree run by run.

Defined cases: a null url, or one without "://", has empty host and path and is judged by the model's prior; rules never fit
an empty host; host letters A-Z are lower-cased, the path is left as it is; ports and user parts stay in the host;
rows may repeat; an empty table gives no rows; judge() keeps other columns, and replaces those that have the names of its
results (host, path, rule, verdict, blocked_probability). A row that a rule decides isn't scored: its probability is null.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import table

SLOTS, ORDERS, STEPS, RATE, RIDGE = 1 << 15, (3, 4, 5), 400, 20.0, 3e-5

#: (host suffix, path prefix, verdict); the longest that fits decides.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))

UNWANTED = "spam casino poker pills viagra pharma-deal adult adult-cams porn xxx sex bets free-bets betting gambling slots lottery jackpot payday-loan ads adserver banner track tracker click-bait clicks popunder warez torrent crack keygen malware phish replica escort dating-hot free-money win-prize miracle-diet link-farm cheap-meds casino-win hot-cams".split()
ORDINARY = "news garden history school library museum science cooking travel music weather recipes university physics poetry language village market-town open-data city-council health nature forum wiki docs journal archive sports theatre railway bakery farm-life river mountain photo-club story letters rain-gauge winter-tales my-notes".split()


SYLLABLES = "th er on an re he in ed nd ha at en es or nt ti hi st ar ou it al is tion ing".split()


def labelled() -> list[tuple[str, str, int]]:
    """(host, path, blocked): topic words and names of common syllables in the same host patterns, with an ordinary path."""
    hosts = ("www.{}.example.net", "{}.example.com", "m.{}.example.org", "blog.{}.example.com", "{}.example.org", "the-{}.example.net")
    paths = ("/en/{}", "/fr/{}.html", "/de/{}/", "/es/{}")
    names = [(w, 1, 4) for w in UNWANTED] + [(w, 0, 3) for w in ORDINARY] + [(a + b, 0, 1) for a in SYLLABLES for b in SYLLABLES if a != b]
    out = []
    for k, (w, y, times) in enumerate(names):
        out += [(hosts[(k + j) % len(hosts)].format(w), paths[(k + k // 4 + j) % 4].format(1 + 7919 * (k + 31 * j) % 49999), y) for j in range(times)]
    return out


def grams(host: str, path: str) -> list[int]:
    """Slots of the n-grams of both parts; each part has its own marks at the ends, so equal grams of both differ."""
    out = set()
    for mark, part in (("h", host), ("p", path.lower())):
        s = f"<{part}>"
        out |= {zlib.crc32(f"{mark}{s[i : i + n]}".encode()) % SLOTS for n in ORDERS for i in range(len(s) - n + 1)}
    return sorted(out)


@cache
def model():
    """Weights and bias."""
    import numpy as np

    rows = [(grams(h, p), y) for h, p, y in labelled()]
    used = np.unique(np.concatenate([g for g, _ in rows]))
    x = np.zeros((len(rows), len(used)), "f4")
    for k, (g, _) in enumerate(rows):
        x[k, np.searchsorted(used, g)] = 1 / np.sqrt(len(g))
    y, v, b = np.array([r[1] for r in rows], "f4"), np.zeros(len(used), "f4"), 0.0
    for _ in range(STEPS):
        e = 1 / (1 + np.exp(-(x @ v + b))) - y
        v -= RATE * (x.T @ e / len(y) + RIDGE * v)
        b -= 0.1 * RATE * float(e.mean())
    w = np.zeros(SLOTS, "f4")
    w[used] = v
    return w, b


def host_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)", 1)


def judge(pages: DataFrame, rules=RULES, threshold: float = 0.5) -> DataFrame:
    """pages with columns host, path, rule, verdict, blocked_probability."""
    weights, bias = model()
    held = pages.sparkSession.sparkContext.broadcast((weights, bias))

    @F.pandas_udf("double")
    def blocked(host: pd.Series, path: pd.Series) -> pd.Series:
        import numpy as np

        w, b = held.value
        out = []
        for h, p in zip(host, path, strict=True):
            if h is None:
                out.append(None)
                continue
            g = grams(h, p)
            out.append(1 / (1 + float(np.exp(-(w[g].sum() / np.sqrt(max(len(g), 1)) + b)))))
        return pd.Series(out, dtype="float64")

    host, path = host_path(F.col("url"))
    rule = verdict = F.lit(None).cast("string")
    for suffix, prefix, what in sorted(rules, key=lambda r: len(r[0] + r[1])):  # a longer rule wraps, so overrides, a shorter one
        fits = ((F.col("host") == suffix) | F.col("host").endswith(f".{suffix}")) & F.col("path").startswith(prefix)
        rule, verdict = F.when(fits, F.lit(suffix + prefix)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    out = pages.withColumns({"host": host, "path": path}).withColumns({"rule": rule, "verdict": verdict})
    out = out.withColumn("blocked_probability", blocked(F.when(F.col("verdict").isNull(), F.col("host")), F.col("path")))
    return out.withColumn("verdict", F.coalesce("verdict", F.when(F.col("blocked_probability") >= threshold, "block").otherwise("allow")))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge the url of every page."""
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op6_url_filter": op6_url_filter}
ORACLES: dict[str, str] = {}
