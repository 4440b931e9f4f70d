"""N-gram Jaccard join (operator 7): a token-group matrix over distinct documents, and components of the links.

1. Every text becomes the set of hashes of its 5-word shingles (its tokens). Equal sets are one node.
2. Tokens have one global order: frequent ones last, the others by hash. A partner of similarity t or more of a set of n shares
   r of the first n - ceil(t n) + r tokens in that order, so with r = 1 + n / SHARE only those decide. A first matrix holds
   node by deciding token. Tokens of one node decide nothing; a node left with fewer than the r tokens that its smallest
   possible partner asks for has no partner. Tokens and nodes are dropped by this in turns, which leaves little more than
   the documents that are made of shared text.
3. Of the m tokens that are left of a node, the m - r + 1 rarest hold the first token that it shares with any partner; these
   are its lookups.
4. Similar nodes are partitioned into groups: min-hashes name leaders (the smallest node that shares one), pairs of
   similarity FAMILY or more join into families, those at the threshold into components. Large components and the rest of a
   family are cut into groups of at most GROUP members and GROUP_TOKENS tokens.
5. Groups of one family meet in tasks of two: the overlap of each query with the other group's whole token union bounds its
   overlap with any member, and only queries that reach the threshold by it open the group for exact comparison. Groups of
   one component need no comparison, so near copies cost in proportion to their number.
6. Across families the token-group matrix decides: per lookup token the groups whose union holds it, in cells of bounded size.
   Groups of different families that meet there, and whose sizes allow a link, are bounded, opened and compared in the same way.
7. Links give connected components by alternating large and small stars.

Families, groups and frequent tokens (counted over all documents in memory-bounded chunks) only steer the work: every pair of
nodes that can be a link and isn't implied by known ones is compared, either in its family or through a lookup token of both.

Defined cases: null and empty texts, and texts without words, have empty sets and link with nothing; with fewer than five
words the whole sequence is one shingle. Rows are what links: rows that repeat a doc_id count one by one, and identical rows
give identical result rows. A null doc_id is kept; component_id is the smallest doc_id that isn't null, or null where a
component has none. An empty table gives no rows; other columns are ignored. Shingles are told apart by 64-bit hashes, sets
by 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import bounded, finish, materialise, release_words, split_words, table, text_bytes, trim

SHINGLE, PERCENT, FAMILY = 5, 75, 40
#: Most members of a group and most of their tokens (one longer member makes a group as well); asks of one leader in a task.
GROUP, GROUP_TOKENS, QUERIES_PER_TASK_GROUP = 256, 60_000, 256
#: Tokens of a chunk in which frequent ones are counted; least count there and overall; most frequent tokens kept.
CHUNK_TOKENS, LEAST_IN_CHUNK, LEAST_OVERALL, MOST_FREQUENT = 2_000_000, 2, 4, 1_000_000
#: Every SHARE tokens of a set lengthen its deciding part by one, and ask for one more shared token.
SHARE = 20
#: Rows of a lookup token in a cell of the matrix; parts that rows of a frequent token are dealt to.
CELL, PARTS = 256, 1024
BROADCAST_PAIRS = 300_000

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SALTS = (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


def shingles(w, width: int = SHINGLE):
    """Shingle hashes of word hashes, in order."""
    import numpy as np

    n = len(w)
    if not n:
        return w
    k = min(n, width)
    h = np.full(n - k + 1, 0x9E3779B97F4A7C15 + (k if n < width else 0), "u8")
    for j in range(k):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + w[j : n - k + 1 + j]
    return finish(h)


def distinct(s):
    """Sorted distinct values."""
    import numpy as np

    s = np.sort(s)
    keep = np.ones(len(s), bool)
    np.not_equal(s[1:], s[:-1], out=keep[1:])
    return s[keep]


def shingle_sets(bodies: list[bytes], width: int = SHINGLE, most: int = 1 << 20) -> Iterator:
    """Sorted distinct shingle hashes of each text; texts are hashed in runs of about `most` bytes."""
    import numpy as np

    lo = size = 0
    for hi, body in enumerate(bodies, 1):
        size += len(body)
        if size < most and hi < len(bodies):
            continue
        run, lo, size = bodies[lo:hi], hi, 0
        starts, _, w = split_words(b"\n".join(run).translate(_LOWER))
        at = np.searchsorted(starts, np.cumsum([0] + [len(x) + 1 for x in run])).tolist()
        every = shingles(w, width) if len(w) >= width else w  # those that cross texts are left out below
        for a, b in zip(at[:-1], at[1:], strict=True):
            yield distinct(every[a : b - width + 1]) if b - a >= width else shingles(w[a:b], width)


def needed(n: int, percent: int = PERCENT) -> int:
    """Deciding tokens that a set of n shares with any partner: those that the smallest partner asks for."""
    return 1 + -(-percent * n // 100) // SHARE


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """How many tokens decide. A partner shares at least ceil(t n) of n, so of the shared ones the 1 + n / SHARE first lie among these."""
    return min(n, n - -(-percent * n // 100) + 1 + n // SHARE)


def deciding_tokens(s, often, rank, percent: int = PERCENT):
    """The first tokens of a set in the global order, and how many of them are frequent. often: sorted frequent tokens; rank: their counts."""
    import numpy as np

    at = np.minimum(np.searchsorted(often, s), len(often) - 1) if len(often) else None
    late = often[at] == s if len(often) else np.zeros(len(s), bool)
    early, n = s[~late], prefix_length(len(s), percent)
    if len(early) >= n:
        return early[:n], 0
    k = at[late]
    rest = s[late][np.lexsort((s[late], rank[k]))][: n - len(early)]
    return np.concatenate([early, rest]), len(rest)


def _signature(s) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


FIRST = "doc_id long, key long, n long, s1 long, s2 long, k0 long, k1 long, k2 long, k3 long, token long, count long"


def _first_pass(batches: Iterator) -> Iterator:
    """A row per document: set size, signature, min-hashes; and rows (token, count) of tokens that are frequent in a chunk."""
    import numpy as np
    import pyarrow as pa

    release_words()
    held: list = []
    seen: set = set()
    size = 0
    names = [c.split()[0] for c in FIRST.split(", ")]

    def out(rows: int, **columns):
        return pa.RecordBatch.from_arrays([pa.array(columns[c], pa.int64()) if c in columns else pa.nulls(rows, pa.int64()) for c in names], names)

    def frequent():
        nonlocal held, size
        t, c = np.unique(np.concatenate(held), return_counts=True)
        held, size = [], 0
        seen.clear()
        keep = c >= LEAST_IN_CHUNK
        return out(int(keep.sum()), token=t[keep].view("i8"), count=c[keep])

    for b in batches:
        rows = np.zeros((len(b), 7), "i8")
        for i, s in enumerate(shingle_sets(b.column("body").to_pylist())):
            if not len(s):
                continue
            sig = _signature(s)
            rows[i, 0] = len(s)
            rows[i, 1:3] = np.frombuffer(sig, "<i8")
            rows[i, 3:] = [int(s[0].view("i8")), *(int((s * np.uint64(k)).min().view("i8")) for k in _SALTS)]
            if sig not in seen:
                seen.add(sig)
                held.append(s)
                size += len(s)
            if size >= CHUNK_TOKENS:
                yield frequent()
        if len(b):
            columns = {c: rows[:, i] for i, c in enumerate(names[2:9])}
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), *(pa.array(columns[c]) for c in names[2:9]), pa.nulls(len(b), pa.int64()), pa.nulls(len(b), pa.int64())], names)
    if held:
        yield frequent()
    held = None
    trim()


def grouped(df: DataFrame, keys: list[str], each: Callable, schema: str) -> DataFrame:
    """each(table of the rows of one key) -> columns, over partitions that are dealt and sorted by the (integer) keys and read as a stream."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        held: list = []
        last = None
        ready: list = []
        size = 0

        def flush():
            nonlocal ready, size
            out = pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*ready, strict=True)], names)
            ready, size = [], 0
            return out

        def done() -> None:
            nonlocal held, size
            columns = each(pa.Table.from_batches(held))
            held = []
            if len(columns[0]):
                ready.append(columns)
                size += len(columns[0])

        for b in batches:
            if not len(b):
                continue
            k = np.column_stack([b.column(c).to_numpy(zero_copy_only=False).astype("i8") for c in keys])
            cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1).tolist(), len(b)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                now = tuple(k[lo])
                if held and now != last:
                    done()
                last = now
                held.append(b.slice(lo, hi - lo))
            if size > 10_000:
                yield flush()
        if held:
            done()
        if ready:
            yield flush()
        trim()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of the undirected edges (u, v); comp is the smallest node reachable."""
    e = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small_low.select("u", F.col("m").alias("v"))).distinct()
        e = materialise(small)
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).head()
        if now == mark or not now[0]:
            break
        mark = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("comp"))).distinct()


def survivors(docs: DataFrame, often, rank, percent: int = PERCENT) -> DataFrame:
    """(s1, token): deciding tokens that two or more distinct sets hold, and all frequent ones among the deciding tokens."""
    held = docs.sparkSession.sparkContext.broadcast((often, rank))

    def deciding(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        seen: set = set()
        for b in batches:
            parts: list = []
            for s in shingle_sets(b.column("body").to_pylist()):
                if not len(s) or (sig := _signature(s)) in seen:
                    continue
                if len(seen) >= 200_000:
                    seen.clear()
                seen.add(sig)
                t, late = deciding_tokens(s, *held.value, percent)
                s1 = int.from_bytes(sig[:8], "little", signed=True)
                salt = np.zeros(len(t), "i4")
                salt[len(t) - late :] = 1 + s1 % PARTS
                parts.append((t, np.full(len(t), s1, "i8"), salt))
            if parts:
                t, s1, salt = (np.concatenate(x) for x in zip(*parts, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(t.view("i8")), pa.array(salt), pa.array(s1)], ["token", "salt", "s1"])
        seen.clear()
        trim()

    # A frequent token passes as it is and is dealt to PARTS parts, so no task gets all rows of one.
    def shared(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        rest = [np.zeros(0, "i8"), np.zeros(0, "i4"), np.zeros(0, "i8")]

        def kept(t, salt, s1):
            new = np.ones(len(t), bool)
            new[1:] = (t[1:] != t[:-1]) | (s1[1:] != s1[:-1]) | (salt[1:] != salt[:-1])
            t, salt, s1 = t[new], salt[new], s1[new]
            same = (t[1:] == t[:-1]) & (salt[1:] == salt[:-1])
            keep = salt > 0
            keep[1:] |= same
            keep[:-1] |= same
            return pa.RecordBatch.from_arrays([pa.array(s1[keep]), pa.array(t[keep])], ["s1", "token"])

        for b in batches:
            t, salt, s1 = (np.concatenate([r, b.column(c).to_numpy()]) for r, c in zip(rest, ("token", "salt", "s1"), strict=True))
            if not len(t):
                continue
            cut = int(np.flatnonzero((t != t[-1]) | (salt != salt[-1]))[-1]) + 1 if (t[0] != t[-1] or salt[0] != salt[-1]) else 0
            rest = [t[cut:], salt[cut:], s1[cut:]]
            if cut:
                yield kept(t[:cut], salt[:cut], s1[:cut])
        if len(rest[0]):
            yield kept(*rest)

    rows = docs.select("body").mapInArrow(deciding, "token long, salt int, s1 long")
    return rows.repartition("token", "salt").sortWithinPartitions("token", "salt", "s1").mapInArrow(shared, "s1 long, token long")


def lookups(shared: DataFrame, nodes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(node, token): the lookups of the nodes that can have a partner. shared: (s1, token); nodes: (s1, node, n)."""
    per_node = Window.partitionBy("node")
    least = f"1 + (({percent} * n + 99) div 100) div {SHARE}"

    def enough(rows: DataFrame) -> DataFrame:
        return rows.withColumn("m", F.count(F.lit(1)).over(per_node)).where(f"m >= {least}")

    def shared_again(rows: DataFrame) -> DataFrame:
        counts = rows.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
        return rows.join(counts, "token")

    rows = materialise(enough(shared.join(nodes, "s1").select("node", "n", "token")).drop("m"))
    rows = materialise(enough(shared_again(rows)).drop("m", "c"))
    rows = enough(shared_again(rows))
    order = per_node.orderBy("c", "token")
    return materialise(rows.withColumn("place", F.row_number().over(order)).where(f"place <= m - ({least}) + 1").select("node", "token"))


def _sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, tokens): the set of each node, from the text of its representative row."""
    n = nodes.count()
    wanted = bounded(nodes.select("node", F.col("d").alias("doc_id"), "key", "s1", "s2"), n, BROADCAST_PAIRS)
    rows = docs.select("doc_id", F.xxhash64("body").alias("key"), "body").alias("x").join(wanted.alias("w"), F.expr("x.key = w.key and x.doc_id <=> w.doc_id")).select("node", "s1", "s2", "body")

    def tokens(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            keep, out = [], []
            for node, s1, s2, s in zip(*(b.column(c).to_pylist() for c in ("node", "s1", "s2")), shingle_sets(b.column("body").to_pylist()), strict=True):
                if _signature(s) == s1.to_bytes(8, "little", signed=True) + s2.to_bytes(8, "little", signed=True):
                    keep.append(node)
                    out.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int64()), pa.array(out, pa.binary())], ["node", "tokens"])
        trim()

    return materialise(rows.mapInArrow(tokens, "node long, tokens binary"))


def _held(t) -> tuple:
    """Nodes of a group's rows, one row each, with their sets; and the row each came from."""
    import numpy as np

    node = t.column("node").to_numpy()
    side = t.column("side").to_numpy()
    order = np.lexsort((node, side))
    keep = order[np.r_[True, (node[order][1:] != node[order][:-1]) | (side[order][1:] != side[order][:-1])]]
    bodies = t.column("tokens")
    return node[keep], side[keep], [np.frombuffer(bodies[int(k)].as_py(), "u8") for k in keep], keep


def verify(sets: DataFrame, candidates: DataFrame, members: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (u, v) of similarity percent or more, with shared and united tokens, of candidates (q, g): q against the members (g, node) of a group, at most one for each candidate.

    Queries of a group are dealt to parts of about QUERIES_PER_TASK_GROUP, and its members are sent to each part.
    """
    candidates = materialise(candidates)
    parts = candidates.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / QUERIES_PER_TASK_GROUP).cast("int").alias("parts"))
    asks = candidates.join(parts, "g").select("g", F.pmod(F.xxhash64("q", F.lit(3)), F.col("parts")).cast("int").alias("part"), F.col("q").alias("node"), F.lit(1).alias("side"))
    holds = members.join(parts, "g").select("g", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "node", F.lit(0).alias("side"))
    wanted = materialise(asks.unionByName(holds))
    rows = sets.join(bounded(wanted, wanted.count(), BROADCAST_PAIRS), "node").select("g", "part", "side", "node", "tokens")

    def opened(t) -> tuple:
        import numpy as np

        node, side, held, _ = _held(t)
        k = int((side == 0).sum())
        union = held[0] if k == 1 else distinct(np.concatenate(held[:k])) if k else np.zeros(0, "u8")
        out = []
        for q, s in zip(node[k:], held[k:], strict=True):
            hit = s[union[np.minimum(np.searchsorted(union, s), len(union) - 1)] == s] if len(union) else s[:0]
            if 100 * len(hit) < percent * len(s):
                continue  # no member can reach the threshold: the group stays closed
            for d, m in zip(node[:k], held[:k], strict=True):
                if d != q and 100 * min(len(s), len(m)) >= percent * max(len(s), len(m)):
                    both = len(hit) if k == 1 else int((m[np.minimum(np.searchsorted(m, hit), len(m) - 1)] == hit).sum())
                    if 100 * both >= percent * (len(s) + len(m) - both):
                        out.append((q, d, both, len(s) + len(m) - both))
                        break
        return tuple(np.array(out, "i8").reshape(-1, 4).T)

    return materialise(grouped(rows, ["g", "part"], opened, "u long, v long, shared long, united long"))


def _overlaps(a: list, b: list):
    """Shared tokens of every set of a with every set of b, and of every set of a with the union of b; by tokens that two or more sets hold, a block at a time."""
    import numpy as np

    every = np.concatenate(a + b)
    owner = np.repeat(np.arange(len(a) + len(b)), [len(s) for s in a + b])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    number = np.cumsum(np.r_[True, every[1:] != every[:-1]]) - 1
    counts = np.bincount(number)
    keep = counts[number] > 1
    owner, number = owner[keep], number[keep]
    number = np.cumsum(np.r_[True, number[1:] != number[:-1]]) - 1 if len(number) else number
    both, union = np.zeros((len(a), len(b)), "i8"), np.zeros(len(a), "i8")
    many = int(number[-1]) + 1 if len(number) else 0
    for lo in range(0, many, 8192):
        x, y = np.searchsorted(number, [lo, min(lo + 8192, many)])
        m = np.zeros((len(a) + len(b), min(8192, many - lo)), "f4")
        m[owner[x:y], number[x:y] - lo] = 1
        held = m[len(a) :]
        both += np.rint(m[: len(a)] @ held.T).astype("i8")
        union += np.rint(m[: len(a)] @ held.max(0)).astype("i8")
    return both, union


def compare(sets: DataFrame, groups: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (u, v) between members of different components of one family.

    A unit is a large component of a family, or the rest of it; units are cut into groups and paired, and one task holds
    two groups. Links already implied by others of the task are left out.
    """
    several = groups.groupBy("family").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("family")
    g = materialise(groups.join(several, "family").select("family", "unit", "chunk", "node", "n", "comp"))
    units = g.groupBy("family", "unit").agg(F.count(F.lit(1)).alias("m"))
    first, second = units.select("family", F.col("unit").alias("u1")), units.select("family", F.col("unit").alias("u2"))
    met = first.join(second, "family").where("u1 < u2 or (u1 = u2 and u1 = -1)")
    span = g.groupBy("family", "unit", "chunk").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    one = lambda i: span.select("family", *[F.col(c).alias(f"{n}{i}") for c, n in (("unit", "u"), ("chunk", "k"), ("lo", "lo"), ("hi", "hi"))])
    pairs = met.join(one(1), ["family", "u1"]).join(one(2), ["family", "u2"]).where("u1 <> u2 or k1 <= k2").where((percent * F.col("lo1") <= 100 * F.col("hi2")) & (percent * F.col("lo2") <= 100 * F.col("hi1")))
    pairs = materialise(pairs.select("family", "u1", "k1", "u2", "k2"))
    cols = ["family", "u1", "k1", "u2", "k2", "node", "comp", "side"]
    side = lambda p, i: p.join(g.select("family", F.col("unit").alias(f"u{i}"), F.col("chunk").alias(f"k{i}"), "node", "comp"), ["family", f"u{i}", f"k{i}"]).withColumn("side", F.lit(i)).select(*cols)
    wanted = materialise(side(pairs, 1).unionByName(side(pairs.where("u1 <> u2 or k1 <> k2"), 2)))
    rows = sets.join(bounded(wanted, wanted.count(), BROADCAST_PAIRS), "node").select(*cols, "tokens")

    def opened(t) -> tuple:
        import numpy as np

        node, side, held, rows = _held(t)
        comp, n, k = t.column("comp").to_numpy()[rows], np.array([len(s) for s in held]), int((side == 1).sum())
        second = slice(k, None) if k < len(held) else slice(0, k)
        both, union = _overlaps(held[:k], held[second])
        open_ = 100 * union >= percent * n[:k]  # the others' bound stays below the threshold
        link = (100 * both >= percent * (n[:k, None] + n[second] - both)) & (comp[:k, None] != comp[second]) & open_[:, None]
        out, root = [], {int(x): int(x) for x in set(comp)}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for i, j in zip(*np.nonzero(link), strict=True):
            a, b = find(int(comp[i])), find(int(comp[second][j]))
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((node[i], node[second][j]))
        return tuple(np.array(out, "i8").reshape(-1, 2).T)

    return materialise(grouped(rows, ["family", "u1", "k1", "u2", "k2"], opened, "u long, v long"))


def meeting_groups(looked: DataFrame, groups: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (g1, g2) of groups of different families that share a lookup token and whose sizes allow a link.

    Rows of a token are dealt to cells of two blocks of about CELL rows, so a common one is many small tasks.
    """
    rows = looked.join(groups.select("node", "family", "g", "lo", "hi"), "node").select("token", "family", "g", "lo", "hi").distinct()
    rows = materialise(rows)
    counts = rows.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("blocks"), F.min("family").alias("a"), F.max("family").alias("z")).where("a <> z").select("token", "blocks")
    own = F.pmod(F.xxhash64("g", F.lit(9)), F.col("blocks")).cast("int")
    cells = rows.join(counts, "token").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("token", F.least("own", "other").alias("b1"), F.greatest("own", "other").alias("b2"), "own", "family", "g", "lo", "hi")

    def paired(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        names = ["token", "b1", "b2", "own", "family", "g", "lo", "hi"]
        rest = np.zeros((0, 8), "i8")
        found: list = []
        size = 0

        def out():
            nonlocal found, size
            p = np.unique(np.concatenate(found), axis=0)
            found, size = [], 0
            return pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], ["g1", "g2"])

        def meet(x) -> None:
            nonlocal size
            same = lambda i, j: (x[i, :3] == x[j, :3]).all(1)
            i, step = np.arange(len(x)), 1
            while len(i):
                i = i[i + step < len(x)]
                i = i[same(i, i + step)]
                a, b = x[i], x[i + step]
                fit = (a[:, 4] != b[:, 4]) & (percent * a[:, 6] <= 100 * b[:, 7]) & (percent * b[:, 6] <= 100 * a[:, 7])
                fit &= (a[:, 1] == a[:, 2]) | (a[:, 3] != b[:, 3])  # rows of one block meet in their own cell
                if fit.any():
                    g = np.sort(np.column_stack([a[fit, 5], b[fit, 5]]), axis=1)
                    found.append(g)
                    size += len(g)
                step += 1

        for b in batches:
            x = np.concatenate([rest, np.column_stack([b.column(c).to_numpy().astype("i8") for c in names])])
            if not len(x):
                continue
            other = np.flatnonzero((x[:, :3] != x[-1, :3]).any(1))
            cut = int(other[-1]) + 1 if len(other) else 0
            meet(x[:cut])
            rest = x[cut:]
            if size > 400_000:
                yield out()
        meet(rest)
        if found:
            yield out()

    return cells.repartition("token", "b1", "b2").sortWithinPartitions("token", "b1", "b2").mapInArrow(paired, "g1 long, g2 long").distinct()


def jaccard_classes(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every document."""
    import numpy as np

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes())
    first = materialise(docs.select("doc_id", F.xxhash64("body").alias("key"), "body").mapInArrow(_first_pass, FIRST))
    known = first.where("token is null")
    counted = first.where("token is not null").groupBy("token").agg(F.sum("count").alias("count")).where(F.col("count") >= LEAST_OVERALL)
    frequent = counted.orderBy(F.desc("count"), "token").limit(MOST_FREQUENT).toPandas()  # at most MOST_FREQUENT rows
    often, rank = frequent["token"].to_numpy("i8").view("u8"), frequent["count"].to_numpy("i8")
    order = np.argsort(often)

    # One node for each distinct set: the row that its tokens are read from, and its smallest doc_id.
    sets_ = known.where("n > 0").groupBy("s1", "s2", "n", "k0", "k1", "k2", "k3").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("r"), F.min("doc_id").alias("lo"))
    nodes = materialise(sets_.select(F.monotonically_increasing_id().alias("node"), "s1", "s2", "n", "k0", "k1", "k2", "k3", F.col("r.doc_id").alias("d"), "r.key", "lo"))
    looked = lookups(survivors(docs, often[order], rank[order], percent), nodes.select("s1", "node", "n"), percent)
    left = materialise(nodes.drop("lo").join(looked.select("node").distinct(), "node"))
    sets = _sets(docs, left)

    keys = left.select("node", "n", F.posexplode(F.array("k0", "k1", "k2", "k3")).alias("band", "min"))
    leaders = keys.groupBy("band", "min").agg(F.min(F.struct("node", "n")).alias("lead"), F.count(F.lit(1)).alias("m")).where("m > 1").select("band", "min", F.col("lead.node").alias("g"), F.col("lead.n").alias("ln"))
    near = keys.join(leaders, ["band", "min"]).where((F.col("node") != F.col("g")) & (100 * F.least("n", "ln") >= FAMILY * F.greatest("n", "ln")))
    candidates = near.select(F.col("node").alias("q"), "g").distinct()
    similar = verify(sets, candidates, candidates.select("g", F.col("g").alias("node")).distinct(), FAMILY)
    links = similar.where(100 * F.col("shared") >= percent * F.col("united")).select("u", "v")
    comps, families = components(links), components(similar.select("u", "v"))

    joined = left.select("node", "n").join(comps, "node", "left").join(families.select("node", F.col("comp").alias("family")), "node", "left")
    joined = joined.withColumns({"linked": F.col("comp").isNotNull(), "comp": F.coalesce("comp", "node"), "family": F.coalesce("family", "node")})
    sizes = joined.where("linked").groupBy("comp").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > GROUP // 8)
    joined = joined.join(sizes.select("comp", F.col("comp").alias("unit")), "comp", "left").withColumn("unit", F.coalesce("unit", F.lit(-1)))
    units = joined.groupBy("family", "unit").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("tokens"))
    chunks = F.ceil(F.greatest(F.col("m") / GROUP, F.least(F.col("tokens") / GROUP_TOKENS, F.col("m"))))
    joined = joined.join(units, ["family", "unit"]).withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(5)), chunks).cast("int"))
    # The members of a component meet other families together, the others alone.
    joined = joined.withColumn("g", F.when(F.col("linked"), F.xxhash64("comp", "chunk")).otherwise(F.xxhash64("node")))
    joined = materialise(joined.select("node", "n", "comp", "family", "unit", "chunk", "g"))
    groups = joined.join(joined.groupBy("g").agg(F.min("n").alias("lo"), F.max("n").alias("hi")), "g")

    within = compare(sets, joined, percent)
    pairs = materialise(meeting_groups(looked, groups, percent))
    asks = pairs.join(joined.select(F.col("g").alias("g1"), F.col("node").alias("q"), "n"), "g1").join(joined.groupBy("g").agg(F.min("n").alias("lo"), F.max("n").alias("hi")).withColumnRenamed("g", "g2"), "g2")
    asks = asks.where((percent * F.col("n") <= 100 * F.col("hi")) & (percent * F.col("lo") <= 100 * F.col("n")))
    across = verify(sets, asks.select("q", F.col("g2").alias("g")), joined.select("g", "node"), percent)
    more = within.unionByName(across.select("u", "v"))
    comps = components(links.unionByName(more)) if not more.isEmpty() else comps

    member = materialise(comps.join(nodes.select("node", "lo"), "node"))
    lowest = member.groupBy("comp").agg(F.min("lo").alias("low"))
    classes = nodes.select("node", "s1", "s2", "n", "lo").join(member.join(lowest, "comp").select("node", "low"), "node", "left").select("s1", "s2", "n", F.coalesce("low", "lo").alias("component_id"))
    linked = known.where("n > 0").select("doc_id", "s1", "s2", "n").join(classes, ["s1", "s2", "n"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked.unionByName(known.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents of similarity 0.75 or more, over all documents."""
    return jaccard_classes(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op7_jaccard_join": op7_jaccard_join}
ORACLES: dict[str, str] = {}
