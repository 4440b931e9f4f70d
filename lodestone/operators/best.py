"""The best documents of each query, gathered in a task from scores that come a few documents at a time."""

from __future__ import annotations

#: Documents that are scored in one step, so that scores in memory are at most STEP times the queries of a tile.
STEP = 256


class Best:
    """At most k documents for each of `queries` queries: by descending score, ties to the smaller document; NaN counts as greatest."""

    def __init__(self, queries: int, k: int):
        import numpy as np

        self.k, self.floor, self.held, self.pending = k, np.full(queries, -np.inf), [], 0
        self.limit = max(20_000, 2 * k * queries)

    def add(self, scores, docs, columns=None, least: float | None = None) -> None:
        """scores: documents by queries; docs: Arrow array of their ids; columns: which queries, else all; least: scores must be above it."""
        import numpy as np
        import pyarrow as pa

        if not len(docs):
            return
        columns = np.arange(scores.shape[1]) if columns is None else columns
        s = np.where(np.isnan(scores), np.inf, scores)
        keep = s >= self.floor[columns]
        if least is not None:
            keep &= s > least
        if len(docs) > self.k:  # rows below a query's kth score here can't be among its k best
            keep &= s >= np.partition(s, len(s) - self.k, axis=0)[len(s) - self.k]
        i, j = np.nonzero(keep)
        if len(i):
            self.held.append((columns[j], s[i, j], scores[i, j], docs.take(pa.array(i))))
            self.pending += len(i)
            if self.pending > self.limit:
                self._cut()

    def _cut(self) -> None:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        q, s, raw = (np.concatenate([h[n] for h in self.held]) for n in range(3))
        d = pa.concat_arrays([h[3] for h in self.held])
        if pa.types.is_integer(d.type) and not d.null_count:
            order = np.lexsort((d.to_numpy(), -s, q))
        else:
            order = pc.sort_indices(pa.table({"q": q, "s": -s, "d": d}), [("q", "ascending"), ("s", "ascending"), ("d", "ascending")], null_placement="at_start").to_numpy()
        q = q[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        kept = order[place < self.k]
        last = place == self.k - 1
        self.floor[q[last]] = s[order[last]]
        q = q[place < self.k]
        self.held, self.pending = [(q, s[kept], raw[kept], d.take(pa.array(kept)))], 0

    def batches(self, ids, names: list[str]):
        """Arrow batches (query, doc, score) of what is held; ids: Arrow array of the queries' ids."""
        import pyarrow as pa

        if self.held:
            self._cut()
            q, _, raw, d = self.held[0]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(q)), d, pa.array(raw)], names)


def steps(batches, size: int = STEP):
    """The batches, at most `size` rows at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, size):
            yield batch.slice(lo, size)


def rounded(scores, places: int):
    import numpy as np

    return np.floor(scores * 10**places + 0.5) / 10**places


def arrow_type(df, column: str):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)
