"""Splitting documents into chunks: recursive separators with overlap, and parent / child sections.

Both packings carry state from piece to piece, so they run as Arrow-batched Python over whole documents; a document is
one row, and no shuffle is needed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lodestone.operators.best import steps

#: Documents whose chunks are held at a time.
DOCS = 64
#: Separators from coarse to fine.
SEPARATORS = ("\n\n", "\n", ". ", "? ", "! ", " ", "")
CHUNKS = "doc_id long, chunk_id string, page_number int, chunk_index int, total_chunks int, text string, image_url string, has_image boolean"
_URL = re.compile(r"\[Image URL:\s*(.*?)\]")


def pack(pieces: list[str], size: int, overlap: int) -> list[str]:
    """Runs of pieces of at most `size` characters; each run starts with the last pieces of the one before, up to `overlap`."""
    out, lo, length = [], 0, 0  # the open run is pieces[lo:k]
    for k, p in enumerate(pieces):
        if length + len(p) > size and lo < k:
            out.append("".join(pieces[lo:k]))
            while length > overlap and lo < k:
                length -= len(pieces[lo])
                lo += 1
        length += len(p)
    if lo < len(pieces):
        out.append("".join(pieces[lo:]))
    return [t for t in map(str.strip, out) if t]


def split(text: str, size: int, overlap: int, level: int = 0) -> list[str]:
    """Chunks of a text by the coarsest separator it holds, finer ones for pieces that are too long."""
    at = next((i for i in range(level, len(SEPARATORS)) if SEPARATORS[i] == "" or SEPARATORS[i] in text), len(SEPARATORS) - 1)
    sep = SEPARATORS[at]
    pieces = [p if p.endswith(sep) else p + sep for p in text.split(sep)] if sep else list(text)
    out: list[str] = []
    run: list[str] = []
    for p in pieces:
        if len(p) < size:
            run.append(p)
            continue
        out += pack(run, size, overlap)
        run = []
        out += split(p, size, overlap, at + 1) if sep and at + 1 < len(SEPARATORS) else [p]
    return out + pack(run, size, overlap)


def _batch(rows: list[tuple], schema):
    import pyarrow as pa

    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def recursive_chunks(docs: DataFrame, size: int = 400, overlap: int = 60, *, name: str = "filename", pages: str | None = None) -> DataFrame:
    """Chunks of documents (doc_id, name, text[, pages array]).

    Paged documents number their chunks across pages and skip blank ones before numbering; unpaged ones number before
    skipping. A page's first image URL, else the document's, goes with its chunks.
    """
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")
    made = to_arrow_schema(T.StructType.fromDDL(CHUNKS))
    page_list = F.col(pages) if pages else F.lit(None).cast("array<string>")

    def chunked(batches: Iterator) -> Iterator:
        for b in steps(batches, DOCS):
            rows = []
            for doc, name_, text, parts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                default = m[1].strip() if (m := _URL.search(text or "")) else ""
                if parts is not None and len(parts):
                    n = 0
                    for page, part in enumerate(parts, 1):
                        if not (part or "").strip():
                            continue
                        url = m[1].strip() if (m := _URL.search(part)) else default
                        for t in split(part, size, overlap):
                            if t.strip():
                                rows.append((doc, f"{name_}_p{page}_c{n}", page, n, None, t.strip(), url, bool(url)))
                                n += 1
                else:
                    found = split(text or "", size, overlap)
                    rows += [(doc, f"{name_}_chunk_{i}", None, i, len(found), t.strip(), default, bool(default)) for i, t in enumerate(found) if t.strip()]
            yield _batch(rows, made)

    return docs.select("doc_id", F.col(name).alias("name"), "text", page_list.alias("pages")).mapInArrow(chunked, CHUNKS)


def approximate_tokens(text: str) -> int:
    return max(1, len(text) // 4)


_SENTENCE = re.compile(r"(?<=[.?!])\s+")
SECTIONS = (
    "doc_id long, parent_id string, child_id string, section_title string, full_content string, content string, token_count long, pages array<int>"
)


def parents_of(nodes: list[tuple[str, str, int]], title: str, child_target: int = 192, parent_target: int = 1536) -> list[tuple[str, list[tuple[str, str, int]]]]:
    """(section title, nodes) of each parent. A node is (type, content, page); a header opens a section once two children's worth is held."""
    out: list[tuple[str, list]] = []
    held: list[tuple[str, str, int]] = []
    size = 0
    for node in nodes:
        n = approximate_tokens(node[1])
        if node[0] == "header" and size >= 2 * child_target and held:
            out.append((title, held))
            held, size = [], 0
        if node[0] == "header":
            title = node[1].strip()
        if held and size + n > parent_target:
            out.append((title, held))
            held, size = [], 0
        held = [*held, node]
        size += n
    return [*out, (title, held)] if held else out


def children_of(nodes: list[tuple[str, str, int]], target: int = 192, keep_last: bool = True) -> list[tuple[str, int]]:
    """(content, tokens) of a parent's children: paragraphs, or sentences of long ones, up to `target`; the last unit is repeated."""
    out, held, size = [], [], 0
    units = []
    for _, content, _ in nodes:
        text = content.strip()
        if text:
            units += _SENTENCE.split(text) if approximate_tokens(text) > target else [text]
    for u in units:
        n = approximate_tokens(u)
        if held and size + n > target:
            out.append((" ".join(held), size))
            held = held[-1:] if keep_last else []
            size = sum(map(approximate_tokens, held))
        held.append(u)
        size += n
    return [*out, (" ".join(held), size)] if held else out


def parent_child_chunks(nodes: DataFrame, child_target: int = 192, parent_target: int = 1536, overlap: int = 32) -> DataFrame:
    """Sections of documents (doc_id, title, nodes array<struct<type, content, page>> in order): a row per child, with its parent."""

    made = to_arrow_schema(T.StructType.fromDDL(SECTIONS))

    def packed(batches: Iterator) -> Iterator:
        for b in steps(batches, DOCS):
            rows = []
            for doc, title, items in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for p, (section, held) in enumerate(parents_of([(i["type"], i["content"] or "", i["page"]) for i in items], title, child_target, parent_target)):
                    parent = f"p_{doc}_{p:04d}"
                    full = "\n\n".join(f"\n[Table Layout]:\n{c}\n" if kind == "table" else c for kind, c, _ in held)
                    pages = sorted({page for _, _, page in held})
                    rows += [(doc, parent, f"c_{parent}_{k:03d}", section, full, c, n, pages) for k, (c, n) in enumerate(children_of(held, child_target, overlap > 0))]
            yield _batch(rows, made)

    return nodes.select("doc_id", "title", "nodes").mapInArrow(packed, SECTIONS)


def section_titles(nodes: DataFrame, doc: str, order: str, kind: str, content: str, default: str) -> DataFrame:
    """Adds section_title: the last header at or before a node, else a default."""
    from pyspark.sql import Window

    w = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return nodes.withColumn("section_title", F.coalesce(F.last(F.when(F.col(kind) == "header", F.trim(F.col(content))), ignorenulls=True).over(w), F.col(default)))
