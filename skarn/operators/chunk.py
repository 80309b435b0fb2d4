"""Document chunking: structure-aware text chunks and declaration-aware code chunks, a row per chunk."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import CODE_EXTENSIONS

CHUNK = "id string, document_name string, chunk_index int, total_chunks int, text string, start_char int, end_char int, token_count_estimate int"
#: Where texts are cut, coarsest first.
SEPARATORS = [re.compile(x, re.A) for x in (r"(?=\n#{1,3}\s)", r"\n\s*\n", r"\n", r"(?<=[.!?])\s+", r"\s+")]
#: What trimmed lines that begin a declaration match, and the lines that a code chunk has at least before
#: it ends at one.
DECLARATIONS = [
    re.compile(x, re.A)
    for x in (
        r"^(export\s+)?(async\s+)?function\s+",
        r"^(export\s+)?(const|let|var)\s+\w+\s*=\s*(async\s+)?\(",
        r"^(export\s+)?class\s+",
        r"^(export\s+)?interface\s+",
        r"^(export\s+)?type\s+\w+\s*=",
        r"^(pub\s+)?fn\s+",
        r"^(pub\s+)?struct\s+",
        r"^(pub\s+)?impl\s+",
        r"^func\s+(\([^)]+\)\s+)?\w+",
        r"^type\s+\w+\s+struct",
        r"^def\s+\w+\s*\(",
        r"^class\s+\w+.*:",
        r"^@\w+",
    )
]
LEAST_LINES = 15


def _pieces(text: str, size: int) -> list[str]:
    """Cut at the coarsest separator first, and again only what is still too long."""
    parts = [text]
    for cut in SEPARATORS:
        if all(len(p) <= size for p in parts):
            break
        parts = [x for p in parts for x in (cut.split(p) if len(p) > size else [p])]
    return parts


def text_chunks(text: str, size: int = 600, overlap: int = 120) -> list[str]:
    """Runs of pieces, joined by newlines, that fit in ``size``; each begins with the end of the one before. Where a run
    ends is looked up in the running sums of the pieces' lengths."""
    pieces = [p for p in map(str.strip, _pieces(text, size)) if p]
    sums = [0, *accumulate(len(p) + 1 for p in pieces)]
    out: list[str] = []
    low = 0
    while low < len(pieces):
        tail = out[-1][-overlap:].strip() if out and 0 < overlap < len(out[-1]) else ""
        room = size + 1 - (len(tail) + 1 if tail else 0)
        high = max(low + 1, bisect_right(sums, sums[low] + room) - 1)
        out.append("\n".join([*([tail] if tail else []), *pieces[low:high]]))
        low = high
    return out


def declared_lines(lines: list[str], json: bool) -> list[int]:
    """The numbers of the lines that begin a declaration, or in JSON an object or array."""
    trimmed = [x.strip() for x in lines]
    return [i for i, x in enumerate(trimmed) if any(p.match(x) for p in DECLARATIONS) or (json and x[:1] in ("{", "}", "["))]


def line_ranges(n: int, declared: list[int], most: int, overlap: int) -> list[tuple[int, int]]:
    """Ranges of lines that cover n lines: each ends at the first declaration that is over ``LEAST_LINES`` lines from its
    start and after the end of the range before, if there is one within ``most`` lines, else after ``most``."""
    out: list[tuple[int, int]] = []
    low = end = 0
    while not out or end < n:
        low = max(low + 1, end - overlap) if out else 0
        limit = min(n, low + most)
        k = bisect_right(declared, max(end, low + LEAST_LINES))
        end = min(limit, declared[k]) if k < len(declared) else limit
        out.append((low, end))
    return out


def code_chunks(code: str, name: str, most_lines: int = 45, overlap: int = 8) -> list[str]:
    lines = code.split("\n")
    ranges = line_ranges(len(lines), declared_lines(lines, name.lower().endswith(".json") or name.lower() == "json"), most_lines, overlap)
    return [x for x in ("\n".join(lines[a:b]).strip() for a, b in ranges) if x]


def placed(text: str, chunks: list[str]) -> Iterator[tuple[str, int, int]]:
    """(chunk, start, end): each looked for by its first 30 characters from the end of the one before, and taken to
    begin there where it is not found."""
    at = 0
    for chunk in chunks:
        found = text.find(chunk[:30], at)
        start = at if found < 0 else found
        at = start + len(chunk)
        yield chunk, start, at


def _chunked(docs: DataFrame, name: str, text: str, kind: str, cut: Callable[[str, str], list[str]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                content = content.as_py() or ""
                chunks = cut(content, doc or "")
                rows += [(f"{doc}-{kind}-{i}", doc, i, len(chunks), c, a, b, max(1, int(len(c) / 4 + 0.5))) for i, (c, a, b) in enumerate(placed(content, chunks), 1)]
            types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
            columns = list(zip(*rows, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in CHUNK.split(", ")])

    return docs.select(F.col(name).cast("string"), F.col(text).cast("string")).mapInArrow(run, CHUNK)


def chunk_text(docs: DataFrame, name: str = "doc_id", text: str = "text", size: int = 600, overlap: int = 120) -> DataFrame:
    """A row per chunk; a null or blank text has none."""
    return _chunked(docs, name, text, "chunk", lambda t, _: text_chunks(t, size, overlap))


def chunk_code(docs: DataFrame, name: str = "name", text: str = "text", most_lines: int = 45, overlap: int = 8) -> DataFrame:
    return _chunked(docs, name, text, "code", lambda t, n: code_chunks(t, n, most_lines, overlap))


def chunk_any(docs: DataFrame, name: str = "name", text: str = "text", size: int = 550, overlap: int = 100, most_lines: int = 40) -> DataFrame:
    """Code files by declarations, all others as text; ids say which."""
    code = F.lower(F.element_at(F.split(F.col(name).cast("string"), r"\."), -1)).isin(CODE_EXTENSIONS)
    return chunk_text(docs.where(~F.coalesce(code, F.lit(False))), name, text, size, overlap).union(chunk_code(docs.where(code), name, text, most_lines))


def document_totals(chunks: DataFrame) -> DataFrame:
    """(document_name, chunks, tokens)."""
    return chunks.groupBy("document_name").agg(F.count(F.lit(1)).alias("chunks"), F.sum("token_count_estimate").alias("tokens"))
