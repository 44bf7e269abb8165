"""Chunks of documents: sections, tables, recursive splitting with overlap."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Headers of sections, rows of tables, separators from coarse to fine.
HEADERS = [
    re.compile(p, re.M)
    for p in (r"^(\d+\.(?:\d+\.)*)\s+(.+)$", r"^([IVXLivxl]+\.)\s+(.+)$", r"^\([a-z]\)\s+(.+)$", r"^([A-Z][A-Z\s]{5,})$", r"^#{1,4}\s+(.+)$")
]
TABLE_ROW = re.compile(r"^\|.*\|$|^[\w\s]+\s*\|\s*[\w\s]+|^\s*\S+\s{3,}\S+\s{3,}\S+")
FINE = ("\n\n\n", "\n\n", "\n", ". ", "; ", ", ", " ", "")
COARSE = ("\n\n", "\n", ". ", " ", "")
SCHEMA = "doc_id {key}, chunk_id string, chunk_index int, total_chunks int, chunk_type string, section_title string, page_content string, chunk_size int"


@dataclass(frozen=True)
class ChunkConfig:
    size: int = 1200
    overlap: int = 200
    least: int = 100
    headers: bool = True
    tables: bool = True
    article_size: int = 2400
    article_overlap: int = 300


def split_recursive(text: str, size: int, overlap: int, separators=FINE) -> list[str]:
    """Pieces of at most `size` characters, cut at the coarsest separator that occurs; neighbours share up to `overlap`."""
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    sep, finer = separators[at], separators[at + 1 :]
    if sep:
        raw = text.split(sep)
        pieces = [raw[0]] + [sep + r for r in raw[1:]]
    else:
        pieces = list(text)
    out: list[str] = []
    short: list[str] = []
    for piece in filter(None, pieces):
        if len(piece) < size:
            short.append(piece)
            continue
        out += _merge(short, size, overlap)
        short = []
        out += split_recursive(piece, size, overlap, finer) if finer else [piece]
    return out + _merge(short, size, overlap)


def _merge(pieces: list[str], size: int, overlap: int) -> list[str]:
    out, held, total = [], [], 0
    for piece in pieces:
        if held and total + len(piece) > size:
            whole = "".join(held).strip()
            if whole:
                out.append(whole)
            while total > overlap or (total + len(piece) > size and total > 0):
                total -= len(held.pop(0))
        held.append(piece)
        total += len(piece)
    whole = "".join(held).strip()
    return out + [whole] if whole else out


def split_sections(text: str) -> list[tuple[str, str]]:
    """`(header, body)` in order; a header ends where the next begins, empty bodies drop out."""
    marks = sorted(((m.start(), m.end(), m.group().strip()) for p in HEADERS for m in p.finditer(text)), key=lambda m: m[0])
    if not marks:
        return [("", text)]
    out = []
    if text[: marks[0][0]].strip():
        out.append(("", text[: marks[0][0]].strip()))
    for i, (_, end, header) in enumerate(marks):
        body = text[end : marks[i + 1][0] if i + 1 < len(marks) else len(text)].strip()
        if body:
            out.append((header, body))
    return out


def split_tables(text: str) -> list[tuple[str, str]]:
    """`(kind, text)`: runs of table rows apart from the rest, blank runs left out."""
    out: list[tuple[str, list[str]]] = []
    for line in text.split("\n"):
        kind = "table" if TABLE_ROW.match(line) else "text"
        if out and out[-1][0] == kind:
            out[-1][1].append(line)
        else:
            out.append((kind, [line]))
    return [(k, "\n".join(v)) for k, v in out if "\n".join(v).strip()]


def chunk_text(text: str | None, title: str = "", article: bool = False, config: ChunkConfig = ChunkConfig()) -> list[tuple[str, str, str]]:
    """`(kind, section, content)` of each chunk; null texts and those under `least` characters have none."""
    if text is None or len(text.strip()) < config.least:
        return []
    if article:
        pieces = split_recursive(text, config.article_size, config.article_overlap, COARSE)
        return [("article", title, p) for p in pieces if len(p.strip()) >= config.least]
    out = []
    for header, body in split_sections(text) if config.headers else [("", text)]:
        for kind, part in split_tables(body) if config.tables else [("text", body)]:
            whole = kind == "table" and len(part) < 2 * config.size
            for piece in [part] if whole else split_recursive(part, config.size, config.overlap):
                if len(piece.strip()) >= config.least:
                    out.append((kind, header, f"[Section: {header}]\n\n{piece}" if header else piece))
    return out


def chunk_documents(docs: DataFrame, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """One row per chunk of `doc_id, text, title, doc_type`; chunks of a document are numbered from 0."""
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for d, text, title, kind in frame[["doc_id", "text", "title", "doc_type"]].itertuples(index=False):
                made = chunk_text(text, title or "", (kind or "").strip().lower() in ("article", "news"), config)
                rows += [(d, f"{d}_{i:04d}", i, len(made), k, s, c, len(c)) for i, (k, s, c) in enumerate(made)]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_id", "chunk_index", "total_chunks", "chunk_type", "section_title", "page_content", "chunk_size"])

    return docs.select("doc_id", "text", "title", "doc_type").mapInPandas(run, SCHEMA.format(key=key))


#: The splitter of indexes without sections.
PLAIN = ChunkConfig(size=1000, overlap=200, least=1, headers=False, tables=False)


def plain_chunks(docs: DataFrame, config: ChunkConfig = PLAIN) -> DataFrame:
    """`doc_id, chunk_id, size` of the recursive splitter alone; null and blank texts have no chunks."""
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [
                (d, f"{d}_chunk_{i:04d}", len(piece))
                for d, text in frame.itertuples(index=False)
                for i, piece in enumerate(split_recursive(text or "", config.size, config.overlap, ("\n\n", "\n", ". ", " ", "")))
            ]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_id", "size"])

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {key}, chunk_id string, size int")
