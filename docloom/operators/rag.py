"""Retrieval for questions: neighbours, filters, context and a pluggable language model."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the frame of a prompt.
PROMPT = "Answer the question from the context.\n\nContext:\n%s\n\nQuestion: %s\n\nAnswer:"


def hashing_embedder(dims: int = 64):
    """A pandas UDF that embeds texts by signed hashing of their words, normalised; null and wordless texts give zeros."""

    @F.pandas_udf("array<float>")
    def embed(text: pd.Series) -> pd.Series:
        def one(t: str | None) -> list[float]:
            v = np.zeros(dims)
            for w in (t or "").lower().split():
                h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "little")
                v[h % dims] += 1 if (h >> 40) & 1 else -1
            n = np.linalg.norm(v)
            return (v / n if n else v).astype(np.float32).tolist()

        return text.map(one)

    return embed


def context(found: DataFrame, text: str = "content") -> DataFrame:
    """`query_id, context`: the texts found for a query in the order of their rank, joined by blank lines."""
    return found.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", F.col(text).alias("t")))).alias("parts")).select(
        "query_id", F.array_join(F.transform("parts", lambda p: p["t"]), "\n\n").alias("context")
    )


def prompt(ctx: Column, question: Column) -> Column:
    return F.format_string(PROMPT, ctx, question)


def answer(prompts: DataFrame, model: Callable[[str], str] | None = None) -> DataFrame:
    """`query_id, answer` from a callable that takes a prompt; without one, the prompt's length and digest (for tests)."""
    call = model or (lambda p: f"{len(p)}:{hashlib.sha256(p.encode()).hexdigest()[:8]}")

    @F.pandas_udf("string")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda p: None if p is None else call(p))

    return prompts.select("query_id", ask("prompt").alias("answer"))


def source_records(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """For each chunk found the record that an answer names as its source; missing fields have their defaults, the preview 150 characters."""
    texts = ("source_id", "institution_type", "doc_type", "section_title", "url", "chunk_id", "persona", "life_stage", "risk_level", "product_type")
    have = set(chunks.columns)

    def field(name: str, default) -> Column:
        return F.coalesce(F.col(name), F.lit(default)) if name in have else F.lit(default)

    return found.join(chunks, "vec_id").select(
        "query_id", "rank", field("title", "Unknown").alias("title"), field("source_name", "Unknown").alias("source_name"),
        *[field(t, "").alias("section" if t == "section_title" else t) for t in texts], field("relevance_score", 0.0).alias("relevance_score"),
        F.substring("page_content", 1, 150).alias("preview"),
    )
