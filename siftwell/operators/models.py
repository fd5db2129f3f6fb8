"""Embedding and synopsis by plugged-in functions of lists of texts, called in Arrow batches on the executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.operators.catalog import stale_embeddings

#: Characters of a document that an embedder and a summarizer see, and texts in one call.
EMBED_CHARS, SYNOPSIS_CHARS, CALL = 8000, 4000, 64


def _joined(*columns: Column) -> Column:
    return F.concat_ws(" ", *[F.nullif(F.coalesce(c, F.lit("")), F.lit("")) for c in columns])


def embedding_text() -> Column:
    """Title, or name without one, description and snippet."""
    title = F.coalesce(F.nullif("title", F.lit("")), F.col("name"))
    return F.substring(_joined(title, F.col("description"), F.col("content_snippet")), 1, EMBED_CHARS)


def _called(rows: DataFrame, function: Callable[[list[str]], list], schema: str, column: str) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for a in range(0, len(frame), CALL):
                part = frame.iloc[a : a + CALL]
                got = function(part["text"].tolist())
                if len(got) != len(part):
                    raise ValueError(f"{len(part)} texts gave {len(got)} results")
                yield pd.DataFrame({"doc_id": part["doc_id"].tolist(), column: got})

    return rows.mapInPandas(run, schema)


def embed_stale(documents: DataFrame, embeddings: DataFrame, embedder: Callable[[list[str]], list[list[float]]], model: str) -> DataFrame:
    """(doc_id, embedding, model, updated_at) of the documents that have no embedding of this model or an older one than themselves."""
    due = documents.join(stale_embeddings(documents, embeddings, model).select("doc_id").distinct(), "doc_id", "left_semi")
    made = _called(due.select("doc_id", embedding_text().alias("text")), embedder, "doc_id long, embedding array<float>", "embedding")
    return made.select("doc_id", "embedding", F.lit(model).alias("model"), F.current_timestamp().alias("updated_at"))


def merge_embeddings(embeddings: DataFrame, made: DataFrame) -> DataFrame:
    """embeddings with made in place of what those documents had."""
    return embeddings.join(made.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(made)


def synopses(documents: DataFrame, summarizer: Callable[[list[str]], list[str]]) -> DataFrame:
    """(doc_id, synopsis): what is stored, else what the summarizer makes of description and snippet; nothing to go by gives null."""
    has = F.coalesce("synopsis", F.lit("")) != ""
    text = F.substring(_joined(F.col("description"), F.col("content_snippet")), 1, SYNOPSIS_CHARS)
    todo = documents.where(~has).select("doc_id", text.alias("text"))
    made = _called(todo.where("text != ''"), summarizer, "doc_id long, synopsis string", "synopsis")
    empty = todo.where("text = ''").select("doc_id", F.lit(None).cast("string").alias("synopsis"))
    return documents.where(has).select("doc_id", "synopsis").unionByName(made).unionByName(empty)
