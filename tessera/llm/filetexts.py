"""Whole file texts from their chunks, streamed file by file."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_file(files: DataFrame, chunks: DataFrame, work: Callable[..., tuple | None], file_cols: list[str], schema: str) -> DataFrame:
    """The rows that ``work(file id, columns of the file, text)`` gives for each file; None gives no row.

    The text is the file's chunks in chunk_index order, joined by a line break; repeated rows of a chunk count once, and a null chunk text
    reads as empty. The rows of both tables are put together, shuffled once by file and sorted, each file's own row first, and streamed, so one file
    is held at a time. Files without chunks and chunks without a file are left out.
    """
    left = files.select(F.col("id").cast("bigint").alias("file_id"), F.lit(-1).cast("bigint").alias("place"), F.lit(None).cast("bigint").alias("chunk_id"), F.lit(None).cast("string").alias("text"), *file_cols)
    empty = [F.lit(None).cast(t).alias(c) for c, t in left.dtypes if c in file_cols]
    right = chunks.select(F.col("file_id").cast("bigint").alias("file_id"), F.coalesce(F.col("chunk_index"), F.lit(0)).cast("bigint").alias("place"), F.coalesce("id", F.lit(0)).cast("bigint").alias("chunk_id"), F.coalesce("text", F.lit("")).alias("text"), *empty)
    rows = left.unionByName(right).filter("file_id is not null").repartition("file_id").sortWithinPartitions("file_id", F.col("chunk_id").isNotNull(), "place", "chunk_id")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, about, parts, last, out = None, None, [], None, []

        def close() -> None:
            if about is not None and parts:
                row = work(current, about, "\n".join(parts))
                if row is not None:
                    out.append(row)

        for batch in batches:
            columns = [batch[c].tolist() for c in ("file_id", "place", "chunk_id", "text", *file_cols)]
            for file_id, place, chunk_id, text, *rest in zip(*columns, strict=True):
                if file_id != current:
                    close()
                    current, about, parts, last = file_id, None, [], None
                if text is None:
                    about = tuple(rest)
                    continue
                if (place, chunk_id) != last and about is not None:
                    parts.append(text)
                last = (place, chunk_id)
            yield pd.DataFrame(out, columns=names)
            out.clear()
        close()
        yield pd.DataFrame(out, columns=names)

    return rows.mapInPandas(run, schema)
