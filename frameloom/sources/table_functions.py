"""The parsers as table functions of SQL: `SELECT f.path, c.* FROM files f, LATERAL png_chunks(f.content) c`.

Each takes a file's content and yields the rows that its DataFrame form has for the file; Spark sends contents and rows in
Arrow batches. Contents that are null or of another kind give no rows. Spark 4.1 has no LATERAL for functions of
whole Arrow batches, so these are called file by file.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from frameloom.operators import container, metadata


def _table_function(rows: Callable[[bytes | None], Iterator[tuple]], shape: str):
    class Parser:
        def eval(self, content):
            yield from rows(content)

    return udtf(Parser, returnType=shape, useArrow=True)


#: name -> rows of a content, and their schema; the DataFrame forms are made of the same two.
PARSERS: dict[str, tuple[Callable[[bytes | None], Iterator[tuple]], str]] = {
    "png_chunks": (container.chunk_rows, container.CHUNK),
    "jpeg_segments": (metadata.segment_rows, metadata.SEGMENT),
    "exif_tags": (metadata.tag_rows, metadata.TAG),
    "text_chunks": (metadata.text_rows, metadata.TEXT),
    "gif_frames": (container.gif_rows, container.GIF_FRAME),
}


def register_table_functions(spark: SparkSession, prefix: str = "") -> list[str]:
    """Make the parsers known to SQL in this session, under their names with a prefix."""
    for name, (rows, shape) in PARSERS.items():
        spark.udtf.register(prefix + name, _table_function(rows, shape))
    return [prefix + name for name in PARSERS]
