"""What the operators share: reading, word classes, row keys and blocks of texts.

Spark bounds an Arrow batch by bytes (64 MB unless the session says otherwise).
Texts are handled as UTF-8 bytes. Both word classes used here end only at ASCII
bytes, so splitting bytes gives the same words as splitting code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A block of texts that is worked on at once; a longer text is a block by itself.
BLOCK_BYTES = 4 << 20

#: Lower-cases A-Z and nothing else.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

#: Lower-cases A-Z; every ASCII byte that is no letter or digit becomes a space.
WORD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)

UPPER_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table; the scan reads no others."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER_LETTERS, UPPER_LETTERS.lower())


def id_remainder(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text (remainder 0)."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(parts))


def texts_of(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def blocks(
    batches: Iterator[pa.RecordBatch], text: int = 1, most: int = BLOCK_BYTES
) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cut Arrow batches into blocks of about ``most`` bytes of text, whole rows each."""
    for batch in batches:
        texts = texts_of(batch.column(text))
        start, size = 0, 0
        for i, t in enumerate(texts):
            if size and size + len(t) > most:
                yield batch.slice(start, i - start), texts[start:i]
                start, size = i, 0
            size += len(t)
        if start < len(texts):
            yield batch.slice(start), texts[start:]
