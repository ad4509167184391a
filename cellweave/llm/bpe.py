"""Byte-level BPE by recursive DuckDB queries inside each task.

A task keeps an in-memory DuckDB of its own with the merge table: every pair of tokens
whose joined bytes are a token, with that token's rank. The distinct pre-tokens of a
block become rows ``(word, place, token, following token)``. The recursive query joins
the rows with the merge table, takes each word's leftmost pair of minimum rank, contracts
it (the left row goes, the right one becomes the joined token), and goes on until a word
has no pair left, when its rows are final. An aggregation ordered by place gives each
word's ids, and a second one its decoded bytes.

Encoded pre-tokens are kept for the following blocks of the task, up to a bound after
which the store starts anew, so memory does not grow with the partition. A pre-token of
more than ``LONG_BYTES`` contracts the same pairs in the same order from a heap in
Python: a query would need as many rounds over as many rows as it has bytes.

Defined cases: null and empty texts have no ids and decode to no bytes; special tokens
are ordinary text; repeated rows and ids are kept; an empty table gives an empty result.
Only the named columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import blocks

#: Encoded pre-tokens a task keeps.
STORED_WORDS = 400_000

#: Pre-tokens of more bytes are contracted from a heap.
LONG_BYTES = 200

#: White space of the pattern's ``\\s`` is the Unicode property, as in the original library.
SPACE = r"\p{White_Space}"

CONTRACT = """
WITH RECURSIVE step(word, place, token, following, done) AS (
    SELECT word, place, token, following, false FROM start
  UNION ALL
    SELECT s.word,
           s.place - (s.place > coalesce(b.best, s.place))::INT,
           CASE WHEN s.place = b.best + 1 THEN b.made ELSE s.token END,
           CASE WHEN s.place = b.best - 1 THEN b.made ELSE s.following END,
           b.best IS NULL
    FROM step s LEFT JOIN (
      SELECT word, (least % 65536)::INT AS best, (least // 65536)::INT AS made
      FROM (
        SELECT l.word, min(m.made * 65536 + l.place) AS least
        FROM step l JOIN merges m ON m.a = l.token AND m.b = l.following
        WHERE NOT l.done
        GROUP BY l.word
      )
    ) b ON b.word = s.word
    WHERE NOT s.done AND s.place IS DISTINCT FROM b.best
)
SELECT word, list(token ORDER BY place) AS ids FROM step WHERE done GROUP BY word
"""

DECODE = """
SELECT word, string_agg(bytes, '' ORDER BY place) AS hex FROM encoded JOIN tokens USING (id) GROUP BY word
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


def compiled(pattern: str) -> regex.Pattern:
    """The pre-token pattern, with ``\\s`` and ``\\S`` spelled out as the Unicode property."""
    inside = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^{SPACE}\p{{L}}\p{{N}}]")
    return regex.compile(inside.replace(r"\s", SPACE).replace(r"\S", rf"[^{SPACE}]"))


def heap_contract(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Contract the leftmost pair of minimum rank until none is left."""
    part: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
    after = list(range(1, len(word) + 1))
    before = list(range(-1, len(word) - 1))

    def pair(i: int):
        if i >= 0 and after[i] < len(part) and (rank := ranks.get(part[i] + part[after[i]])) is not None:
            heapq.heappush(heap, (rank, i, part[i], part[after[i]]))

    heap: list = []
    for i in range(len(word) - 1):
        pair(i)
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = after[i]
        if part[i] != left or j >= len(part) or part[j] != right:
            continue
        part[i], part[j] = left + right, None
        after[i] = after[j]
        if after[j] < len(part):
            before[after[j]] = i
        pair(before[i])
        pair(i)
    return [ranks[p] for p in part if p is not None]


class Coder:
    """Encodes and decodes distinct pre-tokens; one for each task."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.done: dict[str, tuple[bytes, bytes]] = {}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        left, right, made = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), made.append(rank)
        merges = pa.table({"a": pa.array(left, pa.int32()), "b": pa.array(right, pa.int32()), "made": pa.array(made, pa.int64())})
        tokens = pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "bytes": [t.hex() for t in ranks]})
        for name, table in (("merges", merges), ("tokens", tokens)):
            self.db.register("given", table)
            self.db.execute(f"CREATE TABLE {name} AS FROM given")
            self.db.unregister("given")
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)

    def _rows(self, words: list[bytes]) -> pa.Table:
        sizes = np.array([len(w) for w in words], np.int64)
        begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        token = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        following = np.append(token[1:], np.int32(-1))
        following[begin[1:] - 1] = -1
        return pa.table(
            {
                "word": np.repeat(np.arange(len(words), dtype=np.int32), sizes),
                "place": (np.arange(len(token)) - np.repeat(begin, sizes)).astype(np.int32),
                "token": token,
                "following": following,
            }
        )

    def _contracted(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as little-endian bytes."""
        self.db.register("start", self._rows(words))
        found = self.db.sql(CONTRACT).to_arrow_table().combine_chunks()
        self.db.unregister("start")
        result = [b""] * len(words)
        lists = found.column("ids").chunk(0)
        flat = lists.values.to_numpy().astype("<u4").tobytes()
        bounds = (4 * lists.offsets.to_numpy().astype(np.int64)).tolist()
        for i, word in enumerate(found.column("word").to_pylist()):
            result[word] = flat[bounds[i] : bounds[i + 1]]
        return result

    def _decoded(self, ids: list[bytes]) -> list[bytes]:
        bounds = np.concatenate(([0], np.cumsum([len(i) // 4 for i in ids]))).astype(np.int32)
        flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
        size = np.diff(bounds)
        places = pa.table(
            {
                "word": np.repeat(np.arange(len(ids), dtype=np.int32), size),
                "place": np.arange(len(flat), dtype=np.int32) - np.repeat(bounds[:-1], size),
                "id": flat,
            }
        )
        self.db.register("encoded", places)
        found = self.db.sql(DECODE).to_arrow_table()
        self.db.unregister("encoded")
        result = [b""] * len(ids)
        for word, text in zip(found.column("word").to_pylist(), found.column("hex").to_pylist()):
            result[word] = bytes.fromhex(text)
        return result

    def learn(self, words: set[str]) -> None:
        """Encode and decode the pre-tokens not yet stored."""
        if len(self.done) > STORED_WORDS:
            self.done.clear()
        new = [w for w in words if w not in self.done]
        raw = [w.encode() for w in new]
        ids = [b""] * len(new)
        short = []
        for i, w in enumerate(raw):
            if w in self.ranks:
                ids[i] = self.ranks[w].to_bytes(4, "little")
            elif len(w) > LONG_BYTES:
                ids[i] = np.array(heap_contract(w, self.ranks), "<u4").tobytes()
            else:
                short.append(i)
        for i, found in zip(short, self._contracted([raw[i] for i in short]) if short else []):
            ids[i] = found
        self.done.update(zip(new, zip(ids, self._decoded(ids) if new else [])))


def encode_blocks(ranks: dict[bytes, int], pattern: str, batches: Iterator[pa.RecordBatch], text: int):
    """Blocks of rows with the ids (as bytes) and the decoded bytes of their texts."""
    coder, find = Coder(ranks), compiled(pattern).findall
    for rows, texts in blocks(batches, text):
        pieces = [find(t.decode()) for t in texts]
        coder.learn(set().union(*pieces))
        done = coder.done
        coded = [[done[p] for p in found] for found in pieces]
        yield rows, [b"".join([c[0] for c in x]) for x in coded], [b"".join([c[1] for c in x]) for x in coded]


def _ids_of(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, "<u4").astype(np.int64)


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """The documents with ``ids`` (array of int) and ``decoded`` (binary) in the place of further columns."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    columns = docs.columns
    at = columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, ids, decoded in encode_blocks(ranks.value, pattern, batches, at):
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array([_ids_of(i) for i in ids], pa.list_(pa.int32())), pa.array(decoded, pa.binary())],
                names=[*columns, "ids", "decoded"],
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, ids array<int>, decoded binary")


def digest(docs: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: number of ids, SHA-256 of the ids (little-endian, 32 bits) and of the decoded bytes."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    read = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, ids, decoded in encode_blocks(ranks.value, pattern, batches, 1):
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0),
                    pa.array([len(i) // 4 for i in ids], pa.int64()),
                    pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()),
                    pa.array([hashlib.sha256(d).hexdigest() for d in decoded], pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    id_type = docs.schema[doc_id].dataType.simpleString()
    return read.mapInArrow(run, f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string")
