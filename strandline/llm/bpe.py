"""Byte-level BPE by rank tables: overlapping chunk encoding, and decoding to raw bytes.

Texts of up to ``chunk_chars`` are pre-tokenised at once. Longer ones are cut into overlapping
chunks, which are pre-tokenised in parallel tasks; the boundaries of neighbouring chunks are
stitched where both have the same one, from which point on both scans go alike. If an overlap
holds none (one pre-token longer than it, say), scanning resumes at the last sure boundary until
it meets the next chunk's. Each pre-token is then encoded by itself.

Defined cases: null text is an empty text; an empty text has no ids and decodes to no bytes;
repeated rows and ids each get a result; null ids stay null; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW_ID, slices, texts

#: A boundary this close to a chunk's end may move once the following characters are known.
LOOKAHEAD = 2
ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])


class RankEncoder:
    """Pre-tokens to ids, with a bounded store of those met before."""

    def __init__(self, ranks_path: str, pattern: str, room: int = 400_000):
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.scan = regex.compile(pattern)
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.merges = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, tuple[int, ...]] = {}
        self.room = room

    def pieces(self, text: str) -> list[str]:
        return self.scan.findall(text)

    def ids(self, pieces: list[str]) -> list[int]:
        known = self.known
        new = [piece for piece in set(pieces) if piece not in known]
        for piece in new:
            known[piece] = tuple(self.merges.encode_ordinary(piece))
        found = list(chain.from_iterable(map(known.__getitem__, pieces)))
        if len(known) > self.room:
            for piece in new:
                del known[piece]
        return found

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def rank_encoder(ranks_path: str, pattern: str) -> RankEncoder:
    return RankEncoder(ranks_path, pattern)


def chunked(text: str, chunk_chars: int, overlap: int) -> list[tuple[int, str]]:
    """(start, chunk) so that neighbours share ``overlap`` characters."""
    step = chunk_chars - overlap
    return [(at, text[at : at + chunk_chars]) for at in range(0, max(1, len(text) - overlap), step)]


def ends_of(pieces: list[str]) -> list[int]:
    return list(accumulate(map(len, pieces)))


def stitched(scan, chunks: list[tuple[int, str, list[int]]]) -> tuple[str, list[int]]:
    """The whole text and its pre-tokens' ends, from (start, chunk, ends within the chunk)."""
    whole, at = [], 0
    for start, chunk, _ in chunks:
        whole.append(chunk[at - start :])
        at = start + len(chunk)
    text = "".join(whole)
    sure: list[int] = [0]
    for start, chunk, ends in chunks:
        stop = start + len(chunk)
        limit = stop if stop == len(text) else stop - LOOKAHEAD
        own = [start, *(start + e for e in ends if start + e <= limit)] if start == 0 or ends else [start]
        there = set(own)
        low = len(sure)
        while low and sure[low - 1] >= start:
            low -= 1
        common = next((i for i in range(low, len(sure)) if sure[i] in there), None)
        if common is None:
            for match in scan.finditer(text, sure[-1]):
                if match.end() > limit and stop != len(text):
                    break
                sure.append(match.end())
                if match.end() in there:
                    common = len(sure) - 1
                    break
        if common is not None:
            meet = sure[common]
            del sure[common + 1 :]
            sure.extend(e for e in own if e > meet)
    return text, sure[1:]


def cut(text: str, ends: list[int]) -> list[str]:
    return [text[i:j] for i, j in zip([0, *ends], ends)]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, chunk_chars: int = 1 << 15, overlap: int = 1 << 10) -> DataFrame:
    """(doc_id, ids ARRAY<INT>) of every row of docs(doc_id, text)."""
    rows = texts(docs).withColumn("text", F.coalesce("text", F.lit("")))
    kind = "doc_id long, ids array<int>"

    def whole(batches):
        encoder = rank_encoder(ranks_path, pattern)
        for batch in slices(batches):
            ids = [np.array(encoder.ids(encoder.pieces(t)), np.int32) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(ids, pa.list_(pa.int32()))], schema=ENCODED)

    chunk_schema = pa.schema([(ROW_ID, pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("chunk", pa.string())])

    def split(batches):
        for batch in slices(batches, 1):
            row = batch.to_pylist()[0]
            parts = chunked(row["text"], chunk_chars, overlap)
            for at in range(0, len(parts), 64):
                yield pa.RecordBatch.from_pylist([{ROW_ID: row[ROW_ID], "doc_id": row["doc_id"], "start": s, "chunk": c} for s, c in parts[at : at + 64]], schema=chunk_schema)

    scanned_schema = chunk_schema.append(pa.field("ends", pa.list_(pa.int32())))

    def scan(batches):
        encoder = rank_encoder(ranks_path, pattern)
        for batch in slices(batches, 32):
            ends = [ends_of(encoder.pieces(c)) for c in batch["chunk"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends, pa.list_(pa.int32()))], schema=scanned_schema)

    def join(table: pa.Table) -> pa.Table:
        encoder = rank_encoder(ranks_path, pattern)
        table = table.sort_by("start")
        chunks = list(zip(table["start"].to_pylist(), table["chunk"].to_pylist(), table["ends"].to_pylist()))
        ids = encoder.ids(cut(*stitched(encoder.scan, chunks)))
        return pa.table({"doc_id": table["doc_id"][:1], "ids": pa.array([np.array(ids, np.int32)], pa.list_(pa.int32()))}, schema=ENCODED)

    size = F.length("text")
    short = rows.where(size <= chunk_chars).mapInArrow(whole, kind)
    named = rows.where(size > chunk_chars).withColumn(ROW_ID, F.monotonically_increasing_id())
    chunks = named.mapInArrow(split, f"{ROW_ID} long, doc_id long, start long, chunk string")
    ends = chunks.repartition(ROW_ID, "start").mapInArrow(scan, f"{ROW_ID} long, doc_id long, start long, chunk string, ends array<int>")
    return short.unionByName(ends.groupBy(ROW_ID).applyInArrow(join, kind))


def decode_documents(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, decoded BINARY): the ids' bytes one after another."""
    schema = ENCODED.append(pa.field("decoded", pa.binary()))

    def run(batches):
        encoder = rank_encoder(ranks_path, pattern)
        for batch in slices(batches):
            ids = batch["ids"]
            flat, edges = ids.flatten().to_pylist(), (np.asarray(ids.offsets) - ids.offsets[0].as_py()).tolist()
            decoded = [encoder.decode(flat[i:j]) for i, j in zip(edges, edges[1:])]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], ids.cast(ENCODED.field("ids").type), pa.array(decoded, pa.binary())], schema=schema)

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")
