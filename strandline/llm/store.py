"""Token ids in a content-addressed store: unique chunks once, recipes per document, Merkle manifest.

Format, under one folder (all Parquet, so that any store Spark reads will do):

``chunks``    digest BINARY(20), n INT, payload BINARY: ids as little-endian unsigned integers
              of ``width`` bytes; each digest (BLAKE2b of the payload) once.
``recipes``   files in ascending (doc_id, row_id); block INT is the file's number. doc_id, row_id,
              n_tokens, local_start (ids before it in its block), width, digests ARRAY<BINARY>,
              ends ARRAY<LONG> (ids up to each chunk's end), root BINARY(32): Merkle root of digests.
``manifest``  block, n_docs, n_tokens, root: Merkle root of the block's document roots. The root over
              the blocks' roots is the store's; ``write_store`` returns it.

Reading verifies the reconstruction from the payloads upwards: a payload has its digest, a
document's digests have its root, a block's documents the manifest's root, and the blocks, where the
reader names it, the store's. A chunk, document or block that is missing, too many or changed is an
error, never a document less.

Chunks end where a rolling hash of the last 16 ids has ``bits`` zero bits, so equal passages give
equal chunks wherever they stand. One shuffle carries the payloads; every task sends a payload
only the first time it meets it, so copies don't pile up at one digest.

Defined cases: null text is an empty text (its ids are the end id alone); repeated rows and ids
are stored each; null ids come last; an empty table gives an empty store.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW_ID, Scratch, lookup, portions, texts
from .segments import column_encoder

SHORTEST, LONGEST, BITS = 64, 4096, 9
#: Digests a task remembers, to send a payload once.
REMEMBERED = 200_000


def digest(payload: bytes) -> bytes:
    return hashlib.blake2b(payload, digest_size=20).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary tree of SHA-256; an odd node moves up as it is."""
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def chunk_marks(ids: np.ndarray) -> np.ndarray:
    """Where the hash of the last 16 ids lets a chunk end; the hash is built by doubling its window four times."""
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    for span in (1, 2, 4, 8):
        rolled = h.copy()
        rolled[span:] += h[:-span] << np.uint64(span) if len(h) > span else np.uint64(0)
        h = rolled
    return np.flatnonzero((h >> np.uint64(40)) & np.uint64((1 << BITS) - 1) == 0) + 1


def chunk_ends(ids: np.ndarray) -> list[int]:
    """Content-defined ends."""
    return ends_at(chunk_marks(ids).tolist(), len(ids))


def ends_at(marks: list[int], n: int) -> list[int]:
    """Ends of n ids with these marks. None is before SHORTEST, so marks whose 16 ids reach back before the first don't count."""
    ends, at = [], 0
    for mark in marks:
        while mark - at > LONGEST:
            at += LONGEST
            ends.append(at)
        if mark - at >= SHORTEST and mark < n:
            ends.append(mark)
            at = mark
    while n - at > LONGEST:
        at += LONGEST
        ends.append(at)
    return [*ends, n]


def shift_tables(bits: int) -> list[np.ndarray]:
    """For each k < bits: what 2**k zero bytes after it make of a CRC-32, by its four bytes' values."""
    values = np.arange(256, dtype=np.uint32)
    table = np.stack([step_linear(values << np.uint32(8 * i)) for i in range(4)])
    tables = []
    for _ in range(bits):
        tables.append(table)
        table = apply_shift(table, table)
    return tables


def step_linear(c: np.ndarray) -> np.ndarray:
    """One zero byte through the CRC-32 register, without the conditioning at both ends."""
    for _ in range(8):
        c = np.where(c & 1, (c >> np.uint32(1)) ^ np.uint32(0xEDB88320), c >> np.uint32(1)).astype(np.uint32)
    return c


def apply_shift(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][crc >> np.uint32(8) & 255] ^ table[2][crc >> np.uint32(16) & 255] ^ table[3][crc >> np.uint32(24)]


@lru_cache(maxsize=1)
def shifts() -> list[np.ndarray]:
    return shift_tables(44)


def shifted_crc(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """The part of each CRC-32 in that of a message which goes on for ``zeros`` more bytes.

    The CRC-32 of joined messages is the exclusive or of their parts.
    """
    crc = crc.astype(np.uint32)
    for k, table in enumerate(shifts()):
        some = np.flatnonzero(zeros >> k & 1)
        if len(some):
            crc[some] = apply_shift(table, crc[some])
    return crc


def write_store(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, block_docs: int = 20_000, most_blocks: int = 10_000) -> str:
    """Encode every row of docs(doc_id, text) with the end id appended, write the store, and return its root."""
    spark = docs.sparkSession
    rows = texts(docs).withColumn(ROW_ID, F.monotonically_increasing_id()).withColumn("text", F.coalesce("text", F.lit("")))
    kind = (
        "kind string, place binary, n int, payload binary, doc_id long, row_id long, n_tokens long, width int, digests array<binary>, ends array<long>, root binary"
    )
    schema = pa.schema([
        ("kind", pa.string()), ("place", pa.binary()), ("n", pa.int32()), ("payload", pa.binary()), ("doc_id", pa.int64()), (ROW_ID, pa.int64()), ("n_tokens", pa.int64()),
        ("width", pa.int32()), ("digests", pa.list_(pa.binary())), ("ends", pa.list_(pa.int64())), ("root", pa.binary()),
    ])

    def encode(batches):
        encoder = column_encoder(tokenizer_path)
        end, sent = np.array([end_id], encoder.kind).tobytes(), set()
        for batch in portions(batches, "text"):
            chunks, recipes = [], []
            data, begins = encoder.encode(batch["text"], end)
            begins //= encoder.width
            marks = chunk_marks(np.frombuffer(data, encoder.kind))
            upto = np.searchsorted(marks, begins, "right").tolist()
            for i, (row_id, first, last) in enumerate(zip(batch[ROW_ID].to_pylist(), begins[:-1].tolist(), begins[1:].tolist())):
                ends, digests, at = ends_at((marks[upto[i] : upto[i + 1]] - first).tolist(), last - first), [], 0
                for stop in ends:
                    payload = data[(first + at) * encoder.width : (first + stop) * encoder.width]
                    digests.append(name := digest(payload))
                    if name not in sent:
                        if len(sent) < REMEMBERED:
                            sent.add(name)
                        chunks.append((name, stop - at, payload))
                    at = stop
                recipes.append((row_id.to_bytes(8, "little"), last - first, digests, ends, merkle(digests)))
            for kind_name, names, found in (("chunk", ("place", "n", "payload"), chunks), ("recipe", ("place", "n_tokens", "digests", "ends", "root"), recipes)):
                columns = dict(zip(names, zip(*found))) | ({"doc_id": batch["doc_id"], ROW_ID: batch[ROW_ID], "width": [encoder.width] * len(found)} if kind_name == "recipe" else {})
                columns["kind"] = [kind_name] * len(found)
                if found:
                    arrays = [columns[f.name] if isinstance(columns.get(f.name), pa.Array) else pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(len(found), f.type) for f in schema]
                    yield pa.RecordBatch.from_arrays(arrays, schema=schema)
            # Else the pool keeps a portion's memory beside what the next one takes.
            pa.default_memory_pool().release_unused()

    def once(batches):
        last = None
        for batch in batches:
            places = batch["place"].to_pylist()
            kept = [p != q or k != "chunk" for p, q, k in zip(places, [last, *places], batch["kind"].to_pylist())]
            last = places[-1] if places else last
            yield batch.filter(pa.array(kept, pa.bool_()))

    moved = rows.mapInArrow(encode, kind).repartition("place").sortWithinPartitions("place")
    moved.mapInArrow(once, kind).write.mode("overwrite").partitionBy("kind").parquet(f"{path}/written")
    written = spark.read.schema(kind).parquet(f"{path}/written")
    recipes = written.where("kind = 'recipe'").select("doc_id", ROW_ID, "n_tokens", "width", "digests", "ends", "root")
    blocks = max(1, min(most_blocks, -(-recipes.count() // block_docs)))
    plain = "doc_id long, row_id long, n_tokens long, width int, digests array<binary>, ends array<long>, root binary"

    def placed(batches):
        from pyspark import TaskContext

        block, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = np.asarray(batch["n_tokens"])
            local = start + np.cumsum(n) - n
            start += int(n.sum())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(n), block, np.int32)), pa.array(local)], names=[*batch.schema.names, "block", "local_start"])

    ordered = recipes.repartitionByRange(blocks, F.col("doc_id").asc_nulls_last(), ROW_ID).sortWithinPartitions(F.col("doc_id").asc_nulls_last(), ROW_ID)
    ordered.mapInArrow(placed, f"{plain}, block int, local_start long").write.mode("overwrite").parquet(f"{path}/recipes")

    block_roots(spark.read.parquet(f"{path}/recipes")).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")
    return store_root(spark, path)


MANIFEST = "block int, n_docs long, n_tokens long, root binary"


def block_roots(recipes: DataFrame) -> DataFrame:
    """The manifest of recipes(block, local_start, n_tokens, root): a row for each block."""

    def rooted(table: pa.Table) -> pa.Table:
        table = table.sort_by("local_start")
        n = table["n_tokens"].to_numpy()
        if (table["local_start"].to_numpy() != np.cumsum(n) - n).any():
            raise ValueError("a block's documents don't follow one another: a recipe is missing or changed")
        return pa.table({"block": table["block"][:1], "n_docs": [table.num_rows], "n_tokens": [int(n.sum())], "root": [merkle(table["root"].to_pylist())]})

    return recipes.select("block", "local_start", "n_tokens", "root").groupBy("block").applyInArrow(rooted, MANIFEST)


def manifest_rows(manifest: DataFrame) -> list[tuple[int, int, int, bytes]]:
    """The rows by block, at most ``most_blocks`` of them."""
    return sorted((r["block"], r["n_docs"], r["n_tokens"], bytes(r["root"])) for r in manifest.collect())


def root_of(rows: list[tuple[int, int, int, bytes]]) -> str:
    return merkle([b"".join((block.to_bytes(4, "little"), docs.to_bytes(8, "little"), tokens.to_bytes(8, "little"), root)) for block, docs, tokens, root in rows]).hex()


def store_root(spark: SparkSession, path: str) -> str:
    """Hex digits of the Merkle root over the manifest's rows."""
    return root_of(manifest_rows(spark.read.schema(MANIFEST).parquet(f"{path}/manifest")))


def verify_manifest(spark: SparkSession, path: str, root: str | None = None) -> None:
    """An error unless digests give the recipes' roots, these the manifest's rows, each once, and these the ``root``."""
    columns = ["block", "local_start", "n_tokens", "root"]

    def run(batches):
        for batch in batches:
            for name, leaves, ends, n in zip(batch["root"].to_pylist(), batch["digests"].to_pylist(), batch["ends"].to_pylist(), batch["n_tokens"].to_pylist()):
                if merkle(leaves) != name or len(ends) != len(leaves) or ends[-1] != n or any(i >= j for i, j in zip(ends, ends[1:])):
                    raise ValueError("a recipe's digests don't have its root")
            yield batch.select(columns)

    written = manifest_rows(spark.read.schema(MANIFEST).parquet(f"{path}/manifest"))
    recipes = spark.read.parquet(f"{path}/recipes").select(*columns, "digests", "ends")
    found = manifest_rows(block_roots(recipes.mapInArrow(run, "block int, local_start long, n_tokens long, root binary")))
    if written != found:
        raise ValueError(f"recipes and manifest differ in blocks {sorted({r[0] for r in set(written) ^ set(found)})[:5]}")
    if root is not None and root_of(written) != root:
        raise ValueError("the manifest doesn't have the store's root")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """(digest, n, payload) of the unique chunks."""
    return spark.read.schema("kind string, place binary, n int, payload binary").parquet(f"{path}/written").where("kind = 'chunk'").select(F.col("place").alias("digest"), "n", "payload")


def read_recipes(spark: SparkSession, path: str) -> DataFrame:
    """The recipes with ``start``, the ids of all documents before; the manifest has one row a block."""
    from pyspark.sql import Window

    manifest = spark.read.parquet(f"{path}/manifest")
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = manifest.select("block", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("block_start"))
    return spark.read.parquet(f"{path}/recipes").join(F.broadcast(offsets), "block").withColumn("start", F.col("block_start") + F.col("local_start"))


def verified_recipes(spark: SparkSession, path: str, root: str | None) -> DataFrame:
    verify_manifest(spark, path, root)
    return read_recipes(spark, path)


def occurrences(recipes: DataFrame) -> DataFrame:
    """A row for each chunk of each document, with the ids that the recipe gives it."""
    starts = F.concat(F.array(F.lit(0).cast("long")), F.slice("ends", 1, F.size("ends") - 1))
    pieces = F.arrays_zip(F.col("digests").alias("digest"), F.col("ends").alias("end"), starts.alias("from"))
    own = ["doc_id", ROW_ID, "start", "n_tokens", "width"]
    return recipes.select(*own, F.explode(pieces).alias("piece")).select(*own, "piece.digest", "piece.end", (F.col("piece.end") - F.col("piece.from")).alias("need"))


def with_chunks(recipes: DataFrame, chunks: DataFrame) -> DataFrame:
    """Occurrences with the columns of chunks(digest, n, ...); one that isn't there, or has another length, is an error.

    A chunk that very many documents hold is dealt over the tasks.
    """
    found = lookup(occurrences(recipes), chunks.withColumn("there", F.lit(True)), "digest")
    lost = F.concat(F.lit("the store has no chunk "), F.hex("digest"), F.lit(" of "), F.col("need").cast("string"), F.lit(" ids"))
    sound = F.coalesce("there", F.lit(False)) & (F.col("n") == F.col("need"))
    return found.withColumn("end", F.when(sound, F.col("end")).otherwise(F.raise_error(lost))).drop("there", "need")


def read_ids(spark: SparkSession, path: str, root: str | None = None) -> DataFrame:
    """(doc_id, row_id, start, ids ARRAY<LONG>) rebuilt from the store, and verified."""

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("end")
        kind = np.dtype(f"<u{table['width'][0].as_py()}")
        if any(digest(p) != d for p, d in zip(table["payload"].to_pylist(), table["digest"].to_pylist())):
            raise ValueError("a chunk's payload doesn't match its digest")
        ids = np.frombuffer(b"".join(table["payload"].to_pylist()), kind).astype(np.int64)
        if len(ids) != table["n_tokens"][0].as_py():
            raise ValueError("a document doesn't have its ids")
        return pa.table({"doc_id": table["doc_id"][:1], ROW_ID: table[ROW_ID][:1], "start": table["start"][:1], "ids": pa.array([ids], pa.list_(pa.int64()))})

    joined = with_chunks(verified_recipes(spark, path, root), read_chunks(spark, path))
    return joined.groupBy(ROW_ID).applyInArrow(build, f"doc_id long, {ROW_ID} long, start long, ids array<long>")


def read_digests(spark: SparkSession, path: str, root: str | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the store's files, verified up to the manifest.

    Every chunk's payload is read once, checked against its digest and reduced to its CRC-32;
    a document's is put together from its chunks', so that payloads don't move again.
    ids_crc32 takes ids as little-endian unsigned 32-bit integers.
    """

    @F.pandas_udf("long")
    def checked(payload: pd.Series, name: pd.Series, n: pd.Series) -> pd.Series:
        crcs = []
        for p, d, k in zip(payload, name, n):
            if digest(p) != d:
                raise ValueError("a chunk's payload doesn't match its digest")
            crcs.append(zlib.crc32(np.frombuffer(p, f"<u{len(p) // k}").astype("<u4").tobytes()))
        return pd.Series(crcs, dtype="int64")

    @F.pandas_udf("long")
    def part(crc: pd.Series, tail: pd.Series) -> pd.Series:
        return pd.Series(shifted_crc(crc.to_numpy(), 4 * tail.to_numpy()).astype(np.int64))

    # Not computed again for every read of the few columns.
    found = Scratch(spark, "token-store-chunks").keep(read_chunks(spark, path).select("digest", "n", checked("payload", "digest", "n").alias("chunk_crc")), "chunks")
    joined = with_chunks(verified_recipes(spark, path, root), found).withColumn("part", part("chunk_crc", F.col("n_tokens") - F.col("end")))
    whole = joined.groupBy(ROW_ID, "doc_id", "start", "n_tokens").agg(F.bit_xor("part").alias("ids_crc32"))
    return whole.select("doc_id", "start", "n_tokens", "ids_crc32")
