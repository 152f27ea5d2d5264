"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming check, components.

Fingerprints of ``blocks`` blocks that differ in at most ``max_bits`` bits agree on some
``blocks - max_bits`` whole blocks. Every choice of that many blocks is a join key; with 6 blocks
and 3 bits a key has about 32 bits, so chance meetings stay rare up to billions of rows. Equal
fingerprints are merged before. A key with many different fingerprints is cut into tiles of
bounded size, every two parts of it meeting in one tile; a tile reports its connected pieces as
stars, never its pairs.

Defined cases: null text is an empty text; a text without words has fingerprint zero and is
linked like any other; repeated rows each get a result; rows with a null id take part and get the
smallest id of their component (null if it has none); an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lookup, per_slice, texts
from .components import connected_components

#: Bytes of a text taken apart at once; a longer text is taken in pieces that end between words.
PIECE = 1 << 20
SPACE = re.compile(rb"[\x20\x09-\x0D]")


def word_blocks(raw: bytes, overlap: int, size: int = PIECE):
    """Lists of words; each starts with the last ``overlap`` words of the one before."""
    at, carried = 0, []
    while at < len(raw):
        end = len(raw)
        if end - at > size:
            gap = SPACE.search(raw, at + size)
            end = gap.start() if gap else end
        words = carried + raw[at:end].split()
        at = end
        if words:
            yield words
            carried = words[len(words) - overlap :] if overlap and len(words) >= overlap else (words if overlap else [])


def shingle_hashes(text: str | None, shingle: int, seed: int):
    """Arrays of the shingles' XXH64, repeats included; the sequence itself if it is shorter."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower()
    digest, short, some = xxhash.xxh64_intdigest, None, False
    for words in word_blocks(raw, shingle - 1):
        if len(words) < shingle:
            short = words
            continue
        some = True
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = [0, *ends[: len(words) - shingle].tolist()]
        stops = (ends[shingle - 1 :] - 1).tolist()
        yield np.fromiter((digest(joined[i:j], seed) for i, j in zip(starts, stops)), np.uint64, len(stops))
    if short and not some:
        yield np.array([digest(b" ".join(short), seed)], np.uint64)


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """64 bits; a bit is set if more than half of the shingles' hashes have it."""
    total, ones = 0, np.zeros(64, np.int64)
    for hashes in shingle_hashes(text, shingle, seed):
        for at in range(0, len(hashes), 1 << 16):
            some = hashes[at : at + (1 << 16)]
            total += len(some)
            ones += np.unpackbits(some.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big") if total else 0


#: Multipliers and offsets of the min-wise hashes: any odd numbers do.
BANDS, BAND_ROWS = 32, 6
_DRAW = np.random.default_rng(20_240_601)
SPREAD = _DRAW.integers(1, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) | np.uint64(1)
OFFSET = _DRAW.integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64)


def shingle_set(parts) -> np.ndarray:
    """The different hashes of a text's shingle_hashes, ascending."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *parts]))


class Sketch(NamedTuple):
    fp: int
    set_id: int  # digest of the set of shingles
    size: int  # different shingles
    least: np.ndarray  # min-wise hashes of the set (all ones without words)


def sketch(text: str | None, shingle: int = 5, seed: int = 42) -> Sketch:
    total, ones, parts = 0, np.zeros(64, np.int64), []
    least = np.full(len(SPREAD), np.iinfo(np.uint64).max)
    for hashes in shingle_hashes(text, shingle, seed):
        total += len(hashes)
        parts.append(hashes)
        for at in range(0, len(hashes), 1 << 12):
            some = hashes[at : at + (1 << 12)]
            ones += np.unpackbits(some.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int32)
            np.minimum(least, (some[:, None] * SPREAD + OFFSET).min(0), out=least)
    fp = int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big") if total else 0
    own = shingle_set(parts)
    return Sketch(fp, xxhash.xxh64_intdigest(own.tobytes(), seed), len(own), least)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp LONG) of every row of docs(doc_id, text)."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batch):
        return {"doc_id": batch["doc_id"], "fp": [signed(fingerprint(t, shingle, seed)) for t in batch["text"].to_pylist()]}

    return texts(docs).mapInArrow(per_slice(run, schema), "doc_id long, fp long")


def masks(blocks: int, max_bits: int) -> list[int]:
    """The bits of every choice of blocks - max_bits whole blocks, as signed 64-bit numbers."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    block = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    return [signed(sum(some)) for some in itertools.combinations(block, blocks - max_bits)]


def stars(fps: np.ndarray, near) -> tuple[np.ndarray, np.ndarray]:
    """Connected pieces of distinct, ascending fingerprints: (smallest, other) for each other.

    near(front, rest) tells for indices front and rest which of them are linked.
    """
    n, seen, low, high = len(fps), np.zeros(len(fps), bool), [], []
    for first in range(n):
        if seen[first]:
            continue
        seen[first] = True
        front, piece = np.array([first]), []
        while len(front):
            rest = np.flatnonzero(~seen)
            hit = np.zeros(len(rest), bool)
            for at in range(0, len(front), 64):
                left = np.flatnonzero(~hit)
                hit[left] = near(front[at : at + 64], rest[left]).any(0)
            front = rest[hit]
            seen[front] = True
            piece.append(fps[front])
        others = np.concatenate(piece)
        low.append(np.full(len(others), fps[first]))
        high.append(others)
    empty = np.zeros(0, np.int64)
    return (np.concatenate(low), np.concatenate(high)) if low else (empty, empty)


def hamming(max_bits: int):
    """For star_runs: links of at most max_bits different bits."""

    def over(fps: np.ndarray, _):
        bits = fps.view(np.uint64)  # of a signed number numpy counts the bits of its absolute value
        return lambda front, rest: np.bitwise_count(bits[front, None] ^ bits[None, rest]) <= max_bits

    return over


def agreeing(similarity: float):
    """For star_runs: links of sketches that agree in at least that share."""

    def over(_, sketches: np.ndarray):
        need = similarity * sketches.shape[1]
        return lambda front, rest: (sketches[front][:, None, :] == sketches[rest][None, :, :]).sum(2) >= need

    return over


def similar_sets(similarity: float):
    """For star_runs: links of sets of hashes whose Jaccard similarity is at least that, counted exactly."""

    def over(_, sets: list[np.ndarray]):
        sizes = np.array(list(map(len, sets)))
        words, places = np.unique(np.concatenate(sets), return_inverse=True)
        own = np.split(places, np.cumsum(sizes)[:-1])
        marked = np.zeros(len(words), bool)

        def near(front, rest):
            # Only whether a row of the front meets it matters, so what is found isn't compared again.
            hit, left = np.zeros((len(front), len(rest)), bool), np.arange(len(rest))
            for k, f in enumerate(front):
                small, large = np.minimum(sizes[f], sizes[rest[left]]), np.maximum(sizes[f], sizes[rest[left]])
                marked[own[f]] = True
                for at in left[small >= similarity * large - 1e-9]:
                    both = np.count_nonzero(marked[own[rest[at]]])
                    hit[k, at] = both >= similarity * (sizes[f] + sizes[rest[at]] - both) - 1e-9
                marked[own[f]] = False
                left = left[~hit[k, left]]
            return hit

        return near

    return over


def read_sketches(some: pa.ChunkedArray) -> np.ndarray:
    return np.stack([np.frombuffer(x, np.uint8) for x in some.to_pylist()])


def star_runs(over, column: str | None = None, read=None):
    """For mapInArrow over rows sorted by (key, tile): the stars of every run, a run at a time.

    ``over`` makes the link test of a run from its fingerprints and what ``read`` makes of ``column``.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def flush(table: pa.Table, edges: np.ndarray):
        fps = table["fp"].to_numpy()
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, j in zip(edges, edges[1:]):
            own, at = np.unique(fps[i:j], return_index=True)
            if len(own) < 2:
                continue
            low, high = stars(own, over(own, read(table[column].slice(i, j - i).take(pa.array(at))) if column else None))
            a.append(low)
            b.append(high)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], schema=schema)

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            keys = np.stack([held["key"].to_numpy(), held["tile"].to_numpy()])
            edges = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
            if len(edges):
                yield flush(held, np.r_[0, edges])
                held = held.slice(edges[-1])
        if held is not None:
            yield flush(held, np.array([0, held.num_rows]))

    return run


def in_tiles(keyed: DataFrame, tile: int, most: int | None = None) -> DataFrame:
    """The rows of keyed(key, fp, ...) with a column tile, for the keys that several rows share.

    ``tile`` bounds the rows that meet in one place, and ``most`` the sum of their column size: a
    key with more is dealt into parts, and each two parts get a tile of their own. Rows of a key
    that very many share learn its parts where they are, so the key is never in one task as a whole.
    """
    count, parts = F.count("*").alias("count"), F.ceil(F.col("count") / tile)
    if most:
        sizes, parts = keyed.groupBy("key").agg(count, F.sum("size").alias("sum")), F.greatest(parts, F.ceil(F.col("sum") / most))
    else:
        sizes = keyed.groupBy("key").agg(count)
    sizes = sizes.where("count > 1").select("key", "count", parts.alias("parts"))
    part = F.pmod(F.xxhash64(F.lit(7), "fp"), F.col("parts"))
    tiles = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda i: F.least(i, part) * F.col("parts") + F.greatest(i, part))
    found = lookup(keyed, sizes.drop("count"), "key", "inner", counts=sizes)
    return found.select(*keyed.columns, F.explode(tiles).alias("tile"))


def tile_edges(dealt: DataFrame, runs) -> DataFrame:
    return dealt.repartition("key", "tile").sortWithinPartitions("key", "tile").mapInArrow(runs, "a long, b long").distinct()


def links(fps: DataFrame, max_bits: int = 3, blocks: int = 6, tile: int = 2048) -> DataFrame:
    """Edges (a, b) that connect exactly what Hamming distance <= max_bits connects.

    ``fps`` has one row per different fingerprint.
    """
    pieces = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(masks(blocks, max_bits))])
    keyed = fps.select("fp", F.explode(pieces).alias("key"))
    return tile_edges(in_tiles(keyed, tile), star_runs(hamming(max_bits)))


def near_duplicate_components(docs: DataFrame, shingle: int = 3, max_bits: int = 3, blocks: int = 6, seed: int = 42, tile: int = 2048) -> DataFrame:
    """(doc_id, fp, component_id) of every row of docs(doc_id, text).

    component_id is the smallest doc_id that links of at most ``max_bits`` bits reach.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.keep(fingerprints(docs, shingle, seed), "fingerprints")
    least = scratch.keep(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("count")), "distinct")
    roots = connected_components(links(least.select("fp"), max_bits, blocks, tile), scratch)
    rooted = scratch.keep(least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    smallest = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = lookup(rooted.select("fp", "root"), smallest, "root").select("fp", "component_id")
    return lookup(rows, named, "fp", "inner", counts=least.select("fp", "count")).select("doc_id", "fp", "component_id")


def similar_links(sketches: DataFrame, similarity: float, tile: int = 1024) -> DataFrame:
    """Edges (a, b) of the sets of sketches(fp, bands ARRAY<LONG>, sketch) that agree in at least ``similarity``."""
    keyed = sketches.select("fp", F.posexplode("bands").alias("band", "value")).select("fp", F.xxhash64("band", "value").alias("key"))
    return tile_edges(in_tiles(keyed, tile).join(sketches.select("fp", "sketch"), "fp"), star_runs(agreeing(similarity), "sketch", read_sketches))


def deduplicate(
    docs: DataFrame, shingle: int = 5, similarity: float = 0.8, max_bits: int = 3, blocks: int = 6, seed: int = 42, slack: float = 0.15, tile: int = 1024, most: int = 1 << 20
) -> DataFrame:
    """One row of each group of near-duplicates, all columns of docs as they were.

    Linked are sets of ``shingle`` words whose Jaccard similarity is ``similarity`` or more, counted
    on the sets themselves. Which sets are compared is found in two ways: bands of min-wise hashes
    (a pair at 0.8 shares one with probability 0.9999) whose sketches agree to within ``slack`` of
    ``similarity``, five standard errors; and fingerprints within ``max_bits`` bits, by pigeonhole
    blocks. What these connect is a cluster, and all pairs of a cluster are compared, in tiles of
    two parts of about ``tile`` texts and ``most`` shingles each.

    The row with the smallest id stays, null ids last; of rows alike in id and text the one whose
    other columns come first as JSON. A null text is an empty one; texts without a word are each
    other's copies; one of fewer than ``shingle`` words has itself as its only shingle; an empty table
    gives an empty one.
    """
    scratch, exact = Scratch(docs.sparkSession, "dedup"), Scratch(docs.sparkSession, "dedup-exact")
    text_hash = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    fields = [("doc_id", pa.int64()), ("text_hash", pa.int64()), ("fp", pa.int64()), ("set_id", pa.int64()), ("size", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())]
    schema = pa.schema(fields)

    def run(batch):
        found = [sketch(t, shingle, seed) for t in batch["text"].to_pylist()]
        least = np.stack([f.least for f in found]) if found else np.zeros((0, len(SPREAD)), np.uint64)
        rows = least.reshape(len(found), BANDS, BAND_ROWS)
        bands = (rows * SPREAD[:BAND_ROWS]).sum(2, dtype=np.uint64).view(np.int64)
        return {
            "doc_id": batch["doc_id"], "text_hash": batch["text_hash"], "fp": [signed(f.fp) for f in found], "set_id": [signed(f.set_id) for f in found], "size": [f.size for f in found],
            "bands": list(bands), "sketch": [x.tobytes() for x in (least >> np.uint64(20) & np.uint64(255)).astype(np.uint8)],
        }

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_hash.alias("text_hash"))
    kind = "doc_id long, text_hash long, fp long, set_id long, size long, bands array<long>, sketch binary"
    rows = scratch.keep(rows.mapInArrow(per_slice(run, schema), kind), "rows")
    sketches = scratch.keep(rows.groupBy(F.col("set_id").alias("fp")).agg(F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "sketches")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash", "n", "size")
    counted = rows.groupBy("set_id", "doc_id", "text_hash").agg(F.count("*").alias("n"), F.first("size").alias("size"))
    best = scratch.keep(counted.groupBy("set_id").agg(F.min(order).alias("best")), "best")

    # Candidates: the sets of one fingerprint, of near fingerprints, and of similar sketches.
    pairs = rows.select("fp", "set_id").distinct()
    first = scratch.keep(pairs.groupBy("fp").agg(F.min("set_id").alias("first")), "first")
    named = lambda side: first.select(F.col("fp").alias(side), F.col("first").alias(f"{side}_first"))
    same = lookup(pairs, first, "fp", "inner").where("set_id <> first").select(F.col("first").alias("a"), F.col("set_id").alias("b"))
    block = scratch.keep(links(first.select("fp"), max_bits, blocks), "block")
    block = lookup(lookup(block, named("a"), "a", "inner"), named("b"), "b", "inner").select(F.col("a_first").alias("a"), F.col("b_first").alias("b"))
    roots = connected_components(same.unionByName(block).unionByName(similar_links(sketches, similarity - slack, tile)), scratch)
    scratch.drop("sketches", "rows", "first", "block")
    own = F.col("root").alias("key")
    clusters = roots.select(own, F.col("node").alias("set_id")).unionByName(roots.select(own, F.col("root").alias("set_id")).distinct())
    keyed = clusters.join(best, "set_id").select("key", F.col("set_id").alias("fp"), "best.doc_id", "best.text_hash", "best.n", "best.size")
    dealt = exact.keep(in_tiles(keyed, tile, most), "dealt")

    def chosen(some: DataFrame, how: str, *columns: str) -> DataFrame:
        some = some.withColumnsRenamed({"doc_id": "stay_id", "text_hash": "stay_hash"})
        texted = docs if how == "left_semi" else docs.select("doc_id", F.col("text").cast("string").alias("text"))
        found = texted.join(some, texted["doc_id"].eqNullSafe(some["stay_id"]) & (text_hash == some["stay_hash"]), how)
        return found.select(*columns) if columns else found

    def once(some: DataFrame, how: str, by: list[str], *columns: str) -> DataFrame:
        """Rows of docs for some(doc_id, text_hash, n), one of each where n rows are alike, by id and text."""
        found = chosen(some.where("n = 1"), how, *columns)
        if not some.where("n > 1").isEmpty():
            alike = chosen(some.where("n > 1"), how, *columns)
            row = F.struct(*alike.columns)
            firsts = alike.groupBy(*[F.col(c).alias(f"by_{c}") for c in by]).agg(F.min_by(row, F.to_json(row)).alias("row"))
            found = found.unionByName(firsts.select("row.*"))
        return found

    read = lambda some: [shingle_set(shingle_hashes(t, shingle, seed)) for t in some.to_pylist()]
    compared = once(dealt, "inner", ["key", "tile", "fp"], "key", "tile", "fp", "text")
    roots = connected_components(tile_edges(compared, star_runs(similar_sets(similarity), "text", read)), exact)
    stay = best.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").groupBy(F.coalesce("root", "set_id").alias("root")).agg(F.min("best").alias("best"))
    stay = scratch.keep(stay.select("best.doc_id", "best.text_hash", "best.n"), "stay")
    exact.drop("dealt")
    return once(stay, "left_semi", ["doc_id", "text"])
