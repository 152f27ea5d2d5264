"""Best-fit packing of tokenised documents into sequences, improved by swap-based local search.

Documents become pieces of at most ``capacity`` tokens, dealt at random into groups of bounded size.
In a group every piece first goes, as it comes, into the fullest bin that takes it; swap-based local
search then does the work: pieces move, or are exchanged one for one and two for one, between
underfull bins, every change raising the sum of squared fills, so that bins empty. The loose bins of
all groups are pooled and packed again until one group is left.

Defined cases: null text is an empty text (the end id alone); repeated rows and ids are packed
each; null ids stay null; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW_ID, Scratch, slices, texts
from .segments import segment_encoder

PIECES = pa.schema([("doc_id", pa.int64()), (ROW_ID, pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
PLACED = "doc_id long, row_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, fill long"


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int) -> DataFrame:
    """A row for each piece of each row of docs(doc_id, text)."""
    rows = texts(docs).withColumn(ROW_ID, F.monotonically_increasing_id()).withColumn("text", F.coalesce("text", F.lit("")))

    def run(batches):
        encoder = segment_encoder(tokenizer_path)
        end = np.array([end_id], encoder.kind).tobytes()
        for batch in slices(batches):
            out = []
            for doc_id, row_id, raw in zip(batch["doc_id"].to_pylist(), batch[ROW_ID].to_pylist(), encoder.encode(batch["text"].to_pylist())):
                ids = np.frombuffer(raw + end, encoder.kind)
                for i, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    out.append((doc_id, row_id, i, at, len(part), zlib.crc32(part.astype("<u4").tobytes())))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), PIECES)], schema=PIECES)

    return rows.mapInArrow(run, "doc_id long, row_id long, piece int, start long, length long, ids_crc32 long")


def arrival_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of indices: each piece, as it comes, into the fullest bin that still takes it.

    Bins are kept by the room they have left; a bit set of the rooms in use finds the next one.
    """
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    used, bins = 0, []
    for i, size in enumerate(lengths):
        above = used >> size
        if above:
            room = size + (above & -above).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                used ^= 1 << room
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        rooms[room - size].append(b)
        used |= 1 << room - size
    return bins


class Search:
    """Local search over bins of pieces: moves, one-for-one and two-for-one exchanges between underfull bins.

    A donor gives one piece, or one or two for one piece of the other bin; what goes over on balance
    fits there, and the sum of squared fills rises. Of all such changes with the donor the one with
    the largest rise is made. Bins are donors in turn, emptiest first, each until nothing helps it;
    the search ends when a whole round of donors changes nothing, or when the pieces fill no fewer bins.
    As every change raises a bounded whole number, there is an end without a cap on steps.
    """

    def __init__(self, lengths: list[int], bins: list[list[int]], capacity: int):
        self.capacity = capacity
        self.lengths = np.array(lengths, np.int64)
        self.where = np.empty(len(lengths), np.int64)
        for b, content in enumerate(bins):
            self.where[content] = b
        self.fill = np.bincount(self.where, self.lengths, len(bins)).astype(np.int64) if len(lengths) else np.zeros(len(bins), np.int64)
        self.content = [set(b) for b in bins]
        self.least = -(-int(self.fill.sum()) // capacity)
        self.count = int((self.fill > 0).sum())
        self.accepted = {"move": 0, "exchange": 0, "two for one": 0}
        self._queue: list[int] = []
        self._changed = True
        self._refresh()

    def squares(self) -> int:
        return int((self.fill**2).sum())

    def bins(self) -> list[list[int]]:
        return [sorted(b) for b in self.content if b]

    def run(self) -> None:
        while self.step():
            pass

    def step(self) -> bool:
        """Make one change; False if none is left that helps, or none is needed."""
        while self.count > self.least:
            if not self._queue:
                if not self._changed:
                    return False
                self._changed = False
                self._refresh()
                live = np.flatnonzero((self.fill > 0) & (self.fill < self.capacity))
                self._queue = live[np.argsort(-self.fill[live], kind="stable")].tolist()
                if not self._queue:
                    return False
            donor = self._queue[-1]
            if 0 < self.fill[donor] < self.capacity and self._improve(donor):
                self._changed = True
                return True
            self._queue.pop()
        return False

    def _refresh(self) -> None:
        """The pieces of underfull bins, and after them every bin as a piece of no length, for moves."""
        live = (self.fill > 0) & (self.fill < self.capacity)
        self._pieces = np.flatnonzero(live[self.where]) if len(self.where) else np.zeros(0, np.int64)
        self._sizes = self.lengths[self._pieces]
        self._bins = np.flatnonzero(live)

    def _improve(self, donor: int) -> bool:
        fill, mine = self.fill, np.array(sorted(self.content[donor]), np.int64)
        own = np.unique(self.lengths[mine])
        some, counts = np.unique(self.lengths[mine], return_counts=True)
        pairs = some[:, None] + some[None, :]
        pairs = np.unique(pairs[(some[:, None] < some[None, :]) | ((some[:, None] == some[None, :]) & (counts[:, None] > 1))])
        given = np.union1d(own, pairs)
        best_rise, best = 0, None
        for offered, sizes, bins in ((own, None, self._bins), (given, self._sizes, self.where[self._pieces])):
            if not len(bins):
                continue
            at = fill[bins]
            taken = sizes if sizes is not None else 0
            rank = np.searchsorted(offered, taken + (self.capacity - at), side="right") - 1
            gain = np.where(rank >= 0, offered[np.maximum(rank, 0)] - taken, 0)
            # What goes over on balance raises the squares by 2 g (g + the other's fill - the donor's).
            rise = 2 * gain * (gain + at - fill[donor])
            rise[(gain <= 0) | (bins == donor) | (at <= 0) | (at >= self.capacity)] = 0
            k = int(rise.argmax())
            if rise[k] > best_rise:
                best_rise, best = int(rise[k]), (int(bins[k]), int(offered[rank[k]]), None if sizes is None else int(self._pieces[k]))
        if best is None:
            return False
        other, total, back = best
        gone = self._of_length(mine, total, own)
        for one, two, moved in ((donor, other, gone), (other, donor, () if back is None else (back,))):
            for i in moved:
                self.content[one].remove(i)
                self.content[two].add(i)
                self.where[i] = two
                fill[one] -= self.lengths[i]
                fill[two] += self.lengths[i]
        self.accepted["move" if back is None else "exchange" if len(gone) == 1 else "two for one"] += 1
        self.count -= not self.content[donor]
        return True

    def _of_length(self, mine: np.ndarray, total: int, own: np.ndarray) -> tuple[int, ...]:
        """One piece of that length, or else two."""
        sizes = self.lengths[mine]
        if total in own:
            return (int(mine[np.flatnonzero(sizes == total)[0]]),)
        for size in own.tolist():
            first, second = np.flatnonzero(sizes == size), np.flatnonzero(sizes == total - size)
            if len(second) and (total - size != size or len(first) > 1):
                return int(mine[first[0]]), int(mine[second[-1]])
        raise AssertionError("no such pieces")


def packed(capacity: int):
    """For applyInArrow: a group's pieces with bin, offset and the bin's fill."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.select(PIECES.names).sort_by([(ROW_ID, "ascending"), ("piece", "ascending")])
        lengths = table["length"].to_pylist()
        search = Search(lengths, arrival_fit(lengths, capacity), capacity)
        search.run()
        bins = search.bins()
        place = np.zeros((len(lengths), 3), np.int64)
        for b, content in enumerate(bins):
            at = 0
            total = sum(lengths[i] for i in content)
            for i in sorted(content):
                place[i] = (key[0].as_py() << 32) + b, at, total
                at += lengths[i]
        for name, values in zip(("bin", "offset", "fill"), place.T):
            table = table.append_column(name, pa.array(np.ascontiguousarray(values)))
        return table

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = 4096, group_pieces: int = 16_384, pooled_below: float = 0.98) -> DataFrame:
    """(doc_id, row_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece.

    ``group_pieces`` bounds the pieces packed in one task. Bins less full than ``pooled_below`` of
    the capacity are pooled over all groups and packed again, until one group holds them all, or
    until pooling leaves as many of their pieces as before.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    cut = scratch.keep(pieces(docs, tokenizer_path, end_id, capacity), "pieces")
    is_loose, out = F.col("fill") < pooled_below * capacity, []
    left, name, turn = cut.count(), "pieces", 0
    while True:
        n = max(1, -(-left // group_pieces))
        group = F.pmod(F.xxhash64(F.lit(turn), ROW_ID, "piece"), F.lit(n)) + (turn << 24)
        packed_once = cut.withColumn("group", group).groupBy("group").applyInArrow(packed(capacity), PLACED)
        done = scratch.keep(packed_once, f"packed-{turn}")
        scratch.drop(name)
        loose = done.where(is_loose).count() if n > 1 else 0
        if n == 1 or loose in (0, left):
            out.append(done)
            break
        out.append(done.where(~is_loose))
        cut, left, name, turn = scratch.keep(done.where(is_loose).select(PIECES.names), f"loose-{turn}"), loose, f"loose-{turn}", turn + 1
    placed = reduce(DataFrame.unionByName, out)
    return placed.select("doc_id", ROW_ID, "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset")
