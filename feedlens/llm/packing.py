"""Packing by bounded-space online placement.

Every task encodes its documents and keeps a fixed number of open windows. A document
longer than a window is cut into whole windows and a rest. A rest goes into the open
window where it leaves the least room; where none fits, it is cut so that the
fullest window is closed full, and goes on in a new one (cuts shorter than
``min_cut`` are not made: then the fullest is emitted as it is). At the end a task
merges its open windows the same way, so that at most one stays open.
These leftovers are merged over tasks, ``MERGE_FAN`` at a time and whole, until one
group is left.

A task holds its open windows and the document that it encodes, never ids of earlier
documents beyond the windows; only rows of numbers are shuffled.

Defined results: null counts as the empty text (its end token is still packed);
repeated rows and null ids are documents of their own; ids of any type pass through unchanged; an
empty table gives no rows; other columns are ignored. A window is filled to the full length except the ones
emitted with less than ``min_cut`` left and the last leftovers.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship_by_value, small_batches, staged
from .tokens import shared_encoder

WINDOW = 4096
OPEN_WINDOWS = 16
MIN_CUT = 16
MERGE_FAN = 32

NUMBERS = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def piece_ddl(docs: DataFrame) -> str:
    """A piece's columns; doc_id has the type that it has in the documents."""
    return f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{n} bigint" for n in NUMBERS) + ", left boolean"


class Windows:
    """Open windows of one task. A window is [used, pieces]; a piece is (doc, start, ids), ids as 32-bit bytes."""

    def __init__(self, size: int, most: int, min_cut: int):
        self.size, self.most, self.min_cut = size, most, min_cut
        self.open: list[list] = []

    def place(self, doc, start: int, ids: bytes) -> Iterator[list]:
        """Place one piece; yields the windows that this closes."""
        whole = 4 * self.size
        at = 0
        while len(ids) - at >= whole:
            yield [self.size, [(doc, start + at // 4, ids[at : at + whole])]]
            at += whole
        start, ids = start + at // 4, ids[at:]
        length = len(ids) // 4
        if not length:
            return
        fits = [w for w in self.open if w[0] + length <= self.size]
        if fits:
            best = max(fits, key=lambda w: w[0])
        elif len(self.open) < self.most:
            best = [0, []]
            self.open.append(best)
        else:
            full = max(self.open, key=lambda w: w[0])
            room = self.size - full[0]
            if room >= self.min_cut and length - room >= self.min_cut:
                full[1].append((doc, start, ids[: 4 * room]))
                full[0] = self.size
                start, ids, length = start + room, ids[4 * room :], length - room
            self.open.remove(full)
            yield full
            best = [0, []]
            self.open.append(best)
        best[1].append((doc, start, ids))
        best[0] += length
        if best[0] == self.size:
            self.open.remove(best)
            yield best

    def merge(self) -> Iterator[list]:
        """Close all but one window: the emptiest is dealt over the fullest until it is gone."""
        while len(self.open) > 1:
            self.open.sort(key=lambda w: w[0])
            small = self.open.pop(0)
            for doc, start, ids in small[1]:
                while ids and self.open:
                    full = max(self.open, key=lambda w: w[0])
                    part = min(len(ids) // 4, self.size - full[0])
                    full[1].append((doc, start, ids[: 4 * part]))
                    full[0] += part
                    start, ids = start + part, ids[4 * part :]
                    if full[0] == self.size:
                        self.open.remove(full)
                        yield full
                if ids:
                    self.open.append([len(ids) // 4, [(doc, start, ids)]])


def pack_tasks(docs: DataFrame, path: str, end_id: int, window: int, open_windows: int, min_cut: int) -> DataFrame:
    """Pieces of every task, with the task's own sequence numbers; ``left`` marks its last open window."""
    ship_by_value()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        enc = shared_encoder(path)
        end = np.array([end_id], "<u4").tobytes()
        state = Windows(window, open_windows, min_cut)
        serial = 0
        rows: list[tuple] = []
        kind = pa.null()

        def emit(w: list, left: bool) -> None:
            nonlocal serial
            at = 0
            for (doc_id, tokens), start, ids in w[1]:
                rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), tokens, (task << 32) + serial, at, left))
                at += len(ids) // 4
            serial += 1

        def flush() -> pa.RecordBatch:
            cols = list(zip(*rows)) if rows else [[]] * 8
            kinds = [kind, *[pa.int64()] * len(NUMBERS), pa.bool_()]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc_id", *NUMBERS, "left"])
            rows.clear()
            return out

        for b in batches:
            kind = b.schema.field(0).type
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = enc.ids(text or "") + end
                for w in state.place((doc_id, len(ids) // 4), 0, ids):
                    emit(w, False)
            yield flush()
        for w in state.merge():
            emit(w, False)
        for w in state.open:
            emit(w, True)
        if rows:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, piece_ddl(docs))


def merge_group(window: int):
    """Whole leftover windows of one group into as few windows as best fit finds.

    Only a window that ends up less than half full stays ``left``: one per group at most.
    """

    def run(rows: pa.Table) -> pa.Table:
        # numbers only: the ids of documents stay in Arrow, whatever their type and nulls
        seq, length, offset = (rows[c].to_numpy() for c in ("sequence_id", "length", "offset"))
        names, of = np.unique(seq, return_inverse=True)
        size = np.zeros(len(names), np.int64)
        np.add.at(size, of, length)
        bins: list[list[int]] = []  # [place in names, used]
        into, shift = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        for k in np.argsort(-size, kind="stable").tolist():
            fit = [x for x in bins if x[1] + size[k] <= window]
            best = max(fit, key=lambda x: x[1]) if fit else [k, 0]
            if not fit:
                bins.append(best)
            into[k], shift[k] = best
            best[1] += int(size[k])
        low = [x[0] for x in bins if 2 * x[1] < window]
        out = rows.drop_columns(["grp"])
        for name, value in (("sequence_id", names[into[of]]), ("offset", offset + shift[of]), ("left", np.isin(into[of], low))):
            out = out.set_column(out.schema.get_field_index(name), name, pa.array(value))
        return out

    return run


def pack_documents(docs: DataFrame, path: str, end_id: int = 2, window: int = WINDOW, open_windows: int = OPEN_WINDOWS, min_cut: int = MIN_CUT, fan: int = MERGE_FAN) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    first = staged(pack_tasks(docs, path, end_id, window, open_windows, min_cut), "pack")
    done = first.where(~F.col("left")).drop("left")
    left = first.where("left")
    # a task leaves one window at most: its number is the group key, fewer by the fan each round
    groups = (left.agg(F.max(F.shiftright("sequence_id", 32))).first()[0] or 0) + 1
    width = 1
    while groups > 1:
        width *= fan
        group = F.floor(F.shiftright("sequence_id", 32) / F.lit(width))
        merged = left.withColumn("grp", group).groupBy("grp").applyInArrow(merge_group(window), piece_ddl(docs))
        merged = staged(merged, "merge")
        done = done.unionByName(merged.where(~F.col("left")).drop("left"))
        left = merged.where("left")
        groups = -(-groups // fan)
    return done.unionByName(left.drop("left"))
