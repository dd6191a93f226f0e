"""Documents packed into training sequences by vector best fit.

A sequence has three capacities: tokens, documents, and attention cost (the sum of
the squared lengths of its pieces, as attention does not cross documents). Pieces
are placed from the largest to the smallest. Among the open sequences in which a
piece meets every capacity, one is selected by what would be left of the three, each
as a share of its capacity and weighted: the smallest norm of the residual, or the
largest product of the piece's demand with the residual. If none is open
enough, a new one begins.

Pieces are dealt with their ids, 2 bytes each if the vocabulary allows, into groups of about
``group`` pieces or ``GROUP_BYTES`` of text. One task packs a group and gives out its finished sequences, so
there is one shuffle, and nothing is joined. A group's few unfilled sequences are the price of packing in
parallel: under one in a thousand pieces.

The deal goes by place in the input, so that copies of one document spread over all groups. ``documents``
should therefore be a table (files), whose rows come in the same order if a lost executor's work is repeated.

Edge cases: a null text is empty and has the end id only. Rows of equal id are
packed row by row. Pieces beyond a capacity on their own (more tokens or cost than a sequence
has) get a sequence of their own and break no other's limit. Empty input gives an
empty result. Clashing column names: only ``id`` and ``text`` are read by ``pieces`` and ``pack_documents``,
and results are named as given.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import text_or_empty, written
from basketry.llm.tokens import bytes_of_id, encoder

LENGTH = 4096
GROUP = 20_000
GROUP_BYTES = 1 << 24
GIVEN = 256  # sequences given out at once


def pieces(documents: DataFrame, path: str, end: int, length: int = LENGTH, id: str = "doc_id",
           text: str = "text") -> DataFrame:
    """doc_id, piece (from 0), start (its document's ids before it), length, place (running, in the input's
    partition) and ids (binary, of the width that ``bytes_of_id`` names). Only documents of more than
    ``length`` ids are cut."""
    kind = f"<u{bytes_of_id(path)}"
    kept = documents.select(F.col(id).alias("doc_id"), text_or_empty(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, place = encoder(path).encode, TaskContext.get().partitionId() * 7919
        for batch in batches:
            owner, number, starts, lengths, ids = [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                mine = np.append(np.frombuffer(encode(text.as_py()), "<u4"), end).astype(kind).tobytes()
                n = len(mine) // int(kind[2:])
                for k, start in enumerate(range(0, n, length)):
                    owner.append(i)
                    number.append(k)
                    starts.append(start)
                    lengths.append(min(length, n - start))
                    ids.append(mine[start * int(kind[2:]):(start + length) * int(kind[2:])])
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(owner, pa.int64())), pa.array(number, pa.int32()),
                pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()),
                pa.array(range(place, place + len(ids)), pa.int64()), pa.array(ids, pa.binary())],
                names=["doc_id", "piece", "start", "length", "place", "ids"])
            place += len(ids)
    own = documents.schema[id].dataType.simpleString()
    return kept.mapInArrow(
        run, f"doc_id {own}, piece int, start long, length long, place long, ids binary")


def best_fit(lengths: np.ndarray, capacity: tuple[int, int, int], weights: tuple[float, float, float],
             select: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece. Sequences are numbered from 0."""
    cap = np.array(capacity, float)
    scale = np.array(weights, float) ** (2 if select == "norm" else 1) / cap ** 2  # of shares of capacities
    demand = np.stack([lengths, np.ones(len(lengths)), lengths.astype(float) ** 2])
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    room = np.empty((3, max(16, len(lengths) // 4)))  # what is left in the open sequences
    number = np.empty(room.shape[1], np.int64)
    opened = made = 0
    least = np.array([lengths.min(initial=1), 1.0, float(lengths.min(initial=1)) ** 2])
    for i in np.argsort(-lengths, kind="stable"):
        d = demand[:, i]
        fits = (room[:, :opened] >= d[:, None]).all(axis=0)
        at = np.flatnonzero(fits)
        if len(at):
            if select == "norm":
                left = room[:, at] - d[:, None]
                best = at[(scale[:, None] * left * left).sum(axis=0).argmin()]
            else:
                best = at[((scale * d)[:, None] * room[:, at]).sum(axis=0).argmax()]
        else:
            best = opened
            if opened == room.shape[1]:
                room = np.concatenate([room, np.empty_like(room)], axis=1)
                number = np.concatenate([number, np.empty_like(number)])
            room[:, opened], number[opened] = cap, made
            opened, made = opened + 1, made + 1
        sequence[i], offset[i] = number[best], cap[0] - room[0, best]
        room[:, best] -= d
        if (room[:, best] < least).any():  # nothing fits any more: close it
            opened -= 1
            room[:, best], number[best] = room[:, opened], number[opened]
    return sequence, offset


def pack(rows: DataFrame, length: str = "length", tokens: int = LENGTH, documents: int | None = None,
         cost: int | None = None, weights: tuple[float, float, float] = (1.0, 0.05, 0.05),
         select: str = "norm", group: int = GROUP) -> DataFrame:
    """``rows`` with ``sequence_id`` and ``offset`` for each. Without ``documents`` or
    ``cost`` these capacities are what a sequence of ``tokens`` tokens can need at most.

    ``rows`` is read twice, so it should be a table.
    """
    capacity = (tokens, documents or tokens, cost or tokens * tokens)
    count = rows.count()
    groups = max(1, round(count / group))
    names = rows.columns
    schema = rows.withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long")).schema
    dealt = rows.withColumn("\tgroup", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in names]), F.lit(groups)))

    def packed(number: int, table: pa.Table) -> Iterator[pa.RecordBatch]:
        sequence, offset = best_fit(table.column(length).to_numpy(), capacity, weights, select)
        yield from table.append_column("sequence_id", pa.array(sequence * groups + number)).append_column(
            "offset", pa.array(offset)).to_batches()
    return dealt.repartition("\tgroup").sortWithinPartitions("\tgroup", *names).mapInArrow(by_group(packed), schema)


def by_group(made):
    """For mapInArrow over rows sorted by their last column, a group's number: the batches that ``made(number, table)``
    gives for each group, where the table has the other columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, waiting = None, []
        for batch in batches:
            marks = batch.column(batch.num_columns - 1).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(marks)) + 1).tolist(), len(marks)]
            for a, b in zip(cuts, cuts[1:]):
                if a < b:
                    if waiting and marks[a] != number:
                        yield from done(number, waiting)
                        waiting = []
                    number = int(marks[a])
                    waiting.append(batch.slice(a, b - a))
        if waiting:
            yield from done(number, waiting)

    def done(number: int, waiting: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(waiting)
        yield from made(number, table.drop_columns([table.column_names[-1]]))
    return run


def pack_documents(documents: DataFrame, path: str, end: int, length: int = LENGTH, most: int | None = None,
                   cost: int | None = None, weights: tuple[float, float, float] = (1.0, 0.05, 0.05),
                   select: str = "norm", group: int = GROUP) -> DataFrame:
    """The written sequences of all pieces: sequence_id, width (bytes of an id), ids (binary) and placed, an array
    of (offset, doc_id, piece, start, length) in the order of offsets. ``most`` documents and ``cost`` as in ``pack``."""
    rows, size = documents.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    groups = max(1, math.ceil(max(rows / group, (size or 0) / GROUP_BYTES)))
    capacity, width = (length, most or length, cost or length * length), bytes_of_id(path)
    cut = pieces(documents, path, end, length)
    dealt = cut.withColumn("\tgroup", F.pmod("place", F.lit(groups))).drop("place")
    own = cut.schema["doc_id"].dataType.simpleString()

    def sequences(number: int, table: pa.Table) -> Iterator[pa.RecordBatch]:
        sequence, offset = best_fit(table.column("length").to_numpy(), capacity, weights, select)
        order = np.lexsort((offset, sequence))
        begins = np.r_[np.flatnonzero(np.diff(sequence[order], prepend=-1)), len(order)]
        names = ["doc_id", "piece", "start", "length"]
        for i in range(0, len(begins) - 1, GIVEN):
            cuts = begins[i:i + GIVEN + 1]
            some = order[cuts[0]:cuts[-1]]
            part, cuts = table.take(pa.array(some)).combine_chunks(), cuts - cuts[0]
            ids = part.column("ids").to_pylist()
            entry = pa.StructArray.from_arrays(
                [pa.array(offset[some]), *(part.column(n).combine_chunks() for n in names)], ["offset", *names])
            yield from pa.table({
                "sequence_id": pa.array(sequence[some][cuts[:-1]] * groups + number),
                "width": pa.array(np.full(len(cuts) - 1, width, np.int32)),
                "ids": pa.array([b"".join(ids[a:b]) for a, b in zip(cuts[:-1], cuts[1:])], pa.binary()),
                "placed": pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), entry)}).to_batches()
    schema = (f"sequence_id long, width int, ids binary, "
              f"placed array<struct<offset:long,doc_id:{own},piece:int,start:long,length:long>>")
    ordered = dealt.repartition("\tgroup").sortWithinPartitions("\tgroup")
    return written(ordered.mapInArrow(by_group(sequences), schema), "sequences")


def placements(sequences: DataFrame) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (of 4 bytes an id), sequence_id and offset of all pieces, as the
    sequences hold them."""
    own = sequences.schema["placed"].dataType.elementType["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            placed = batch.column(3)
            entries = placed.flatten()
            counts = np.diff(placed.offsets.to_numpy())
            offset, length = (entries.field(n).to_numpy() for n in ("offset", "length"))
            begins = np.r_[0, np.cumsum(counts)].tolist()
            sums = np.empty(len(offset), np.int64)
            for i, (width, ids) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2))):
                wide = np.frombuffer(ids.as_buffer(), f"<u{width}").astype("<u4")
                for j in range(begins[i], begins[i + 1]):
                    sums[j] = crc32(wide[offset[j]:offset[j] + length[j]])
            yield pa.RecordBatch.from_arrays([
                *(entries.field(n) for n in ("doc_id", "piece", "start", "length")), pa.array(sums),
                batch.column(0).take(pa.array(np.repeat(np.arange(len(counts)), counts))), entries.field("offset")],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
    return sequences.select("sequence_id", "width", "ids", "placed").mapInArrow(
        run, f"doc_id {own}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
