"""Sequence packing as vector bin packing with the dot-product heuristic.

A piece of a document asks for three resources of a training sequence: tokens,
segments (one) and loss-bearing tokens.  A sequence is filled bin by bin: of all
waiting pieces that fit under all three limits, the one whose demand has the largest
dot product with what the sequence has left (both relative to the limits) goes in.
When nothing fits any more and at least ``min_cut`` tokens are left, the head of the
longest waiting piece is cut off to fill them.  Whole multiples of the sequence
length at the front of a document become sequences of their own first.

Scale: packing needs no order among documents, so each task packs its own rows in
rounds of bounded size (``round_docs`` rows or ``round_tokens`` tokens); nothing is
shuffled.  Sequence ids are the task's number and a counter, so a task that runs
again after a lost executor produces the same rows.

Edge cases: null or empty text is a document of its end mark alone; repeated rows are
packed once each; a null id stays null; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ids_field, quoted, slices
from .tokens import text_ids, vocabulary_path

END = np.asarray([1], "<u4").tobytes()


def dot_product_pack(tokens: np.ndarray, loss: np.ndarray, limits: tuple[int, int, int], min_cut: int) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (item, first token of the piece within the item, length).

    ``tokens`` and ``loss`` are per item, all tokens at most ``limits[0]``.  A piece's
    loss-bearing tokens are the last ones of its item, so a head that is cut off takes
    none before the prompt part is used up.
    """
    size, segments, loss_limit = limits
    order = np.lexsort((np.arange(len(tokens)), -loss, tokens))
    left_tokens, left_loss, item = tokens[order].astype(np.int64), loss[order].astype(np.int64), order.copy()
    start = np.zeros(len(tokens), np.int64)
    out: list[list[tuple[int, int, int]]] = []
    weight = (1.0 / size**2, 1.0 / loss_limit**2)
    while len(item):
        room, seg, room_loss, sequence = size, segments, loss_limit, []
        while seg and room and len(item):
            fits = int(np.searchsorted(left_tokens, room, "right"))
            best = -1
            if fits:
                value = left_tokens[:fits] * (weight[0] * room) + left_loss[:fits] * (weight[1] * room_loss)
                if room_loss < size:
                    value = np.where(left_loss[:fits] <= room_loss, value, -1.0)
                best = int(np.argmax(value))
                best = best if value[best] >= 0 else -1
            if best >= 0:
                n, l = int(left_tokens[best]), int(left_loss[best])
                sequence.append((int(item[best]), int(start[item[best]]), n))
                left_tokens, left_loss, item = (np.delete(x, best) for x in (left_tokens, left_loss, item))
                room, room_loss, seg = room - n, room_loss - l, seg - 1
                continue
            last = len(item) - 1
            n, l = int(left_tokens[last]), int(left_loss[last])
            head = min(room, n - l + room_loss, n - 1)  # a head of the prompt alone bears no loss
            if head < max(1, min_cut):
                break
            head_loss = max(0, head - (n - l))
            k = int(item[last])
            sequence.append((k, int(start[k]), head))
            start[k] += head
            room, room_loss, seg = room - head, room_loss - head_loss, seg - 1
            left_tokens, left_loss, item = left_tokens[:-1], left_loss[:-1], item[:-1]
            at = int(np.searchsorted(left_tokens, n - head))
            left_tokens, left_loss, item = np.insert(left_tokens, at, n - head), np.insert(left_loss, at, l - head_loss), np.insert(item, at, k)
        if not sequence:  # an item whose loss alone is over the limit: cut at the limit
            n, k = int(left_tokens[-1]), int(item[-1])
            head = max(1, min(n, n - int(left_loss[-1]) + loss_limit))
            sequence.append((k, int(start[k]), head))
            start[k] += head
            if head < n:
                left_tokens[-1], left_loss[-1] = n - head, int(left_loss[-1]) - loss_limit
                again = np.argsort(left_tokens, kind="stable")
                left_tokens, left_loss, item = left_tokens[again], left_loss[again], item[again]
            else:
                left_tokens, left_loss, item = left_tokens[:-1], left_loss[:-1], item[:-1]
        out.append(sequence)
    return out


def pack_documents(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = 2048, segments: int = 128, loss_limit: int | None = None, loss_tokens: str | None = None,
    min_cut: int = 16, round_docs: int = 2048, round_tokens: int = 4_000_000, vocabulary: str | None = None,
) -> DataFrame:
    """Pieces of all documents with their places in sequences.

    ``loss_tokens`` names a column with the number of loss-bearing tokens at the end of
    each document (answers of instruction data); by default all tokens of a document
    bear a loss.  Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, segment, loss_tokens.
    """
    path = vocabulary or vocabulary_path()
    limits = (size, segments, loss_limit or size)
    body = F.coalesce(quoted(text).cast("string"), F.lit(""))
    rows = docs.select(quoted(doc_id).alias("doc_id"), body.alias("text"), (quoted(loss_tokens) if loss_tokens else F.lit(None)).cast("long").alias("loss"))
    longs = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "segment", "loss_tokens"]
    schema = T.StructType([T.StructField(doc_id, docs.schema[doc_id].dataType), *[T.StructField(c, T.LongType()) for c in longs]])
    id_type = ids_field(rows, "doc_id")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = text_ids(path)
        base, used = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36, 0
        ids: list[object] = []
        bodies: list[bytes] = []
        losses: list[int] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal used
            rows, used = _round(bodies, losses, limits, min_cut, base, used)
            who = pa.array([ids[k] for k in rows[0]], id_type)
            return pa.RecordBatch.from_arrays([who, *[pa.array(np.asarray(x, np.int64)) for x in rows[1:]]], names=[doc_id, *longs])

        for batch in slices(batches, "text", round_docs, 32 << 20):
            for who, body, bears in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("loss").to_pylist(), strict=True):
                found = encode(body) + END
                n = len(found) // 4
                ids.append(who)
                bodies.append(found)
                losses.append(n if bears is None else max(0, min(n, bears)))
                held += n
                if len(ids) >= round_docs or held >= round_tokens:
                    yield flush()
                    ids, bodies, losses, held = [], [], [], 0
        if ids:
            yield flush()

    return rows.mapInArrow(pack, schema)


def _round(bodies: list[bytes], losses: list[int], limits: tuple[int, int, int], min_cut: int, base: int, used: int) -> tuple[list[list[int]], int]:
    size, _, loss_limit = limits
    out: list[list[int]] = [[] for _ in range(9)]
    item_doc, item_start, item_tokens, item_loss = [], [], [], []

    def add(k: int, start: int, n: int, sequence: int, offset: int, segment: int) -> None:
        total = len(bodies[k]) // 4
        bears = max(0, min(n, start + n - (total - losses[k])))
        for column, x in zip(out, (k, start, n, zlib.crc32(memoryview(bodies[k])[4 * start : 4 * (start + n)]), total, base + sequence, offset, segment, bears), strict=True):
            column.append(x)

    for k, body in enumerate(bodies):
        total, start = len(body) // 4, 0
        while total - start >= size and loss_limit >= size:
            add(k, start, size, used, 0, 0)
            used += 1
            start += size
        while start < total:
            n = min(size, total - start)
            item_doc.append(k)
            item_start.append(start)
            item_tokens.append(n)
            item_loss.append(max(0, min(n, start + n - (total - losses[k]))))
            start += n
    for sequence in dot_product_pack(np.asarray(item_tokens, np.int64), np.asarray(item_loss, np.int64), limits, min_cut) if item_doc else []:
        offset = 0
        for segment, (k, start, n) in enumerate(sequence):
            add(item_doc[k], item_start[k] + start, n, used, offset, segment)
            offset += n
        used += 1
    return out, used
