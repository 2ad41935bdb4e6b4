"""Operator 9, packing: concatenate and cut.

Pass one encodes every document and writes, per task, the ids with their place
in the task's own run of tokens. The running sum of the tasks' totals turns
those places into global offsets. Pass two cuts at every multiple of the
window and writes one boundary record per piece.

Encoding: a text is split at single spaces and line breaks between other
characters, which are always borders for the byte-level BPE, and every different
unit is encoded once per worker by ``tokenizers``; ids of known units are
gathered by numpy. Units are told apart by a 64-bit hash.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import checked_broadcast, spread_text, table, write_stage
from cairn.llm.kernels import Prefix, slices, text_buffer

WINDOW = 2048
END_ID = 1
CACHE_UNITS = 1_000_000
"""Known units kept per worker (or those of one slice, if more); when more are
met, the cache starts anew."""


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def unit_starts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Byte positions at which a new unit begins: each text's start, a single
    space between characters that are no white space, and both sides of such
    a line break. Near any white space beyond ASCII nothing is cut."""
    n = len(data)
    solid = data > 0x20
    solid &= data != 0x7F
    odd = np.zeros(n, bool)  # bytes of characters that may be white space
    odd[(data == 0xC2) | (data == 0xE1) | (data == 0xE2) | (data == 0xE3)] = True
    lead = np.flatnonzero(odd)
    for k in (1, 2):
        at = lead + k
        odd[at[at < n]] = True
    solid &= ~odd
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    if n:
        before[1:], after[:-1] = solid[:-1], solid[1:]
        full = np.flatnonzero(np.diff(offs))
        before[offs[:-1][full]] = False
        after[offs[1:][full] - 1] = False
    between = before & after
    cut = np.zeros(n + 1, bool)
    line = np.flatnonzero(between & (data == 0x0A))
    cut[np.flatnonzero(between & (data == 0x20))] = True
    cut[line] = True
    cut[line + 1] = True
    cut[offs] = True
    cut[n] = False
    return np.flatnonzero(cut)


class UnitEncoder:
    """Ids of many texts, encoding each different unit once."""

    def __init__(self, path: str):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.keys, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.first, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _learn(self, keys: np.ndarray, units: list[str]) -> None:
        coded = [e.ids for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]
        slot = len(self.first) - 1 + np.arange(len(keys))
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum([len(x) for x in coded], dtype=np.int64)])
        self.ids = np.concatenate([self.ids, np.array([y for x in coded for y in x], np.uint32)])
        both = np.concatenate([self.keys, keys])
        order = np.argsort(both, kind="stable")
        self.keys, self.slot = both[order], np.concatenate([self.slot, slot])[order]

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and each text's first place."""
        starts = unit_starts(data, offs)
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        keys = Prefix(data).of(starts, ends)
        uniq, example, inverse = np.unique(keys, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, uniq)
        known = np.zeros(len(uniq), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == uniq[inside]
        if not known.all():
            raw = data.tobytes()
            full = len(self.keys) + int((~known).sum()) > CACHE_UNITS
            new = np.arange(len(uniq)) if full else np.flatnonzero(~known)
            if full:
                self.clear()
            for lo in range(0, len(new), 20_000):
                part = new[lo:lo + 20_000]
                self._learn(uniq[part], [raw[starts[i]:ends[i]].decode("utf-8", "replace") for i in example[part]])
            at = np.searchsorted(self.keys, uniq)
        slot = self.slot[at][inverse]
        size = self.first[slot + 1] - self.first[slot]
        total = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=total[1:])
        take = np.arange(total[-1]) + np.repeat(self.first[slot] - total[:-1], size)
        return self.ids[take], total[np.searchsorted(starts, offs)]


_ENCODERS: dict[str, UnitEncoder] = {}


def encoder(path: str) -> UnitEncoder:
    """The Python worker's encoder: what it knows serves all tasks it runs."""
    if path not in _ENCODERS:
        _ENCODERS[path] = UnitEncoder(path)
    return _ENCODERS[path]


TOKENS = "chunk long, doc_id long, n long, start long, ids binary"


def _encode_task(path: str, end_id: int):
    def run(batches):
        enc, place, chunk = encoder(path), 0, TaskContext.get().partitionId()
        for b in batches:
            data, offs = text_buffer(b.column("text"))
            for lo, hi in slices(offs):
                ids, first = enc.encode(data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo])
                n = np.diff(first) + 1
                start = place + np.cumsum(n) - n
                place = int(start[-1] + n[-1])
                packed = []
                for i in range(hi - lo):
                    x = np.empty(n[i], "<u4")
                    x[:-1], x[-1] = ids[first[i]:first[i + 1]], end_id
                    packed.append(x.astype("<u2").tobytes() if x.max() < 65536 else b"\0" + x.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(hi - lo, chunk)), b.column("doc_id").slice(lo, hi - lo), pa.array(n), pa.array(start),
                     pa.array(packed, pa.binary())], names=["chunk", "doc_id", "n", "start", "ids"])
    return run


def unpack_ids(raw: bytes) -> np.ndarray:
    """Stored ids: 16-bit, or after a leading zero byte (odd length) 32-bit."""
    return np.frombuffer(raw, "<u4", offset=1) if len(raw) % 2 else np.frombuffer(raw, "<u2").astype("<u4")


PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "ids array<int>")


def _cut_task(window: int, with_ids: bool):
    def run(batches):
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
                                                    "offset", "ids")}
            for doc, n, at, raw in zip(b.column("doc_id").to_pylist(), b.column("n").to_pylist(),
                                       b.column("at").to_pylist(), b.column("ids")):
                ids, s = unpack_ids(raw.as_py()), 0
                while s < n:
                    size = min(n - s, window - (at + s) % window)
                    piece = ids[s:s + size]
                    for k, v in (("doc_id", doc), ("start", s), ("length", size), ("ids_crc32", zlib.crc32(piece.tobytes())),
                                 ("doc_tokens", n), ("sequence_id", (at + s) // window), ("offset", (at + s) % window),
                                 ("ids", piece.astype(np.int32) if with_ids else None)):
                        out[k].append(v)
                    s += size
            types = [pa.int64()] * 7 + [pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], names=list(out))
    return run


def pack_documents(docs: DataFrame, window: int = WINDOW, end_id: int = END_ID, path: str | None = None,
                   with_ids: bool = True) -> DataFrame:
    """Rows, one per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, ids (null if not asked for).

    A document is its ids, then ``end_id``; a null or empty text is ``end_id``
    alone. Sequences are windows of the concatenation, so only the last one
    may be short. Repeated rows are packed as often as they occur; null
    doc_ids are kept; an empty table gives no pieces. Only doc_id and text are
    read.
    """
    src = spread_text(docs.select("doc_id", "text"))
    coded = write_stage(src.mapInArrow(_encode_task(path or tokenizer_path(), end_id), TOKENS), "op9-ids")
    totals = coded.groupBy("chunk").agg(F.sum("n").alias("total"))
    before = F.sum("total").over(Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    shift = totals.select(F.col("chunk").alias("c"), F.coalesce(before, F.lit(0)).alias("shift"))
    placed = coded.join(checked_broadcast(shift), F.col("chunk") == F.col("c"))
    return placed.select("doc_id", "n", (F.col("start") + F.col("shift")).alias("at"), "ids").mapInArrow(
        _cut_task(window, with_ids), PIECES)


def q_op9(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), with_ids=False).drop("ids")
