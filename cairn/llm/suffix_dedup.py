"""Operator 5, suffix-array dedup by bucket-pointer refinement.

Removes every byte covered by a string of ``length`` bytes that also starts at
another place of the table. Sorting all suffixes is not needed for that: two
places are equal if their bucket identifiers stay equal to depth ``length``.

1. Initial buckets: the identifier of a place is the hash of its q-gram, q =
   length / 2. Each window (a place whose string of ``length`` bytes lies in its
   text) is represented by the place with the smallest identifier among its
   q-grams, its anchor; equal windows have equal anchors. Consecutive windows of
   one anchor form a range (about 80 windows). Anchors alone in their bucket are
   settled: none of their windows occurs elsewhere.
2. First refinement: a range's identifier joins those of its first and later
   offsets. Ranges with equal identifiers are equal throughout, so all their
   windows are repeated.
3. Second refinement, only for windows of ranges that share their anchor's
   bucket with a different range: a window's identifier joins those of its
   offsets 0 and length - q, reusing the identifiers at hand. Of equal ranges one
   stands for all.

Each step sorts identifiers in blocks dealt by value; within a chunk of texts
equal ones are counted first and travel as one, so a passage that a third of
all texts share costs a block one entry per chunk. Identifiers are 64-bit hashes
(equal strings always meet; a false match has probability about 2**-64).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import blocks_for, spread_text, table, with_rows, write_stage
from cairn.llm.kernels import Prefix, home, mix, slices, text_buffer

LENGTH = 400
CHUNK_BYTES = 1 << 20
_A, _B, _C = (np.uint64(x) for x in (0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93))
_NO_RETURN, _NO_RETURN_TWICE = np.uint32(0xFFFFFFFF), np.uint32(0xFFFFFFFE)

ROWS = pa.schema([("dest", pa.int32()), ("kind", pa.int32()), ("chunk", pa.int64()), ("ids", pa.binary()), ("more", pa.binary()),
                  ("flags", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("text", pa.binary()), ("offs", pa.binary()),
                  ("froms", pa.binary()), ("tos", pa.binary()), ("places", pa.binary())])
ROWS_SQL = ("dest int, kind int, chunk long, ids binary, more binary, flags binary, doc_ids array<long>, text binary, "
            "offs binary, froms binary, tos binary, places binary")
ANCHORS, TEXT, WINDOWS, DONE = 0, 1, 2, 3
LARGE_ROWS = {"compression": "zstd", "parquet.block.size": 16 << 20, "parquet.block.size.row.check.min": 1,
              "parquet.block.size.row.check.max": 1, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}
"""For tables of rows of megabytes: sizes are checked at every row, which bounds
what a task holds, and zstd works on streams, not on buffers of a whole page."""
OUT_SQL = "doc_id long, n_bytes long, n_removed long, spans array<struct<from:long,to:long>>, kept_sha256 string, kept binary"


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in ROWS], schema=ROWS)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    m = len(x) - width + 1
    if m <= 0:
        return np.zeros(0, x.dtype)
    padded = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[:len(x)] = x
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    back = np.minimum.accumulate(rows, axis=1).ravel()
    return np.minimum(ahead[:m], back[width - 1:width - 1 + m])


class Ranges:
    """Anchors and ranges of a chunk of texts.

    ``first``/``last``: first and last window of each range, as places in the
    chunk; ``anchor``, ``ident``: identifiers of its anchor and of itself.
    """

    def __init__(self, data: np.ndarray, offs: np.ndarray, length: int, keep: bool):
        self.length, self.q = length, (length + 1) // 2
        self.parts: list[tuple[int, np.ndarray]] = []  # identifiers by slice, if kept
        found: list[tuple] = []
        for lo, hi in slices(offs):
            base = int(offs[lo])
            ids = self._slice(data[base:offs[hi]], offs[lo:hi + 1] - base, base, found)
            if keep:
                self.parts.append((base, ids))
        names = ("anchor", "ident", "first", "last")
        for k, name in enumerate(names):
            kind = np.uint64 if k < 2 else np.int64
            setattr(self, name, np.concatenate([np.zeros(0, kind), *[f[k] for f in found]]))

    def _slice(self, data, offs, base, found) -> np.ndarray:
        length, q = self.length, self.q
        if not (np.diff(offs) >= length).any():
            return np.zeros(0, np.uint64)
        at = np.arange(len(data) - q + 1)
        ids = Prefix(data).of(at, at + q)
        order = (ids >> np.uint64(32) << np.uint64(32)) | at.astype(np.uint64)
        least = sliding_min(order, length - q + 1)
        sizes = np.maximum(np.diff(offs) - length + 1, 0)
        ends = np.cumsum(sizes)
        windows = np.arange(ends[-1]) + np.repeat(offs[:-1] - (ends - sizes), sizes)
        anchor = (least[windows] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.ones(len(windows), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (windows[1:] != windows[:-1] + 1)
        new[(ends - sizes)[sizes > 0]] = True
        start = np.flatnonzero(new)
        first, last = windows[start], windows[np.append(start[1:], len(windows)) - 1]
        anchor = anchor[start]
        ident = mix(ids[first] * _A + ids[first + length - q] * _B + ids[last + length - q] * _C + (last - first).astype(np.uint64))
        found.append((ids[anchor], ident, first + base, last + base))
        return ids

    def windows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places, identifiers, range) of the windows of some ranges; the
        identifiers of the slices must have been kept."""
        first, size = self.first[which], (self.last - self.first + 1)[which]
        places = np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)
        out = np.zeros(len(places), np.uint64)
        bounds = np.searchsorted(places, [b for b, _ in self.parts] + [np.iinfo(np.int64).max])
        for (base, ids), x, y in zip(self.parts, bounds[:-1], bounds[1:]):
            p = places[x:y] - base
            out[x:y] = mix(ids[p] * _A + ids[p + self.length - self.q] * _B) if y > x else 0
        return places, out, np.repeat(which, size)

    def grouped(self):
        """Per range: number of different ranges at its anchor here, number of
        ranges equal to it here, whether it is the first of these; and the
        order by (anchor, identifier) with the start of every anchor."""
        order = np.lexsort((self.ident, self.anchor))
        a, b = self.anchor[order], self.ident[order]
        n = len(order)
        new_a = np.append(True, a[1:] != a[:-1]) if n else np.zeros(0, bool)
        new_b = new_a | np.append(True, b[1:] != b[:-1]) if n else new_a
        anchor_no, pair_no = np.cumsum(new_a) - 1, np.cumsum(new_b) - 1
        kinds = np.bincount(anchor_no[new_b], minlength=anchor_no[-1] + 1 if n else 0)
        mult = np.bincount(pair_no) if n else np.zeros(0, np.int64)
        out = [np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)]
        out[0][order], out[1][order], out[2][order] = (kinds[anchor_no], mult[pair_no], new_b) if n else (0, 0, False)
        return out[0], out[1], out[2], order[new_a]


def _chunks(batches):
    """Chunks of at least CHUNK_BYTES: (number, doc_ids, bytes, offsets). The
    number comes from the scan's own partition, in the column ``part``."""
    number = None
    ids, parts, sizes, held = [], [], [], 0

    def chunk():
        return number, pa.concat_arrays(ids), np.concatenate(parts), np.append(0, np.cumsum(np.concatenate(sizes)))
    for b in batches:
        if b.num_rows and number is None:
            number = b.column("part")[0].as_py() << 24
        data, offs = text_buffer(b.column("text"))
        for lo, hi in slices(offs, CHUNK_BYTES):
            ids.append(b.column("doc_id").slice(lo, hi - lo))
            parts.append(data[offs[lo]:offs[hi]])
            sizes.append(np.diff(offs[lo:hi + 1]))
            held += int(offs[hi] - offs[lo])
            if held >= CHUNK_BYTES:
                yield chunk()
                number, ids, parts, sizes, held = number + 1, [], [], [], 0
    if ids:
        yield chunk()


def _by_block(blocks: int, ids: np.ndarray, **arrays) -> list[dict]:
    """Block rows of entries. Identifiers are scrambled before they are dealt: anchors
    are the smallest of many, so by value nearly all would fall into the first block."""
    key = mix(ids ^ _A)
    order = np.argsort(key)
    ids, arrays = ids[order], {k: v[order] for k, v in arrays.items()}
    limits = (np.arange(blocks + 1, dtype=object) * (1 << 64) // blocks)[1:-1].astype(np.uint64)
    bounds = np.concatenate([[0], np.searchsorted(key[order], limits), [len(ids)]])
    return [{"dest": b, "ids": ids[x:y].tobytes(), **{k: v[x:y].tobytes() for k, v in arrays.items()}}
            for b, (x, y) in enumerate(zip(bounds[:-1], bounds[1:])) if y > x]


def _chunk_task(length: int, blocks: int):
    """Each chunk as one row, and one entry per anchor of it: its range's
    identifier, or flag 2 if there are different ranges; flag 1 if there are
    several equal ones."""
    def run(batches):
        for number, doc_ids, data, offs in _chunks(batches):
            r = Ranges(data, offs, length, keep=False)
            kinds, mult, _, one = r.grouped()
            flags = np.where(kinds[one] > 1, 2, np.where(mult[one] > 1, 1, 0)).astype(np.uint8)
            rows = _by_block(blocks, r.anchor[one], more=r.ident[one], flags=flags)
            if rows:
                yield _batch([{**x, "kind": ANCHORS, "chunk": number} for x in rows])
            yield _batch([{"dest": int(home(number, blocks)[0]), "kind": TEXT, "chunk": number, "doc_ids": doc_ids.to_pylist(),
                           "text": data.tobytes(), "offs": offs.astype(np.int64).tobytes()}])
    return run


def _entries(batches, names: dict):
    """All entries of a block as arrays, with the row they came from; other
    rows are passed on as they come."""
    chunks, held = [], {k: [] for k in names}
    for b in batches:
        mine = np.isin(b.column("kind").to_numpy(), (ANCHORS, WINDOWS))
        if not mine.all():
            yield pa.RecordBatch.from_arrays(b.filter(pa.array(~mine)).columns, schema=ROWS)
        for i in np.flatnonzero(mine):
            chunks.append(b.column("chunk")[i].as_py())
            for k, kind in names.items():
                held[k].append(np.frombuffer(b.column(k)[i].as_py(), kind))
    row = np.repeat(np.arange(len(chunks)), [len(x) for x in held["ids"]])
    return np.array(chunks, np.int64), row, {k: np.concatenate([np.zeros(0, names[k]), *v]) for k, v in held.items()}


def _answers(chunks, row, blocks, kind, **arrays):
    """Answer rows, one per chunk row that gets any."""
    order = np.argsort(row, kind="stable")
    bounds = np.searchsorted(row[order], np.arange(len(chunks) + 1))
    cols = {k: v[order] for k, v in arrays.items()}
    out = [{"dest": int(home(c, blocks)[0]), "kind": kind, "chunk": int(c), **{k: v[x:y].tobytes() for k, v in cols.items()}}
           for c, x, y in zip(chunks, bounds[:-1], bounds[1:]) if y > x]
    for i in range(0, len(out), 500):
        yield _batch(out[i:i + 500])


def _settle_anchors_task(blocks: int):
    """Answers per chunk and anchor that occurs elsewhere: 1 if an equal range
    exists, plus 2 if the range's windows are to be compared."""
    def run(batches):
        chunks, row, e = yield from _entries(batches, {"ids": np.uint64, "more": np.uint64, "flags": np.uint8})
        if not len(row):
            return
        order = np.lexsort((e["more"], e["flags"] == 2, e["ids"]))
        a, b, f, row = e["ids"][order], e["more"][order], e["flags"][order], row[order]
        new_a = np.append(True, a[1:] != a[:-1])
        new_b = new_a | np.append(True, (b[1:] != b[:-1]) | ((f[1:] == 2) != (f[:-1] == 2)))
        no_a, no_b = np.cumsum(new_a) - 1, np.cumsum(new_b) - 1
        weight = np.where(f == 0, 1, 2)
        total = np.bincount(no_a, weight)[no_a]
        equal = np.bincount(no_b, weight)[no_b] > 1
        kinds = np.bincount(no_a[new_b])[no_a] + (np.bincount(no_a, f == 2) > 0)[no_a]
        status = np.where(equal, 1, 0) | np.where((kinds > 1) & (~equal | new_b), 2, 0)
        keep = (total > 1) & (f != 2) & (status > 0)
        yield from _answers(chunks, row[keep], blocks, ANCHORS, ids=a[keep], flags=status[keep].astype(np.uint8))
    return run


def _settle_windows_task(blocks: int):
    """Places of windows that occur elsewhere."""
    def run(batches):
        chunks, row, e = yield from _entries(batches, {"ids": np.uint64, "places": np.uint32})
        if not len(row):
            return
        order = np.argsort(e["ids"], kind="stable")
        a, p, row = e["ids"][order], e["places"][order], row[order]
        no = np.cumsum(np.append(True, a[1:] != a[:-1])) - 1
        twice = np.bincount(no, np.where(p == _NO_RETURN_TWICE, 2, 1))[no] > 1
        keep = twice & (p < _NO_RETURN_TWICE)
        yield from _answers(chunks, row[keep], blocks, WINDOWS, places=p[keep])
    return run


def covered(n: int, froms: np.ndarray, tos: np.ndarray) -> np.ndarray:
    depth = np.bincount(froms, minlength=n + 1) - np.bincount(tos, minlength=n + 1)
    return np.cumsum(depth)[:n] > 0


def _results(doc_ids, data: np.ndarray, offs: np.ndarray, gone: np.ndarray, with_text: bool):
    """Output rows of finished texts."""
    out = {k: [] for k in ("n_bytes", "n_removed", "spans", "sha", "kept")}
    total = np.append(0, np.cumsum(gone))
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist()):
        removed = int(total[b] - total[a])
        part, spans = data[a:b], []
        if removed:
            mask = gone[a:b]
            edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))).reshape(-1, 2)
            spans = [{"from": x, "to": y} for x, y in edge.tolist()]
            part = part[~mask]
        raw = part.tobytes()
        for k, v in zip(out, (b - a, removed, spans, hashlib.sha256(raw).hexdigest(), raw if with_text else None)):
            out[k].append(v)
    span = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
    return pa.RecordBatch.from_arrays(
        [pa.array(doc_ids, pa.int64()), pa.array(out["n_bytes"], pa.int64()), pa.array(out["n_removed"], pa.int64()),
         pa.array(out["spans"], span), pa.array(out["sha"], pa.string()), pa.array(out["kept"], pa.binary())],
        names=["doc_id", "n_bytes", "n_removed", "spans", "kept_sha256", "kept"])


def _ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _refine_task(length: int, blocks: int, with_text: bool):
    """Chunks with the answers on their anchors: finished texts, windows that
    need comparing, and the texts that wait for them."""
    def one(r: dict, answers: list[dict]):
        data, offs = np.frombuffer(r["text"], np.uint8), np.frombuffer(r["offs"], np.int64)
        g = Ranges(data, offs, length, keep=True)
        kinds, mult, first, _ = g.grouped()
        ids = np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(x["ids"], np.uint64) for x in answers]])
        status = np.concatenate([np.zeros(0, np.uint8), *[np.frombuffer(x["flags"], np.uint8) for x in answers]])
        order = np.argsort(ids)
        ids, status = ids[order], status[order]
        at = np.searchsorted(ids, g.anchor)
        told = np.zeros(len(g.anchor), np.uint8)
        hit = at < len(ids)
        hit[hit] = ids[at[hit]] == g.anchor[hit]
        told[hit] = status[at[hit]]
        several = kinds > 1
        equal = (mult > 1) | (~several & ((told & 1) > 0))
        compare = np.where(several, first, first & ((told & 2) > 0))
        wait = compare & ~equal
        # windows to compare, equal ones of this chunk counted here
        places, idents, owner = g.windows(np.flatnonzero(compare))
        order = np.argsort(idents, kind="stable")
        places, idents, back = places[order], idents[order], wait[owner[order]]
        new = np.append(True, idents[1:] != idents[:-1]) if len(idents) else np.zeros(0, bool)
        no = np.cumsum(new) - 1
        size = np.bincount(no) if len(no) else np.zeros(0, np.int64)
        known = places[back & (size[no] > 1)] if len(no) else places
        ref = np.where(size[no] > 1, _NO_RETURN_TWICE, np.where(back, places.astype(np.uint32), _NO_RETURN)).astype(np.uint32) \
            if len(no) else places.astype(np.uint32)
        rows = [{**x, "kind": WINDOWS, "chunk": r["chunk"]} for x in _by_block(blocks, idents[new], places=ref[new])]
        froms = np.concatenate([g.first[equal], known])
        tos = np.concatenate([g.last[equal], known]) + length
        # texts with a window still open wait
        open_ = np.zeros(len(offs) - 1, bool)
        pending = places[back & (size[no] == 1)] if len(no) else places
        open_[np.searchsorted(offs, pending, "right") - 1] = True
        gone = covered(len(data), froms, tos)
        doc_ids = np.array(r["doc_ids"], object)

        def subset(which: np.ndarray):
            sizes = np.diff(offs)[which]
            mask = np.repeat(which, np.diff(offs))
            return doc_ids[which].tolist(), data[mask], np.append(0, np.cumsum(sizes)), gone[mask]
        if (~open_).any():
            d, x, o, m = subset(~open_)
            rows.append({"kind": DONE, "chunk": r["chunk"], "dest": int(home(r["chunk"], blocks)[0]),
                         "text": _ipc(_results(d, x, o, m, with_text))})
        if open_.any():
            d, x, o, m = subset(open_)
            edge = np.flatnonzero(np.diff(np.concatenate([[0], m.view(np.int8), [0]]))).reshape(-1, 2)
            rows.append({"kind": TEXT, "chunk": r["chunk"], "dest": int(home(r["chunk"], blocks)[0]), "doc_ids": d, "text": x.tobytes(),
                         "offs": o.astype(np.int64).tobytes(), "froms": edge[:, 0].astype(np.int64).tobytes(),
                         "tos": edge[:, 1].astype(np.int64).tobytes(), "places": offs[:-1][open_].astype(np.int64).tobytes()})
        return rows

    def run(batches):
        for texts, answers in _by_chunk(batches):
            for r in texts:
                rows = one(r, answers)
                for i in range(0, len(rows), 200):
                    yield _batch(rows[i:i + 200])
    return run


def _by_chunk(batches):
    """(text rows, answer rows) of one chunk after the other; rows come sorted by
    chunk, so no more than a chunk is held."""
    chunk, texts, answers = None, [], []
    for b in batches:
        for lo in range(0, b.num_rows, 16):
            for r in b.slice(lo, 16).to_pylist():
                if r["chunk"] != chunk:
                    if chunk is not None:
                        yield texts, answers
                    chunk, texts, answers = r["chunk"], [], []
                (texts if r["kind"] == TEXT else answers).append(r)
    if chunk is not None:
        yield texts, answers


def _finish_task(length: int, with_text: bool):
    """Waiting texts with the answers on their windows; finished ones as they are."""
    def waiting(r: dict, answers: list[dict]) -> pa.RecordBatch:
        data, offs = np.frombuffer(r["text"], np.uint8), np.frombuffer(r["offs"], np.int64)
        origin = np.frombuffer(r["places"], np.int64)  # place of each text in its chunk
        p = np.concatenate([np.zeros(0, np.uint32), *[np.frombuffer(x["places"], np.uint32) for x in answers]]).astype(np.int64)
        k = np.searchsorted(origin, p, "right") - 1
        p = p - origin[k] + offs[:-1][k]
        gone = covered(len(data), np.concatenate([np.frombuffer(r["froms"], np.int64), p]),
                       np.concatenate([np.frombuffer(r["tos"], np.int64), p + length]))
        return _results(r["doc_ids"], data, offs, gone, with_text)

    def run(batches):
        for texts, others in _by_chunk(batches):
            done = [r for r in others if r["kind"] == DONE]
            for r in done:
                yield from pa.ipc.open_stream(r["text"])
            for r in texts:
                yield waiting(r, [x for x in others if x["kind"] == WINDOWS])
    return run


def suffix_dedup(docs: DataFrame, length: int = LENGTH, with_text: bool = True) -> DataFrame:
    """Rows, one per row of ``docs``: doc_id, n_bytes, n_removed, spans (maximal
    removed byte ranges), kept_sha256, kept (remaining bytes; null if
    ``with_text`` is false).

    A null text is empty. Copies and repeated rows remove each other wholly if
    they have ``length`` bytes; shorter texts lose nothing. Null doc_ids are
    kept. An empty table gives no rows. Only doc_id and text are read. The removed
    ranges may cut a character in two.
    """
    blocks = blocks_for(docs)
    src = spread_text(docs.select("doc_id", "text")).withColumn("part", F.spark_partition_id())
    # chunks and their anchors are written together: another scan of ``src`` need not cut the same chunks, as the order of
    # dealt rows and the splits of files may change
    chunks = write_stage(src.mapInArrow(_chunk_task(length, blocks), ROWS_SQL), "op5-chunks", **LARGE_ROWS)
    texts = chunks.filter(F.col("kind") == TEXT)
    anchors = chunks.filter(F.col("kind") == ANCHORS).select(*[c if c in ("dest", "kind", "chunk", "ids", "more", "flags") else
                                                               F.lit(None).cast(t).alias(c) for c, t in chunks.dtypes])
    settled = anchors.repartitionById(blocks, F.col("dest")).mapInArrow(_settle_anchors_task(blocks), ROWS_SQL)

    def by_chunk(rows: DataFrame) -> DataFrame:
        return rows.repartitionById(blocks, F.col("dest")).sortWithinPartitions("chunk", "kind")
    parts = by_chunk(settled.unionByName(texts)).mapInArrow(_refine_task(length, blocks, with_text), ROWS_SQL)
    finish = _finish_task(length, with_text)
    if not with_text:
        rest = parts.repartitionById(blocks, F.col("dest")).mapInArrow(_settle_windows_task(blocks), ROWS_SQL)
        return by_chunk(rest).mapInArrow(finish, OUT_SQL)
    parts = write_stage(parts, "op5-parts")  # finished texts are then moved no more
    rest = parts.filter(F.col("kind") != DONE).repartitionById(blocks, F.col("dest")).mapInArrow(_settle_windows_task(blocks), ROWS_SQL)
    return parts.filter(F.col("kind") == DONE).mapInArrow(finish, OUT_SQL).unionByName(by_chunk(rest).mapInArrow(finish, OUT_SQL))


def _cut_task(text_name: str):
    def run(batches):
        for b in batches:
            out = []
            names = b.schema.names[:-1]
            for text, spans in zip(b.column(text_name).cast(pa.binary()), b.column("spans").to_pylist()):
                if not spans:
                    out.append(text.as_py())
                    continue
                data = np.frombuffer(text.as_py(), np.uint8)
                head = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
                keep = np.ones(len(data), bool)
                for s in spans:  # only whole characters go
                    a = head[np.searchsorted(head, s["from"])]
                    keep[a:head[np.searchsorted(head, s["to"], "right") - 1]] = False
                out.append(data[keep].tobytes())
            cols = [pa.array(out, pa.binary()).cast(pa.string()) if n == text_name else b.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(cols, names=names)
    return run


def cut_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with the repeated strings cut out of the texts (characters that
    are only partly covered stay); all rows and all other columns stay, whatever their names are. ``docs``
    must be a table as read.
    """
    rows = with_rows(docs, "op5-rows")
    inner, text = rows.columns[:-1], f"c{docs.columns.index('text')}"
    found = suffix_dedup(rows.select(F.col("row").alias("doc_id"), F.col(text).alias("text")), length, with_text=False)
    changed = write_stage(found.filter("n_removed > 0").select(F.col("doc_id").alias("row"), "spans"), "op5-spans")
    kinds = dict(rows.dtypes)
    both = rows.join(changed, "row", "left").select(*inner, "spans")
    return both.mapInArrow(_cut_task(text), ", ".join(f"{c} {kinds[c]}" for c in inner)).toDF(*docs.columns)


def q_op5(spark, sf_dir: str) -> DataFrame:
    out = suffix_dedup(table(spark, sf_dir, "documents"), with_text=False)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
