"""Removal of repeated byte strings: exact, by anchors and a threshold-bounded expansion on a Burrows-Wheeler transform.

Every string (window) of `length` bytes is filed under its anchor, the GRAM bytes of the least hash within it, so equal
windows meet under one anchor wherever they stand. Neighbouring windows with one anchor form a region.

1. One pass over the texts emits regions (anchor hash, region digest); those that repeat one of the same slice are known to
   go and dealt evenly. Equal regions (copies) are settled by digest: all but the first are removed. Anchors that only equal
   regions share are done.
2. Anchors with different regions: the first of each is cut from its text. A task sorts the rotations of its regions, forms
   their Burrows-Wheeler transform and expands intervals backwards, breadth first, so that common-prefix lengths appear in
   increasing order; it stops at `length`. Rotations between two boundaries share `length` bytes at least: all windows of
   such a group but the first are removed.
3. Anchors with more than HOT_BYTES of regions don't fit one transform. Their regions are divided by a second anchor, of
   another hash, dealt anew and treated alike: copies are settled, what is left is transformed. Should the two anchors
   together still be too hot, their windows are dealt and sorted by their bytes, and all of a run of equal ones but the
   first are removed, however long the run is.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import _BASE, _BYTE_CODE, _INV, _mix, powers, slices, stash, text_bytes, unstash

GRAM = 32
#: Region bytes of one anchor that are transformed at once, and of several together: 2 MB at most, which take about 200 MB.
HOT_BYTES = BATCH_BYTES = 1 << 20
#: Bytes of texts whose regions are found at once; a hundred times as many are taken by the numbers beside them.
TEXT_BYTES = 1 << 18
#: Bytes of lists that may be broadcast to the texts, and of a row and of a list item there; more are joined by shuffle.
BROADCAST_BYTES, ROW_BYTES, ITEM_BYTES = 128 << 20, 80, 48
_LAST = np.iinfo(np.int64).max


def _hasher(data: np.ndarray):
    """A function that hashes data[a:b] for arrays a and b of bounds."""
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_CODE[data] * powers(_BASE, n), out=total[1:])
    back = powers(_INV, n + 1)
    return lambda a, b: _mix((total[b] - total[a]) * back[a])


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The place of the leftmost least value of every window of `width` values, by doubling."""
    index, size = np.arange(len(h)), 1
    low = h
    while size < width:
        step = min(size, width - size)
        a, b = low[:-step], low[step:]
        right = b < a
        index = np.where(right, index[step:], index[:-step])
        low = np.where(right, b, a)
        size += step
    return index


def regions(data: np.ndarray, offsets: np.ndarray, length: int, gram: int = GRAM, seed: int = 0):
    """(text, first window, windows, anchor hash, digest) of the regions of texts joined in data; windows never cross texts. seed: the hash that chooses anchors."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none
    digest = _hasher(data)
    at = np.arange(len(data) - gram + 1)
    h = digest(at, at + gram)
    if seed:
        h = _mix(h + np.uint64(seed))
    anchor = _least(h, length - gram + 1)[: len(data) - length + 1]
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    start = np.arange(len(data) - length + 1)
    inside = text[start] == text[start + length - 1]
    start, anchor = start[inside], anchor[inside]
    if not len(start):
        return none, none, none, none, none
    new = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (text[start[1:]] != text[start[:-1]])))
    first, n = start[new], np.diff(np.append(new, len(start)))
    where = anchor[new]
    r = _mix(digest(first, first + n + length - 1) + n.astype(np.uint64) * np.uint64(0x9E3779B1) + (where - first).astype(np.uint64))
    return text[first], first - offsets[text[first]], n, h[where].view(np.int64), r.view(np.int64)


def _ids(column: pa.Array) -> np.ndarray:
    """Ids as longs; null comes last."""
    return column.cast(pa.int64()).fill_null(_LAST).to_numpy(zero_copy_only=False)


def _checks(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A number for each text that tells apart rows which share an id."""
    raw = data.tobytes()
    return np.array([zlib.crc32(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], dtype=np.int64)


_ROW = "kind int, h long, r long, doc long, chk long, at int, n int"


def _rows(kind: int, h, r, doc, chk, at, n) -> pa.RecordBatch:
    columns = [pa.array(np.full(len(doc), kind, np.int32)), pa.array(h), pa.array(r), pa.array(doc), pa.array(chk), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32))]
    return pa.RecordBatch.from_arrays(columns, names=["kind", "h", "r", "doc", "chk", "at", "n"])


def _emit(length: int, text_col: str, id_col: str):
    """Step 1: kind 0, a region; kind 1, a region that repeats one of the same slice and so is removed.

    The two are told apart in one pass: nothing depends on how a second one would be sliced.
    """

    def run(batches):
        for batch in batches:
            for piece in slices(batch, text_col, TEXT_BYTES):
                data, offsets = text_bytes(piece.column(text_col))
                text, at, n, h, r = regions(data, offsets, length)
                if not len(text):
                    continue
                doc, chk = _ids(piece.column(id_col))[text], _checks(data, offsets)[text]
                order = np.lexsort((at, chk, doc, r, h))
                doc, chk, at, n, h, r = (x[order] for x in (doc, chk, at, n, h, r))
                same = np.append(False, (h[1:] == h[:-1]) & (r[1:] == r[:-1]))
                twin = same & np.append(False, (doc[1:] == doc[:-1]) & (chk[1:] == chk[:-1]) & (at[1:] == at[:-1]))  # a repeated row
                for kind, rows in ((0, ~same), (1, same & ~twin)):
                    if rows.any():
                        yield _rows(kind, h[rows], r[rows], doc[rows], chk[rows], at[rows], n[rows])

    return run


def _settle(batches):
    """Rows sorted by anchor, digest and place: kind 1, removed copies; kind 0, firsts of anchors with different regions.

    Rows of kind 1 come last and pass. Holds one row at a time besides the batch, however many rows an anchor has.
    """
    names = ("h", "r", "doc", "chk", "at", "n")
    last = None  # the row before this batch
    held = None  # the only region so far of the anchor of the last row
    for batch in batches:
        known = pc.greater(batch.column("kind"), 0)
        if pc.any(known).as_py():
            yield batch.filter(known)
            batch = batch.filter(pc.invert(known))
        if not batch.num_rows:
            continue
        c = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in names}
        before = {k: np.append(c[k][:1] if last is None else last[k], c[k][:-1]) for k in names}
        new_h = c["h"] != before["h"]
        if last is None:
            new_h[0] = True
        new_r = new_h | (c["r"] != before["r"])
        twin = ~new_r & (c["doc"] == before["doc"]) & (c["chk"] == before["chk"]) & (c["at"] == before["at"])
        gone = ~new_r & ~twin
        if gone.any():
            yield _rows(1, *(c[k][gone] for k in names))
        first = {k: c[k][new_r] for k in names}
        if held is not None:
            first = {k: np.append(held[k], first[k]) for k in names}
        open_h = last["h"][0] if last is not None and held is None else None  # its regions so far have gone out
        held, last = None, {k: c[k][-1:] for k in names}
        if len(first["h"]):
            edge = np.flatnonzero(np.append(True, first["h"][1:] != first["h"][:-1]))
            count = np.repeat(np.diff(np.append(edge, len(first["h"]))), np.diff(np.append(edge, len(first["h"]))))
            several = count > 1
            if open_h is not None:
                several |= first["h"] == open_h
            if first["h"][-1] == last["h"][0] and not several[-1]:
                held = {k: first[k][-1:] for k in names}
            if several.any():
                yield _rows(0, *(first[k][several] for k in names))


def _join_small(docs: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """docs (with _doc) joined with per-document lists, which are broadcast only if their size allows."""
    rows, items = lists.agg(F.count("*"), F.coalesce(F.sum(F.size("items")), F.lit(0))).first()
    small = rows * ROW_BYTES + items * ITEM_BYTES <= BROADCAST_BYTES
    return docs.join(F.broadcast(lists) if small else lists, "_doc", how)


def _cut(length: int, text_col: str):
    """Step 2: the bytes of each listed region."""

    def run(batches):
        for batch in batches:
            doc, items = batch.column("_doc").to_numpy(zero_copy_only=False), batch.column("items")
            out: list[list] = [[] for _ in range(7)]
            held = 0
            for i in range(batch.num_rows):
                raw = (batch.column(text_col)[i].as_py() or "").encode()
                chk = zlib.crc32(raw)
                listed = items[i].values
                h, c, at, n = (listed.field(k).to_numpy(zero_copy_only=False) for k in ("h", "chk", "at", "n"))
                for k in np.flatnonzero(c == chk).tolist():
                    s, m = int(at[k]), int(n[k])
                    for column, value in zip(out, (int(h[k]), k, int(doc[i]), chk, s, m, raw[s : s + m + length - 1]), strict=True):
                        column.append(value)
                    held += m + length
                if held > 4 << 20 or i == batch.num_rows - 1:
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=["h", "r", "doc", "chk", "at", "n", "bytes"])
                    out, held = [[] for _ in range(7)], 0

    return run


def prefix_groups(x: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The rotations of x in order, and whether each begins a new group of rotations that share `length` bytes.

    Rotations are sorted by 128 bytes at least, by doubling. Boundaries of fewer than 64 common bytes come from the sort;
    from there intervals of the Burrows-Wheeler transform are extended backwards, breadth first: an interval of l + 1 bytes
    whose end isn't a boundary yet makes one, of exactly l common bytes. Ends that are none by `length` share that many.
    """
    n = len(x)
    small = np.int32 if n < 1 << 31 else np.int64
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = key << np.uint64(8) | np.roll(x, -j)
    ranks, size = {}, 8
    while True:
        order = np.argsort(key, kind="stable").astype(small)
        step = key[order]
        rank = np.empty(n, small)
        rank[order] = np.cumsum(np.append(False, step[1:] != step[:-1]), dtype=small)
        ranks[size] = rank
        if size > length:
            break
        key = rank.astype(np.uint64) * np.uint64(n) + np.roll(rank, -size).astype(np.uint64)
        size *= 2
    del key, step
    start = 64 if length > 64 else max(s for s in ranks if s <= length and s >= 8)
    g = ranks[start][order]
    bound = np.append(True, g[1:] != g[:-1])
    half = ranks[start // 2]
    del ranks, rank, g
    edge = np.flatnonzero(bound[1:])  # last row of every interval of `start` bytes but the last one
    here, there = order[edge], order[edge + 1]
    near = (half[here] == half[there]) & (half[(here + start // 2 - 1) % n] == half[(there + start // 2 - 1) % n])
    begin = np.flatnonzero(bound)[:-1]
    low, high = begin[near], edge[near] + 1  # half-open intervals whose end has exactly start - 1 common bytes
    del half, here, there
    bwt = x[(order - 1) % n].astype(np.int64)
    places = np.argsort(bwt, kind="stable")
    keys = bwt[places] * (n + 1) + places
    for _ in range(start, length):
        if not len(low):
            break
        width = high - low
        owner = np.repeat(np.arange(len(low)), width)
        at = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width) + np.repeat(low, width)
        pair = np.unique(owner * 256 + bwt[at])
        owner, c = pair >> 8, pair & 255
        new_low, new_high = np.searchsorted(keys, c * (n + 1) + low[owner]), np.searchsorted(keys, c * (n + 1) + high[owner])
        fresh = new_high < n
        fresh[fresh] = ~bound[new_high[fresh]]
        low, high = new_low[fresh], new_high[fresh]
        bound[high] = True
    return order, bound


def repeated(parts: list[bytes], doc: np.ndarray, chk: np.ndarray, at: np.ndarray, n: np.ndarray, length: int) -> list[np.ndarray]:
    """For each region, which of its windows also starts earlier (smaller document, or the same and an earlier place)."""
    gap = b"\xff"  # never in UTF-8; windows of a region end before it
    x = np.frombuffer(gap.join(parts) + gap, dtype=np.uint8)
    if len(x) < 2 * length:
        x = np.concatenate([x, np.full(2 * length - len(x), 0xFF, np.uint8)])
    size = np.array([len(p) + 1 for p in parts])
    begin = np.cumsum(size) - size
    owner = np.full(len(x), -1, dtype=np.int64)
    flat = np.repeat(np.arange(len(parts)), n)
    inner = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
    owner[begin[flat] + inner] = flat
    order, bound = prefix_groups(x, length)
    group = np.cumsum(bound)
    use = owner[order] >= 0
    place, group = order[use], group[use]
    part = owner[place]
    offset = at[part] + place - begin[part]
    rows = np.lexsort((offset, chk[part], doc[part], group))
    part, group, offset, place = part[rows], group[rows], offset[rows], place[rows]
    same = np.append(False, group[1:] == group[:-1])
    # a repeated row brings the same window twice; it isn't earlier than itself
    twin = same & np.append(False, (doc[part[1:]] == doc[part[:-1]]) & (chk[part[1:]] == chk[part[:-1]]) & (offset[1:] == offset[:-1]))
    lead = np.flatnonzero(~same)
    head = lead[np.cumsum(~same) - 1] if len(same) else lead
    as_head = (doc[part] == doc[part[head]]) & (chk[part] == chk[part[head]]) & (offset == offset[head]) if len(same) else same
    gone = same & ~(twin & as_head)
    out = np.zeros(len(flat), dtype=bool)
    first = np.cumsum(n) - n
    out[first[part[gone]] + place[gone] - begin[part[gone]]] = True
    return np.split(out, np.cumsum(n)[:-1])


_WINDOW = "kind int, h long, r long, doc long, chk long, at int, n int, bytes binary"


def _windows(rows: pa.RecordBatch, raw: pa.Array | None = None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*rows.columns, pa.nulls(rows.num_rows, pa.binary()) if raw is None else raw], names=[*rows.schema.names, "bytes"])


def _expand(length: int, hot: int, batch_bytes: int, again: bool):
    """Step 2 in batches of whole anchors, rows sorted by anchor, digest and place: kind 1, runs of removed windows; kind 2, of anchors above `hot` bytes.

    Of regions with one digest all but the first are removed. What goes out of a hot anchor is, the first time, its regions
    divided by a second anchor, and again its single windows.
    """

    def flush(rows: list[tuple]):
        h, doc, chk, at, n = (np.array([r[k] for r in rows], dtype=np.int64) for k in (0, 2, 3, 4, 5))
        flags = repeated([r[6] for r in rows], doc, chk, at, n, length)
        part, start, many = [], [], []
        for i, f in enumerate(flags):
            if f.any():
                edge = np.flatnonzero(np.diff(np.concatenate([[0], f.view(np.int8), [0]])))
                part += [i] * (len(edge) // 2)
                start += edge[::2].tolist()
                many += (edge[1::2] - edge[::2]).tolist()
        if part:
            part, start, many = np.array(part), np.array(start), np.array(many)
            zero = np.zeros(len(part), np.int64)
            yield _windows(_rows(1, h[part], zero, doc[part], chk[part], at[part] + start, many))

    def spread(rows: list[tuple]):
        for s in range(0, len(rows), 1024):
            some = rows[s : s + 1024]
            h, doc, chk, at, n = (np.array([r[k] for r in some], dtype=np.int64) for k in (0, 2, 3, 4, 5))
            raw = [r[6] for r in some]
            if again:
                part = np.repeat(np.arange(len(some)), n)
                first = np.arange(len(part)) - np.repeat(np.cumsum(n) - n, n)
                many, second, r = np.ones(len(part), np.int64), h[part], np.zeros(len(part), np.int64)
            else:
                size = np.array([len(x) for x in raw])
                part, first, many, second, r = regions(np.frombuffer(b"".join(raw), dtype=np.uint8), np.append(0, np.cumsum(size)), length, seed=0x5DEECE66D)
                second = _mix(h[part].view(np.uint64) ^ second.view(np.uint64)).view(np.int64)
            cut = pa.array([raw[i][a : a + m + length - 1] for i, a, m in zip(part.tolist(), first.tolist(), many.tolist(), strict=True)], pa.binary())
            yield _windows(_rows(2, second, r, doc[part], chk[part], at[part] + first, many), cut)

    def copies(rows: list[tuple]):
        if rows:
            h, r, doc, chk, at, n = (np.array([x[k] for x in rows], dtype=np.int64) for k in range(6))
            yield _windows(_rows(1, h, r, doc, chk, at, n))

    def run(batches):
        rows: list[tuple] = []  # whole anchors
        anchor: list[tuple] = []  # of the anchor at hand
        held, many = 0, 0  # bytes of both lists, and of the anchor at hand
        last = None  # anchor, digest and place of the row before
        for batch in batches:
            gone = []
            for row in zip(*(batch.column(k).to_pylist() for k in ("h", "r", "doc", "chk", "at", "n", "bytes")), strict=True):
                if last is None or row[0] != last[0]:
                    rows, anchor, many = rows + anchor, [], 0
                    if held >= batch_bytes:
                        yield from flush(rows)
                        rows, held = [], 0
                elif again and row[1] == last[1]:
                    if row[2:5] != last[2:5]:  # else a repeated row
                        gone.append(row)
                    last = row
                    continue
                last = row
                many += len(row[6]) + 1
                if many > hot:
                    yield from spread(anchor)
                    yield from spread([row])
                    held -= sum(len(r[6]) + 1 for r in anchor)
                    anchor = []
                else:
                    anchor.append(row)
                    held += len(row[6]) + 1
            yield from copies(gone)
        rows += anchor
        if rows:
            yield from flush(rows)

    return run


def _later(batches):
    """Windows sorted by their bytes and place: kind 1, all of a run of equal ones but the first and its repetitions."""
    before = None  # the last row of the batch before
    head = None  # the place of the first of its run
    for batch in batches:
        if not batch.num_rows:
            continue
        raw = batch.column("bytes")
        place = [batch.column(k).to_numpy(zero_copy_only=False) for k in ("doc", "chk", "at")]
        same = np.append(before is not None and before == raw[0].as_py(), pc.equal(raw.slice(1), raw.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)).astype(bool)
        lead = np.flatnonzero(~same)
        run = np.cumsum(~same)
        heads = [np.append(np.int64(0 if head is None else head[i]), p[lead])[run] for i, p in enumerate(place)]
        gone = same & ~np.logical_and.reduce([p == q for p, q in zip(place, heads, strict=True)])
        if gone.any():
            zero = np.zeros(int(gone.sum()), np.int64)
            yield _rows(1, zero, zero, *(p[gone] for p in place), zero + 1)
        before, head = raw[batch.num_rows - 1].as_py(), [int(q[-1]) for q in heads]


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, hot: int = HOT_BYTES, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(doc, items): for each document that loses bytes, runs of windows (chk, at, n) that also start earlier."""
    found = docs.select(id_col, text_col).mapInArrow(_emit(length, text_col, id_col), _ROW)
    dealt = found.repartition(F.when(F.col("kind") == 0, F.col("h")).otherwise(F.xxhash64("doc", "chk", "at"))).sortWithinPartitions("kind", "h", "r", "doc", "chk", "at")
    settled = stash(dealt.mapInArrow(_settle, _ROW), "settled")
    known = docs.withColumn("_doc", F.coalesce(F.col(id_col).cast("long"), F.lit(int(_LAST)))).select("_doc", text_col)
    listed = settled.where("kind = 0").groupBy(F.col("doc").alias("_doc")).agg(F.collect_list(F.struct("h", "chk", "at", "n")).alias("items"))
    listed = stash(listed, "listed")
    cut = _join_small(known, listed, "inner").mapInArrow(_cut(length, text_col), "h long, r long, doc long, chk long, at int, n int, bytes binary")
    columns = ("doc", "chk", "at", "n")
    gone = [settled.where("kind = 1").select(*columns)]
    for again in (False, True):
        dealt = cut.repartition("h").sortWithinPartitions("h", "r", "doc", "chk", "at")
        expanded = stash(dealt.mapInArrow(_expand(length, hot, batch_bytes, again), _WINDOW), "expanded")
        gone.append(expanded.where("kind = 1").select(*columns))
        cut = expanded.where("kind = 2").drop("kind")
    unstash(listed)
    late = cut.select("bytes", "doc", "chk", "at").repartition("bytes").sortWithinPartitions("bytes", "doc", "chk", "at").mapInArrow(_later, _ROW)
    every = gone[0].unionByName(gone[1]).unionByName(gone[2]).unionByName(late.select(*columns))
    return every.repartition("doc").sortWithinPartitions("doc", "chk", "at").mapInArrow(_joined, "_doc long, items array<struct<chk: bigint, at: int, n: int>>")


def _joined(batches):
    """Runs of windows sorted by document, check and place, with neighbours joined: a list for each document.

    Joining leaves about one run for each removed span, so that lists are short.
    """
    held: list[list[np.ndarray]] = []  # of the document at hand

    def out(doc, chk, at, end):
        new = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        items = pa.StructArray.from_arrays([pa.array(chk), pa.array(at.astype(np.int32)), pa.array((end - at).astype(np.int32))], names=["chk", "at", "n"])
        return pa.RecordBatch.from_arrays([pa.array(doc[new]), pa.ListArray.from_arrays(pa.array(np.append(new, len(doc)).astype(np.int32)), items)], names=["_doc", "items"])

    for batch in batches:
        if not batch.num_rows:
            continue
        doc, chk, at, n = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("doc", "chk", "at", "n"))
        rows = [doc, chk, at, at + n]
        if held:
            rows = [np.concatenate([*parts, x]) for parts, x in zip(zip(*held, strict=True), rows, strict=True)]
        doc, chk, at, end = rows
        group = np.cumsum(np.append(False, (doc[1:] != doc[:-1]) | (chk[1:] != chk[:-1])))
        reach = np.maximum.accumulate(end + (group << 32))  # offsets are below 2^31
        new = np.flatnonzero(np.append(True, at[1:] + (group[1:] << 32) > reach[:-1]))
        end = reach[np.append(new[1:] - 1, len(doc) - 1)] - (group[new] << 32)
        doc, chk, at = doc[new], chk[new], at[new]
        cut = int(np.flatnonzero(doc == doc[-1])[0])
        if cut:
            yield out(doc[:cut], chk[:cut], at[:cut], end[:cut])
        held = [[doc[cut:], chk[cut:], at[cut:], end[cut:]]]
    if held:
        yield out(*held[0])


def _spans(raw: bytes, listed, length: int) -> list[tuple[int, int]]:
    """Maximal removed runs of a text, from its listed windows."""
    if listed is None or not len(listed):
        return []
    chk = zlib.crc32(raw)
    c, at, n = (listed.field(k).to_numpy(zero_copy_only=False) for k in ("chk", "at", "n"))
    mine = c == chk
    start = at[mine].astype(np.int64)
    end = start + n[mine] + length - 1
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order]) if mine.any() else end
    if not len(start):
        return []
    new = np.append(True, start[1:] > end[:-1])
    return list(zip(start[new].tolist(), end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)].tolist(), strict=True))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, hot: int = HOT_BYTES, digests: bool = False, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """docs with kept (binary: the bytes left), n_bytes, n_removed and n_spans; or, with digests, the SHA-256 of what is left.

    Each byte that a string of `length` bytes covers which also starts earlier (in a document of a smaller id, or before in
    the same one) is removed; strings are those of the input, overlaps count, matches never cross documents. A null text is
    empty and loses nothing, as do texts shorter than `length`. Rows without an id come last in the order; rows that share
    an id are ordered by a checksum of their texts, and equal rows are kept or cut alike. Columns that bear an output's name
    are replaced; an empty table gives no rows. At least 64 bytes of length are needed.
    """
    if length <= 2 * GRAM:
        raise ValueError(f"the length must be above {2 * GRAM}")
    made = ("n_bytes", "n_removed", "n_spans", "kept_sha256" if digests else "kept")
    kept = [f for f in docs.schema.fields if f.name not in made and not (digests and f.name == text_col)]
    lists = stash(removals(docs, id_col, text_col, length, hot, batch_bytes), "removals")
    rows = docs.withColumn("_doc", F.coalesce(F.col(id_col).cast("long"), F.lit(int(_LAST))))
    joined = _join_small(rows, lists, "left")
    names = [f.name for f in kept]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["n_bytes long, n_removed long, n_spans long", "kept_sha256 string" if digests else "kept binary"])

    def run(batches):
        for batch in batches:
            for piece in slices(batch, text_col):
                items = piece.column("items")
                out: list[list] = [[], [], [], []]
                for i, text in enumerate(piece.column(text_col).to_pylist()):
                    raw = (text or "").encode()
                    spans = _spans(raw, items[i].values if items[i].is_valid else None, length)
                    left, at = [], 0
                    for a, b in spans:
                        left.append(raw[at:a])
                        at = b
                    whole = b"".join([*left, raw[at:]])
                    for column, value in zip(out, (len(raw), len(raw) - len(whole), len(spans), hashlib.sha256(whole).hexdigest() if digests else whole), strict=True):
                        column.append(value)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string() if digests else pa.binary())
                fields = [*(piece.schema.field(n) for n in names), *(pa.field(n, t) for n, t in zip(made, kinds, strict=True))]
                yield pa.RecordBatch.from_arrays([*(piece.column(n) for n in names), *(pa.array(x, t) for x, t in zip(out, kinds, strict=True))], schema=pa.schema(fields))

    return joined.mapInArrow(run, schema)
