"""N-gram Jaccard join by parity sketches.

Every distinct shingle flips one bit of a document's sketch (XOR), so that the Hamming distance of two sketches is at most
the symmetric difference of their sets. Linked sets of a and b shingles differ in at most (a + b)(1 - t)/(1 + t) shingles,
D in a band of sizes; the sketch of a band falls into D + 1 + s pieces, so linked documents agree in s + 1 pieces at least
(pigeonhole). A piece is a wide sketch of its own, held as the XOR of the 64-bit codes of its flipped bits. Pieces without
a flipped bit say nothing and aren't joined where a document has s of them at most: it still agrees in a full one.

1. Two passes over the texts: set size, set digest and sketch of each document; then its piece keys. Documents of equal
   sets are one node. Keys travel packed by range, about 12 bytes each, and become rows where they are sorted. Sketches have
   four bits or more for each shingle that linked sets of the size may differ in, so they tell most near misses.
2. Buckets: keys that several nodes share. Each member is compared with its bucket's least node only (a star): by sketches,
   then by whole sets. A node's pairs are cut by salts, so that one with very many is dealt to many tasks.
3. Components of the verified links. Buckets within one component are done. In the others, taken together where they have
   nearly the same members, members of different components are compared, in blocks, by sketches; first a spanning forest of
   what passes is verified and joins components, then every pair that is left between different ones.

Step 3 makes the result exact; a group of near copies costs a star and a forest of links, not all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import _mix, checked_broadcast, restrict, shingles, slices, stash, text_bytes, unstash, words
from tapeloom.llm.components import components

#: Members of a block.
BLOCK = 256
#: Keys and nodes that a task gathers before it packs them.
PACK_KEYS, PACK_NODES = 1 << 20, 30_000
#: Pairs of one node that are verified together, and the nodes with more that may be broadcast (16 MB).
HUB_PAIRS, HUBS = 1024, 1_000_000
#: Labels, with a number each, that may be broadcast (16 MB).
LABELS = 1_000_000
#: Wanted documents and their pairs that may be broadcast to the texts (24 bytes each, 40 MB); more are joined by shuffle.
BROADCAST_ROWS, BROADCAST_ITEMS = 300_000, 1_000_000
_RATIO = 1.5


def bands(top: int, percent: int) -> list[tuple[int, int, int, int]]:
    """(lowest size, highest size, pieces, spare pieces s) of each band of sizes up to top."""
    out, low = [], 1
    while low <= top:
        high = max(low, int(np.ceil(low * _RATIO)) - 1)
        most = (high + high * 100 // percent) * (100 - percent) // (100 + percent)
        spare = 0
        for _ in range(30):  # as many as the band's smallest sets have empty pieces, and three deviations more
            empty = (most + 1 + spare) * np.exp(-low / (most + 1 + spare))
            spare = min(int(np.ceil(empty + 3 * np.sqrt(empty))), 3 * high - most - 1) if most else 0
        out.append((low, high, most + 1 + spare, spare))
        low = high + 1
    return out


def sets(column: pa.Array, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes, the text each belongs to (in order), and the number of each text."""
    data, offsets = text_bytes(column)
    h, _, _, bounds = words(data, offsets)
    x, owner = shingles(h, bounds, k)
    if seed:
        x = _mix(x + np.uint64(seed))
    order = np.lexsort((x, owner))
    x, owner = x[order], owner[order]
    new = np.ones(len(x), dtype=bool)
    new[1:] = (x[1:] != x[:-1]) | (owner[1:] != owner[:-1])
    x, owner = x[new], owner[new]
    return x, owner, np.bincount(owner, minlength=len(column))


def _sums(x: np.ndarray, size: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x, out=total[1:])
    ends = np.cumsum(size)
    return total[ends] - total[ends - size]


def set_digest(x: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set, as two longs; equal for equal sets."""
    one = _mix(_sums(_mix(x ^ np.uint64(0x5851F42D4C957F2D)), size) + size.astype(np.uint64))
    two = _sums(_mix(x ^ np.uint64(0x14057B7EF767814F)), size)
    return one.view(np.int64), two.view(np.int64)


def piece_keys(x: np.ndarray, owner: np.ndarray, size: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket keys of all texts, joined, and how many each text has."""
    n = len(size)
    table = bands(int(size.max(initial=0)), percent)
    lows = np.array([b[0] for b in table], dtype=np.int64)
    pieces = np.array([b[2] if b[2] > 1 else 0 for b in table], dtype=np.int64)  # one piece: only equal sets link
    spare = np.array([b[3] for b in table], dtype=np.int64)
    own = np.searchsorted(lows, size, side="right") - 1
    below = own - 1
    first = np.where(size > 0, pieces[np.maximum(own, 0)] if len(table) else 0, 0)
    reaches = (below >= 0) & (-(-size * percent // 100) < lows[np.maximum(own, 0)]) if len(table) else np.zeros(n, bool)
    second = np.where(reaches, pieces[np.maximum(below, 0)] if len(table) else 0, 0)
    count = first + second
    start = np.cumsum(count) - count
    prints = np.zeros(int(count.sum()), np.uint64)
    code, place = _mix(x ^ np.uint64(0x2545F4914F6CDD1D)), x >> np.uint64(32)
    for many, at in ((first, start), (second, start + first)):
        mine = many[owner] > 0
        p = many[owner[mine]]
        index = at[owner[mine]] + ((place[mine] * p.astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        np.bitwise_xor.at(prints, index, code[mine])
    text = np.repeat(np.arange(n), count)
    index = np.arange(len(prints)) - start[text]
    upper = index >= first[text]
    band = np.where(upper, below[text], own[text])
    index = np.where(upper, index - first[text], index).astype(np.uint64)
    keys = _mix(prints + _mix((band.astype(np.uint64) << np.uint64(40)) + index)).view(np.int64)
    empty = prints == 0
    side = 2 * text + upper
    many = np.bincount(side[empty], minlength=2 * n)
    extra = (spare[band] if len(spare) else 0) - many[side]
    # with fewer empty pieces than s, a document's last full ones aren't needed: of two linked documents the one that leaves
    # out from the lower place on leaves out s - e pieces, and they agree in s + 1 - e full ones at least
    full = np.cumsum(~empty)
    last = np.zeros(2 * n, np.int64)
    np.maximum.at(last, side, full)
    keep = np.where(extra >= 0, ~empty & (full <= last[side] - extra), True)
    return keys[keep], np.bincount(text[keep], minlength=n)


def sketch_words(size: np.ndarray, percent: int) -> np.ndarray:
    """64-bit words of the sketch of sets of a size, a power of two: four bits or more for each shingle that linked sets may differ in."""
    most = (size + size * 100 // percent) * (100 - percent) // (100 + percent)
    return np.int64(1) << np.ceil(np.log2(np.maximum((most + 15) // 16, 1))).astype(np.int64)


def flat_sketch(x: np.ndarray, owner: np.ndarray, width: np.ndarray) -> np.ndarray:
    """The sketches of all texts, joined; width: the words of each."""
    start = np.cumsum(width) - width
    out = np.zeros(int(width.sum()), np.uint64)
    at = x & (width[owner].astype(np.uint64) * np.uint64(64) - np.uint64(1))
    np.bitwise_xor.at(out, start[owner] + (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return out


def _lists(values: np.ndarray, count: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(values.view(np.int64)))


def _fresh(ids: pa.Array, node: np.ndarray, seen: set[int]) -> np.ndarray:
    """Which rows have an id and a node that the task hasn't met; seen gets them."""
    fresh = ids.is_valid().to_numpy(zero_copy_only=False).copy()
    for i, v in enumerate(node.tolist()):
        if fresh[i]:
            fresh[i] = v not in seen
            seen.add(v)
    return fresh


def sketch(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int, seed: int = 0) -> DataFrame:
    """(doc_id, n_shingles, node, check, sketch) of each row; node and check are null for texts without words.

    Of the copies that a task meets only the first has a sketch.
    """

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for piece in slices(batch, text_col):
                x, owner, size = sets(piece.column(text_col), k, seed)
                node, check = set_digest(x, size)
                none = size == 0
                use = _fresh(piece.column(id_col), node, seen) & ~none
                width = np.where(use, sketch_words(size, percent), 0)
                flat = flat_sketch(x[use[owner]], owner[use[owner]], width)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(id_col).cast(pa.int64()), pa.array(size), pa.array(node, mask=none), pa.array(check, mask=none), _lists(flat, width)],
                    names=["doc_id", "n_shingles", "node", "check", "sketch"],
                )

    return docs.select(id_col, text_col).mapInArrow(run, "doc_id long, n_shingles long, node long, check long, sketch array<long>")


def pack(keys: np.ndarray, count: np.ndarray, node: np.ndarray, ranges: int) -> pa.RecordBatch:
    """One row for each range of keys that occurs: 40 further bits of each key, the nodes, and which node each key has."""
    bits = keys.view(np.uint64)
    part = ((bits >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    order = np.argsort(part.astype(np.uint16) if ranges <= 1 << 16 else part, kind="stable")
    part, bits, who = part[order].astype(np.int64), bits[order], np.repeat(np.arange(len(node)), count)[order]
    fresh = np.ones(len(part), dtype=bool)
    fresh[1:] = part[1:] != part[:-1]
    start = np.flatnonzero(fresh)
    fresh[1:] |= who[1:] != who[:-1]
    run = np.cumsum(fresh) - 1
    size = np.diff(np.append(start, len(part)))
    at = run - np.repeat(run[start], size)
    runs = np.diff(np.append(run[start], run[-1] + 1 if len(run) else 0))

    def lists(values, n):
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(values))

    return pa.RecordBatch.from_arrays(
        [
            pa.array(part[start].astype(np.int32)), lists(bits.astype(np.uint32).view(np.int32), size), lists((bits >> np.uint64(32)).astype(np.uint8).view(np.int8), size),
            lists(at.astype(np.int16), size), lists(node[who[fresh]], runs),
        ],
        names=["part", "low", "high", "at", "nodes"],
    )


def piece_rows(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int, seed: int = 0) -> DataFrame:
    """(part, key, node): the piece keys of all nodes, dealt by part, ranges of keys; of a task's copies only the first's."""
    ranges = min(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 << 22)

    def run(batches):
        seen: set[int] = set()
        held, n_keys, n_nodes = [], 0, 0
        for batch in batches:
            for piece in slices(batch, text_col):
                x, owner, size = sets(piece.column(text_col), k, seed)
                node, _ = set_digest(x, size)
                use = _fresh(piece.column(id_col), node, seen)
                keys, count = piece_keys(x[use[owner]], owner[use[owner]], np.where(use, size, 0), percent)
                some = count > 0
                if n_keys + len(keys) > PACK_KEYS or n_nodes + some.sum() > PACK_NODES:
                    if held:
                        yield pack(*map(np.concatenate, zip(*held, strict=True)), ranges)
                    held, n_keys, n_nodes = [], 0, 0
                for s in range(0, int(some.sum()), PACK_NODES):
                    chosen = np.flatnonzero(some)[s : s + PACK_NODES]
                    ends = np.cumsum(count)
                    one = keys[ends[chosen[0]] - count[chosen[0]] : ends[chosen[-1]]], count[chosen], node[chosen]
                    if s + PACK_NODES < some.sum():
                        yield pack(*one, ranges)
                    else:
                        held.append(one)
                        n_keys, n_nodes = n_keys + len(one[0]), n_nodes + len(chosen)
        if held:
            yield pack(*map(np.concatenate, zip(*held, strict=True)), ranges)

    packed = docs.select(id_col, text_col).mapInArrow(run, "part int, low array<int>, high array<byte>, at array<short>, nodes array<long>").repartition("part")
    each = packed.select("*", F.posexplode("low").alias("p", "l"))
    low, high = F.col("l").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)), F.get("high", F.col("p")).cast("long").bitwiseAND(F.lit(0xFF))
    key = F.shiftleft(F.col("part").cast("long"), 40).bitwiseOR(F.shiftleft(high, 32)).bitwiseOR(low)
    return each.select("part", key.alias("key"), F.get("nodes", F.get("at", F.col("p")).cast("int")).alias("node"))


def _matrix(values: np.ndarray, start: np.ndarray, width: np.ndarray, rows: np.ndarray, w: int) -> np.ndarray:
    """The sketches of some rows, each folded to w words: bits are taken modulo a power of two, so halves are XORed."""
    out = np.zeros((len(rows), w), np.uint64)
    for many in np.unique(width[rows]):
        own = np.flatnonzero(width[rows] == many)
        got = values[start[rows[own]][:, None] + np.arange(many)]
        out[own] = np.bitwise_xor.reduce(got.reshape(len(own), many // w, w), axis=1)
    return out


def _sketches(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words, and the first word and the number of words of each row."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False).view(np.uint64), offsets[:-1].astype(np.int64), np.diff(offsets).astype(np.int64)


def _distances(left, right, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Hamming distance of the sketches of left rows p and right rows q, at the smaller width of each pair."""
    (xa, sa, wa), (xb, sb, wb) = left, right
    out = np.zeros(len(p), np.int64)
    least = np.minimum(wa[p], wb[q])
    for w in np.unique(least).tolist():
        mine = np.flatnonzero(least == w)
        rows_a, at_a = np.unique(p[mine], return_inverse=True)
        rows_b, at_b = np.unique(q[mine], return_inverse=True)
        a, b = _matrix(xa, sa, wa, rows_a, w), _matrix(xb, sb, wb, rows_b, w)
        step = max(1, (1 << 18) // w)
        for s in range(0, len(mine), step):
            out[mine[s : s + step]] = np.bitwise_count(a[at_a[s : s + step]] ^ b[at_b[s : s + step]]).sum(axis=1, dtype=np.int64)
    return out


def _similar(na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    return np.minimum(na, nb) * 100 >= np.maximum(na, nb) * percent


def salted(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pairs (a, b), stashed, with a salt that cuts the pairs of each a into groups of about HUB_PAIRS; and (a, salts) of those cut.

    The second has a row for every HUB_PAIRS pairs at most, and no more than HUBS rows, so it may be broadcast.
    """
    if not hasattr(pairs, "stash_path"):
        pairs = stash(pairs, "pairs")
    most = max(HUB_PAIRS, pairs.count() // HUBS + 1)
    hubs = stash(pairs.groupBy("a").count().where(F.col("count") > most).select("a", F.ceil(F.col("count") / most).cast("int").alias("salts")), "hubs")
    salt = F.pmod(F.xxhash64("b"), F.coalesce("salts", F.lit(1))).cast("int")
    return pairs.join(F.broadcast(hubs), "a", "left").select("a", "b", salt.alias("salt")), hubs


def near(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b) that sizes and sketches leave possible, with their salt."""
    cut, hubs = salted(pairs)
    right = sketches.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b"))
    left = sketches.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a"))
    left = left.join(F.broadcast(hubs), "a", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")

    def run(batches):
        for batch in batches:
            na, nb = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            rows = np.flatnonzero(_similar(na, nb, percent))
            d = _distances(_sketches(batch.column("s_a")), _sketches(batch.column("s_b")), rows, rows)
            keep = rows[d * (100 + percent) <= (na + nb)[rows] * (100 - percent)]
            yield batch.select(["a", "b", "salt"]).take(pa.array(keep))

    return cut.join(right, "b").join(left, ["a", "salt"]).select("a", "b", "salt", "n_a", "n_b", "s_a", "s_b").mapInArrow(run, "a long, b long, salt int")


class Verifier:
    """Tells by whole sets which pairs of nodes link."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, k: int, percent: int, seed: int, nodes: DataFrame):
        self.docs, self.id_col, self.text_col, self.k, self.percent, self.seed, self.nodes = docs, id_col, text_col, k, percent, seed, nodes

    def __call__(self, pairs: DataFrame) -> DataFrame:
        """Those of pairs (a, b, salt) whose sets link, stashed.

        The set of b goes to each of its a's once, that of a to each of its salts: one shuffle, in which a task holds one
        set of an a and sees the others pass.
        """
        text_col, k, percent, seed = self.text_col, self.k, self.percent, self.seed
        pairs = stash(pairs, "near")
        to = pairs.groupBy(F.col("b").alias("node")).agg(F.collect_list(F.struct("a", "salt")).alias("to")).withColumn("salts", F.lit(0))
        hub = pairs.groupBy(F.col("a").alias("node")).agg((F.max("salt") + 1).alias("salts"))
        hub = hub.select("node", F.expr("cast(array() as array<struct<a: bigint, salt: int>>)").alias("to"), "salts")
        ends = to.unionByName(hub).groupBy("node").agg(F.flatten(F.collect_list("to")).alias("to"), F.max("salts").alias("salts"))
        wanted = stash(ends.join(self.nodes.select("node", F.col("first_id").alias("_first")), "node"), "wanted")
        rows, items = wanted.agg(F.count("*"), F.coalesce(F.sum(F.size("to")), F.lit(0))).first()
        listed = F.broadcast(wanted) if rows <= BROADCAST_ROWS and items <= BROADCAST_ITEMS else wanted
        found = self.docs.select(F.col(self.id_col).alias("_id"), F.col(text_col).alias("_text")).join(listed, F.col("_id") == F.col("_first")).select("_text", "node", "to", "salts")

        def emit(batches):
            for batch in batches:
                for piece in slices(batch, "_text"):
                    x, owner, size = sets(piece.column("_text"), k, seed)
                    node, _ = set_digest(x, size)
                    ends, mine = np.cumsum(size), piece.column("node").to_numpy()
                    out, held = [[], [], [], []], 0
                    for i in np.flatnonzero(node == mine).tolist():  # rows that share an id may hold other texts
                        own = x[ends[i] - size[i] : ends[i]].view(np.int64)
                        listed = piece.column("to")[i].values
                        to = [(int(node[i]), s, None) for s in range(piece.column("salts")[i].as_py())]
                        to += zip(listed.field("a").to_pylist(), listed.field("salt").to_pylist(), [int(node[i])] * len(listed), strict=True)
                        for a, salt, b in to:
                            for column, value in zip(out, (a, salt, b, own), strict=True):
                                column.append(value)
                            held += len(own)
                            if held > PACK_KEYS // 2:
                                yield _set_rows(out)
                                out, held = [[], [], [], []], 0
                    if held:
                        yield _set_rows(out)

        def check(batches):
            at, own = None, None
            for batch in batches:
                a, salt, b = (batch.column(c).to_pylist() for c in ("a", "salt", "b"))
                column = batch.column("shingles")
                offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).view(np.uint64)
                keep = []
                for i in range(batch.num_rows):
                    x = values[offsets[i] : offsets[i + 1]]
                    if b[i] is None:
                        at, own = (a[i], salt[i]), x.copy()
                    elif at == (a[i], salt[i]):
                        place = np.minimum(np.searchsorted(own, x), len(own) - 1)
                        common = int((own[place] == x).sum())
                        if common * (100 + percent) >= (len(own) + len(x)) * percent:
                            keep.append(i)
                yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

        rows = found.mapInArrow(emit, "a long, salt int, b long, shingles array<long>")
        linked = stash(rows.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first()).mapInArrow(check, "a long, b long"), "linked")
        for done in (pairs, wanted):
            unstash(done)
        return linked


def _set_rows(columns: list[list]) -> pa.RecordBatch:
    a, salt, b, shingle = columns
    size = np.array([len(x) for x in shingle], dtype=np.int64)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(salt, pa.int32()), pa.array(b, pa.int64()), _lists(np.concatenate(shingle), size)], names=["a", "salt", "b", "shingles"])


def _forest(label_a: np.ndarray, label_b: np.ndarray, count: int) -> np.ndarray:
    """Of edges between labels 0 to count - 1, best first, those of a spanning forest."""
    root = np.arange(count)
    out: list[int] = []
    while True:
        ends = np.stack([root[label_a], root[label_b]], axis=1)
        live = np.flatnonzero(ends[:, 0] != ends[:, 1])
        if not len(live):
            return np.array(sorted(out), dtype=np.int64)
        best = np.unique(np.unique(ends[live].reshape(-1), return_index=True)[1] // 2)  # the best edge of each tree
        for e in live[best].tolist():
            x, y = root[label_a[e]], root[label_b[e]]
            if x != y:
                root[root == max(x, y)] = min(x, y)
                out.append(e)


def _across(percent: int, forest: bool):
    """Pairs of two blocks' members, of different labels, that sizes and sketches leave possible: all, or a spanning forest of them."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                sides = []
                for name in ("left", "right"):
                    flat = batch.column(name)[i].values
                    node, label, n = (flat.field(f).to_numpy(zero_copy_only=False) for f in ("node", "label", "n"))
                    sides.append((node, label, n, _sketches(flat.field("sketch"))))
                (a, la, na, xa), (b, lb, nb, xb) = sides
                twice = len(a) == len(b) and bool((a == b).all())  # a block and itself: each pair once
                p, q = np.nonzero((la[:, None] != lb[None, :]) & _similar(na[:, None], nb[None, :], percent) & (a[:, None] < b[None, :] if twice else True))
                if not len(p):
                    continue
                d, total = _distances(xa, xb, p, q), na[p] + nb[q]
                keep = np.flatnonzero(d * (100 + percent) <= total * (100 - percent))
                if forest:
                    keep = keep[np.argsort(d[keep] / total[keep], kind="stable")]
                    names, index = np.unique(np.concatenate([la[p[keep]], lb[q[keep]]]), return_inverse=True)
                    keep = keep[_forest(index[: len(keep)], index[len(keep) :], len(names))]
                x, y = a[p[keep]], b[q[keep]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    return run


def residual(members: DataFrame, labels: DataFrame, sketches: DataFrame, percent: int, forest: bool) -> DataFrame:
    """Pairs (a, b) of different labels that share a bucket and may link, but for those with a bucket's least node.

    Members of a bucket's most frequent label, which may be nearly all, aren't compared with one another.
    """
    m = members.where("node <> lo").select("key", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    same = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"d{i}") for i in (1, 2)]
    each = m.groupBy("key", "label").agg(F.count("*").alias("many"), *same)
    mixed = each.groupBy("key").agg(F.sum("many").alias("size"), F.max(F.struct("many", "label")).alias("top"), *[F.bit_xor(f"d{i}").alias(f"d{i}") for i in (1, 2)]).where("top.many < size")
    # near misses share many pieces: of buckets with the same members one is compared
    mixed = mixed.groupBy("size", "d1", "d2").agg(F.min(F.struct("key", "top.label")).alias("x")).select("x.key", "size", F.col("x.label").alias("first"))
    mixed = stash(mixed, "mixed")
    m = m.join(mixed, "key")
    # and buckets with one most frequent label are one where their members together make fewer pairs than each bucket for itself
    cost = mixed.groupBy("first").agg(F.sum(F.col("size").cast("double") * F.col("size")).alias("apart"), F.count("*").alias("keys")).where("keys > 1")
    cost = stash(cost.select("first", "apart"), "cost")
    joint = m.join(checked_broadcast(cost, LABELS), "first").groupBy("first", "node").agg(F.first("apart").alias("apart")).groupBy("first").agg(F.count("*").alias("n"), F.first("apart").alias("apart"))
    joint = stash(joint.where(F.col("n").cast("double") * F.col("n") <= F.col("apart")).select("first", F.lit(True).alias("joint")), "joint")
    m = m.join(checked_broadcast(joint, LABELS), "first", "left").select(F.when(F.col("joint"), F.xxhash64("first", F.lit(1))).otherwise(F.col("key")).alias("key"), "first", "node", "label").distinct()
    m = stash(m, "compared")
    count = m.groupBy("key").agg(F.count("*").alias("size"), F.count_if(F.col("label") == F.col("first")).alias("many"))
    small = F.col("size") <= BLOCK
    tops = F.when(small, 1).otherwise(F.greatest(F.ceil(F.col("many") / BLOCK), F.lit(1))).cast("int")
    rests = F.when(small, 0).otherwise(F.ceil((F.col("size") - F.col("many")) / BLOCK)).cast("int")
    x = m.join(count, "key").join(sketches, "node").withColumn("tops", tops).withColumn("rests", rests)
    h = F.xxhash64("node", F.lit(1))
    at = F.when((F.col("rests") == 0) | (F.col("label") == F.col("first")), F.pmod(h, F.col("tops"))).otherwise(F.col("tops") + F.pmod(h, F.greatest("rests", F.lit(1)))).cast("int")
    block = stash(x.withColumn("block", at).groupBy("key", "tops", "rests", "block").agg(F.collect_list(F.struct("node", "label", "n", "sketch")).alias("left")), "blocks")
    whole = block.where("rests = 0").select("left", F.col("left").alias("right"))
    cut = block.where("rests > 0")
    other = cut.select("key", F.col("block").alias("other"), F.col("left").alias("right"))
    # a block of the rest meets all blocks of the first label and those of the rest from itself on
    meets = F.concat(F.sequence(F.lit(0), F.col("tops") - 1), F.sequence("block", F.col("tops") + F.col("rests") - 1))
    pairs = cut.where("block >= tops").withColumn("other", F.explode(meets)).join(other, ["key", "other"])
    found = stash(whole.unionByName(pairs.select("left", "right")).mapInArrow(_across(percent, forest), "a long, b long").distinct(), "across")
    unstash(block)
    unstash(m)
    return found


def merge(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, label) with those joined that further links (a, b) connect; links may name nodes without a label."""
    named = links
    for end in ("a", "b"):
        named = named.join(labels.select(F.col("node").alias(end), F.col("label").alias("up")), end, "left").withColumn(end, F.coalesce("up", end)).drop("up")
    upper = components(named).select(F.col("node").alias("label"), F.col("label").alias("up"))
    single = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).distinct().join(labels, "node", "left_anti").select("node", F.col("node").alias("label"))
    return stash(labels.unionByName(single).join(upper, "label", "left").select("node", F.coalesce("up", "label").alias("label")), "merged")


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, percent: int = 90) -> tuple[DataFrame, DataFrame]:
    """The sketched documents, and (node, label, first_id) of the nodes that link with another."""
    seed = 0
    while True:
        base = stash(sketch(docs, id_col, text_col, k, percent, seed), "sketch")
        known = base.where(F.col("doc_id").isNotNull() & F.col("node").isNotNull())
        nodes = stash(known.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.min("check").alias("c1"), F.max("check").alias("c2")), "nodes")
        if nodes.where("c1 <> c2").isEmpty():
            break
        seed += 1  # two sets met in 64 bits: hash anew
    bucket = Window.partitionBy("part", "key")
    each = piece_rows(docs, id_col, text_col, k, percent, seed).withColumn("lo", F.min("node").over(bucket)).withColumn("hi", F.max("node").over(bucket))
    members = stash(each.where("lo <> hi").select("part", "key", "node", "lo").distinct().drop("part"), "members")
    held = base.where(F.size("sketch") > 0).groupBy("node").agg(F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    sketches = stash(held.join(members.select("node").distinct(), "node", "left_semi"), "sketches")
    verify = Verifier(docs, id_col, text_col, k, percent, seed, nodes)
    labels = components(verify(near(members.where("node <> lo").select(F.col("lo").alias("a"), F.col("node").alias("b")).distinct(), sketches, percent)))
    for forest in (True, False):  # most links by few pairs; then every pair that is left
        labels = merge(labels, verify(salted(residual(members, labels, sketches, percent, forest))[0]))
    for done in (members, sketches):
        unstash(done)
    return base, labels.join(nodes.select("node", "first_id"), "node")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row: the size of its shingle set and the smallest id reachable by links.

    Two documents link when 100 * |intersection| >= percent * |union| of their distinct k-word shingles. A text of fewer
    than k words has its whole sequence as one shingle; one without words, or null, has none and links with nothing. Rows
    that share an id count as one document; a row without an id gets the component of documents with an equal set, or
    null. The id column must hold integers. Other columns are left out; an empty table gives no rows.
    """
    base, nodes = links(docs, id_col, text_col, k, percent)
    first = nodes.groupBy("label").agg(F.min("first_id").alias("least"))
    named = nodes.join(first, "label").select(F.col("node").alias("_node"), "least")
    known = base.where(F.col("doc_id").isNotNull() & F.col("node").isNotNull()).groupBy(F.col("node").alias("_node")).agg(F.min("doc_id").alias("first_id"))
    known = known.join(named, "_node", "left").select("_node", F.coalesce("least", "first_id").alias("component_id"))
    # texts without words have no node: they are dealt by their ids
    out = base.select("doc_id", "n_shingles", "node", F.coalesce("node", F.xxhash64("doc_id")).alias("_node")).join(known, "_node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select(F.col("doc_id").alias(id_col), "n_shingles", component.alias("component_id"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """docs without those that have a document of a smaller id in their component. Rows without an id stay."""
    found = near_duplicates(docs, id_col, text_col, k, percent)
    gone = stash(found.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct(), "gone")
    return restrict(docs, gone, id_col, False).select(*docs.columns)


ORACLE = r"""
WITH RECURSIVE low AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + size - 1], ' ') AS s FROM (SELECT doc_id, w, least(3, len(w)) AS size, unnest(range(1, len(w) - least(3, len(w)) + 2)) AS i FROM low WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
inter AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM inter JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 90 * (p.n + q.n - c)),
sym AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(src, dst) AS (SELECT a, b FROM sym UNION SELECT reach.src, sym.b FROM reach JOIN sym ON reach.dst = sym.a)
SELECT low.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(low.doc_id, coalesce(m, low.doc_id)) AS component_id
FROM low LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT src AS doc_id, min(dst) AS m FROM reach GROUP BY src) USING (doc_id)
"""
