"""Language-model scoring by context-tree weighting.

Bytes are decomposed into eight binary decisions; each decision has a context tree over the bytes before. Its first three
levels name a byte by its class (64 for the last two bytes, 16 for the third); below them, contexts are the last three to
DEPTH bytes as they are. The top has at most 2^24 counts and travels; the contexts of bytes grow with the corpus and stay
in a table, dealt by their last three bytes, so that a subtree lies in one place. Every node holds a Krichevsky-Trofimov
estimate; the weights of all depths follow from the counts of the whole training set, and scoring mixes the estimates
along a text's contexts: the most frequent ones (HOT_CONTEXTS at most) travel to the texts, all others are joined. Contexts
of texts that aren't learned from take their places in the tree without counts. Texts begin in, and end with, a byte that UTF-8 never uses, so that scores of texts are probabilities.

Beside it stands an add-one model of words. Its counts grow with the corpus and are never gathered in one place: the most
frequent words (HOT_WORDS at most) travel to the texts, all others are joined.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import _mix, held_out, slices, stash, text_bytes, words

HOT_WORDS = 131_072
#: Contexts with their byte that travel to the texts: 16 bytes each.
HOT_CONTEXTS = 2_000_000
#: Bytes of the longest context: with the byte that follows, 56 bits.
DEPTH = 6
#: Bytes of texts that are counted or scored at once.
TEXT_BYTES = 1 << 20
#: Keys of subtrees that are weighed at a time.
WEIGHED_KEYS = 200_000
#: Parts of the counts for each shuffle partition; a task adds up one at a time.
PARTS = 4
#: Distinct words that a task sums before it passes them on.
HELD_WORDS = 500_000
#: And deep keys: 16 bytes each.
HELD_CONTEXTS = 2_000_000
#: Counts whose log gamma is looked up.
_SMALL = 1 << 14
_EDGE = 0xFF
_END = _mix(np.array([0x656E64], dtype=np.uint64)).view(np.int64)[0]


def _fine() -> np.ndarray:
    """64 classes of bytes: letters without case, digits together, groups of signs, UTF-8 lead bytes and continuations."""
    c = np.zeros(256, dtype=np.int64)
    for i in range(26):
        c[65 + i] = c[97 + i] = 1 + i
    c[48:58] = 27
    for i, group in enumerate((" ", "\n\t\r", ".", ",", "!?", ";:", "'\"`", "([{<", ")]}>", "-_/\\", "|", "*#$%&@+=^~"), 28):
        for ch in group:
            c[ord(ch)] = i
    c[0x80:0xC0] = 40 + (np.arange(64) % 16)
    c[0xC0:0xC3], c[0xC3], c[0xC4:0xD0], c[0xD0:0xE0], c[0xE0:0xF0], c[0xF0:0xFF] = 56, 57, 58, 59, 60, 61
    c[_EDGE] = 62
    return c


def _coarse() -> np.ndarray:
    """16 classes: the commonest letters apart, other letters, signs and blanks, other bytes."""
    c = np.zeros(256, dtype=np.int64)
    c[0x80:] = 1
    c[[*range(65, 91), *range(97, 123)]] = 2
    for i, ch in enumerate("aeiounthrsdlc", 3):
        c[ord(ch)] = c[ord(ch) - 32] = i
    return c


_FINE, _COARSE = _fine(), _coarse()


def context_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 24-bit key (contexts, byte) of every byte and of each text's end, and the n + 1 offsets of texts among them."""
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(offsets))
    padded = np.full(len(data) + 3 * (n + 1), _EDGE, dtype=np.uint8)
    at = np.arange(len(data)) + 3 * (owner + 1)
    padded[at] = data
    fine = _FINE[padded]
    key = np.empty(len(padded), dtype=np.int64)
    key[3:] = (((_COARSE[padded[:-3]] << 6 | fine[1:-2]) << 6 | fine[2:-1]) << 8) | padded[3:]
    ends = offsets[1:] + 3 * np.arange(1, n + 1)
    use = np.zeros(len(padded), dtype=bool)
    use[at] = use[ends] = True
    return key[use], offsets + np.arange(n + 1)


def deep_keys(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The DEPTH bytes before every byte and each text's end, the last one highest, and below them the byte itself; ordered as context_keys."""
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(offsets))
    padded = np.full(len(data) + DEPTH * (n + 1), _EDGE, dtype=np.int64)
    at = np.arange(len(data)) + DEPTH * (owner + 1)
    padded[at] = data
    use = np.zeros(len(padded), dtype=bool)
    use[at] = use[offsets[1:] + DEPTH * np.arange(1, n + 1)] = True
    place = np.flatnonzero(use)
    key = padded[place]
    for back in range(1, DEPTH + 1):
        key |= padded[place - back] << (8 * (DEPTH + 1 - back))
    return key


def top_class(key: np.ndarray) -> np.ndarray:
    """The 16 bits of classes that context_keys gives the last three bytes of deep keys."""
    last = key >> (8 * (DEPTH - 2))
    return _COARSE[last & 255] << 12 | _FINE[last >> 8 & 255] << 6 | _FINE[last >> 16]


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log gamma for x > 0: Stirling's series after a shift by eight."""
    shift = np.ones_like(x)
    for i in range(8):
        shift = shift * (x + i)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(shift)


_HALVES, _WHOLES = (_lgamma(np.arange(_SMALL) + x) for x in (0.5, 1.0))


def _at(count: np.ndarray, table: np.ndarray, plus: float) -> np.ndarray:
    """log gamma of count + plus, from the table where that reaches."""
    out = table[np.minimum(count, _SMALL - 1).astype(np.int64)]
    large = count >= _SMALL
    if large.any():
        out[large] = _lgamma(count[large] + plus)
    return out


def _kt(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov block probability; counts are whole."""
    return _at(zero, _HALVES, 0.5) + _at(one, _HALVES, 0.5) - _at(zero + one, _WHOLES, 1.0) - np.log(np.pi)


def _bits(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of zeros and ones at the 255 nodes of the binary tree over bytes, from counts of 256 bytes."""
    zero, one = [], []
    for level in range(8):
        halves = counts.reshape(*counts.shape[:-1], 1 << level, 2, 128 >> level).sum(axis=-1)
        zero.append(halves[..., 0])
        one.append(halves[..., 1])
    return np.concatenate(zero, axis=-1).astype(float), np.concatenate(one, axis=-1).astype(float)


_HALF = np.log(0.5)


def weigh(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """log10 of every byte's probability in every context of classes alone: 2^24 numbers, from counts of context keys."""
    slot, one, zero, _ = mixture(keys, counts)
    total, at = np.zeros((len(one), 1)), 0
    for depth in range(8):
        nodes = slice(at, at + (1 << depth))
        total = np.stack([total + np.log10(zero[:, nodes]), total + np.log10(one[:, nodes])], axis=-1).reshape(len(one), -1)
        at += 1 << depth
    return total.astype(np.float32)[slot].reshape(-1)


def mixture(keys: np.ndarray, counts: np.ndarray, below: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What the levels of classes add to the probabilities of one and zero at each node over bytes, and the weight of what lies below.

    below: keys (class context, node) and the sums of log block probabilities of the contexts of bytes there; without it
    the classes are leaves. Contexts that weren't seen share a row; the first result has the row of each of the 2^16.
    """
    whole = np.zeros(1 << 24, dtype=np.int64)
    whole[keys] = counts
    whole = whole.reshape(16, 64, 64, 256)
    if below is not None:
        order = np.argsort(below[0] >> 8 & 63, kind="stable")
        under, value = below[0][order], below[1][order]
        bounds = np.searchsorted(under >> 8 & 63, np.arange(65))

    def level(last: int):
        """Of the contexts that end in one class: block probabilities, and weights and counts of depths 3, 2, 1."""
        zero3, one3 = _bits(whole[:, :, last])
        zero2, one2 = zero3.sum(axis=0), one3.sum(axis=0)
        zero1, one1 = zero2.sum(axis=0), one2.sum(axis=0)
        kt3, kt2, kt1 = _kt(zero3, one3), _kt(zero2, one2), _kt(zero1, one1)
        if below is None:
            all3, w3 = kt3, np.ones_like(kt3)
        else:
            part = slice(bounds[last], bounds[last + 1])
            deep = np.zeros((16, 64, 255))
            deep[under[part] >> 20, under[part] >> 14 & 63, under[part] & 255] = value[part]
            all3 = np.logaddexp(_HALF + kt3, _HALF + deep)
            w3 = np.exp(_HALF + kt3 - all3)
        all2 = np.logaddexp(_HALF + kt2, _HALF + all3.sum(axis=0))
        all1 = np.logaddexp(_HALF + kt1, _HALF + all2.sum(axis=0))
        return all1, ((np.exp(_HALF + kt1 - all1), zero1, one1), (np.exp(_HALF + kt2 - all2), zero2, one2), (w3, zero3, one3))

    zero0, one0 = _bits(whole.sum(axis=(0, 1, 2)))
    kt0 = _kt(zero0, one0)
    w0 = np.exp(_HALF + kt0 - np.logaddexp(_HALF + kt0, _HALF + sum(level(c)[0] for c in range(64))))
    slot = np.zeros((16, 64, 64), dtype=np.int64)
    rows, size = [], 0
    for c in range(64):
        one, zero, rest = 0.0, 0.0, 1.0
        for w, z, o in ((w0, zero0, one0), *level(c)[1]):
            one, zero, rest = one + rest * w * (o + 0.5) / (z + o + 1), zero + rest * w * (z + 0.5) / (z + o + 1), rest * (1 - w)
        seen = whole[:, :, c].any(axis=-1)
        blank = seen.argmin(axis=0)  # a context that wasn't seen, for each class of the last byte but one
        take = seen.copy()
        take[blank, np.arange(64)] = True
        own = np.full((16, 64), -1)
        own[take] = size + np.arange(take.sum())
        slot[:, :, c] = np.where(take, own, own[blank, np.arange(64)])
        rows.append([np.broadcast_to(x, (16, 64, 255))[take].astype(np.float32) for x in (one, zero, rest)])
        size += int(take.sum())
    return slot.reshape(-1), *(np.concatenate(x) for x in zip(*rows, strict=True))


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array, and the index among them of each."""
    new = np.append(True, x[1:] != x[:-1])[: len(x)]
    return x[new], np.cumsum(new) - 1


def _nodes(key: np.ndarray, n: np.ndarray):
    """Per level of the byte's bits, of sorted distinct deep keys with their subtrees whole: the index of each key's deepest node and its bit, and per depth 3 to DEPTH (node ids, parents' indices, zeros, ones, log KT, log block probability)."""
    kept = []
    for d in range(3, DEPTH):
        u, inverse = np.unique(key >> (8 * (DEPTH + 1 - d)) << 8 | key & 255, return_inverse=True)
        kept.append((u, np.bincount(inverse, n, len(u))))
    kept.append((key, n.astype(float)))
    for bits in range(8):
        tree = []
        for u, count in kept:
            ids, index = _runs(u >> (8 - bits))
            bit = u >> (7 - bits) & 1
            one = np.bincount(index, count * bit, len(ids))
            zero = np.bincount(index, count, len(ids)) - one
            up = np.searchsorted(tree[-1][0], ids >> (bits + 8) << bits | ids & ((1 << bits) - 1)) if tree else None
            tree.append([ids, up, zero, one, _kt(zero, one), None])
        tree[-1][5] = tree[-1][4]
        for above, under in zip(tree[-2::-1], tree[:0:-1], strict=True):
            above[5] = np.logaddexp(_HALF + above[4], _HALF + np.bincount(under[1], under[5], len(above[0])))
        yield bits, index, bit, tree  # keys are their own at the last depth


def under_classes(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For mixture: keys (class context, node) and sums of the log block probabilities of three bytes."""
    ids, value = [], []
    for bits, _, _, tree in _nodes(key, n):
        node, log_all = tree[0][0], tree[0][5]
        ids.append(top_class(node >> bits << (8 * (DEPTH - 2))) << 8 | ((1 << bits) - 1 + (node & ((1 << bits) - 1))))
        value.append(log_all)
    got, index = np.unique(np.concatenate(ids), return_inverse=True)
    return got, np.bincount(index, np.concatenate(value), len(got))


def price(key: np.ndarray, n: np.ndarray, top: tuple) -> np.ndarray:
    """log10 of the byte's probability for each deep key; top: see mixture."""
    slot, *parts = top
    out = np.zeros(len(key))
    for bits, index, bit, tree in _nodes(key, n):
        ids = tree[0][0]
        row = slot[top_class(ids >> bits << (8 * (DEPTH - 2)))]
        one, zero, rest = (x[row, (1 << bits) - 1 + (ids & ((1 << bits) - 1))].astype(float) for x in parts)
        for d, (_, up, z, o, kt, log_all) in enumerate(tree):
            if d:
                one, zero, rest = one[up], zero[up], rest[up]
            w = np.exp(_HALF + kt - log_all) if d < len(tree) - 1 else 1.0
            one, zero, rest = one + rest * w * (o + 0.5) / (z + o + 1), zero + rest * w * (z + 0.5) / (z + o + 1), rest * (1 - w)
        out += np.log10(np.where(bit, one[index], zero[index]))
    return out


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts; parts are sorted, which the sort makes use of."""
    key, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    return key[new], np.add.reduceat(n, new) if len(new) else n


def _parts(kind: int, key: np.ndarray, n: np.ndarray, parts: int):
    """Sums as rows (kind, part, keys, counts): deep keys by a hash of their last three bytes, so that subtrees stay whole, others by one of the key."""
    place = _mix((key >> (8 * (DEPTH - 2)) if kind == 2 else key).view(np.uint64)) % np.uint64(parts)
    order = np.argsort(place.astype(np.uint32), kind="stable")  # keys stay sorted within a part
    place, key, n = place[order].astype(np.int32), key[order], n[order]
    new = np.flatnonzero(np.append(True, place[1:] != place[:-1])[: len(place)])
    edge = np.append(new, len(key)).astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(edge), pa.array(x)) for x in (key, n)]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(new), kind, np.int32)), pa.array(place[new]), *lists], names=["kind", "part", "keys", "counts"])


def gather(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """(kind, part, keys, counts), sums of parts of the input: how often each word (kind 0, by hash; the end of a text is a word), each context key (kind 1) and each deep key (kind 2) occurs in rows marked `learn`; other rows add their deep keys with 0."""
    parts = PARTS * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        contexts = np.zeros(1 << 24, dtype=np.uint32)  # 64 MB; a task reads far less than 2^32 bytes
        held, size = {0: [], 2: []}, {0: 0, 2: 0}
        for batch in batches:
            for learn in (True, False):
                mine = batch.filter(pc.equal(batch.column("learn"), learn))
                for piece in slices(mine, text_col, TEXT_BYTES):
                    data, offsets = text_bytes(piece.column(text_col))
                    found = {2: deep_keys(data, offsets)}
                    if learn:
                        keys, _ = context_keys(data, offsets)
                        np.add.at(contexts, keys, np.uint32(1))
                        found[0] = np.append(words(data, offsets)[0].view(np.int64), np.full(piece.num_rows, _END))
                    for kind, x in found.items():
                        key, n = np.unique(x, return_counts=True)
                        held[kind].append((key, n if learn else np.zeros(len(n), np.int64)))
                        size[kind] += len(key)
                        most = HELD_CONTEXTS if kind else HELD_WORDS
                        if size[kind] > most:
                            held[kind] = [_merge(held[kind])]
                            size[kind] = len(held[kind][0][0])
                            if size[kind] > most // 2:
                                yield _parts(kind, *held[kind][0], parts)
                                held[kind], size[kind] = [], 0
        for kind in held:
            if held[kind]:
                yield _parts(kind, *_merge(held[kind]), parts)
        used = np.flatnonzero(contexts)
        if len(used):
            yield _parts(1, used, contexts[used].astype(np.int64), parts)

    return rows.select(text_col, "learn").mapInArrow(run, "kind int, part int, keys array<long>, counts array<long>")


_COUNTS = "kind int, keys array<long>, counts array<long>, value double"


def _packed(kind: int, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([key], pa.list_(pa.int64())), pa.array([n], pa.list_(pa.int64())), pa.array([None], pa.float64())], names=["kind", "keys", "counts", "value"])


def summed(found: DataFrame) -> DataFrame:
    """The sums of gather() as rows (kind, keys, counts) of sorted keys; those of deep keys hold whole subtrees, WEIGHED_KEYS about.

    One shuffle brings a part's rows together, and a task adds up a part at a time, a small share of its rows. Beside deep
    keys go, as kind 3, the keys of under_classes with their sums of logs, one row each.
    """

    def under(key: np.ndarray, n: np.ndarray):
        ids, logs = under_classes(key, n)
        for s in range(0, len(ids), 50_000):
            many = len(ids[s : s + 50_000])
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(many + 1, dtype=np.int32)), pa.array(x)) for x in (ids[s : s + 50_000], np.zeros(many, np.int64))]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(many, 3, np.int32)), *lists, pa.array(logs[s : s + 50_000])], names=["kind", "keys", "counts", "value"])

    def ready(kind: int, held: list):
        key, n = _merge(held)
        if kind != 2:
            yield _packed(kind, key, n)
            return
        start = 0
        while start < len(key):
            end = len(key)
            if end - start > WEIGHED_KEYS:  # up to the end of the subtree there
                end = int(np.searchsorted(key, ((key[start + WEIGHED_KEYS] >> (8 * (DEPTH - 2))) + 1) << (8 * (DEPTH - 2))))
            yield _packed(2, key[start:end], n[start:end])
            yield from under(key[start:end], n[start:end])
            start = end

    def run(batches):
        held, at = [], None
        for batch in batches:
            kinds, parts = batch.column("kind").to_pylist(), batch.column("part").to_pylist()
            for i in range(batch.num_rows):
                if at != (kinds[i], parts[i]):
                    if held:
                        yield from ready(at[0], held)
                    held, at = [], (kinds[i], parts[i])
                held.append(tuple(batch.column(c)[i].values.to_numpy() for c in ("keys", "counts")))
        if held:
            yield from ready(at[0], held)

    return found.repartition("part").sortWithinPartitions("kind", "part").mapInArrow(run, _COUNTS)


def _flat(counts: DataFrame, kind: int) -> DataFrame:
    """(key, n) of a kind of sums."""
    x = counts.where(F.col("kind") == kind).select(F.explode(F.arrays_zip("keys", "counts")).alias("x"))
    return x.select(F.col("x.keys").alias("key"), F.col("x.counts").alias("n"))


def _arrays(df: DataFrame) -> list[np.ndarray]:
    """The columns of a frame of numbers, without a row object for each."""
    return [c.to_numpy() for c in df.toArrow().columns]


def _most_frequent(counts: DataFrame, most: int, value: str = "n") -> tuple[np.ndarray, np.ndarray]:
    """The words (or contexts) above the least count that at most `most` reach, sorted, with their counts or another value."""
    levels = counts.groupBy("n").agg(F.count("*").alias("words"))
    total = 0
    least = None
    # the highest levels first; there are fewer levels than words, and each has one word at least
    for r in levels.orderBy(F.desc("n")).limit(most).toLocalIterator():
        total += r["words"]
        if total > most:
            break
        least = r["n"]
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key, got = _arrays(counts.where(F.col("n") >= least).select("key", value))
    order = np.argsort(key)
    return key[order], got[order]


def _rest(key: np.ndarray, owner: np.ndarray, count: int) -> tuple[pa.Array, pa.Array]:
    """Per row the distinct keys and how often each occurs."""
    order = np.lexsort((key, owner))
    key, owner = key[order], owner[order]
    new = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1]))) if len(key) else np.zeros(0, np.int64)
    start = pa.array(np.searchsorted(owner[new], np.arange(count + 1)).astype(np.int32))
    return pa.ListArray.from_arrays(start, pa.array(key[new])), pa.ListArray.from_arrays(start, pa.array(np.diff(np.append(new, len(key)))))


def score(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_words: int = HOT_WORDS, hot_contexts: int = HOT_CONTEXTS) -> DataFrame:
    """Per row of docs: id, n_tokens, n_known, train_tokens, base_score, n_bytes, score.

    score: log10 of the probability that the context-tree model of train gives the text and its end. base_score: the sum
    over words (blanks apart, A-Z lower-cased) and one end of log10((c + 1) / (N + V + 1)), c the word's count in train, N
    all, V distinct; n_known: the words with c > 0. A null text is empty: it has one token, the end. Repeated rows count
    and are scored each on its own. Without training rows every byte is as likely as any other and c is 0. Words are told
    apart by 64-bit hashes. Columns other than id and text are left out; an empty table gives no rows.
    """
    both = [d.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.lit(learn).alias("learn")) for d, learn in ((train, True), (docs, False))]
    return _score(both[0].unionByName(both[1]), both[1], id_col, hot_words, hot_contexts)


def _score(rows: DataFrame, docs: DataFrame, id_col: str, hot_words: int, hot_contexts: int) -> DataFrame:
    """See score(); rows (text, learn) hold the training texts, marked, and all texts of docs (doc_id, text) that aren't among them."""
    spark = docs.sparkSession
    counts = stash(summed(gather(rows)), "counts")
    vocabulary = _flat(counts, 0)
    n_all, n_words = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    contexts = _arrays(_flat(counts, 1))  # at most 2^24 rows, by the width of keys
    sums = counts.where("kind = 3").select(F.get("keys", F.lit(0)).alias("key"), "value").groupBy("key").agg(F.sum("value").alias("value"))
    top = spark.sparkContext.broadcast(mixture(*contexts, _arrays(sums)))  # nodes of classes: at most 2^24 rows too

    def prices(batches):
        for batch in batches:
            for i in range(batch.num_rows):  # whole subtrees
                key, n = (batch.column(c)[i].values.to_numpy() for c in ("keys", "counts"))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n), pa.array(price(key, n, top.value))], names=["key", "n", "value"])

    priced = stash(counts.where("kind = 2").select("keys", "counts").mapInArrow(prices, "key long, n long, value double"), "priced")
    model = spark.sparkContext.broadcast(_most_frequent(priced.where("n > 0"), hot_contexts, "value"))
    hot = spark.sparkContext.broadcast(_most_frequent(vocabulary, hot_words))
    floor = float(n_all + n_words + 1)

    def run(batches):
        (deep_key, deep_value), (hot_key, hot_n) = model.value, hot.value
        hot_log = np.log10((hot_n + 1) / floor)
        row, task = 0, TaskContext.get().partitionId()
        for batch in batches:
            for piece in slices(batch, "text", TEXT_BYTES):
                count = piece.num_rows
                data, offsets = text_bytes(piece.column("text"))
                keys = deep_keys(data, offsets)
                order = np.argsort(keys)
                found, index = _runs(keys[order])
                writer = np.repeat(np.arange(count), np.diff(offsets) + 1)[order]
                place = np.minimum(np.searchsorted(deep_key, found), max(len(deep_key) - 1, 0))
                met = deep_key[place] == found if len(deep_key) else np.zeros(len(found), bool)
                value = np.bincount(writer, np.where(met, deep_value[place], 0.0)[index], count) if len(deep_key) else np.zeros(count)
                away = ~met[index]
                far, far_often = _rest(found[index[away]], writer[away], count)
                h, _, _, first = words(data, offsets)
                size = np.diff(first)
                token = np.append(h.view(np.int64), np.full(count, _END))
                owner = np.append(np.repeat(np.arange(count), size), np.arange(count))
                at = np.minimum(np.searchsorted(hot_key, token), max(len(hot_key) - 1, 0))
                known = hot_key[at] == token if len(hot_key) else np.zeros(len(token), bool)
                base = np.bincount(owner[known], hot_log[at[known]], count) if len(hot_key) else np.zeros(count)
                rare, often = _rest(token[~known], owner[~known], count)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + count) + (task << 40)), piece.column("doc_id"), pa.array(size + 1), pa.array(np.bincount(owner[known], minlength=count)),
                        pa.array(base), pa.array(value), pa.array(np.diff(offsets)),
                        rare, often, far, far_often,
                    ],
                    names=["row", "doc_id", "n_tokens", "known", "base", "score", "n_bytes", "rare", "often", "far", "far_often"],
                )
                row += count

    schema = "row long, doc_id long, n_tokens long, known long, base double, score double, n_bytes long, rare array<long>, often array<long>, far array<long>, far_often array<long>"
    scored = stash(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema), "scored")
    each = scored.select("row", F.explode(F.arrays_zip("rare", "often")).alias("x")).select("row", F.col("x.rare").alias("key"), F.col("x.often").alias("times"))
    each = each.join(vocabulary, "key", "left").withColumn("c", F.coalesce("n", F.lit(0)))
    more = each.groupBy("row").agg(
        F.sum(F.col("times") * F.log10((F.col("c") + 1) / F.lit(floor))).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more_known")
    )
    away = scored.select("row", F.explode(F.arrays_zip("far", "far_often")).alias("x")).select("row", F.col("x.far").alias("key"), F.col("x.far_often").alias("times"))
    deeper = away.join(priced.select("key", "value"), "key").groupBy("row").agg(F.sum(F.col("times") * F.col("value")).alias("deeper"))
    out = scored.drop("rare", "often", "far", "far_often").join(more, "row", "left").join(deeper, "row", "left")
    return out.select(
        F.col("doc_id").alias(id_col), "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"), F.lit(int(n_all)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "n_bytes", (F.col("score") + F.coalesce("deeper", F.lit(0.0))).alias("score"),
    )


def split_score(docs: DataFrame, mod: int = 7, rest: int = 2) -> DataFrame:
    """score() of all docs (doc_id, text) with held_out; train: those whose crc32(doc_id as text) mod `mod` isn't rest."""
    out = _score(docs.select("text", (~held_out(mod, rest)).alias("learn")), docs, "doc_id", HOT_WORDS, HOT_CONTEXTS)
    return out.withColumn("held_out", held_out(mod, rest))
