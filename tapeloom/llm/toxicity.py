"""Toxicity by maximum-scoring segments.

Tokens are words of letters and digits, and their four- and five-byte beginnings. A token's score is the lower bound of its
log-odds between toxic and other training documents under an informative Dirichlet prior (the tokens' overall rates);
toxic documents count once for each left neighbour of the token, so that words that merely stand in copies of a toxic text
aren't listed. A linear-time scan finds all maximal scoring segments of a text. Their scores are calibrated by the
extreme-value law of Karlin and Altschul, its two parameters fitted to the clean texts; the law of sums of the highest
scores aggregates all passages of a text, and one logistic curve maps the result to 0..1.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import fit_logistic, labelled, slices, text_bytes, words

#: Labelled rows that fitting looks at.
TRAIN_ROWS = 20_000
#: Pseudo-documents of the prior, and their greatest share of the training rows.
PRIOR, PRIOR_SHARE = 500.0, 0.1
BOUND_Z = 2.33
LEAST_DOCS = 3
#: A listed token's rate in toxic documents is so many times that in others. Of so many tokens some look toxic by chance,
#: but only by little; and the ordinary words among them would make long segments of any text.
LEAST_RATIO = 9.0
#: Share of clean texts by whose highest scores K is fitted.
TAIL = 0.005
_GAPS = np.ones(256, dtype=bool)
_GAPS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_BEGINNINGS = (4, 5)
#: Significances beyond this are alike.
_MOST = 30.0


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of each word and of its beginnings, a row for a word (0: it has no such beginning), and word bounds of texts."""
    data, offsets = text_bytes(column)
    h, first, last, bounds = words(data, offsets, _GAPS)
    out = [h]
    for size in _BEGINNINGS:
        longer = np.flatnonzero(last - first > size)
        part = np.zeros(len(h), np.uint64)
        if len(longer):
            index = (first[longer][:, None] + np.arange(size)).reshape(-1)
            part[longer] = words(data[index], np.arange(len(longer) + 1) * size, np.zeros(256, bool))[0] ^ np.uint64(size)
        out.append(part)
    return np.stack(out, axis=1).view(np.int64), bounds


@dataclass(frozen=True)
class Lexicon:
    token: np.ndarray  # sorted
    value: np.ndarray
    other: float  # of a word that isn't listed; negative
    decay: float  # lambda
    factor: float  # K
    curve: tuple[float, float]

    def word_scores(self, t: np.ndarray) -> np.ndarray:
        """The best score among a word and its beginnings."""
        if not len(self.token) or not len(t):
            return np.full(len(t), self.other)
        at = np.minimum(np.searchsorted(self.token, t), len(self.token) - 1)
        return np.where(self.token[at] == t, self.value[at], self.other).max(axis=1)

    def significance(self, best: np.ndarray, size: np.ndarray) -> np.ndarray:
        """-log10 of the chance that a clean text of that many words has a segment of that score (Gumbel)."""
        expected = self.factor * np.maximum(size, 1) * np.exp(-self.decay * np.maximum(best, 0))
        return np.where(best > 0, np.clip(-np.log10(np.maximum(-np.expm1(-expected), 1e-300)), 0, _MOST), 0.0)

    def evidence(self, cuts: list[list[tuple[int, int, float]]], size: np.ndarray) -> np.ndarray:
        """-log10 of the chance that a clean text of that many words has passages as telling as these, all of them together.

        The r highest scores, each times lambda less ln(K n), sum to T with a chance of about exp(-T) T^(r-1) / (r! (r-1)!);
        the most telling r counts, at half the weight for each further passage.
        """
        out = self.significance(np.array([max((x[2] for x in c), default=0.0) for c in cuts]), size)
        shift = np.log(self.factor * np.maximum(size, 1))
        for i, c in enumerate(cuts):
            if len(c) < 2:
                continue
            total, best = 0.0, out[i]
            for r, v in enumerate(sorted((x[2] for x in c), reverse=True), 1):
                one = self.decay * v - shift[i]
                if one <= 0:
                    break  # not above what a clean text shows
                total += one
                if r > 1:
                    log_p = -total + (r - 1) * math.log(total) - math.lgamma(r + 1) - math.lgamma(r) + r * math.log(2)
                    best = max(best, -log_p / math.log(10))
            out[i] = min(best, _MOST)
        return out


def segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, end, score), left to right, in linear time.

    Candidates are kept with the cumulative sums before and after them; one that can be lengthened to the left by an
    earlier candidate of a lower beginning and a lower end merges with all from there on.
    """
    up = np.flatnonzero(score > 0)
    if not len(up):
        return []
    total = np.concatenate([[0.0], np.cumsum(score)])
    stack: list[tuple[int, int, float, float, int]] = []  # first, end, sum before, sum after, place of the nearest candidate of a lower beginning
    for i in up.tolist():
        first, end, low, high = i, i + 1, total[i], total[i + 1]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= low:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= high:
                stack.append((first, end, low, high, j))
                break
            first, low = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b, float(high - low)) for a, b, low, high, _ in stack]


def _counts(batches):
    for batch in batches:
        for piece in slices(batch, "text"):
            t, bounds = tokens(piece.column("text"))
            label = piece.column("label").to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(piece.num_rows), np.diff(bounds))
            flat, owner = t.reshape(-1), np.repeat(owner, t.shape[1])
            order = np.lexsort((owner, flat))
            flat, owner = flat[order], owner[order]
            new = np.ones(len(flat), dtype=bool)
            new[1:] = (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])
            flat, toxic = flat[new & (flat != 0)], label[owner[new & (flat != 0)]] > 0
            token, index = np.unique(flat, return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(token), pa.array(np.bincount(index, toxic, len(token)).astype(np.int64)), pa.array(np.bincount(index, ~toxic, len(token)).astype(np.int64))], names=["token", "y1", "y0"]
            )


def log_odds(y1, y0, n1: float, n0: float) -> np.ndarray:
    """Lower bound of the log-odds ratio under a Dirichlet prior of pseudo-documents at the token's overall rate."""
    y1, y0 = np.asarray(y1, float), np.asarray(y0, float)
    mass = min(PRIOR, PRIOR_SHARE * (n1 + n0))
    prior = mass * (y1 + y0 + 0.5) / (n1 + n0 + 1)
    delta = np.log((y1 + prior) / (n1 + mass)) - np.log((y0 + prior) / (n0 + mass))
    return delta - BOUND_Z * np.sqrt(1 / (y1 + prior) + 1 / (y0 + prior))


def fit(docs: DataFrame, labels: DataFrame, target: str = "toxic", mod: int = 5, bound: int = TRAIN_ROWS) -> Lexicon:
    """Fits on at most bound labelled rows whose crc32(doc_id as text) mod `mod` isn't 0.

    What reaches the driver is bounded by those rows: their candidate tokens with counts, and four numbers a row for the curve. Without rows of both classes every text scores the rate of toxic rows (0 without rows).
    """
    rows = labelled(docs, labels, target, mod, bound).persist()
    try:
        size = {r["label"]: r["n"] for r in rows.groupBy((F.col("label") > 0).cast("int").alias("label")).agg(F.count("*").alias("n")).collect()}
        n1, n0 = float(size.get(1, 0)), float(size.get(0, 0))
        if not n1 or not n0:
            rate = 0.0 if not n1 else 1.0
            return Lexicon(np.zeros(0, np.int64), np.zeros(0), -1.0, 1.0, 0.1, (0.0, 20.0 if rate else -20.0))
        counted = rows.select("text", "label").mapInArrow(_counts, "token long, y1 long, y0 long").groupBy("token").agg(F.sum("y1").alias("y1"), F.sum("y0").alias("y0"))
        found = counted.where(F.col("y1") >= LEAST_DOCS).toPandas()
        y1, y0 = found["y1"].to_numpy(float), found["y0"].to_numpy(float)
        good = (log_odds(y1, y0, n1, n0) > 0) & (y1 / n1 >= LEAST_RATIO * y0 / n0)
        token, y1, y0 = found["token"].to_numpy(np.int64)[good], y1[good], y0[good]
        order = np.argsort(token)
        token, y1, y0 = token[order], y1[order], y0[order]

        def met(batches):
            for batch in batches:
                for piece in slices(batch, "text"):
                    t, bounds = tokens(piece.column("text"))
                    before = np.zeros(len(t), np.int64)
                    before[1:] = t[:-1, 0]
                    before[bounds[:-1][bounds[:-1] < len(t)]] = 0
                    at = np.minimum(np.searchsorted(token, t), len(token) - 1)
                    row, column = np.nonzero(token[at] == t)
                    yield pa.RecordBatch.from_arrays([pa.array(at[row, column]), pa.array(before[row])], names=["at", "before"])

        contexts = np.zeros(len(token))
        if len(token):
            pairs = rows.where("label > 0").select("text").mapInArrow(met, "at long, before long").distinct().groupBy("at").count().collect()
            contexts[[r["at"] for r in pairs]] = [r["count"] for r in pairs]
        spread = np.minimum(y1, contexts)
        value = log_odds(spread, y0, n1, n0)
        keep = (value > 0) & (spread / n1 >= LEAST_RATIO * y0 / n0)
        lexicon, values = token[keep], value[keep]
        return _calibrate(rows, Lexicon(lexicon, values, -0.02, 1.0, 0.1, (1.0, 0.0)), y0[keep])
    finally:
        rows.unpersist()


def _best(model: Lexicon, piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[tuple[int, int, float]]]]:
    t, bounds = tokens(piece.column("text"))
    s = model.word_scores(t)
    cuts = [segments(s[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    best = np.array([max((x[2] for x in c), default=0.0) for c in cuts])
    listed = np.array([int((s[a:b] > 0).sum()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
    return best, np.diff(bounds), listed, cuts


def _calibrate(rows: DataFrame, model: Lexicon, clean: np.ndarray) -> Lexicon:
    """The score of unlisted words from their rates in both classes, lambda and K from the clean texts, and the curve.

    clean: the clean documents with each listed token.
    """

    def numbers(of: Lexicon):
        def run(batches):
            for batch in batches:
                for piece in slices(batch, "text"):
                    best, size, listed, cuts = _best(of, piece)
                    yield pa.RecordBatch.from_arrays([piece.column("label").cast(pa.int64()), pa.array(best), pa.array(size), pa.array(listed), pa.array(of.evidence(cuts, size))], names=["label", "best", "size", "listed", "x"])

        got = rows.select("text", "label").mapInArrow(run, "label long, best double, size long, listed long, x double").toPandas()
        return (got["label"].to_numpy() > 0), got["best"].to_numpy(), got["size"].to_numpy(float), got["listed"].to_numpy(float), got["x"].to_numpy()

    y, _, size, listed, _ = numbers(model)
    rate1 = (listed[y].sum() + 0.5) / (size[y].sum() + 1)
    rate0 = (listed[~y].sum() + 0.5) / (size[~y].sum() + 1)
    other = min(-1e-3, float(np.log((1 - rate1) / (1 - rate0))) if rate1 < 1 else -1.0)
    share = (clean + 0.5) / (size[~y].sum() + len(clean) + 1)
    lo, hi = 1e-6, 50.0
    for _ in range(80):  # lambda: the positive root of E[exp(lambda s)] = 1 over clean words
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (share * np.exp(np.minimum(mid * model.value, 700))).sum() + (1 - share.sum()) * np.exp(mid * other) < 1 else (lo, mid)
    model = Lexicon(model.token, model.value, other, max(lo, 0.05), 0.1, (1.0, 0.0))
    y, best, size, _, _ = numbers(model)
    model = Lexicon(model.token, model.value, other, model.decay, _factor(best[~y], size[~y], model), (1.0, 0.0))
    y, _, _, _, x = numbers(model)
    order = np.lexsort((x, y))
    w = fit_logistic(x[order][:, None], y[order].astype(float), ridge=1e-5)
    return Lexicon(model.token, model.value, model.other, model.decay, model.factor, (float(w[0]), float(w[1])))


def _factor(best: np.ndarray, size: np.ndarray, model: Lexicon) -> float:
    """K of the extreme-value law: so that as many clean texts are expected to show a high score as did.

    That score is the one that TAIL of them reach, which a few wrong labels don't move; it is a listed word's least score if
    so many don't reach even that.
    """
    if not len(best) or not len(model.value):
        return 0.1
    level = max(float(np.quantile(best, 1 - TAIL, method="higher")), float(model.value.min()))
    met = max(float((best >= level).sum()), 0.5)
    lo, hi = 1e-9, 1e6
    for _ in range(100):
        mid = (lo * hi) ** 0.5
        lo, hi = (mid, hi) if -np.expm1(-mid * np.maximum(size, 1) * np.exp(-model.decay * level)).sum() < met else (lo, mid)
    return lo


def score(docs: DataFrame, model: Lexicon, text_col: str = "text", keep_text: bool = True, with_segments: bool = True) -> DataFrame:
    """docs with score (0 to 1) and segments, each (first word, end word, score, significance) of a toxic passage.

    Whole texts are scanned in one pass; null and empty texts have no segments and the score of a text without toxic words.
    Repeated rows score alike; columns that bear an output's name are replaced; an empty table stays empty.
    """
    made = ("score", "segments")
    kept = [f for f in docs.schema.fields if f.name not in made and (keep_text or f.name != text_col)]
    names = [f.name for f in kept]
    kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("significance", pa.float64())]))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["score double"] + ["segments array<struct<first:int,end:int,score:double,significance:double>>"] * with_segments)

    def run(batches):
        for batch in batches:
            for piece in slices(batch, text_col):
                _, size, _, cuts = _best(model, pa.RecordBatch.from_arrays([piece.column(text_col)], names=["text"]))
                value = 1 / (1 + np.exp(-np.clip(model.curve[0] * model.evidence(cuts, size) + model.curve[1], -30, 30)))
                columns = [*(piece.column(n) for n in names), pa.array(value)]
                fields = [*(piece.schema.field(n) for n in names), pa.field("score", pa.float64())]
                if with_segments:
                    rows = [[{"first": a, "end": b, "score": v, "significance": float(model.significance(np.array([v]), np.array([n]))[0])} for a, b, v in c] for c, n in zip(cuts, size, strict=True)]
                    columns.append(pa.array(rows, kind))
                    fields.append(pa.field("segments", kind))
                yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(fields))

    return docs.mapInArrow(run, schema)
