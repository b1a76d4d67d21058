"""Quality classifier: a sparse rule ensemble over text statistics, compiled into Spark column expressions.

Small boosted trees over the statistics give rules (the conjunctions on the paths to their nodes); a logistic model with an
L1 penalty keeps few of them. Fitting sees at most `bound` labelled rows; scoring is one pass: the statistics are counted
over whole texts, and the rules are ordinary columns.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import labelled, shingles, slices, text_bytes, words

STATISTICS = (
    "log_words", "word_bytes", "upper_share", "symbol_share", "digit_share", "stop_share", "exclaim_share", "line_share",
    "distinct_words", "same_as_last", "distinct_shingles", "hashlike_words",
)
#: Labelled rows that fitting looks at.
TRAIN_ROWS = 20_000

_CLASSES = np.zeros((256, 8), dtype=np.int64)  # letters, upper, symbols, digits, stops, exclaims, lines, blanks
_CLASSES[[*range(65, 91), *range(97, 123), *range(128, 256)], 0] = 1
_CLASSES[range(65, 91), 1] = 1
_CLASSES[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,'-!"], 2] = 1
_CLASSES[range(48, 58), 3] = 1
_CLASSES[[ord(c) for c in ".,"], 4] = 1
_CLASSES[ord("!"), 5] = 1
_CLASSES[10, 6] = 1
_CLASSES[[32, *range(9, 14)], 7] = 1
_SYMBOL = _CLASSES[:, 2].astype(bool) | (np.arange(256) == 33)


def _distinct(x: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((x, owner))
    x, owner = x[order], owner[order]
    new = np.ones(len(x), dtype=bool)
    new[1:] = (x[1:] != x[:-1]) | (owner[1:] != owner[:-1])
    return np.bincount(owner[new], minlength=n)


def statistics(column: pa.Array) -> np.ndarray:
    """A row of STATISTICS for each text; an empty or null text has zeros."""
    data, offsets = text_bytes(column)
    n = len(column)
    counts = np.stack([np.bincount(data[offsets[i] : offsets[i + 1]], minlength=256) for i in range(n)]) @ _CLASSES if n else np.zeros((0, 8), np.int64)
    letters, upper, symbols, digits, stops, exclaims, lines, blanks = counts.T.astype(float)
    ink = np.maximum(np.diff(offsets) - blanks, 1)
    h, first, last, bounds = words(data, offsets)
    size = np.diff(bounds)
    owner = np.repeat(np.arange(n), size)
    many = np.maximum(size, 1)
    same = np.zeros(len(h), dtype=bool)
    same[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    marked = _SYMBOL[data]
    double = np.zeros(len(data) + 1, np.int64)
    if len(data) > 1:
        np.cumsum(marked[1:] & marked[:-1], out=double[1:-1])
        double[-1] = double[-2]
    odd = double[np.maximum(last - 1, 0)] - double[first] > 0 if len(h) else np.zeros(0, bool)
    s, s_owner = shingles(h, bounds, 3)
    s_size = np.bincount(s_owner, minlength=n)
    out = [
        np.log1p(size), (np.diff(offsets) - blanks) / many, upper / np.maximum(letters, 1), symbols / ink, digits / ink, stops / many, exclaims / ink, lines / many,
        _distinct(h, owner, n) / many, np.bincount(owner[same], minlength=n) / many, _distinct(s, s_owner, n) / np.maximum(s_size, 1), np.bincount(owner[odd], minlength=n) / many,
    ]
    return np.column_stack(out).astype(float)


def measure(docs: DataFrame, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with a column for each of STATISTICS; columns of those names are replaced. One pass, no shuffle."""
    kept = [f for f in docs.schema.fields if f.name not in STATISTICS and (keep_text or f.name != text_col)]
    names = [f.name for f in kept]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"{s} double" for s in STATISTICS])

    def run(batches):
        for batch in batches:
            for piece in slices(batch, text_col):
                x = statistics(piece.column(text_col))
                out = pa.schema([*(piece.schema.field(n) for n in names), *(pa.field(s, pa.float64()) for s in STATISTICS)])
                yield pa.RecordBatch.from_arrays([*(piece.column(n) for n in names), *(pa.array(np.ascontiguousarray(x[:, j])) for j in range(len(STATISTICS)))], schema=out)

    return docs.mapInArrow(run, schema)


@dataclass(frozen=True)
class Rules:
    """A logistic model over conjunctions; a condition (j, above, cut) holds if statistic j is > cut (above) or <= cut."""

    intercept: float
    weighted: tuple[tuple[float, tuple[tuple[int, bool, float], ...]], ...]

    def score(self) -> Column:
        """The probability of label 1, from the columns of STATISTICS."""
        total = F.lit(float(self.intercept))
        for weight, rule in self.weighted:
            test = F.lit(True)
            for j, above, cut in rule:
                test = test & ((F.col(STATISTICS[j]) > cut) if above else (F.col(STATISTICS[j]) <= cut))
            total = total + F.when(test, float(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def _tree(binned: np.ndarray, cuts: list[np.ndarray], gradient: np.ndarray, hessian: np.ndarray, rows: np.ndarray, depth: int, path: tuple, rules: set, step: np.ndarray) -> None:
    """Grows a tree by histogram splits; adds each path to rules and each leaf's value to step."""
    best = (1e-6 * len(gradient), None)
    total = gradient[rows].sum() ** 2 / (hessian[rows].sum() + 1)
    for j in range(binned.shape[1]) if depth else ():
        bins = len(cuts[j]) + 1
        g = np.cumsum(np.bincount(binned[rows, j], gradient[rows], bins))[:-1]
        h = np.cumsum(np.bincount(binned[rows, j], hessian[rows], bins))[:-1]
        n = np.cumsum(np.bincount(binned[rows, j], minlength=bins))[:-1]
        gain = g**2 / (h + 1) + (gradient[rows].sum() - g) ** 2 / (hessian[rows].sum() - h + 1) - total
        gain[(n < 5) | (len(rows) - n < 5)] = -1
        if len(gain) and gain.max() > best[0]:
            best = (gain.max(), (j, int(gain.argmax())))
    if best[1] is None:
        step[rows] = gradient[rows].sum() / (hessian[rows].sum() + 1)
        return
    j, b = best[1]
    low = binned[rows, j] <= b
    for above, part in ((False, rows[low]), (True, rows[~low])):
        longer = (*path, (j, above, float(cuts[j][b])))
        rules.add(longer)
        _tree(binned, cuts, gradient, hessian, part, depth - 1, longer, rules, step)


def _lasso(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic weights with an L1 penalty, by accelerated proximal gradient; the intercept is free."""
    n, d = x.shape
    scale = 4 / (np.linalg.norm(np.column_stack([x, np.ones(n)]), 2) ** 2 / n)
    w = z = np.zeros(d + 1)
    t = 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ z[:-1] + z[-1], -30, 30)))
        new = z - scale * np.append(x.T @ (p - y), (p - y).sum()) / n
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - scale * penalty, 0)
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        z, w = new + (last - 1) / t * (new - w), new
    return w[:-1], float(w[-1])


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 25, depth: int = 3, penalty: float = 3e-4) -> Rules:
    """Rules from boosted trees, weighted by the lasso. One class only, or no rows: a constant."""
    if len(y) == 0 or y.min() == y.max():
        rate = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
        return Rules(float(np.log(rate / (1 - rate))), ())
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.01, 0.99, 48))) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)])
    margin, rules = np.zeros(len(y)), set()
    every = np.arange(len(y))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        step = np.zeros(len(y))
        _tree(binned, cuts, y - p, p * (1 - p), every, depth, (), rules, step)
        margin += 0.5 * step
    table: dict[bytes, tuple] = {}
    for rule in sorted(rules, key=lambda r: (len(r), r)):  # of rules that hold for the same rows, the shortest
        hold = np.ones(len(y), dtype=bool)
        for j, above, cut in rule:
            hold &= (x[:, j] > cut) if above else (x[:, j] <= cut)
        if 0 < hold.sum() < len(y):
            table.setdefault(np.packbits(hold).tobytes(), (rule, hold))
    kept = list(table.values())
    if not kept:
        rate = y.mean()
        return Rules(float(np.log(rate / (1 - rate))), ())
    w, intercept = _lasso(np.column_stack([h for _, h in kept]).astype(float), y, penalty)
    return Rules(intercept, tuple((float(v), r) for v, (r, _) in zip(w, kept, strict=True) if abs(v) > 1e-4))


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", mod: int = 5, bound: int = TRAIN_ROWS) -> Rules:
    """Fits on at most bound labelled rows whose crc32(doc_id as text) mod `mod` isn't 0; bound rows of numbers reach the driver."""
    rows = measure(labelled(docs, labels, target, mod, bound), keep_text=False).select("label", *STATISTICS).collect()
    found = np.array([list(r) for r in rows], dtype=float).reshape(-1, 1 + len(STATISTICS))
    found = found[np.lexsort(found.T)]  # the fit doesn't depend on the order in which rows arrive
    return fit_rules(found[:, 1:], found[:, 0])


def score(docs: DataFrame, model: Rules, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with score, the probability that the text is good (0 to 1).

    Null and empty texts are scored by their statistics, all zero. Repeated rows get equal scores; a column named score is
    replaced; other columns are never looked at. An empty table stays empty.
    """
    kept = [c for c in docs.columns if c != "score" and (keep_text or c != text_col)]
    return measure(docs, text_col, keep_text).select(*kept, model.score().alias("score"))
