"""Secret scans with multipart credential linking.

Strong spans (key assignments, access identifiers, long hex strings) are always reported. Weak candidates (identifier
assignments, mixed random-looking strings, endpoints) are reported only when their complementary parts stand in the same
scope: the same paragraph, at most `scope_chars` code points away. The interval join of parts and scopes runs within a
document, by binary search over starts with running maxima of ends, so no group of documents ever meets in one task.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import slices

# The contract's patterns and least lengths.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_ASSIGN, LEAST_ACCESS = 8, 16
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "ident", "secret", "endpoint")

#: Found before ASSIGN is tried at all, in lower-cased text.
_KEYS = ("password", "passwd", "secret", "token", "api_key", "apikey")
_IDENT = re.compile(r"\b(?:access[_-]?key(?:[_-]?id)?|client[_-]?id|account[_-]?id|user(?:name)?|login)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9@._-]{4,}", re.IGNORECASE | re.ASCII)
_IDENT_KEYS = ("access", "client", "account", "user", "login")
_RANDOM = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
_ENDPOINT = re.compile(r"\b[a-z][a-z0-9+.-]{1,9}://[^\s\"'<>]{4,}", re.ASCII)


def base_spans(text: str, low: str) -> list[tuple[str, int, int]]:
    found = []
    if any(k in low for k in _KEYS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return found


def _mixed(s: str) -> bool:
    return any(c.isdigit() for c in s) and any(c.islower() for c in s) and any(c.isupper() for c in s)


class _Parts:
    """The spans of one class, to be asked whether one of them stands near."""

    def __init__(self, spans: list[tuple[int, int]]):
        spans = sorted(spans)
        self.start = [s for s, _ in spans]
        self.reach = list(accumulate((e for _, e in spans), max))

    def near(self, start: int, end: int) -> bool:
        at = bisect_right(self.start, end)
        return at > 0 and self.reach[at - 1] >= start


def linked_spans(text: str, low: str, base: list[tuple[str, int, int]], scope_chars: int) -> list[tuple[str, int, int]]:
    """Weak candidates whose complementary parts stand in their scope; none overlaps a base span or an earlier candidate."""
    ends = [("endpoint", m.start(), m.end()) for m in _ENDPOINT.finditer(text)] if "://" in low else []
    idents = [("ident", m.start(), m.end()) for m in _IDENT.finditer(text)] if any(k in low for k in _IDENT_KEYS) else []
    if not base and not ends and not idents:
        return []
    taken = _Parts([(s, e - 1) for _, s, e in base])
    weak: list[tuple[str, int, int]] = []
    for group in (ends, idents, [("secret", m.start(), m.end()) for m in _RANDOM.finditer(text) if _mixed(m.group())]):
        weak += [x for x in group if not taken.near(x[1], x[2] - 1)]
        taken = _Parts([(s, e - 1) for _, s, e in [*base, *weak]])
    if not weak:
        return []
    breaks = [m.start() for m in re.finditer(r"\n\s*\n", text)]
    has_ident = _Parts([(s, e) for k, s, e in [*base, *weak] if k in ("access", "ident")])
    has_secret = _Parts([(s, e) for k, s, e in [*base, *weak] if k in ("assign", "hex", "secret")])
    has_end = _Parts([(s, e) for k, s, e in weak if k == "endpoint"])

    def scope(s: int, e: int) -> tuple[int, int]:
        at = bisect_left(breaks, s)
        lo = breaks[at - 1] + 1 if at else 0
        at = bisect_left(breaks, e)
        hi = breaks[at] - 1 if at < len(breaks) else len(text)
        return max(lo, s - scope_chars), min(hi, e + scope_chars)

    out = []
    for kind, s, e in weak:
        around = scope(s, e)
        ident, secret, end = (x.near(*around) for x in (has_ident, has_secret, has_end))
        if (ident and secret) if kind == "endpoint" else (secret if kind == "ident" else ident or end):
            out.append((kind, s, e))
    return out


def find(text: str | None, scope_chars: int = 200) -> list[tuple[str, int, int]]:
    """All spans of one text, by start, then kind."""
    if not text:
        return []
    low = text.lower()
    base = base_spans(text, low)
    spans = base + linked_spans(text, low, base, scope_chars)
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def scan(docs: DataFrame, text_col: str = "text", scope_chars: int = 200, keep_text: bool = True) -> DataFrame:
    """docs with `spans`, an array of (kind, start, end) in code points, end exclusive, by start, then kind.

    Whole texts are scanned; null and empty texts have no spans; repeated rows are scanned each on its own; a column
    already named spans is replaced; an empty table stays empty. Base spans may overlap each other; linked ones overlap
    nothing. One pass without a shuffle.
    """
    kept = [f for f in docs.schema.fields if f.name != "spans" and (keep_text or f.name != text_col)]
    names = [f.name for f in kept]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["spans array<struct<kind:string,start:int,end:int>>"])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for batch in batches:
            for piece in slices(batch, text_col):
                spans = [[{"kind": k, "start": s, "end": e} for k, s, e in find(t, scope_chars)] for t in piece.column(text_col).to_pylist()]
                out = pa.schema([*(piece.schema.field(n) for n in names), pa.field("spans", kind)])
                yield pa.RecordBatch.from_arrays([*(piece.column(n) for n in names), pa.array(spans, kind)], schema=out)

    return docs.mapInArrow(run, schema)


def joined(spans: str, kinds: tuple[str, ...] = KINDS) -> Column:
    """kind:start:end of the spans of these kinds, comma-joined."""
    mine = F.filter(spans, lambda x: x["kind"].isin(*kinds))
    return F.array_join(F.transform(mine, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per row: the number of spans of each base kind, the SHA-256 of the base spans, and all spans as text."""

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return scanned.select(id_col, *map(count, BASE_KINDS), F.sha2(joined("spans", BASE_KINDS), 256).alias("base_sha256"), joined("spans").alias("spans"))


def redact(scanned: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """The texts with every span, overlapping ones as one, replaced by mark; spans goes. Texts without spans stay as they are."""
    merged = F.aggregate(
        "spans",
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= x["start"]),
            F.concat(
                F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
                F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end"))),
            ),
        ).otherwise(F.concat(acc, F.array(F.struct(x["start"].alias("start"), x["end"].alias("end"))))),
    )
    cut = F.aggregate(
        merged,
        F.struct(F.lit("").alias("text"), F.lit(0).alias("at")),
        lambda acc, x: F.struct(
            F.concat(acc["text"], F.substring(F.col(text_col), acc["at"] + 1, x["start"] - acc["at"]), F.lit(mark)).alias("text"),
            x["end"].alias("at"),
        ),
        lambda acc: F.concat(acc["text"], F.substring(F.col(text_col), acc["at"] + 1, F.length(text_col))),
    )
    return scanned.withColumn(text_col, F.when(F.size("spans") > 0, cut).otherwise(F.col(text_col))).drop("spans")
