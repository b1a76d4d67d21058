"""Benchmark decontamination with DataFrame functions only.

The normalised windows of the benchmark form a hash set that every task holds (Spark's InSet). A document's words are
scanned once: a position is tried in full only if the hash of its first two words begins some window; a full hit compares
the words themselves, so every hit is verified.

A benchmark of more than `inline_windows` windows doesn't fit a set within the plan. Then the positions of all documents, as
rows of a few numbers, meet the windows' anchors in a join: by broadcast up to BROADCAST_ANCHORS of them, else by shuffle.
What is left is compared word by word, and the hits go back to their documents. Nothing depends on the benchmark's size but
the way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import stash

#: Windows that a task may hold as a set: about 100 bytes each, so 10 MB.
INLINE_WINDOWS = 100_000
#: Anchors that may be broadcast: 16 bytes each, so 32 MB.
BROADCAST_ANCHORS = 2_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and nothing else: plain lower() where the text is ASCII, a translation elsewhere."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def words(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), _GAP), lambda w: w != "")


def windows(bench: DataFrame, n: int, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, size, anchor, window) of every window, repeats of an item's windows gone; anchor: the hash of its first two words."""
    w = bench.select(F.col(item_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    w = w.withColumn("size", F.least(F.lit(n), F.size("w")))
    every = F.transform(
        F.sequence(F.lit(0), F.col("n_w") - F.col("size")),
        lambda i: F.struct(F.xxhash64(F.get("w", i), F.get("w", F.least(i + 1, i + F.col("size") - 1))).alias("anchor"), F.array_join(F.slice("w", i + 1, F.col("size")), " ").alias("window")),
    )
    return w.withColumn("n_w", F.size("w")).select("item", "size", F.explode(every).alias("x")).select("item", "size", "x.anchor", "x.window").distinct()


def _quoted(values) -> str:
    return ", ".join(str(v) if isinstance(v, int) else "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values)


def _anchored(i: str, size: int) -> str:
    return f"xxhash64(_w[{i}], _w[{i + ' + 1' if size > 1 else i}])"


def _positions(size: int) -> str:
    return f"if(size(_w) >= {size}, sequence(0, size(_w) - {size}), cast(array() as array<int>))"


def _scan(rows: DataFrame, listed: list) -> DataFrame:
    """rows (_w) with _hits, the (at, size) of every window of the set that occurs."""
    found = []
    for s in sorted({r["size"] for r in listed}):
        mine = [r for r in listed if r["size"] == s]
        test = f"{_anchored('i', s)} in ({_quoted(sorted({r['anchor'] for r in mine}))}) and array_join(slice(_w, i + 1, {s}), ' ') in ({_quoted(sorted({r['window'] for r in mine}))})"
        found.append(f"transform(filter({_positions(s)}, i -> {test}), i -> struct(i as at, {s} as size))")
    # the condition on the row number always holds; it keeps the optimizer from pushing filters, with the scan inlined, below
    return rows.withColumn("_hits", F.when(F.monotonically_increasing_id() >= 0, F.expr(f"concat({', '.join(found)})")))


def _joined_scan(rows: DataFrame, known: DataFrame, broadcast_anchors: int) -> tuple[DataFrame, DataFrame]:
    """The same by joins: rows, stashed, with _id and _hits; and the hits (_id, window)."""
    base = stash(rows.withColumn("_id", F.monotonically_increasing_id()), "rows")
    anchors = stash(known.select("size", "anchor").distinct(), "anchors")
    sizes = [r[0] for r in anchors.select("size").distinct().limit(1000).collect()]  # at most n, the words of a window
    every = F.expr("concat(" + ", ".join(f"transform({_positions(s)}, i -> struct(i as at, {s} as size, {_anchored('i', s)} as anchor))" for s in sizes) + ")")
    thin = base.select("_id", F.explode(every).alias("x")).select("_id", "x.at", "x.size", "x.anchor")
    near = thin.join(F.broadcast(anchors) if anchors.count() <= broadcast_anchors else anchors, ["size", "anchor"], "left_semi")
    lists = near.groupBy("_id").agg(F.collect_list(F.struct("at", "size")).alias("_near"))
    tried = base.select("_id", "_w").join(lists, "_id").select("_id", F.explode("_near").alias("h"), F.array_join(F.slice("_w", F.col("h.at") + 1, F.col("h.size")), " ").alias("window"))
    hits = stash(tried.join(known.select("size", "window").distinct(), (F.col("h.size") == F.col("size")) & (tried["window"] == known["window"]), "left_semi").select("_id", "h", "window"), "hits")
    found = base.join(hits.groupBy("_id").agg(F.collect_list("h").alias("_hits")), "_id", "left")
    return found.withColumn("_hits", F.coalesce("_hits", F.expr("cast(array() as array<struct<at: int, size: int>>)"))), hits.select("_id", "window").distinct()


def _hit_words() -> Column:
    return F.array_distinct(F.flatten(F.transform("_hits", lambda h: F.sequence(h["at"], h["at"] + h["size"] - 1))))


def _listed(known: DataFrame, most: int) -> list:
    """The benchmark's windows, or one more than `most` of them: their number is the benchmark's, not the documents'."""
    return known.select("size", "anchor", "window").distinct().limit(most + 1).collect()


def mark(docs: DataFrame, bench: DataFrame, n: int = 10, text_col: str = "text", item_text_col: str = "text", item_col: str = "item_id", inline_windows: int = INLINE_WINDOWS, keep_text: bool = True, with_items: bool = True, broadcast_anchors: int = BROADCAST_ANCHORS) -> DataFrame:
    """docs with n_words, n_hit, items (the ids, as sorted strings, of the benchmark items met) and contaminated.

    A null or empty text has no words and no hits; an item without words makes no window; an item of fewer than n words is
    one window of that size. Items that share a window are all met by it; an item whose id is null hits words but isn't
    listed. Repeated rows are marked each on its own. Columns that bear an output's name are replaced. Empty tables give
    no hits, or no rows. Rows that carry the text are shuffled once for the items; without keep_text they are small, and
    without with_items nothing is shuffled, as long as the windows fit the set.
    """
    made = ("n_words", "n_hit", "items", "contaminated")
    kept = [c for c in docs.columns if c not in made and (keep_text or c != text_col)]
    known = windows(bench, n, item_col, item_text_col)
    listed = _listed(known, inline_windows)
    if not listed:
        return docs.select(*kept, F.size(words(F.col(text_col))).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"), F.lit(False).alias("contaminated"))
    row = docs.select(F.struct(*[F.col(c) for c in kept]).alias("_row"), words(F.col(text_col)).alias("_w"))
    item_of = known.groupBy("window").agg(F.collect_set("item").alias("_of"))
    counted = (F.size("_w").cast("long").alias("_n_words"), F.size(_hit_words()).cast("long").alias("_n_hit"))
    if len(listed) > inline_windows:
        found, met = _joined_scan(row, known, broadcast_anchors)
        flat = found.select("_id", "_row", *counted)
        if with_items:
            items = met.join(item_of, "window").groupBy("_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_of")))).alias("_items"))
            flat = flat.join(items, "_id", "left").withColumn("_items", F.coalesce("_items", F.array().cast("array<string>")))
    else:
        met = F.array_distinct(F.transform("_hits", lambda h: F.array_join(F.slice("_w", h["at"] + 1, h["size"]), " ")))
        flat = _scan(row, listed).withColumn("_id", F.monotonically_increasing_id()).select("_id", "_row", *counted, met.alias("_met"))
        if with_items:
            hit = flat.select("_id", "_row", "_n_words", "_n_hit", F.explode_outer("_met").alias("window")).join(F.broadcast(item_of), "window", "left")  # at most inline_windows rows
            hit = hit.groupBy("_id").agg(F.first("_row").alias("_row"), F.first("_n_words").alias("_n_words"), F.first("_n_hit").alias("_n_hit"), F.collect_set("_of").alias("_of"))
            flat = hit.withColumn("_items", F.array_sort(F.array_distinct(F.flatten("_of"))))
    items = [F.col("_items").alias("items")] if with_items else []
    return flat.select("_row.*", F.col("_n_words").alias("n_words"), F.col("_n_hit").alias("n_hit"), *items, (F.col("_n_hit") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, bench: DataFrame, n: int = 10, text_col: str = "text") -> DataFrame:
    """The documents without any hit, with the columns they came with."""
    return mark(docs, bench, n, text_col, with_items=False).where(~F.col("contaminated")).select(*docs.columns)


def cut_spans(docs: DataFrame, bench: DataFrame, n: int = 10, text_col: str = "text", inline_windows: int = INLINE_WINDOWS, broadcast_anchors: int = BROADCAST_ANCHORS) -> DataFrame:
    """The documents, every word inside a hit taken out together with the separators that follow it.

    Texts without hits stay as they are, null and empty ones among them, and so do all columns; repeated rows are cut each on
    its own. Works for a benchmark of any size; an empty one changes nothing.
    """
    known = windows(bench, n)
    listed = _listed(known, inline_windows)
    if not listed:
        return docs
    text = F.col(text_col)
    word, gap = r"[0-9A-Za-z\x{80}-\x{10FFFF}]", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
    rows = docs.withColumn("_w", words(text))
    rows = _scan(rows, listed) if len(listed) <= inline_windows else _joined_scan(rows, known, broadcast_anchors)[0]
    rows = rows.withColumn("_hit", _hit_words()).withColumn("_piece", F.split(text, f"(?<={gap})(?={word})"))
    lead = F.size("_piece") - F.size("_w")  # one piece more if the text begins with separators
    left = F.array_join(F.filter("_piece", lambda p, i: ~F.array_contains("_hit", i - lead)), "")
    return rows.withColumn(text_col, F.when(F.size("_hit") > 0, left).otherwise(text)).select(*docs.columns)


def digest(marked: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return marked.select(
        id_col, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


ORACLE = r"""
WITH low AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
items AS (SELECT item_id, w, least(10, len(w)) AS size FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark) WHERE len(w) > 0),
win AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, size, array_to_string(w[i:i + size - 1], ' ') AS win FROM (SELECT item_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM items)),
sizes AS (SELECT DISTINCT size FROM win),
spots AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS win FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM low, sizes WHERE len(w) >= size)),
hits AS (SELECT doc_id, i, spots.size AS size, item FROM spots JOIN win USING (win)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT doc_id, i, size FROM hits)) GROUP BY doc_id),
met AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM low LEFT JOIN covered USING (doc_id) LEFT JOIN met USING (doc_id)
"""
