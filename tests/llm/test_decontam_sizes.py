"""Hits and cut spans whichever way the benchmark's size takes."""

import random
import re

import pytest

from tapeloom.llm import decontam
from tests.llm.test_llm import low, prose


def brute(docs, bench, n):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t or ""))

    known = {}
    for item, t in bench:
        w = words(t)
        size = min(n, len(w))
        for i in range(len(w) - size + 1) if w else ():
            known.setdefault(tuple(w[i : i + size]), set()).add(item)
    out = []
    for i, t in docs:
        w, hit, met = words(t), set(), set()
        for size in {len(k) for k in known}:
            for a in range(len(w) - size + 1):
                if tuple(w[a : a + size]) in known:
                    hit |= set(range(a, a + size))
                    met |= known[tuple(w[a : a + size])]
        out.append((i, len(w), len(hit), sorted(str(x) for x in met if x is not None), sorted(hit)))
    return out


@pytest.mark.parametrize(("inline", "anchors"), [(100_000, 10), (3, 10_000), (3, 0)])
def test_every_way_gives_the_same(spark, inline, anchors):
    r = random.Random(3)
    bench = [(k, prose(r, 25)) for k in range(12)] + [(90, "two Words"), (91, None), (92, "..."), (None, "lone idless item here"), (93, "word")]
    docs = [(i, prose(r, 40)) for i in range(10)] + [(20, prose(r, 9) + " " + bench[1][1][10:] + " " + prose(r, 5)), (21, "-- " + bench[2][1].upper() + "!"), (22, None), (23, ""), (24, "x two, WORDS two words"), (25, "lone idless item here"), (25, "a word")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    items = spark.createDataFrame(bench, "item_id long, text string")
    want = brute(docs, bench, 10)
    marked = decontam.mark(df, items, inline_windows=inline, broadcast_anchors=anchors)
    got = sorted((x["doc_id"], x["n_words"], x["n_hit"], x["items"]) for x in marked.collect())
    assert got == sorted(w[:4] for w in want) and sum(w[2] > 0 for w in want) >= 5
    plain = decontam.mark(df, items, inline_windows=inline, broadcast_anchors=anchors, with_items=False)
    assert "items" not in plain.columns and sorted((x["doc_id"], x["n_hit"]) for x in plain.collect()) == sorted((w[0], w[2]) for w in want)
    cut = sorted((x["doc_id"], re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(x["text"] or ""))) for x in decontam.cut_spans(df, items, inline_windows=inline, broadcast_anchors=anchors).collect())
    words = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t or "")) for _, t in docs]
    assert cut == sorted((w[0], [x for k, x in enumerate(ws) if k not in w[4]]) for w, ws in zip(want, words, strict=True))
    text = marked._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", text)
