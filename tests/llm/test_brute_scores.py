"""Scores and links that SQL can't express, against plain loops."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tapeloom.llm import quality, secrets, toxicity
from tests.llm.test_llm import low, prose

TEXTS = ["", None, "A b", "Hello, World! 12 12 12 ## @@x\nline two!!", "é" * 9 + " öl 漢字", "the the cat sat on the mat " * 30, "a,b.c;d " * 4 + "\n\n\t x1y2z3"]


def plain_statistics(t):
    t = t or ""
    raw = t.encode()
    if not raw:
        return [0.0] * len(quality.STATISTICS)
    w = re.findall(rb"[^\x20\x09-\x0D]+", low(t).encode())
    asis = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    many, ink = max(len(w), 1), max(sum(map(len, w)), 1)
    letter = sum(chr(b).isalpha() if b < 128 else True for b in raw)
    odd = {b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,'-!"}
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [tuple(w)] * bool(w)
    marked = odd | {33}
    return [
        math.log1p(len(w)), sum(map(len, w)) / many, sum(65 <= b <= 90 for b in raw) / max(letter, 1), sum(b in odd for b in raw) / ink, sum(48 <= b <= 57 for b in raw) / ink, sum(b in b".," for b in raw) / many, raw.count(b"!") / ink,
        raw.count(b"\n") / many, len(set(w)) / many, sum(a == b for a, b in zip(w, w[1:])) / many, len(set(grams)) / max(len(grams), 1), sum(any(x in marked and y in marked for x, y in zip(a, a[1:])) for a in asis) / many,
    ]


def test_quality_scores(spark):
    r = random.Random(1)
    texts = [*TEXTS, *(prose(r, r.randint(1, 80)) for _ in range(20))]
    got = quality.statistics(pa.array(texts, pa.string()))
    want = np.array([plain_statistics(t) for t in texts])
    assert np.allclose(got, want)
    rules = quality.Rules(-0.3, tuple((r.uniform(-2, 2), tuple((r.randrange(12), r.random() < 0.5, float(np.median(want[:, r.randrange(12)]))) for _ in range(r.randint(1, 3)))) for _ in range(15)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scored = {x["doc_id"]: x["score"] for x in quality.score(df, rules).collect()}
    for i, x in enumerate(want):
        total = rules.intercept + sum(weight for weight, rule in rules.weighted if all((x[j] > cut) == above for j, above, cut in rule))
        assert scored[i] == pytest.approx(1 / (1 + math.exp(-total)))


def test_toxicity_scores(spark):
    r = random.Random(2)
    vocabulary = [f"w{i}x" for i in range(40)] + ["hateful", "hatefulness"]
    texts = [None, "", "hateful"] + [" ".join(r.choice(vocabulary) for _ in range(r.randint(1, 60))) for _ in range(60)]

    def hashes(word):
        return toxicity.tokens(pa.array([word]))[0][0]

    listed = {int(hashes(w)[0]): 1.0 + i / 3 for i, w in enumerate(vocabulary[:6])} | {int(hashes("hateful")[1]): 2.5}
    keys = np.array(sorted(listed))
    m = toxicity.Lexicon(keys, np.array([listed[k] for k in keys.tolist()]), -0.4, 0.8, 0.05, (1.3, -2.0))

    def word_score(w):
        return max(listed.get(int(h), m.other) for h in hashes(w))

    def passages(s, a, b):
        best = max(((sum(s[i:j]), -(j - i), i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0, 0))
        if best[0] <= 0:
            return []
        i, j = best[2], best[3]
        return passages(s, a, i) + [(i, j, best[0])] + passages(s, j, b)

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x for x in toxicity.score(df, m).collect()}
    for i, t in enumerate(texts):
        words = (t or "").split()
        found = passages([word_score(w) for w in words], 0, len(words))
        assert [(x["first"], x["end"]) for x in got[i]["segments"]] == [x[:2] for x in found]
        n, x = max(len(words), 1), 0.0
        if found:
            ones = sorted((m.decay * v - math.log(m.factor * n) for _, _, v in found), reverse=True)
            x = -math.log10(max(1 - math.exp(-math.exp(-ones[0])), 1e-300))
            total = 0.0
            for k, one in enumerate(ones, 1):
                total += one
                if one <= 0:
                    break
                if k > 1:
                    x = max(x, -math.log10(math.exp(-total) * total ** (k - 1) / (math.factorial(k) * math.factorial(k - 1)) * 2**k))
        assert got[i]["score"] == pytest.approx(1 / (1 + math.exp(-(1.3 * min(max(x, 0), 30) - 2.0))))


def plain_links(text, scope):
    """Every weak candidate against every other part, paragraph by paragraph."""
    base = secrets.base_spans(text, text.lower())
    weak, taken = [], [(s, e) for _, s, e in base]
    for kind, pattern in (("endpoint", secrets._ENDPOINT), ("ident", secrets._IDENT), ("secret", secrets._RANDOM)):
        new = [(kind, m.start(), m.end()) for m in pattern.finditer(text) if kind != "secret" or secrets._mixed(m.group())]
        new = [x for x in new if not any(s < x[2] and x[1] < e for s, e in taken)]
        weak += new
        taken += [(s, e) for _, s, e in new]
    breaks = [m.start() for m in re.finditer(r"\n\s*\n", text)]
    out = []
    for kind, s, e in weak:
        lo, hi = max([0, *(b + 1 for b in breaks if b < s)]), min([len(text), *(b - 1 for b in breaks if b >= e)])
        lo, hi = max(lo, s - scope), min(hi, e + scope)
        near = {k for k, a, b in [*base, *weak] if a <= hi and b >= lo}
        ident, secret, end = near & {"access", "ident"}, near & {"assign", "hex", "secret"}, near & {"endpoint"}
        if (ident and secret) if kind == "endpoint" else (secret if kind == "ident" else ident or end):
            out.append((kind, s, e))
    return out


def test_links_of_secrets():
    r = random.Random(3)
    parts = ["user=alice77", "login: bob.smith", "https://api.example.test/v1", "db+x://host:99/path", "aB3dE5fG7hI9jK1lM3nO5", "Zz9" * 8, "password=hunter2hunter2", "AKIA" + "A1" * 9, "0123456789abcdef" * 2, "client_id = zzzz9"]
    met = 0
    for _ in range(300):
        text = "".join(r.choice(parts) + r.choice([" ", "\n", "\n\n", " and ", " x" * r.randint(1, 30), "\n \n"]) for _ in range(r.randint(1, 9)))
        for scope in (10, 60):
            want = plain_links(text, scope)
            base = secrets.base_spans(text, text.lower())
            assert secrets.find(text, scope) == sorted(base + want, key=lambda x: (x[1], secrets.KINDS.index(x[0]), x[2]))
            met += len(want)
    assert met > 200


def test_labelled_rows_are_taken_once(spark):
    from tapeloom.llm.common import labelled

    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(3, 1), (3, 0), (None, 1), (61, None)], "doc_id long, quality int")
    rows = [(i, f"t{i}", "x") for i in range(50)] + [(None, "n", "x"), (61, "m", "x")]
    once = spark.createDataFrame(rows, "doc_id long, text string, quality string")
    twice = once.unionByName(spark.createDataFrame([(7, "a", "y"), (7, None, "y"), (9, "t9", "y")], "doc_id long, text string, quality string"))
    one, two = ({r["doc_id"]: (r["text"], r["label"]) for r in labelled(d.withColumn("label", F.lit("clash")), labels, "quality", 5, 1000).collect()} for d in (once, twice))
    import zlib

    assert set(one) == set(two) == {i for i in range(50) if zlib.crc32(str(i).encode()) % 5}
    assert one[3] == ("t3", 1) if 3 in one else True
    assert {k: v for k, v in two.items() if k != 7} == {k: v for k, v in one.items() if k != 7}
    if 7 in two:
        assert two[7] == ("", 1)
    for d in (once, twice):
        got = labelled(d, labels, "quality", 5, 10).collect()
        assert len(got) <= 10 and len({r["doc_id"] for r in got}) == len(got)
