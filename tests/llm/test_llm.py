"""The training-data operators against brute force, on small tables with nulls, ties, repeats and clashing columns."""

import base64
import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tapeloom.llm import ann, bpe, components, ctw, decontam, jaccard_join, quality, queries, secrets, suffix_dedup, toxicity, warc
from tapeloom.llm.common import restrict, shared_path

SF = "/root/testdata/sf0.001"
LETTERS = "abcdefghij"


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def prose(r, n, vocabulary=200):
    return " ".join("".join(LETTERS[int(d)] for d in str(r.randint(100, 100 + vocabulary))) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def docs(spark):
    """Copies, near copies, nulls, empty and long texts, a repeated row, and columns named like outputs."""
    r = random.Random(3)
    texts = [prose(r, r.randint(1, 120)) for _ in range(60)]
    texts += [texts[3], texts[3], texts[5] + " zz", texts[7][:-4], None, "", "  ", "A", "x" * 5000, prose(r, 6000), "É " + texts[9], texts[9].upper()]
    for i in (10, 11, 12):
        w = texts[i].split()
        for k in range(0, len(w), 17):
            w[k] = "new"
        texts.append(" ".join(w))
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return rows, frame(spark, rows).cache()


# BPE


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))


def test_bpe_equals_the_library(spark, docs, library):
    rows, df = docs
    more = ["it's <|endoftext|>B <|startoftext|>", "ΣΟΦΟΣ İ ſ K", "1234 ½", "aaaaaaaaaaaaaaaaaaaaaaa", "the" * 3000, "\u0085\x1c\t"]
    every = frame(spark, rows + [(1000 + i, t, "", "", 0) for i, t in enumerate(more)] + [rows[0]]).withColumn("ids", F.lit("clash"))
    got = bpe.encode_decode(every, queries.tokenizer_path("word_bpe_49k.json")).collect()
    assert len(got) == len(rows) + len(more) + 1
    for g in got:
        e = library.encode(g["text"] or "", add_special_tokens=False)
        assert g["ids"] == " ".join(map(str, e.ids)) and g["n_tokens"] == len(e.ids)
        assert g["decoded"] == library.decode(e.ids, skip_special_tokens=False)
    assert bpe.encode_decode(every.limit(0), queries.tokenizer_path("word_bpe_49k.json")).count() == 0


# WARC


def test_warc_round_trip(spark):
    html = ["<a>", "<b>é</b>", "<a>", None, "", "x\r\n\r\nWARC/1.1\r\n", "<a>"]
    rows = [(i, f"http://h/{i} \n" if i else None, h) for i, h in enumerate(html)] + [(1, "http://again", "<b>é</b>"), (None, "u", "<a>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    path = shared_path(spark, "warc")
    warc.write(pages, path)
    records = warc.read(spark, path)
    assert records.count() == 3 * len(rows)
    captures = warc.assemble(records)
    assert captures.where("request is null or metadata is null").count() == 0
    stored = {bytes(r["p"]) for r in captures.where("response.record_type = 'response'").select(F.col("response.payload").alias("p")).collect()}
    assert stored == {(h or "").encode() for h in html}
    got = sorted((tuple(r) for r in warc.digest(captures).collect()), key=str)
    last = {}
    for i, _, h in rows:
        if i is not None:
            last[h or ""] = max(last.get(h or "", -1), i)
    want = []
    for i, _, h in rows:
        p = (h or "").encode()
        top = last[h or ""]
        d = base64.b32encode(hashlib.sha1(p).digest()).decode()
        want.append((i, len(p), d, "response" if i == top else "revisit", None if i == top else top))
    assert got == sorted(want, key=str)
    assert {r["record_type"] for r in warc.plan(pages, min_bytes=100).collect()} == {"response"}
    empty = shared_path(spark, "warc")
    warc.write(pages.limit(0), empty)
    assert warc.assemble(warc.read(spark, empty)).count() == 0


# Suffix dedup


def brute_removal(rows, size):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for o in range(len(b) - size + 1):
            if b[o : o + size] in seen:
                gone[o : o + size] = b"\1" * size
            seen.add(b[o : o + size])
        out[i] = bytes(x for x, g in zip(b, gone, strict=True) if not g)
    return out


@pytest.mark.parametrize("hot", [65_536, 2])
def test_suffix_dedup_equals_brute_force(spark, hot):
    r = random.Random(8)
    passage = prose(r, 80)
    texts = [prose(r, 40) + passage + prose(r, 30) for _ in range(12)] + [passage, passage[10:], "ab" * 400, None, "", "é" * 300, passage[5:150]]
    texts += [texts[0], prose(r, 3) + passage[50:170] + "q", passage + passage]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("clash"))
    got = {x["doc_id"]: x for x in suffix_dedup.deduplicate(df, hot=hot).collect()}
    want = brute_removal(rows, 100)
    assert {i: bytes(x["kept"]) for i, x in got.items()} == want
    assert all(x["n_removed"] == x["n_bytes"] - len(want[i]) for i, x in got.items())
    assert suffix_dedup.deduplicate(df.limit(0)).count() == 0


def test_prefix_groups_equal_sorting():
    r = random.Random(2)
    for size in (66, 100):
        x = np.frombuffer(("".join(r.choice("ab") for _ in range(400)) * 2 + "c" * 150 + "\xff").encode("latin-1"), dtype=np.uint8)
        order, bound = suffix_dedup.prefix_groups(x, size)
        n = len(x)
        keys = [bytes(x[(i + np.arange(size)) % n]) for i in order]
        assert keys == sorted(keys)
        assert bound.tolist() == [i == 0 or keys[i] != keys[i - 1] for i in range(n)]


def test_suffix_dedup_with_repeated_and_missing_ids(spark):
    r = random.Random(4)
    a, b = prose(r, 60), prose(r, 60)
    df = spark.createDataFrame([(1, a), (1, a), (2, b), (None, a), (None, b)], "doc_id long, text string")
    got = sorted((str(x["doc_id"]), x["n_removed"]) for x in suffix_dedup.deduplicate(df).collect())
    assert got == sorted([("1", 0), ("1", 0), ("2", 0), ("None", len(a)), ("None", len(b))])


# Jaccard join


def word_sets(rows, k):
    out = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t or ""))
        out[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    return out


def brute_components(sets, percent):
    ids = sorted(sets)
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_components_equal_brute_force(spark, docs, k, percent):
    rows, df = docs
    r = random.Random(6)
    base = prose(r, 150).split()
    group = []
    for i in range(40):  # a group of near copies with links and near misses
        w = base[:]
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = prose(r, 1)
        group.append((500 + i, " ".join(w), "", "", 0))
    every = frame(spark, [*rows, *group]).withColumn("component_id", F.lit(1))
    sets = word_sets([x[:2] for x in [*rows, *group]], k)
    want = brute_components(sets, percent)
    found = jaccard_join.near_duplicates(every, k=k, percent=percent).collect()
    assert {x["doc_id"]: x["component_id"] for x in found} == want
    assert {x["doc_id"]: x["n_shingles"] for x in found} == {i: len(s) for i, s in sets.items()}
    kept = {x["doc_id"] for x in jaccard_join.deduplicate(every, k=k, percent=percent).collect()}
    assert kept == {i for i, c in want.items() if i == c}


def test_join_without_rows_or_ids(spark, docs):
    rows, df = docs
    assert jaccard_join.near_duplicates(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, rows[0][1]), (5, rows[0][1]), (None, "other words"), (9, None)], "doc_id long, text string")
    got = sorted((str(x["doc_id"]), str(x["component_id"])) for x in jaccard_join.near_duplicates(odd).collect())
    assert got == [("5", "5"), ("9", "9"), ("None", "5"), ("None", "None")]


def test_linked_sets_share_a_piece():
    rng = np.random.default_rng(3)
    for percent in (80, 90):
        for _ in range(400):
            n = int(rng.integers(2, 300))
            a = rng.integers(0, 2**63, n, dtype=np.uint64)
            cut = int(rng.integers(0, n // 4 + 1))
            a, b = np.unique(a), np.unique(np.concatenate([a[cut:], rng.integers(0, 2**63, int(rng.integers(0, n // 6 + 1)), dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both >= percent * (len(a) + len(b) - both):
                k, c = jaccard_join.piece_keys(np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), np.array([len(a), len(b)]), percent)
                assert len(np.intersect1d(k[: c[0]], k[c[0] :])) or np.array_equal(a, b)


@pytest.mark.parametrize("ranges", [1, 7, 100_000])
def test_packed_keys_unpack(ranges):
    rng = np.random.default_rng(4)
    count, node = rng.integers(1, 9, 50), rng.integers(-(2**62), 2**62, 50)
    keys = rng.integers(-(2**63), 2**63, int(count.sum()))
    got = []
    for row in jaccard_join.pack(keys, count, node, ranges).to_pylist():
        assert len(set(row["nodes"])) == len(row["nodes"])
        for low, high, at in zip(row["low"], row["high"], row["at"], strict=True):
            got.append((row["part"], high & 0xFF, low & 0xFFFFFFFF, row["nodes"][at]))
    bits = [int(k) % 2**64 for k in keys]
    assert sorted(got) == sorted((((b >> 32) * ranges) >> 32, (b >> 32) & 0xFF, b & 0xFFFFFFFF, int(n)) for b, n in zip(bits, np.repeat(node, count), strict=True))


def test_more_nodes_than_a_pack_holds(spark, docs, monkeypatch):
    rows, df = docs
    monkeypatch.setattr(jaccard_join, "PACK_KEYS", 40)
    monkeypatch.setattr(jaccard_join, "PACK_NODES", 3)
    found = jaccard_join.near_duplicates(df, k=3, percent=90).collect()
    assert {x["doc_id"]: x["component_id"] for x in found} == brute_components(word_sets([x[:2] for x in rows], 3), 90)


def test_connected_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(50) if i % 7] + [(100, 100)] + [(r.randint(200, 260), r.randint(200, 260)) for _ in range(40)]
    got = {x["node"]: x["label"] for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = brute_components({n: {n} for e in edges for n in e}, 1000)
    for a, b in edges:
        x, y = min(want[a], want[b]), max(want[a], want[b])
        want = {n: x if c == y else c for n, c in want.items()}
    for a in got:
        for b in got:
            assert (got[a] == got[b]) == (want[a] == want[b])


# ANN


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, 32)) + 2 * rng.normal(size=(20, 32))[rng.integers(0, 20, 2000)]
    x[100:160] = x[100]  # a common vector
    rows = [(i, [float(v) for v in np.float32(u)]) for i, u in enumerate(x)]
    rows += [(3000, None), (3050, [0.0] * 32), (3100, [float("nan")] * 32), (3150, [None, 1.0]), (None, rows[0][1]), rows[7]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.nearest(df, F.col("vec_id") % 50 == 0, block_rows=500).collect()
    v = np.float32(x).astype(float)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    hit = total = 0
    for qid in range(0, 2000, 50):
        s = u @ u[qid]
        s[qid] = -2
        mine = sorted((g for g in got if g["query_id"] == qid), key=lambda g: g["rank"])
        assert [g["rank"] for g in mine] == [1, 2, 3, 4, 5]
        assert all(abs(g["score"] - s[g["vec_id"]]) < 1e-12 for g in mine)
        assert [(-g["score"], g["vec_id"]) for g in mine] == sorted((-g["score"], g["vec_id"]) for g in mine)
        hit += sum(g["score"] >= np.sort(s)[-5] - 1e-12 for g in mine)
        total += 5
    assert hit / total >= 0.9
    assert [g["vec_id"] for g in sorted(got, key=lambda g: g["rank"]) if g["query_id"] == 100] == [101, 102, 103, 104, 105]
    assert {g["query_id"] for g in got} == set(range(0, 2000, 50))
    assert ann.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert ann.nearest(df.where("vec_id in (0, 1)"), F.col("vec_id") % 50 == 0).count() == 1


def test_chi_square():
    assert ann.chi_square(np.array(15.507), 8) == pytest.approx(0.95, abs=1e-4)
    assert ann.chi_square_quantile(0.5, 2) == pytest.approx(2 * math.log(2))


# Classifiers


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01"), reason="needs the test tables")
@pytest.mark.parametrize(("name", "target", "least"), [("op6_quality", "quality", 0.95), ("op10_toxicity", "toxic", 0.9)])
def test_held_out_accuracy(spark, name, target, least):
    sf = "/root/testdata/sf0.01"
    got = queries.queries()[name](spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    x = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").agg(F.avg((F.col("predicted") == F.col(target)).cast("double"))).first()[0]
    assert x >= least
    assert got.where("score < 0 or score > 1 or score is null").count() == 0


def test_classifiers_on_odd_tables(spark, docs):
    rows, df = docs
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.score(df, quality.fit(df, labels)).collect()} == {0.5}
    assert max(r["score"] for r in toxicity.score(df, toxicity.fit(df, labels)).collect()) < 0.5
    some = spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(None, 0, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    assert min(r["score"] for r in quality.score(df, quality.fit(df, some)).collect()) > 0.5
    assert quality.score(df.limit(0), quality.fit(df, some)).count() == 0
    out = toxicity.score(df.withColumn("score", F.lit("clash")), toxicity.fit(df, some))
    assert out.count() == len(rows) and dict(out.dtypes)["score"] == "double"


def test_statistics_of_empty_texts():
    x = quality.statistics(pa.array([None, "", "a b a b a b", "##!! ##!!"]))
    assert not x[:2].any() and x[2, quality.STATISTICS.index("distinct_words")] == pytest.approx(1 / 3)


def test_rules_find_a_conjunction():
    rng = np.random.default_rng(2)
    x = rng.random((3000, len(quality.STATISTICS)))
    y = ((x[:, 2] > 0.5) & (x[:, 5] <= 0.3)).astype(float)
    model = quality.fit_rules(x, y)
    total = np.full(len(x), model.intercept)
    for weight, rule in model.weighted:
        hold = np.ones(len(x), bool)
        for j, above, cut in rule:
            hold &= (x[:, j] > cut) if above else (x[:, j] <= cut)
        total += weight * hold
    assert ((total > 0) == (y > 0)).mean() > 0.97


def test_maximal_segments_equal_brute_force():
    r = random.Random(7)

    def brute(s, a, b):
        best = None
        for i in range(a, b):
            for j in range(i + 1, b + 1):
                v = sum(s[i:j])
                if v > 0 and (best is None or v > best[0] + 1e-12 or (abs(v - best[0]) <= 1e-12 and j - i < best[2] - best[1])):
                    best = (v, i, j)
        if best is None:
            return []
        return brute(s, a, best[1]) + [best[1:]] + brute(s, best[2], b)

    for _ in range(60):
        s = [r.choice((-3, -2, -1, 1, 2, 3)) + r.random() * 0.1 for _ in range(r.randint(0, 14))]
        assert [x[:2] for x in toxicity.segments(np.array(s))] == brute(s, 0, len(s))


# CTW


def test_base_score_and_model(spark, docs):
    rows, df = docs
    got = {r["doc_id"]: r for r in ctw.split_score(df.select("doc_id", "text")).collect()}
    tok = {i: [*re.findall(r"[^\x20\x09-\x0D]+", low(t or "")), None] for i, t, *_ in rows}
    c = Counter(x for i, w in tok.items() if zlib.crc32(str(i).encode()) % 7 != 2 for x in w)
    total, kinds = sum(c.values()), len(c)
    for i, w in tok.items():
        g = got[i]
        assert g["held_out"] == (zlib.crc32(str(i).encode()) % 7 == 2)
        assert (g["n_tokens"], g["n_known"], g["train_tokens"]) == (len(w), sum(c[x] > 0 for x in w), total)
        assert g["base_score"] == pytest.approx(sum(math.log10((c[x] + 1) / (total + kinds + 1)) for x in w))
        assert g["score"] < 0
    small = ctw.score(df, df, hot_words=5).collect()
    full = {r["doc_id"]: r for r in ctw.score(df, df).collect()}
    assert all(r["base_score"] == pytest.approx(full[r["doc_id"]]["base_score"]) and r["n_known"] == full[r["doc_id"]]["n_known"] for r in small)
    assert ctw.score(df.limit(0), df).count() == 0
    blank = ctw.score(df, df.limit(0)).where("doc_id = 0").first()
    assert blank["train_tokens"] == 0 and blank["score"] == pytest.approx((blank["n_bytes"] + 1) * math.log10(1 / 256), rel=1e-4)


def test_context_tree_probabilities():
    data = np.frombuffer("the theory of the thing".encode() * 20, dtype=np.uint8)
    keys, _ = ctw.context_keys(data, np.array([0, len(data)]))
    u, n = np.unique(keys, return_counts=True)
    table = ctw.weigh(u, n).reshape(-1, 256)
    sums = (10.0 ** table[np.unique(u >> 8)].astype(float)).sum(axis=1)
    assert np.allclose(sums, 1, atol=1e-4)

    def kt(a, b):  # log of the estimate, by its product
        v, z, o = 0.0, 0, 0
        for bit, times in ((0, a), (1, b)):
            for _ in range(times):
                v += math.log(((o if bit else z) + 0.5) / (z + o + 1))
                z, o = z + (not bit), o + bit
        return v

    a, b = np.array([3.0, 0.0, 7.0]), np.array([2.0, 0.0, 0.0])
    assert np.allclose(ctw._kt(a, b), [kt(int(x), int(y)) for x, y in zip(a, b, strict=True)])


# Secrets


def test_secret_spans(spark):
    key = "AKIA" + "B" * 16
    texts = [
        f"id {key}\npassword = 'abcdefgh1' token: short", "api_key=" + "a" * 8 + " " + "0123456789abcdef" * 2, "é PASSWORD:x.y/z=12345", "ſecret = abcdefghijk", None, "", "AKIA123",
        f"{key} then Zx9Zx9Zx9Zx9Zx9Zx9Zx9Zx9 at https://api.example.com/v1", "Zx9Zx9Zx9Zx9Zx9Zx9Zx9Zx9 alone", f"{key}\n\nZx9Zx9Zx9Zx9Zx9Zx9Zx9Zx9",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("spans", F.lit("clash"))
    got = {r["doc_id"]: r for r in secrets.digest(secrets.scan(df)).collect()}
    for i, t in enumerate(texts):
        t, want = t or "", []
        for m in re.finditer(r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t):
            want += [("assign", *m.span())] * (len(m[2]) >= 8)
        want += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        want += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        want.sort(key=lambda x: (x[1], secrets.KINDS.index(x[0])))
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert got[i]["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert got[i]["n_assign"] == sum(k == "assign" for k, *_ in want)
        assert set(text.split(",")) - {""} <= set(got[i]["spans"].split(","))
    assert "secret:" in got[7]["spans"] and "endpoint:" in got[7]["spans"]
    assert got[8]["spans"] == "" and "secret:" not in got[9]["spans"]
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(secrets.scan(df)).collect()}
    assert key not in clean[0] and "abcdefgh1" not in clean[0] and "token: short" in clean[0]
    assert clean[8] == texts[8] and clean[4] is None
    assert secrets.scan(df.limit(0)).count() == 0


# Decontamination


def test_decontamination(spark, docs):
    rows, df = docs
    item = " ".join(rows[1][1].split()[:14])
    bench = spark.createDataFrame([(1, item), (2, "A"), (3, None), (4, ""), (10, item), (None, "new")], "item_id long, text string")
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    known = {}
    for i, t in ((1, item), (2, "A"), (10, item), (None, "new")):
        w = pattern.findall(low(t))
        n = min(10, len(w))
        for k in range(len(w) - n + 1):
            known.setdefault(tuple(w[k : k + n]), set()).add(i)
    for limit in (100_000, 1):
        marked = decontam.mark(df.withColumn("items", F.lit("clash")), bench, inline_windows=limit)
        got = {r["doc_id"]: r for r in marked.collect()}
        for i, t, *_ in rows:
            w = pattern.findall(low(t or ""))
            hit, met = set(), set()
            for win, ids in known.items():
                for k in range(len(w) - len(win) + 1):
                    if tuple(w[k : k + len(win)]) == win:
                        hit |= set(range(k, k + len(win)))
                        met |= {str(x) for x in ids if x is not None}
            assert (got[i]["n_words"], got[i]["n_hit"], got[i]["items"]) == (len(w), len(hit), sorted(met)), (limit, i)
    kept = {r["doc_id"] for r in decontam.drop_contaminated(df, bench).collect()}
    assert kept == {i for i, r in got.items() if not r["contaminated"]}
    cut = {r["doc_id"]: r["text"] for r in decontam.cut_spans(df, bench).collect()}
    assert item not in cut[1] and all(cut[i] == rows[i][1] for i in kept)
    assert decontam.mark(df, bench.limit(0)).where("contaminated").count() == 0
    assert decontam.mark(df.limit(0), bench).count() == 0


def test_decontamination_runs_no_python(spark, docs):
    plan = decontam.mark(docs[1], spark.createDataFrame([(1, "a b c")], "item_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# Pipeline


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the test tables")
def test_pipeline_stages_against_brute_force(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    columns = docs.columns
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    good = p.keep_good(spark, docs, SF)
    assert good.columns == columns
    want = brute_components(word_sets(texts.items(), 5), 80)
    one = p.keep_one_of_near_duplicates(spark, docs, SF)
    assert {r["doc_id"] for r in one.collect()} == {i for i, c in want.items() if i == c}
    bench = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(r["text"])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = {" ".join(w[k : k + 10]) for w in bench for k in range(max(1, len(w) - 9))}
    leaks = {i for i, t in texts.items() if any(f" {g} " in f" {' '.join(re.findall(r'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+', low(t)))} " for g in grams)}
    assert {r["doc_id"] for r in p.drop_contaminated(spark, docs, SF).collect()} == set(texts) - leaks
    safe = p.redact_secrets(spark, docs, SF)
    assert safe.columns == columns and safe.count() == len(texts)
    assert not any(secrets.base_spans(r["text"], r["text"].lower()) for r in safe.collect())
    last = p.run(spark, SF).collect()
    kept = {r["doc_id"] for r in last}
    assert kept <= {r["doc_id"] for r in good.collect()} - leaks and len(last) == len(kept) > 0


def test_restrict_beyond_the_bound(spark, docs, monkeypatch):
    monkeypatch.setattr("tapeloom.llm.common.BROADCAST_IDS", 1)
    ids = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    assert sorted(r["doc_id"] for r in restrict(docs[1], ids, "doc_id", True).collect()) == [1, 2, 3]
