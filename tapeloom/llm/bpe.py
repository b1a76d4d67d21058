"""BPE encoding and decoding with a published vocabulary, by batched numpy merge rounds.

The symbols of many words lie in one flat array. A round forms the key of every neighbouring pair within a word, finds
its rank by binary search over the sorted keys of the merge list, takes each word's lowest rank, and merges that pair
wherever it stands in the word, leftmost first. Words that have no pair left drop out of the array.

Merging all places of a word's lowest pair at once is exact when a merge's parts are made by earlier merges only, as the
training of BPE guarantees; `Vocabulary` checks it.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tapeloom.llm.common import slices

SCHEMA = "n_tokens long, ids string, decoded string"
#: Words kept encoded by a worker; beyond it the store starts anew, so memory stays bounded.
CACHE_WORDS = 300_000


# Code points that the tokenizers library, by its tables of Unicode, takes for neither letters nor numbers
# although the regex module does, and capitals whose small letters it knows and Python doesn't (the first of a range: to).
NOT_LETTERS = """
0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DF1 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3
187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED
1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F
"""
NOT_NUMBERS = "11DE0-11DE9 1246F 12475-1247F 12550-12686 16FF4-16FF6"
#: And marks (and a letter with its parts) that it neither orders nor joins when it normalises.
UNORDERED = """
07FD 0898-089F 08CA-08D3 09FE 0C3C 0D3B-0D3C 0EBA 1715 1ABF-1ACE 1DF6-1DFA A82C 10D24-10D27 10EAB-10EAC 10EFD-10EFF 10F46-10F50 10F82-10F85 11070 1133B 1145E 11839-1183A 11930 11938 1193D-1193E 11943
119E0 11A34 11A47 11A99 11D42 11D44-11D45 11D97 11F41-11F42 16FF0-16FF1 1E08F 1E130-1E136 1E2AE 1E2EC-1E2EF 1E4EC-1E4EF
"""
SMALL = "1C89:1C8A A7CB:0264 A7CC:A7CD A7CE:A7CF A7D2:A7D3 A7D4:A7D5 A7DA:A7DB A7DC:019B 10D50-10D65:10D70 16EA0-16EB8:16EBB"


def _set(ranges: str) -> str:
    """The inside of a character class."""
    return "".join("-".join(rf"\U{int(x, 16):08X}" for x in r.split("-")) for r in ranges.split())


def _small() -> dict[int, int]:
    out = {}
    for item in SMALL.split():
        span, to = item.split(":")
        ends = [int(x, 16) for x in span.split("-")]
        out |= {c: int(to, 16) + c - ends[0] for c in range(ends[0], ends[-1] + 1)}
    return out


def _byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies give each byte: printable Latin-1 stands for itself, the rest follow from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


class Vocabulary:
    """A word-end byte-level BPE vocabulary (tokenizers JSON)."""

    def __init__(self, raw: str):
        spec = json.loads(raw)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.steps = self._steps(spec.get("normalizer"))
        top = max([*vocab.values(), *self.special.values()]) + 1
        self.token = [""] * top
        for t, i in [*vocab.items(), *self.special.items()]:
            self.token[i] = t
        self.width = np.int64(top)
        letters = _byte_letters()
        self.plain = np.array([vocab[c] for c in letters], dtype=np.int64)
        self.final = np.array([vocab[c + self.suffix] for c in letters], dtype=np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        rank_made = np.full(top, -1, dtype=np.int64)
        rank_made[made] = np.arange(len(made))
        here = np.arange(len(made))
        if len(np.unique(made)) != len(made) or (rank_made[left] >= here).any() or (rank_made[right] >= here).any():
            raise ValueError("the merges aren't in order of dependency; merge rounds would not be exact")
        key = left * self.width + right
        order = np.argsort(key)
        self.key, self.rank, self.made = key[order], order, made

    def _steps(self, spec: dict | None) -> list[str]:
        """The normaliser's steps: forms of Unicode and `lower`. White space made alike is no step, as no word holds any."""
        if spec is None:
            return []
        if spec["type"] == "Sequence":
            return [x for part in spec["normalizers"] for x in self._steps(part)]
        if spec["type"] in ("NFC", "NFD", "NFKC", "NFKD"):
            return [spec["type"]]
        if spec["type"] == "Lowercase":
            return ["lower"]
        if spec["type"] == "Replace" and spec["pattern"] == {"Regex": r"\s+"} and spec["content"] == " " and not regex.search(self.pattern, " \t\n\u3000"):
            return []
        raise ValueError(f"unknown normaliser {spec['type']}")

    def encode_words(self, byte_words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word."""
        size = np.array([len(w) for w in byte_words], dtype=np.int64)
        flat = np.frombuffer(b"".join(byte_words), dtype=np.uint8)
        ends = np.cumsum(size)
        sym = self.plain[flat]
        sym[ends - 1] = self.final[flat[ends - 1]]
        word = np.repeat(np.arange(len(size)), size)
        done_sym, done_word = [], []
        none = np.int64(len(self.made))
        while len(sym):
            key = sym[:-1] * self.width + sym[1:]
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            rank = np.where((self.key[at] == key) & (word[:-1] == word[1:]), self.rank[at], none)
            rank = np.append(rank, none)
            first = np.flatnonzero(np.diff(word, prepend=-1))
            low = np.minimum.reduceat(rank, first)
            counts = np.diff(np.append(first, len(sym)))
            low_here = np.repeat(low, counts)
            hit = (rank == low_here) & (rank < none)
            # in a run of overlapping places (x x x) every other one merges, from the left
            places = np.flatnonzero(hit)
            if len(places):
                run_start = np.diff(places, prepend=-2) != 1
                index = np.arange(len(places))
                since = index - np.maximum.accumulate(np.where(run_start, index, 0))
                places = places[since % 2 == 0]
                sym = sym.copy()
                sym[places] = self.made[rank[places]]
            stay = np.ones(len(sym), dtype=bool)
            stay[places + 1] = False
            alive = low_here < none
            over = ~alive
            done_sym.append(sym[over])
            done_word.append(word[over])
            keep = stay & alive
            sym, word = sym[keep], word[keep]
        sym = np.concatenate(done_sym) if done_sym else np.zeros(0, np.int64)
        word = np.concatenate(done_word) if done_word else np.zeros(0, np.int64)
        order = np.argsort(word, kind="stable")
        return np.split(sym[order], np.cumsum(np.bincount(word, minlength=len(size)))[:-1])


class Codec:
    """Encodes and decodes texts; keeps the words seen lately."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.find = regex.compile(vocabulary.pattern).findall
        self.names = sorted(vocabulary.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.names)) + ")") if self.names else None
        self.known: dict[str, tuple[str, int, str]] = {}
        # texts with code points on which the library differs are told by a search and cut by a pattern without them
        self.small = _small()
        # (the standard module looks up sets of the basic plane in a bitmap; few texts have code points beyond)
        every = [x for r in (NOT_LETTERS, NOT_NUMBERS, UNORDERED) for x in r.split()] + [f"{c:X}" for c in self.small]
        self.basic, self.beyond = (re.compile(f"[{_set(' '.join(x for x in every if (len(x.split('-')[0]) > 4) == far))}]").search for far in (False, True))
        self.unordered = regex.compile(f"([{_set(UNORDERED)}])")
        exact = vocabulary.pattern
        for name, ranges in (("L", NOT_LETTERS), ("N", NOT_NUMBERS)):
            exact = exact.replace(rf"[\p{{{name}}}]", rf"\p{{{name}}}").replace(rf"[^\s\p{{L}}\p{{N}}]", "\0").replace(rf"\p{{{name}}}", rf"[\p{{{name}}}--[{_set(ranges)}]]").replace("\0", rf"[^\s\p{{L}}\p{{N}}]")
        other = rf"[[^\s\p{{L}}\p{{N}}]||[{_set(NOT_LETTERS)}{_set(NOT_NUMBERS)}]]"
        self.find_odd = regex.compile("(?V1)" + exact.replace(r"[^\s\p{L}\p{N}]", other)).findall

    def normal(self, text: str, odd: bool = False) -> str:
        plain = text.isascii()
        for step in self.v.steps:
            if step != "lower":
                if not plain:
                    parts = self.unordered.split(text) if odd else [text]
                    text = "".join([unicodedata.normalize(step, p) if k % 2 == 0 else p for k, p in enumerate(parts)])
                continue
            if not plain:
                # lower-casing goes letter by letter, so a final sigma gets no form of its own
                text = text.replace("Σ", "σ")
            text = text.lower().translate(self.small) if odd else text.lower()
        return text

    def words(self, text: str) -> list[str]:
        odd = not text.isascii() and (self.basic(text) is not None or len(text.encode("utf-16-le", "surrogatepass")) > 2 * len(text) and self.beyond(text) is not None)
        return (self.find_odd if odd else self.find)(self.normal(text, odd))

    def split(self, text: str) -> list[list[str] | str]:
        """Runs of words, between the special tokens that stand in the text."""
        parts = self.special.split(text) if any(n in text for n in self.names) else [text]
        return [p if k % 2 else self.words(p) for k, p in enumerate(parts) if p]

    def learn(self, new: list[str]) -> None:
        ids = self.v.encode_words([w.encode("utf-8", "surrogatepass") for w in new])
        token = self.v.token
        for w, x in zip(new, ids, strict=True):
            x = x.tolist()
            self.known[w] = (" ".join(map(str, x)), len(x), " ".join([token[i] for i in x]))

    def encode(self, texts: list[str]) -> list[tuple[int, str]]:
        """For each text: the number of ids, and the ids joined by spaces."""
        cut = [self.split(t) for t in texts]
        seen: set[str] = set()
        for parts in cut:
            for p in parts:
                if not isinstance(p, str):
                    seen.update(p)
        if len(self.known) + len(seen) > CACHE_WORDS:
            self.known.clear()
        self.learn([w for w in seen if w not in self.known]) if seen - self.known.keys() else None
        known, out = self.known, []
        for parts in cut:
            ids = []
            for p in parts:
                if isinstance(p, str):
                    ids.append(str(self.v.special[p]))
                else:
                    ids.extend([known[w][0] for w in p])
            joined = " ".join(ids)
            out.append((joined.count(" ") + 1 if joined else 0, joined))
        return out

    def decode(self, ids: str) -> str:
        """Tokens joined by one space, as the library decodes where a vocabulary names no decoder."""
        token = self.v.token
        return " ".join([token[int(i)] for i in ids.split(" ")]) if ids else ""


class FastDecoder:
    """decode() with the id texts looked up directly, which spares turning them into numbers."""

    def __init__(self, vocabulary: Vocabulary):
        self.token = {str(i): t for i, t in enumerate(vocabulary.token)}

    def __call__(self, ids: str) -> str:
        return " ".join(map(self.token.__getitem__, ids.split(" "))) if ids else ""


def load(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_decode(docs: DataFrame, vocabulary_path: str, text_col: str = "text", digests: bool = False) -> DataFrame:
    """docs with n_tokens, ids (decimal, joined by one space) and decoded; or, with digests, n_tokens and the SHA-256 of both.

    Whole texts are encoded. A null text counts as the empty one: no ids, empty decoded text. A special token's string in a
    text becomes its id, as in the library. Repeated rows are encoded each on its own; other columns stay as they are, but
    a column that bears an output's name is replaced. An empty table gives an empty table. Letters and numbers are those of
    the library's tables of Unicode, code point by code point. One pass, no shuffle; a worker
    holds the vocabulary (the file is read on the driver, so its size is known) and at most CACHE_WORDS encoded words.
    """
    made = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["n_tokens", "ids", "decoded"]
    raw = docs.sparkSession.sparkContext.broadcast(load(vocabulary_path))
    kept = [f for f in docs.schema.fields if f.name not in made]
    names = [f.name for f in kept]
    out_schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"{made[0]} long, {made[1]} string, {made[2]} string"])
    arrow_made = [pa.field(made[0], pa.int64()), pa.field(made[1], pa.string()), pa.field(made[2], pa.string())]

    def run(batches):
        vocabulary = Vocabulary(raw.value)
        codec, decode = Codec(vocabulary), FastDecoder(vocabulary)
        for batch in batches:
            for piece in slices(batch, text_col):
                texts = [t or "" for t in piece.column(text_col).to_pylist()]
                coded = codec.encode(texts)
                ids = [x for _, x in coded]
                back = [decode(x) for x in ids]
                if digests:
                    ids = [hashlib.sha256(x.encode()).hexdigest() for x in ids]
                    back = [hashlib.sha256(x.encode()).hexdigest() for x in back]
                columns = [piece.column(n) for n in names]
                columns += [pa.array([n for n, _ in coded], pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([piece.schema.field(n) for n in names] + arrow_made))

    return docs.mapInArrow(run, out_schema)
