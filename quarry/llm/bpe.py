"""BPE encoding by speculation and verification, and decoding.

The vocabulary file is read as it is (path is a parameter); nothing is trained. A word is
first cut greedily into the longest vocabulary tokens. That is the BPE encoding exactly
if every two neighbours are compatible, i.e. if exact merging of their concatenation
gives those two tokens back: merges inside a token never depend on what stands further
away. All adjacent pairs of a batch's new words are tested at once: pairs are packed into
64-bit keys, looked up among those already decided with one binary search, and the rest
are followed back through the merges that made them, all in step. Only words with an
incompatible pair are merged exactly.

The supported file is a word-level BPE with an end-of-word suffix: NFC, blanks to one
space, lower case, a split pattern whose matches are kept, bytes mapped to printable
characters. Special tokens in a text are found before that, as the tokenizers library
does. Decoding joins the tokens by a space, as the file names no decoder.

Null texts are empty texts; an empty text has no ids and decodes to "". Texts of any
length are encoded whole. Repeated rows and extra columns pass through unchanged.
"""

from __future__ import annotations

import gc
import heapq
import json
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..session import ship_package
from .common import blobs, col, free_name


def byte_alphabet() -> list[str]:
    """Printable character of each byte: itself if printable, else from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


class Vocabulary:
    """Tokens, merge ranks and text rules of a tokenizer file.

    Inside, a word is a string of one character per byte, the last raised by 256 to stand
    for the byte with the end-of-word suffix; tokens are kept in the same form.
    """

    def __init__(self, spec: dict):
        import ahocorasick
        import regex
        import tokenizers

        model = spec["model"]
        if model["type"] != "BPE" or not model.get("end_of_word_suffix") or spec.get("decoder"):
            raise ValueError("not a word-level BPE file with an end-of-word suffix")
        self.suffix = model["end_of_word_suffix"]
        self.byte = {c: chr(b) for b, c in enumerate(byte_alphabet())}
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for t, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = t
        self.ids = {inner: i for t, i in vocab.items() if (inner := self.inner(t)) is not None}
        self.ranks: dict[tuple[str, str], int] = {}
        for i, m in enumerate(model["merges"]):
            pair = tuple(self.inner(x) for x in (m.split(" ") if isinstance(m, str) else m))
            if None not in pair:
                self.ranks.setdefault(pair, i)
        self.never = len(self.ranks) + len(self.tokens)  # later than any merge
        splits = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.pattern = regex.compile(splits[0])
        self.finder = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) \
            if self.special else None
        # by token id: length, rank of its last merge (-1: none), the parts of that merge
        n = len(self.tokens)
        self.length, self.birth = np.zeros(n, np.int64), np.full(n, -1, np.int64)
        self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.automaton = ahocorasick.Automaton()
        for t, i in self.ids.items():
            last: list = []
            if self.merged(t, last) == [t]:  # else merging never makes this token
                self.automaton.add_word(t, i)
                self.length[i] = len(t)
                if last and all(x in self.ids for x in last[-1]):
                    self.birth[i] = self.ranks[last[-1]]
                    self.left[i], self.right[i] = (self.ids[x] for x in last[-1])
        self.automaton.make_automaton()
        known = sorted((self.ids[a] << 32 | self.ids[b], r) for (a, b), r in self.ranks.items()
                       if a in self.ids and b in self.ids)
        self.merge_keys = np.array([k for k, _ in known], dtype=np.int64)
        self.merge_ranks = np.array([r for _, r in known], dtype=np.int64)
        self.pair_keys = np.empty(0, np.int64)
        self.pair_good = np.empty(0, bool)
        self.words: dict = {}
        self.forget()
        rules = tokenizers.Tokenizer.from_str(json.dumps(spec | {"model": model | {"vocab": {}, "merges": []}}))
        self.normalizer = rules.normalizer
        self.splitter = tokenizers.pre_tokenizers.Split(tokenizers.Regex(splits[0]), "removed", invert=True)

    def inner(self, token: str) -> str | None:
        """A token of the file in the inner form, None if it isn't made of bytes."""
        ends = token.endswith(self.suffix) and len(token) > len(self.suffix)
        body = token[:-len(self.suffix)] if ends else token
        if not body or any(c not in self.byte for c in body):
            return None
        chars = [self.byte[c] for c in body]
        return "".join(chars[:-1]) + (chr(256 + ord(chars[-1])) if ends else chars[-1])

    def merged(self, word: str, last: list | None = None) -> list[str]:
        """Exact BPE: the best-ranked neighbours merge first, the leftmost of equals.

        ``last``, if given, gets the pairs that were merged.
        """
        if len(word) > 48:
            return self.merged_long(word)
        parts, never = list(word), self.never
        get = self.ranks.get
        found = [get(p, never) for p in zip(parts, parts[1:], strict=False)]
        while found:
            best = min(found)
            if best == never:
                break
            i = found.index(best)
            if last is not None:
                last.append((parts[i], parts[i + 1]))
            parts[i] = both = parts[i] + parts.pop(i + 1)
            del found[i]  # only the pairs next to the merge change
            if i:
                found[i - 1] = get((parts[i - 1], both), never)
            if i < len(found):
                found[i] = get((both, parts[i + 1]), never)
        return parts

    def merged_long(self, word: str) -> list[str]:
        """The same with a heap over a linked list, for words of any length."""
        parts = list(word)
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))
                if (r := self.ranks.get((a, b))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else n
            if j >= n or parts[i] != a or parts[j] != b:
                continue  # one of the two has merged elsewhere meanwhile
            parts[i], parts[j] = a + b, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for x, y in ((before[i], i), (i, k)):
                if x >= 0 and y < n and (r := self.ranks.get((parts[x], parts[y]))) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return [p for p in parts if p is not None]

    def compatible(self, keys: np.ndarray) -> np.ndarray:
        """Whether exact merging keeps the border between the two tokens of each key.

        Followed back in time from the finished tokens: at each moment one part stands
        on either side of the border, and the pair must not have a merge that comes
        before the merge that uses up either part (of equal ranks the left one is first).
        """
        x, y = keys >> 32, keys & 0xFFFFFFFF
        never = self.never
        end_x, end_y = np.full(len(keys), never), np.full(len(keys), never)
        good, todo = np.ones(len(keys), bool), np.arange(len(keys))
        while len(todo):
            pair = x << 32 | y
            at = np.minimum(np.searchsorted(self.merge_keys, pair), len(self.merge_keys) - 1)
            rank = np.where(self.merge_keys[at] == pair, self.merge_ranks[at], never)
            clash = (rank < end_x) & (rank <= end_y) & (rank < never)
            good[todo[clash]] = False
            bx, by = self.birth[x], self.birth[y]
            undo_x = bx > by
            go = ~clash & (np.maximum(bx, by) >= 0)
            end_x, end_y = np.where(undo_x, bx, end_x)[go], np.where(undo_x, end_y, by)[go]
            x, y = np.where(undo_x, self.right[x], x)[go], np.where(undo_x, y, self.left[y])[go]
            todo = todo[go]
        return good

    def verify(self, keys: np.ndarray) -> np.ndarray:
        """``compatible``, remembered per pair."""
        if not len(keys):
            return np.empty(0, bool)
        at = np.searchsorted(self.pair_keys, keys)
        if len(self.pair_keys):
            new = np.unique(keys[self.pair_keys[np.minimum(at, len(self.pair_keys) - 1)] != keys])
        else:
            new = np.unique(keys)
        if len(new):
            put = np.searchsorted(self.pair_keys, new)
            self.pair_good = np.insert(self.pair_good, put, self.compatible(new))
            self.pair_keys = np.insert(self.pair_keys, put, new)
            at = np.searchsorted(self.pair_keys, keys)
        return self.pair_good[at]

    def learn(self, words: list[str]) -> None:
        """Encode new words and remember them."""
        if not words:
            return
        plain = [w.encode().decode("latin-1") for w in words]
        inner = [w[:-1] + chr(256 + ord(w[-1])) for w in plain]
        size = np.array([len(w) for w in inner], dtype=np.int64)
        start = np.cumsum(size + 1) - size - 1
        # speculate: longest tokens from the left, over all words in one string
        hits = np.array(list(self.automaton.iter_long("\u0300".join(inner))), dtype=np.int64).reshape(-1, 2)
        ids = hits[:, 1]
        owner = np.searchsorted(start, hits[:, 0], side="right") - 1
        fits = np.bincount(owner, weights=self.length[ids], minlength=len(words)) == size
        # verify: every two neighbours of every word at once
        inside = owner[:-1] == owner[1:]
        good = self.verify((ids[:-1] << 32 | ids[1:])[inside])
        fits[owner[:-1][inside][~good]] = False
        first = np.searchsorted(owner, np.arange(len(words) + 1)).tolist()
        packed, listed = ids.astype("<u4").tobytes(), ids.tolist()
        for i, (w, ok) in enumerate(zip(words, fits.tolist(), strict=True)):
            if ok:
                a, b = first[i], first[i + 1]
                self.words[w] = (packed[4 * a:4 * b], " ".join([self.tokens[t] for t in listed[a:b]]))
            else:
                got = [t for p in self.merged(inner[i]) if (t := self.ids.get(p)) is not None]
                self.words[w] = (b"".join([t.to_bytes(4, "little") for t in got]),
                                 " ".join([self.tokens[t] for t in got]))

    def pieces(self, text: str) -> list[str]:
        """Words of a text without special tokens.

        Blanks are in no word, so they need not be replaced first. Beyond the scripts whose
        characters all Unicode versions agree on, the library's own rules find the words.
        """
        if not text.isascii() and max(text) >= "\u0530":
            return [w for w, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text))]
        text = unicodedata.normalize("NFC", text)
        if "\u03a3" in text:  # lower case is taken character by character, without word ends
            return self.pattern.findall("".join([c.lower() for c in text]))
        return self.pattern.findall(text.lower())

    def sections(self, text: str) -> list:
        """Words and, as ints, special tokens of a text in order."""
        if self.finder is None or not any(s in text for s in self.special):
            return self.pieces(text)
        out, at = [], 0
        for m in self.finder.finditer(text):
            out += self.pieces(text[at:m.start()])
            out.append(self.special[m.group()])
            at = m.end()
        return out + self.pieces(text[at:])

    def encode_batch(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """(ids as little-endian 32-bit integers, decoded text) of each text."""
        gc.disable()  # the many small tuples hold no cycles
        try:
            return self._encode_batch(texts)
        finally:
            gc.enable()

    def _encode_batch(self, texts: list[str]) -> list[tuple[bytes, str]]:
        out = []
        for at in range(0, len(texts), 256):
            if len(self.words) > 300_000:  # memory bound of what is remembered
                self.forget()
            get = self.words.get
            cut = [self.sections(t) for t in texts[at:at + 256]]
            got = [list(map(get, c)) for c in cut]
            open_ = [i for i, g in enumerate(got) if None in g]
            self.learn(list({w for i in open_ for w, g in zip(cut[i], got[i], strict=True) if g is None}))
            for i in open_:
                got[i] = list(map(get, cut[i]))
            for g in got:
                ids, names = zip(*g, strict=True) if g else ((), ())
                if b"" in ids:  # words of unknown characters only
                    names = [n for n in names if n]
                out.append((b"".join(ids), " ".join(names)))
        return out

    def forget(self) -> None:
        """Forget words, but not the special tokens (kept under their ids)."""
        self.words = {i: (i.to_bytes(4, "little"), t) for t, i in self.special.items()}

    def decode(self, ids) -> str:
        """Tokens joined by a space, special ones included."""
        return " ".join(self.tokens[i] for i in ids)


_LOADED: dict[str, Vocabulary] = {}


def loaded(name: str, spec) -> Vocabulary:
    """The vocabulary of this worker process, built by its first task."""
    if name not in _LOADED:
        _LOADED[name] = Vocabulary(spec.value)
    return _LOADED[name]


def encode(docs: DataFrame, vocabulary: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``token_ids`` (binary, little-endian 32-bit ids), ``n_tokens``
    (long) and ``decoded`` (string). Columns with these names are replaced.

    ``vocabulary`` is a file readable on the driver; it travels with the tasks.
    """
    spark = docs.sparkSession
    ship_package(spark)
    with open(vocabulary, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(json.load(f))  # a tokenizer file: a few MB, fixed size
    ours = ("token_ids", "n_tokens", "decoded")
    keep = [c for c in docs.columns if c.lower() not in ours]
    t = free_name(docs, "_text")
    df = docs.select(*[col(c) for c in keep], col(text_col).cast("string").cast("binary").alias(t))
    schema = T.StructType([*df.schema.fields[:-1], T.StructField("token_ids", T.BinaryType()),
                           T.StructField("n_tokens", T.LongType()), T.StructField("decoded", T.StringType())])

    def run(batches):
        v = loaded(vocabulary, spec)
        try:
            for whole in batches:
                for at in range(0, whole.num_rows, 1024):
                    b = whole.slice(at, 1024)
                    got = v.encode_batch([x.decode("utf-8", "replace") for x in blobs(b.column(b.num_columns - 1))])
                    cols = [*b.columns[:-1], pa.array([g[0] for g in got], pa.binary()),
                            pa.array([len(g[0]) // 4 for g in got], pa.int64()),
                            pa.array([g[1] for g in got], pa.string())]
                    yield pa.RecordBatch.from_arrays(cols, names=schema.names)
        finally:
            v.forget()  # the worker may go on with other steps and should not hold the words

    return df.mapInArrow(run, schema)
