"""Byte-level BPE encoding by backtracking, and decoding by an offset table.

The encoder finds, for each position of a pre-token, the longest vocabulary entries with an Aho-Corasick automaton
and walks forward; two neighbouring tokens may stand only if merging could have left them so (the pair-compatibility
check). Where they may not, it takes the next shorter token or steps back. Each position is given up at most once, so
the time is linear in the text; the result is the one the merge rules give. Words that a worker meets
again are encoded once, as far as a bounded store holds them. Decoding gathers every token's bytes from one array through a table of offsets.

Defined cases: a null or empty text has no tokens and decodes to an empty text; texts of any length are taken whole;
repeated rows each get their result; an empty table gives an empty table; other columns of the input are not read.
Strings of added tokens in a text become those tokens, as the public tokenizers do.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .bytetext import release
from .scratch import read_table

#: The pre-token pattern of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words whose ids a worker keeps, for each of two generations; the rest are encoded when met.
KEPT = 150_000
#: Longer words aren't kept.
KEPT_CHARS = 40


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a vocabulary file, to that byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """A tokenizer file's tokens as bytes, its merges by rank, and the tables made of them."""

    def __init__(self, content: str):
        spec = json.loads(content)
        letters = byte_letters()
        to_bytes = lambda t: bytes(letters[c] for c in t)
        vocab = spec["model"]["vocab"]
        self.ids = {to_bytes(t): i for t, i in vocab.items()}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*self.ids.values(), *self.added.values()], default=-1) + 1
        self.tokens: list[bytes] = [b""] * size
        for t, i in self.ids.items():
            self.tokens[i] = t
        for t, i in self.added.items():
            self.tokens[i] = t.encode()
        #: By pair of ids: rank of the merge; by id: the pair it is made of, and the rank of its making.
        self.merges: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.made: list[int] = [-1] * size
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            a, b = to_bytes(a), to_bytes(b)
            left, right, whole = self.ids[a], self.ids[b], self.ids[a + b]
            if (left, right) not in self.merges:
                self.merges[left, right] = rank
            if whole not in self.parts:
                self.parts[whole] = (left, right)
                self.made[whole] = rank
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in self.tokens])])
        self.data = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.little = [int(i).to_bytes(4, "little") for i in range(size)]
        self._fits: dict[tuple[int, int], bool] = {}
        self._wholes: dict[int, bool] = {}
        self._automaton = None
        self._shorter: dict[int, int] = {}

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for t, i in self.ids.items():
                self._automaton.add_word(t.decode("latin-1"), (len(t), i))
            self._automaton.make_automaton()
        return self._automaton

    def shorter(self, token: int) -> int:
        """The longest other token that begins this one, or -1."""
        found = self._shorter.get(token)
        if found is None:
            t = self.tokens[token]
            found = next((self.ids[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in self.ids), -1)
            self._shorter[token] = found
        return found

    def fits(self, a: int, b: int) -> bool:
        """Whether merging can leave a and b side by side: undoing both, latest merge first, meets no pair at the
        seam that would have been merged before the merge just undone."""
        found = self._fits.get((a, b))
        if found is None:
            if len(self._fits) > 200_000:
                self._fits.clear()
            found = self._fits[a, b] = self._check(a, b)
        return found

    def _check(self, a: int, b: int, limit: int | None = None) -> bool:
        made, merges, parts = self.made, self.merges, self.parts
        before = (len(merges) + 1 if limit is None else limit, 0)
        while True:
            rank = merges.get((a, b))
            if rank is not None and (rank, 1) < before:
                return False
            ra, rb = made[a], made[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                # of one rank, merges go from left to right: a's merge comes before the pair at the seam, b's after it
                before, a = (ra, 1), parts[a][1]
            else:
                before, b = (rb, 2), parts[b][0]

    def encode_piece(self, piece: bytes) -> bytes:
        """Token ids of one pre-token, four bytes each."""
        whole = self.ids.get(piece)
        if whole is not None and (whole not in self.parts or self._whole(whole)):
            return self.little[whole]
        longest: dict[int, tuple[int, int]] = {}
        for end, (size, token) in self.automaton().iter(piece.decode("latin-1")):
            at = end - size + 1
            if at not in longest or longest[at][0] < size:
                longest[at] = (size, token)
        n, pos, out, given_up = len(piece), 0, [], bytearray(len(piece) + 1)
        token = longest[0][1]
        while True:
            end = pos + len(self.tokens[token])
            if not given_up[end] and (not out or self.fits(out[-1], token)):
                out.append(token)
                pos = end
                if pos == n:
                    break
                token = longest[pos][1]
                continue
            token = self.shorter(token)
            while token < 0:
                given_up[pos] = 1
                last = out.pop()
                pos -= len(self.tokens[last])
                token = self.shorter(last)
        return b"".join([self.little[t] for t in out])

    def _whole(self, token: int) -> bool:
        """Whether merging a token's own bytes gives that token: its two parts come about and stand side by side
        until its own merge."""
        found = self._wholes.get(token)
        if found is None:
            a, b = self.parts[token]
            limit = self.made[token]
            found = max(self.made[a], self.made[b]) < limit and all(x not in self.parts or self._whole(x) for x in (a, b))
            found = self._wholes[token] = found and self._check(a, b, limit)
        return found

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the tokens, each copied from the table by its offset."""
        if not len(ids):
            return b""
        begins, sizes = self.offsets[ids], np.diff(self.offsets)[ids]
        ends = np.cumsum(sizes)
        return self.data[np.arange(ends[-1]) + np.repeat(begins - (ends - sizes), sizes)].tobytes()


class Ids(dict):
    """Ids by word, made when first met. Two generations of ``KEPT`` words at most are kept: when the younger is full
    it becomes the older, and words that are met again come back from there."""

    def __init__(self, make):
        super().__init__()
        self.make = make
        self.old: dict = {}

    def __missing__(self, word: str):
        found = self.old.get(word, 0)
        if found == 0:
            found = self.make(word)
        if len(word) <= KEPT_CHARS:
            if len(self) >= KEPT:
                self.old = dict(self)
                self.clear()
            self[word] = found
        return found


_loaded: dict = {}


class Coder:
    """A vocabulary with its patterns, and ids of words between single spaces.

    A space between two other characters begins a pre-token, and a line feed between two is one, so words can be
    encoded one by one. A word of no characters, or with white space at an end, may not; None stands for it, and the
    text is then taken by the pattern as a whole.
    """

    def __init__(self, content: bytes):
        import re

        import regex

        self.vocabulary = v = Vocabulary(content.decode())
        self.pieces = regex.compile(PATTERN).findall
        self.added = re.compile("(" + "|".join(re.escape(t) for t in sorted(v.added, key=len, reverse=True)) + ")") if v.added else None
        self.first = Ids(lambda word: self.word(word, word))
        self.later = Ids(lambda word: self.word(word, " " + word))
        self.feed = self.whole("\n")

    def forget(self) -> None:
        """Drops the kept words at a task's end, since the worker is used again by other stages."""
        for kept in (self.first, self.later):
            kept.clear()
            kept.old = {}
        release()

    def word(self, word: str, text: str) -> bytes | None:
        return None if not word or word[0].isspace() or word[-1].isspace() else self.whole(text)

    def whole(self, text: str) -> bytes:
        encode = self.vocabulary.encode_piece
        return b"".join([encode(p.encode()) for p in self.pieces(text)])

    def plain(self, text: str) -> bytes:
        out: list = []
        first, later = self.first, self.later.__getitem__
        for line in text.split("\n"):
            words = line.split(" ")
            out.append(self.feed)
            out.append(first[words[0]])
            del words[0]
            out.extend(map(later, words))
        try:
            return b"".join(out[1:])
        except TypeError:
            return self.whole(text)

    def encode(self, text: str) -> bytes:
        """Token ids of a text, four bytes each, little-endian."""
        if not text:
            return b""
        if self.added is None or not self.added.search(text):
            return self.plain(text)
        v = self.vocabulary
        return b"".join(v.little[v.added[part]] if part in v.added else self.encode(part) for part in self.added.split(text))


def coder(content: bytes) -> Coder:
    """Made once for each worker process."""
    key = hashlib.sha256(content).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Coder(content)
    return _loaded[key]


def encode(text: str, content: bytes) -> bytes:
    return coder(content).encode(text)


def bpe_encode(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True, decode: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns: the id, the ``keep`` columns, ``n_tokens``, ``ids`` (binary, four bytes each), ``decoded``; the last two where asked for.

    The tokenizer file is read by the driver (about 1.5 MB) and goes to the workers with the function.
    """
    with open(tokenizer_path, "rb") as f:
        content = f.read()
    own = [f"_{i}" for i in range(len(keep))]
    kept = df.select(df[id_col].alias("id"), df[text_col].alias("text"), *[df[c].alias(f"_{i}") for i, c in enumerate(keep)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(content)
        v = c.vocabulary
        try:
            for batch in batches:
                texts = batch.column(1)
                for at in range(0, len(texts), 64):
                    got = [c.encode(t or "") for t in texts.slice(at, 64).to_pylist()]
                    columns = {name: batch.column(name).slice(at, 64) for name in ("id", *own)} | {"n_tokens": pa.array([len(x) // 4 for x in got], pa.int64())}
                    if ids:
                        columns["ids"] = pa.array(got, pa.binary())
                    if decode:
                        columns["decoded"] = pa.array([v.decode(np.frombuffer(x, "<u4")).decode("utf-8", "replace") for x in got], pa.string())
                    yield pa.RecordBatch.from_pydict(columns)
        finally:
            c.forget()

    kinds = dict(kept.dtypes)
    schema = ", ".join(f"{name} {kinds[name]}" for name in ("id", *own)) + ", n_tokens long" + ", ids binary" * ids + ", decoded string" * decode
    return kept.mapInArrow(run, schema).withColumnsRenamed({"id": id_col} | dict(zip(own, keep, strict=True)))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_bpe_backtrack(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    from pyspark.sql import functions as F

    docs = read_table(spark, sf_dir, "documents")
    out = bpe_encode(docs, tokenizer_path or default_tokenizer())
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
