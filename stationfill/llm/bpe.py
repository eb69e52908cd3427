"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

For every prefix of a piece of text there is exactly one last token of its encoding.
A suffix automaton over the vocabulary lists the tokens that end at a position; the one
that goes together with the last token of what stands before it is stored, and following
these back from the end gives the ids. Whether two tokens go together depends on the two
alone: undo their merges from the boundary outwards, latest first, and see whether a
merge across the boundary would have come earlier.

Equal to the tokenizers library for byte-level BPE files without normaliser, prefix space
or post-processor. Null is the empty text; the string of a special token is that token.
Nothing is shuffled; memory is bounded by one Arrow batch and the two caches.
"""

from __future__ import annotations

import gc
import hashlib
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, text_of, tokenizer_path

#: Unicode white space as the tokenizers library counts it.
_BLANK = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECES = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + _BLANK + r"\p{L}\p{N}]+|[" + _BLANK + r"]+(?![^" + _BLANK + r"])|[" + _BLANK + "]+"
)
#: Pieces, and words, kept per worker before the older half is forgotten.
CACHE = 100_000


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in vocabulary files."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in set(shown))
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Recent:
    """What was looked up lately; the older half is forgotten when the newer is full."""

    def __init__(self):
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def get(self, key: str):
        ids = self.recent.get(key)
        return self.older.get(key) if ids is None else ids

    def put(self, key: str, ids: bytes) -> None:
        self.recent[key] = ids
        self.forget()

    def forget(self) -> None:
        if len(self.recent) > CACHE:
            self.older, self.recent = self.recent, {}


class PrefixEncoder:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, letters = spec["model"], _byte_letters()
        byte_of = {c: b for b, c in letters.items()}
        ids = model["vocab"]
        raw = {t: bytes(byte_of[c] for c in t) for t in ids if all(c in byte_of for c in t)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.bytes_of = [b""] * size
        self.rank = [-1] * size
        self.left, self.right = [0] * size, [0] * size
        self.merge_rank: dict[int, int] = {}
        for token, data in raw.items():
            self.bytes_of[ids[token]] = data
        self._grow({data: ids[token] for token, data in raw.items() if token not in self.special})
        for content, i in self.special.items():
            self.bytes_of[i] = content.encode()
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            made = ids[a + b]
            self.merge_rank[ids[a] << 32 | ids[b]] = rank
            if self.rank[made] < 0:
                self.rank[made], self.left[made], self.right[made] = rank, ids[a], ids[b]
        self.pieces = regex.compile(PIECES).findall
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        self.blank = regex.compile(f"[{_BLANK}]").match
        self.blank_after = regex.compile(f" (?:[{_BLANK}]|$)").search
        self.known_pieces, self.known_words = _Recent(), _Recent()
        self.pairs: dict[int, bool] = {}
        self.size_of = [len(x) for x in self.bytes_of]
        self.sizes = np.array(self.size_of, np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)

    def _grow(self, tokens: dict[bytes, int]) -> None:
        """The suffix automaton: a state is the longest end of the text read that begins some token.

        ``ending`` has the tokens that end in a state, longest first. ``steps`` is filled as texts need it.
        """
        self.kids, self.back, self.ending = [{}], [0], [()]
        at_end = {}
        for data, token in tokens.items():
            state = 0
            for byte in data:
                known = self.kids[state].get(byte)
                if known is None:
                    known = self.kids[state][byte] = len(self.kids)
                    self.kids.append({})
                state = known
            at_end[state] = (token, len(data))
        n = len(self.kids)
        self.back, self.ending, self.steps = [0] * n, [()] * n, {}
        level = [0]
        while level:
            below = []
            for state in level:
                for byte, kid in self.kids[state].items():
                    self.back[kid] = self._advance(self.back[state] << 8 | byte) if state else 0
                    own = (at_end[kid],) if kid in at_end else ()
                    self.ending[kid] = own + self.ending[self.back[kid]]
                    below.append(kid)
            level = below

    def _advance(self, key: int) -> int:
        state, byte = key >> 8, key & 255
        while state and byte not in self.kids[state]:
            state = self.back[state]
        to = self.steps[key] = self.kids[state].get(byte, 0)
        return to

    def compatible(self, a: int, b: int) -> bool:
        """Whether a before b stays as it is, so no merge crosses their boundary."""
        key = a << 32 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > 2 * CACHE:
                self.pairs.clear()
            known = self.pairs[key] = self._compatible(a, b)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        rank, across = self.rank, self.merge_rank
        before = len(across)
        while True:
            if across.get(a << 32 | b, before) < before:
                return False
            if rank[a] > rank[b]:
                # Of equal merges the left one comes first, hence no + 1 here.
                before, a = rank[a], self.right[a]
            elif rank[b] >= 0:
                before, b = rank[b] + 1, self.left[b]
            else:
                return True

    def piece(self, text: str) -> bytes:
        """Ids of one piece: the last token of every prefix, then back-pointers from the end."""
        last, end, state = [-1], 0, 0
        pairs, steps, ending = self.pairs, self.steps, self.ending
        for byte in text.encode():
            end += 1
            key = state << 8 | byte
            state = steps.get(key, -1)
            if state < 0:
                state = self._advance(key)
            for token, n in ending[state]:
                if n == end:
                    break
                before = last[end - n]
                fits = pairs.get(before << 32 | token)
                if self.compatible(before, token) if fits is None else fits:
                    break
            last.append(token)
        ids, size = [], self.size_of
        while end:
            ids.append(last[end])
            end -= size[last[end]]
        ids.reverse()
        return array("I", ids).tobytes()

    def _stretch(self, text: str) -> bytes:
        """Ids of a text, piece by piece."""
        pieces, out = self.known_pieces, []
        # A space and letters, perhaps with a last stop or comma, is cut without the pattern.
        if text[1:-1].isalpha() and text[0] == " ":
            parts = (text,) if text[-1].isalpha() else (text[:-1], text[-1]) if text[-1] in ".,|" else self.pieces(text)
        else:
            parts = self.pieces(text)
        for part in parts:
            ids = pieces.get(part)
            if ids is None:
                ids = self.piece(part)
                pieces.put(part, ids)
            out.append(ids)
        return b"".join(out)

    def _plain(self, text: str) -> bytes:
        # A space before anything but white space always begins a piece, so texts are cut there
        # first and what stands between is looked up whole.
        first, *parts = text.split(" ")
        if " " in text and self.blank_after(text):
            first, parts = self._joined(first, parts)
        known = self.known_words
        recent = known.recent
        for part in set(parts).difference(recent):
            ids = known.older.get(part)
            recent[part] = self._stretch(" " + part) if ids is None else ids
        out = self._stretch(first) + b"".join(map(recent.__getitem__, parts))
        known.forget()
        return out

    def _joined(self, first: str, parts: list[str]) -> tuple[str, list[str]]:
        """Put spaces back that are followed by white space or by nothing."""
        whole = [[first]]
        for part in parts:
            if not part or self.blank(part):
                whole[-1].append(part)
            else:
                whole.append([part])
        first, *rest = (" ".join(x) for x in whole)
        return first, rest

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text, as little-endian 32-bit numbers."""
        if self.split is None or not any(s in text for s in self.special):
            return np.frombuffer(self._plain(text), "<u4")
        special = self.special
        ids = (np.uint32(special[x]).tobytes() if x in special else self._plain(x) for x in self.split(text))
        return np.frombuffer(b"".join(ids), "<u4")

    def decode(self, ids) -> str:
        """The text of ids: all their bytes gathered at once, invalid UTF-8 replaced."""
        ids = np.asarray(ids, "<u4")
        pieces = []
        for some in np.array_split(ids, max(1, len(ids) >> 18)):
            size = self.sizes[some]
            ends = np.cumsum(size)
            at = np.repeat(self.starts[some] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)
            pieces.append(self.flat[at].tobytes())
        return b"".join(pieces).decode("utf-8", errors="replace")


_ENCODERS: dict[str, PrefixEncoder] = {}


def encoder(path: str) -> PrefixEncoder:
    """One encoder per worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PrefixEncoder(path)
    return _ENCODERS[path]


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids (array of int) of every text."""
    path = path or tokenizer_path("byte_bpe_50k.json")
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            ids = [own.encode(t.as_py()).tolist() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"]
            )

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decoded(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; invalid UTF-8 becomes replacement characters."""
    path = path or tokenizer_path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            texts = [own.decode(x or ()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256.

    A row per input row, repeated ones included; a null text is empty, a null id stays null.
    Encoding and decoding go through the same encoder, text by text.
    """
    path = path or tokenizer_path("byte_bpe_50k.json")
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # the tables and caches hold no cycles, and walking them over and over takes long
        try:
            own = encoder(path)
            for batch in batches:
                yield coded(own, batch)
        finally:
            gc.enable()  # workers go on to other work

    def coded(own, batch: pa.RecordBatch) -> pa.RecordBatch:
        n, ids_digests, texts = [], [], []
        for text in batch.column("text"):
            ids = own.encode(text.as_py())
            n.append(len(ids))
            ids_digests.append(hashlib.sha256(ids.tobytes()).hexdigest())
            texts.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_digests, pa.string()), pa.array(texts, pa.string())],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
