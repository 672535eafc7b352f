"""BPE encoding by dynamic programming over prefixes, and decoding.

The vocabulary is that of a tokenizer file with word ends (``</w>`` on a word's last token). A word is a string over
byte symbols, its last symbol being one of its own kind, so that every token is a plain string. For each prefix there
is exactly one token that can be the last in the prefix's encoding: one that ends there, and that the last token of
the prefix before it accepts as a neighbour. An automaton over the vocabulary with suffix links gives all tokens that
end at a position; the test for neighbours asks whether any merge across the seam would have come first. The ids are
read off the back-pointers.
"""

import hashlib
import json
import struct
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

#: White space as Unicode has it; Python's own split also takes the four separators U+001C to U+001F.
SPACE = regex.compile(r"\p{White_Space}+")
#: Cached words and pairs of one worker; a full cache starts anew.
CACHE = 400_000
NEVER = 1 << 62


class WordBpe:
    """Encoder and decoder for one tokenizer file: NFC, lower case, words by the file's own pattern, byte symbols."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        model, steps = data["model"], data["pre_tokenizer"]["pretokenizers"]
        self.piece = regex.compile(steps[0]["pattern"]["Regex"])
        self.end = model["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        self.added = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None
        self.text_of = {i: t for t, i in vocab.items()} | {i: t for t, i in self.added.items()}
        self.symbols = self._byte_symbols()
        self.last = {c: chr(0x10000 + ord(c)) for c in self.symbols}

        # Merges by rank give every token its parts and its time of birth.
        self.rank: dict[tuple[int, int], int] = {}
        self.born, self.parts = dict.fromkeys(vocab.values(), -1), {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            left, right = vocab[a], vocab[b]
            made = vocab[a + b]
            self.rank[left, right] = rank
            self.born[made], self.parts[made] = rank, (left, right)
        self.automaton = ahocorasick.Automaton()
        for token, i in vocab.items():
            if token in self.added:
                continue
            word = token.removesuffix(self.end)
            key = word[:-1] + self.last[word[-1]] if word != token and word else token
            self.automaton.add_word(key, (len(key), i))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.seams: dict[tuple[int, bool], list[tuple[int, int]]] = {}
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.decoded = np.array([self.text_of.get(i, "").encode() for i in range(max(self.text_of) + 1)], object)

    @staticmethod
    def _byte_symbols() -> list[str]:
        """The printable character that stands for each byte: itself where it prints, else the next from 256 on."""
        plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        spare = iter(range(256, 512))
        return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]

    def _edge(self, token: int, right: bool) -> list[tuple[int, int]]:
        """The tokens that stand at one edge of ``token`` while it is being merged, each with the rank that ends it."""
        key = (token, right)
        if key not in self.seams:
            found, ends, now = [], NEVER, token
            while True:
                found.append((now, ends))
                if now not in self.parts:
                    break
                ends, now = self.born[now], self.parts[now][right]
            self.seams[key] = found
        return self.seams[key]

    def neighbours(self, a: int, b: int) -> bool:
        """Whether the symbols of ``a`` and ``b`` in a row encode as these two tokens."""
        rank = self.rank
        # Equal ranks merge from left to right: one that ends the left part comes first, one on the right does not.
        known = not any(
            (r := rank.get((x, y))) is not None and r < x_ends and r <= y_ends
            for x, x_ends in self._edge(a, True)
            for y, y_ends in self._edge(b, False)
        )
        if len(self.pairs) >= 4 * CACHE:
            self.pairs.clear()
        self.pairs[a << 20 | b] = known
        return known

    def _word(self, word: str) -> bytes:
        """The packed ids of one word of the pattern."""
        symbols = word if word.isascii() and word.isprintable() else "".join([self.symbols[b] for b in word.encode()])
        symbols = symbols[:-1] + self.last[symbols[-1]]
        pairs, size = self.pairs, len(symbols)
        before, token = [0] * (size + 1), [-1] * (size + 1)
        for at, (length, i) in self.automaton.iter(symbols):
            at += 1
            if token[at] < 0:
                if length == at:
                    token[at] = i
                else:
                    a = token[at - length]
                    if a >= 0:
                        ok = pairs.get(a << 20 | i)
                        if self.neighbours(a, i) if ok is None else ok:
                            token[at], before[at] = i, at - length
        ids = []
        while size:
            ids.append(token[size])
            size = before[size]
        packed = struct.pack(f"<{len(ids)}I", *ids[::-1])
        if len(self.words) >= CACHE:
            self.words.clear()
        self.words[word] = packed
        return packed

    def _spaced(self, chunk: str) -> bytes:
        """The packed ids of what stands between two white spaces."""
        words = self.words
        if chunk.isalpha():
            return words.get(chunk) or self._word(chunk)
        packed = b"".join([words.get(w) or self._word(w) for w in self.piece.findall(chunk)])
        if len(self.chunks) >= CACHE:
            self.chunks.clear()
        self.chunks[chunk] = packed
        return packed

    def _plain(self, text: str) -> bytes:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # the library lowers by the letter
        text = text.lower()
        odd = any(c in text for c in "\x1c\x1d\x1e\x1f")
        words, chunks = self.words, self.chunks
        return b"".join([words.get(w) or chunks.get(w) or self._spaced(w) for w in (SPACE.split(text) if odd else text.split()) if w])

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not self.special or "<|" not in text:
            return self._plain(text)
        parts = self.special.split(text)
        return b"".join(self.added[p].to_bytes(4, "little") if p in self.added else self._plain(p) for p in parts)

    def decode(self, packed: bytes) -> bytes:
        """UTF-8 of the tokens' strings with spaces between: the file names no decoder."""
        return b" ".join(self.decoded[np.frombuffer(packed, "<u4")].tolist())


_LOADED: dict[str, WordBpe] = {}


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of every row, with ``ids`` (packed) and ``decoded`` on request.

    ``path`` is read by the driver alone and goes to the workers with the task. A null or empty text has no tokens.
    Special tokens written out in a text become their ids. Rows that repeat are each returned; other columns are not
    read. No rows: an empty result.
    """
    spec = Tokenizer.from_file(path).to_str()
    mark = hashlib.sha256(spec.encode()).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if mark not in _LOADED:
            _LOADED[mark] = WordBpe(shared.value)
        bpe = _LOADED[mark]
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for text in batch.column(1):
                packed = bpe.encode(text.as_py() or "")
                decoded = bpe.decode(packed)
                row = (len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded).hexdigest(), packed, decoded.decode())
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            arrays = [batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                arrays += [pa.array(out[3], pa.binary()), pa.array(out[4], pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * with_ids
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, schema)
