"""BPE encoding and decoding: the last token of every prefix, then back-pointers.

For every prefix of a piece the byte-pair encoding has exactly one last token. An automaton
over the vocabulary lists all tokens that end at a position; the last token is the one that
is compatible with the last token of the prefix before it. Two tokens are compatible if
encoding their concatenation gives these two tokens, which undoing their merges decides
without encoding anything. The ids follow from the whole piece's last token backwards.

Cases: a null or empty text has no ids and decodes to the empty text. Strings of special
tokens in a text become their ids. Repeated rows give repeated results; other columns of
the input are ignored, whatever their names. A piece of any length takes linear time.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kerbside.llm.common import CACHE_ENTRIES, map_batches

#: Remembered answers about pairs of tokens, and the longest chunk worth remembering.
PAIR_ENTRIES, LONGEST_KEPT = 2_000_000, 48

#: Later than any merge.
NEVER = 1 << 40


class PrefixBpe:
    """Encoder and decoder of a tokenizer file; same results as the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        tokenizer = Tokenizer.from_file(path)
        self._normalizer, self._pre_tokenizer = tokenizer.normalizer, tokenizer.pre_tokenizer
        self._suffix = model.get("end_of_word_suffix") or ""
        vocabulary = model["vocab"]
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        made = {a + b for a, b in merges}
        order = [t for t in vocabulary if t not in made] + list(dict.fromkeys(a + b for a, b in merges))
        #: Tokens are numbered by the merge that makes them, symbols first.
        number = {t: k for k, t in enumerate(order)}
        self._ids = [vocabulary[t] for t in order]
        self._left, self._right = list(range(len(order))), list(range(len(order)))
        self._pairs: dict[int, int] = {}
        for a, b in merges:
            k = number[a + b]
            if (pair := number[a] << 20 | number[b]) not in self._pairs:
                self._pairs[pair] = k
                self._left[k], self._right[k] = number[a], number[b]
        self._strings = {v: k for k, v in vocabulary.items()}
        self._special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self._strings |= {v: k for k, v in self._special.items()}
        self._cut = re.compile("(" + "|".join(map(re.escape, self._special)) + ")") if self._special else None
        self._byte_level = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        self._bytes = {c: b for b, c in _byte_letters().items()}
        self._compatible: dict[int, bool] = {}
        self._chunks: dict[str, bytes] = {}
        self._pieces: dict[str, bytes] = {}
        self._letters = _byte_letters()
        self._latin = self._latin_pattern(spec) if self._suffix else None
        self._automaton = self._suffix_automaton(order)

    def _symbols(self, token: str) -> str:
        """One character per symbol: the last one of a word, if marked, gets its own."""
        if self._suffix and token.endswith(self._suffix):
            return token[:-len(self._suffix) - 1] + self._last(token[-len(self._suffix) - 1])
        return token

    @staticmethod
    def _last(c: str) -> str:
        return chr(ord(c) + 0xF0000)

    def _suffix_automaton(self, order: list[str]) -> ahocorasick.Automaton:
        """Matches of all tokens that can come out of an encoding: those that encode to themselves."""
        automaton, stable = ahocorasick.Automaton(), [False] * len(order)
        for k, t in enumerate(order):
            a, b = self._left[k], self._right[k]
            stable[k] = a == k or stable[a] and stable[b] and self._undo(a, b, k)
            if stable[k]:
                s = self._symbols(t)
                automaton.add_word(s, (k, len(s)))
        automaton.make_automaton()
        return automaton

    def _undo(self, a: int, b: int, limit: int) -> bool:
        """Undo merges on both sides of the border, latest first. False if, in a state so
        reached, a merge across the border would have come before the next undone one.
        ``limit`` is the merge that is to join the two, or beyond all if they stay apart."""
        pairs, left, right = self._pairs, self._left, self._right
        while True:
            k = pairs.get(a << 20 | b)
            if k is not None and k < limit:
                return False
            if a > b:
                limit, a = a, right[a]
                if a == limit:
                    limit, b = b + 1, left[b]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, left[b]
                if b + 1 == limit:
                    limit, a = a, right[a]
                    if a == limit:
                        return True

    def _piece(self, piece: str) -> list[int]:
        """Ids of one piece in the byte letters of the vocabulary."""
        symbols = piece[:-1] + self._last(piece[-1]) if self._suffix else piece
        known, undo = self._compatible, self._undo
        last, lengths, solved = [0] * len(symbols), [0] * len(symbols), -1
        for end, (token, length) in self._automaton.iter(symbols):
            if end == solved:
                continue
            before = end - length
            if before >= 0:
                key = last[before] << 20 | token
                fits = known.get(key)
                if fits is None:
                    if len(known) >= PAIR_ENTRIES:
                        known.clear()
                    fits = known[key] = undo(last[before], token, NEVER)
                if not fits:
                    continue
            last[end], lengths[end], solved = token, length, end
        out, at = [], len(symbols) - 1
        while at >= 0:
            out.append(self._ids[last[at]])
            at -= lengths[at]
        return out[::-1]

    @staticmethod
    def _latin_pattern(spec: dict) -> regex.Pattern | None:
        """The pattern of pieces, if normalizing Latin letters is no more than lowering them."""
        steps = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
        if steps == ["NFC", "Replace", "Lowercase"] and split.get("behavior") == "Removed" and split.get("invert"):
            return regex.compile(split["pattern"]["Regex"])
        return None

    def _split(self, text: str) -> list[str]:
        """Pieces in byte letters. Up to U+024F letters are normal and white space is plain."""
        if self._latin is not None and text.isascii() and text.isprintable():
            return self._latin.findall(text.lower())
        if self._latin is not None and max(text) < "\u0250" and text.isprintable():
            letters = self._letters
            return ["".join([letters[b] for b in p.encode()]) for p in self._latin.findall(text.lower())]
        if self._normalizer is not None:
            text = self._normalizer.normalize_str(text)
        return [p for p, _ in self._pre_tokenizer.pre_tokenize_str(text)] if text else []

    def _piece_bytes(self, piece: str) -> bytes:
        ids = np.array(self._piece(piece), "<u4").tobytes()
        if len(piece) <= LONGEST_KEPT:
            if len(self._pieces) >= CACHE_ENTRIES:
                self._pieces.clear()
            self._pieces[piece] = ids
        return ids

    def _plain(self, text: str) -> bytes:
        """Ids of a text without special tokens."""
        get, new = self._pieces.get, self._piece_bytes
        return b"".join([b if (b := get(p)) is not None else new(p) for p in self._split(text)])

    def _chunk(self, chunk: str) -> bytes:
        ids = self._plain(chunk)
        if len(chunk) <= LONGEST_KEPT:
            if len(self._chunks) >= CACHE_ENTRIES:
                self._chunks.clear()
            self._chunks[chunk] = ids
        return ids

    def _segment(self, text: str) -> bytes:
        """Where pieces hold no white space, texts are cut at it and chunks remembered."""
        if not self._suffix:
            return self._plain(text)
        get, new = self._chunks.get, self._chunk
        return b"".join([b if (b := get(c)) is not None else new(c) for c in text.replace("\n", " ").split(" ") if c])

    def encode_bytes(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self._cut is None or not any(s in text for s in self._special):
            return self._segment(text)
        return b"".join(
            self._special[part].to_bytes(4, "little") if part in self._special else self._segment(part)
            for part in self._cut.split(text) if part)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of ids; tokens stand apart where the tokenizer names no decoder."""
        tokens = [t for i in ids if (t := self._strings.get(i)) is not None]
        if not self._byte_level:
            return " ".join(tokens)
        out = bytearray()
        for t in tokens:
            try:
                out += bytes([self._bytes[c] for c in t])
            except KeyError:
                out += t.encode()
        return out.decode("utf-8", "replace")


def _byte_letters() -> dict[int, str]:
    """The published letters for bytes: printable ones stand for themselves."""
    own = [b for lo, hi in ((33, 126), (161, 172), (174, 255)) for b in range(lo, hi + 1)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


@lru_cache(maxsize=4)
def bpe(path: str) -> PrefixBpe:
    """The encoder of a file, once per worker."""
    return PrefixBpe(path)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, ids``: the token ids of every whole text."""
    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = bpe(path)
        ids = [coder.encode(t) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    source = _texts(docs, id_col, text_col)
    return map_batches(source, encode, f"id {source.schema['id'].dataType.simpleString()}, ids array<int>") \
        .withColumnRenamed("id", id_col)


def decode_documents(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id, text``: the text of every list of ids; a null list gives the empty text."""
    def decode(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = bpe(path)
        texts = [coder.decode(i or []) for i in batch.column("ids").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], ["id", "text"])

    source = tokens.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return map_batches(source, decode, f"id {source.schema['id'].dataType.simpleString()}, text string") \
        .withColumnRenamed("id", id_col)


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every document's text."""
    def digest(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = bpe(path)
        counts, ids_sha, text_sha = [], [], []
        for text in batch.column("text").to_pylist():
            ids = coder.encode_bytes(text)
            decoded = coder.decode(np.frombuffer(ids, "<u4").tolist())
            counts.append(len(ids) // 4)
            ids_sha.append(hashlib.sha256(ids).hexdigest())
            text_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
        return pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(text_sha)],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(
        _texts(docs, "doc_id", "text"), digest,
        "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
