"""Byte-level BPE by dynamic programming over prefixes.

Every prefix of a word has one BPE encoding, so it has one last token. That token is a suffix of the prefix (an
Aho-Corasick automaton over the vocabulary lists the candidates) and it is compatible with the last token of what
precedes it: BPE of the two tokens' bytes is these two tokens. Storing the last token of every prefix and following the
back-pointers from the end gives the ids that merging pair by pair would give, in time linear in the word.

Words are cut out as the byte-level pre-tokenizer does. Words met before in a task come from a cache of bounded size.

Defined cases: a null text is an empty one and has no ids; strings of special tokens inside a text become their ids;
ids outside the vocabulary decode to nothing; repeated rows are encoded each for itself; other columns are kept.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from contextlib import contextmanager
from hashlib import sha256

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Fixed value: the published pre-tokenizer pattern of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE = 200_000
OUTPUT_BYTES = 1 << 23
#: Two token ids make one number: the left one above these bits.
PAIR_BITS = 32


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes: themselves where visible, else the characters from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


def pack(ids: list[int]) -> bytes:
    return array("i", ids).tobytes()


class Cache(dict):
    """A dict that computes what it lacks; when full it begins anew and takes over what it still meets."""

    def __init__(self, compute):
        super().__init__()
        self.compute, self.old = compute, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Tokenizer:
    """Encoder and decoder of one vocabulary file (its JSON text)."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model, cut = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or spec["normalizer"] or cut != cut | {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}:
            raise ValueError("only plain byte-level BPE vocabularies are supported")
        to_byte = byte_alphabet()
        ids = {"".join(chr(to_byte[c]) for c in s): i for s, i in model["vocab"].items()}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*ids.values(), *special.values()]) + 1
        self.bytes = [b""] * size
        for s, i in ids.items():
            self.bytes[i] = s.encode("latin-1")
        for s, i in special.items():
            self.bytes[i] = s.encode("utf-8")
        self.rank, self.parts, self.merged = [-1] * size, [None] * size, {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            left, right = ("".join(chr(to_byte[c]) for c in s) for s in (left, right))
            pair = ids[left], ids[right]
            whole = ids[left + right]
            self.merged.setdefault(pair, rank)
            if self.parts[whole] is None:
                self.parts[whole], self.rank[whole] = pair, rank
        self.special = special
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.suffixes = ahocorasick.Automaton()
        for s, i in ids.items():
            if self.parts[i] is None or self.untouched(*self.parts[i], self.rank[i]):
                self.suffixes.add_word(s, (i, len(s)))
        self.suffixes.make_automaton()
        self.pairs = Cache(lambda pair: self.untouched(pair >> PAIR_BITS, pair & (1 << PAIR_BITS) - 1, len(model["merges"])))
        self.words = Cache(lambda word: self.chunks[word[1:]] if word[0] == " " and word[1:].isalpha() else self.encode_word(word))
        self.chunks = Cache(self.encode_chunk)
        self.pattern = regex.compile(PATTERN)
        self.loose = regex.compile(r"\s \s|\s \Z")
        self.lengths = np.array([len(b) for b in self.bytes], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.flat = np.frombuffer(b"".join(self.bytes), dtype=np.uint8)
        self.decimal = [b"%d" % i for i in range(size)]

    def untouched(self, left: int, right: int, limit: int) -> bool:
        """No merge of a rank under ``limit`` joins the two tokens while their bytes are merged up to them.

        The tokens at the boundary are taken apart in reverse order of their making; equal merges go from left to right.
        """
        rank, parts, merged = self.rank, self.parts, self.merged
        first = merged.get((left, right))
        if first is not None and first < limit:
            return False
        while True:
            if rank[left] > rank[right]:
                limit = rank[left]
                left = parts[left][1]
                crossing = merged.get((left, right))
                if crossing is not None and crossing < limit:
                    return False
            elif parts[right] is None:
                return True
            else:
                limit = rank[right]
                right = parts[right][0]
                crossing = merged.get((left, right))
                if crossing is not None and crossing <= limit:
                    return False

    def encode_word(self, word: str) -> bytes:
        """Packed ids of one pre-tokenized word."""
        s = word if word.isascii() else word.encode("utf-8").decode("latin-1")
        size = len(s)
        last, back = [-1] * size, [-1] * size  # by the prefix's last byte; a back-pointer of -1 is the word's start
        pairs = self.pairs
        for end, (token, length) in self.suffixes.iter(s):
            if last[end] < 0:
                before = end - length
                if before < 0 or last[before] >= 0 and pairs[last[before] << PAIR_BITS | token]:
                    last[end], back[end] = token, before
        out, end = [], size - 1
        while end >= 0:
            out.append(last[end])
            end = back[end]
        out.reverse()
        return pack(out)

    def encode_chunk(self, chunk: str) -> bytes:
        """Packed ids of what stands between two spaces, with the space before it; letters alone are one word."""
        return self.encode_word(" " + chunk) if chunk.isalpha() else self.encode_words(" " + chunk)

    def encode_words(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.pattern.findall(text)))

    def encode_plain(self, text: str) -> bytes:
        # a space after a non-space starts a word, so a text can be cut there; odd runs of white space go in one piece
        if self.loose.search(text):
            return self.encode_words(text)
        head, *rest = text.split(" ")
        return self.encode_words(head) + b"".join(map(self.chunks.__getitem__, rest))

    def encode(self, text: str) -> np.ndarray:
        if self.special_pattern is None or not any(s in text for s in self.special):
            packed = self.encode_plain(text)
        else:
            pieces = self.special_pattern.split(text)
            packed = b"".join(
                pack([self.special[p]]) if i % 2 else self.encode_plain(p) for i, p in enumerate(pieces) if p
            )
        return np.frombuffer(packed, dtype="<i4")

    def decode(self, ids: np.ndarray) -> str:
        ids = ids[(ids >= 0) & (ids < len(self.bytes))]
        lengths = self.lengths[ids]
        shift = self.starts[ids] - np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(ids) else lengths
        return self.flat[np.repeat(shift, lengths) + np.arange(lengths.sum())].tobytes().decode("utf-8", errors="replace")


_KEPT: dict[int, Tokenizer] = {}


@contextmanager
def tokenizer_of(text: str, keep: bool = True) -> Iterator[Tokenizer]:
    """The tokenizer of a vocabulary for one task.

    Python workers outlive their tasks. ``keep`` leaves tokenizer and caches to the worker's next task, which saves about a
    fifth of the time; without it they go at the task's end and leave their memory to other stages.
    """
    key = hash(text)
    tokenizer = _KEPT.get(key) or Tokenizer(text)
    _KEPT.clear()
    if keep:
        _KEPT[key] = tokenizer
    try:
        yield tokenizer
    finally:
        if not keep:
            vars(tokenizer).clear()


def read_vocabulary(path: str) -> str:
    """Text of a vocabulary file; a few MB whatever the corpus, so it is broadcast."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def _mapped(df: DataFrame, added: T.StructField, vocabulary: str, source: str, convert) -> DataFrame:
    """``df`` with a column made from column ``source``; batches are passed on in slices of bounded size."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)
    schema = T.StructType([*[f for f in df.schema.fields if f.name != added.name], added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tokenizer_of(shared.value) as tokenizer:
            for batch in batches:
                kept = batch.drop_columns([added.name]) if added.name in batch.schema.names else batch
                column, start, size, made = batch.column(source), 0, 0, []
                for row in range(batch.num_rows):
                    made.append(convert(tokenizer, column[row]))
                    size += 4 * len(made[-1])
                    if size >= OUTPUT_BYTES or row + 1 == batch.num_rows:
                        part = kept.slice(start, row + 1 - start)
                        yield pa.RecordBatch.from_arrays([*part.columns, _array(made)], names=[*part.schema.names, added.name])
                        start, size, made = row + 1, 0, []

    return df.mapInArrow(run, schema)


def _array(made: list) -> pa.Array:
    if isinstance(made[0], str):
        return pa.array(made, pa.string())
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in made])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(made), pa.int32()))


def encode(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with the token ids of column ``text``."""
    return _mapped(
        df, T.StructField(ids, T.ArrayType(T.IntegerType(), False)), vocabulary, text,
        lambda t, v: t.encode(v.as_py() or ""),
    )


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with the text of column ``ids``; null ids give an empty text."""
    return _mapped(
        df, T.StructField(decoded, T.StringType()), vocabulary, ids,
        lambda t, v: t.decode(v.values.to_numpy() if v.is_valid else np.zeros(0, dtype=np.int32)),
    )


def token_digests(docs: DataFrame, vocabulary: str, keep: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document.

    Encoding, decoding and hashing share one pass over a text, so neither ids nor decoded texts leave the task.
    ``keep``: see ``tokenizer_of``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    rows = docs.select("doc_id", "text")
    schema = T.StructType([
        rows.schema["doc_id"], T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tokenizer_of(shared.value, keep) as tokenizer:
            for batch in batches:
                made = [digests(tokenizer, text.as_py() or "") for text in batch.column("text")]
                counts, ids, decoded = zip(*made) if made else ((), (), ())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                    names=schema.names,
                )

    return rows.mapInArrow(run, schema)


def digests(tokenizer: Tokenizer, text: str) -> tuple[int, str, str]:
    """Number of ids, digest of the ids joined by commas, digest of the text they decode to."""
    ids = tokenizer.encode(text)
    joined = b",".join(map(tokenizer.decimal.__getitem__, ids.tolist()))
    return len(ids), sha256(joined).hexdigest(), sha256(tokenizer.decode(ids).encode("utf-8")).hexdigest()
