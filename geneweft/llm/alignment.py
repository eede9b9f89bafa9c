"""Alignment of two tokenizers over the same bytes.

Tokenizer A is a byte-level BPE, tokenizer B a sentencepiece model with byte fallback. Both read a blank and the text.
The spans that the libraries report are coarse cuts: A's are character offsets, so tokens that share a multibyte
character report the same span; B's byte-fallback tokens report the character they came from. Where spans are shared, the
cut is refined by the number of bytes that each token decodes to. Byte offsets where tokens of both sides end cut the
tokens into groups; a pair of tokens is linked where their byte ranges overlap. A pair's count is the number of documents
that hold it linked.

Neither tokenizer has a token across the start of a word (a blank between two visible characters), so a text is cut
there and a word met before is not tokenized again; the words kept in a task are bounded in number. Documents go in blocks
of bounded size: a block states its distinct pairs once, with the number of its documents that hold them. These
partial counts are added up over all blocks, and the sums come back to the blocks by a join on the pair, whose hottest key
has one row per block.

Defined cases: texts that are null or empty, or whose joined token bytes differ from blank and text on either side, have
no tokens: zeros and an empty digest, and they count for no pair. Strings of special tokens inside a text are plain text.
Rows that repeat an id or a text are documents of their own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from geneweft.llm.bpe import byte_alphabet
from geneweft.llm.registry import stored

BLOCK_BYTES = 1 << 23
WORDS = 300_000
BATCH = 4000
SHIFT = 24
_WORD = re.compile(r"(?<=\S)(?= \S)")
_LOOSE = re.compile(r"\s | \s|\A | \Z")


def read_files(byte_path: str, piece_path: str) -> tuple[str, bytes]:
    """Contents of the two vocabulary files; a few MB whatever the corpus, so they are broadcast."""
    with open(byte_path, encoding="utf-8") as a, open(piece_path, "rb") as b:
        return a.read(), b.read()


def refine(coarse: np.ndarray, shared: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Byte ends of tokens: the coarse end where it is the token's own, else the last such end plus the bytes decoded since."""
    own = np.maximum.accumulate(np.where(shared, -1, np.arange(len(coarse))))
    decoded = np.cumsum(lengths)
    return np.where(own >= 0, coarse[own] - decoded[own], 0) + decoded


class Aligner:
    """Both tokenizers over words, each a blank and what follows up to the next word."""

    def __init__(self, a_json: str, b_model: bytes):
        to_byte = byte_alphabet()
        self.a = Tokenizer.from_str(a_json)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        size = max(self.a.get_vocab(with_added_tokens=True).values()) + 1
        self.a_bytes = [b""] * size
        for s, i in json.loads(a_json)["model"]["vocab"].items():
            self.a_bytes[i] = bytes(to_byte[c] for c in s)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece that goes on into the next word is not supported")
        self.b_single = np.array([self.b.is_byte(i) for i in range(len(pieces))])
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if single else p.replace("▁", " ").encode("utf-8")
            for p, single in zip(pieces, self.b_single)
        ]
        self.a_lengths, self.b_lengths = (np.array([len(x) for x in known]) for known in (self.a_bytes, self.b_bytes))

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """(A ids, A byte ends, B ids, B byte ends) of a text that starts with the added blank; None where the bytes differ."""
        raw, found = text.encode("utf-8"), self.a.encode(text, add_special_tokens=False)
        a_ids, pieces = found.ids, self.b.encode(text[1:], return_type="proto").pieces
        b_ids = [p.id for p in pieces]
        if b"".join(map(self.a_bytes.__getitem__, a_ids)) != raw or b"".join(map(self.b_bytes.__getitem__, b_ids)) != raw:
            return None
        a_ids, b_ids = np.array(a_ids), np.array(b_ids)
        spans = np.fromiter(itertools.chain.from_iterable(found.offsets), dtype=np.int64, count=2 * len(a_ids)).reshape(-1, 2)
        if len(raw) > len(text):
            points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
            width = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
            places = np.concatenate([[0], np.cumsum(width)])
        else:
            places = np.arange(len(raw) + 1)
        shared = np.append(spans[1:, 0] < spans[:-1, 1], False)
        a_ends = refine(places[spans[:, 1]], shared, self.a_lengths[a_ids])
        b_ends = refine(np.array([p.end for p in pieces]) + 1, self.b_single[b_ids], self.b_lengths[b_ids])
        return a_ids, a_ends, b_ids, b_ends


def words_of(text: str) -> list[str]:
    """Blank and text, cut before every blank between two visible characters."""
    if _LOOSE.search(text):
        return _WORD.split(" " + text)
    return [" " + word for word in text.split(" ")]


def links_of(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in A, place in B) of every overlap in order, and whether both tokens end where the overlap ends."""
    ends = np.union1d(a_ends, b_ends)
    i, j = np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)
    return i, j, (a_ends[i] == ends) & (b_ends[j] == ends)


class Words:
    """What is known of the words met in a task: sizes, links and the groups written out.

    ``sizes`` has n_a, n_b, n_groups, n_links and whether the bytes differ; ``codes`` the links of all words one after
    another; ``written`` the groups, each followed by a semicolon.
    """

    def __init__(self, aligner: Aligner):
        self.aligner = aligner
        self.a_text, self.b_text = (
            np.array([[f"{i}{mark}" for i in range(len(known))] for mark in marks], dtype=object)
            for known, marks in ((aligner.a_bytes, ",|"), (aligner.b_bytes, ",;"))
        )
        self.numbers, self.written = {}, []
        self.sizes, self.codes = np.zeros((0, 5), dtype=np.int64), np.zeros(0, dtype=np.int64)

    def known(self, texts_words: list[list[str]]) -> list[int]:
        """Numbers of all words, in order."""
        words = list(itertools.chain.from_iterable(texts_words))
        numbers = list(map(self.numbers.get, words))
        if None not in numbers:
            return numbers
        missing = list(dict.fromkeys(w for w, n in zip(words, numbers) if n is None))
        sizes, codes = [self.sizes], [self.codes]
        for i in range(0, len(missing), BATCH):
            for part in self.tokenized(missing[i : i + BATCH]):
                sizes.append(part[0])
                codes.append(part[1])
        self.sizes, self.codes = np.concatenate(sizes), np.concatenate(codes)
        return list(map(self.numbers.__getitem__, words))

    def tokenized(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Learn new words: those that start and end visibly as one text, the others one by one."""
        plain = [w for w in words if len(w) > 1 and not w[1].isspace() and not w[-1].isspace() and "▁" not in w]
        odd = set(words).difference(plain)
        if plain:
            together = self.aligner.tokens("".join(plain))
            if together is None:
                odd = set(words)
            else:
                yield self.learn(plain, *together)
        for word in (w for w in words if w in odd):
            found = self.aligner.tokens(word)
            if found is None:
                self.numbers[word] = len(self.numbers)
                self.written.append("")
                yield np.array([[0, 0, 0, 0, 1]]), np.zeros(0, dtype=np.int64)
            else:
                yield self.learn([word], *found)

    def learn(self, words: list[str], a_ids, a_ends, b_ids, b_ends) -> tuple[np.ndarray, np.ndarray]:
        i, j, closes = links_of(a_ends, b_ends)
        edges = np.cumsum([len(w.encode("utf-8")) for w in words])
        a_cuts, b_cuts = np.searchsorted(a_ends, edges, side="right"), np.searchsorted(b_ends, edges, side="right")
        link_ends = np.minimum(a_ends[i], b_ends[j])
        l_cuts, g_cuts = np.searchsorted(link_ends, edges, side="right"), np.searchsorted(link_ends[closes], edges, side="right")
        sizes = np.stack([np.diff(c, prepend=0) for c in (a_cuts, b_cuts, g_cuts, l_cuts)] + [np.zeros(len(words), dtype=np.int64)], axis=1)
        # a token comes after all of A's in its group before B's; the last of its side in the group carries the mark
        a_last, b_last = np.zeros(len(a_ids), dtype=bool), np.zeros(len(b_ids), dtype=bool)
        a_last[i[closes]], b_last[j[closes]] = True, True
        group_a, group_b = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
        pieces = np.empty(len(a_ids) + len(b_ids), dtype=object)
        pieces[np.arange(len(a_ids)) + np.searchsorted(group_b, group_a)] = self.a_text[a_last.astype(int), a_ids]
        pieces[np.arange(len(b_ids)) + np.searchsorted(group_a, group_b, side="right")] = self.b_text[b_last.astype(int), b_ids]
        pieces = pieces.tolist()
        start = 0
        for word, end in zip(words, (a_cuts + b_cuts).tolist()):
            self.numbers[word] = len(self.numbers)
            self.written.append("".join(pieces[start:end]))
            start = end
        return sizes, a_ids[i].astype(np.int64) << SHIFT | b_ids[j]

    def keep(self, chosen: np.ndarray) -> None:
        """Forget all words but the chosen numbers."""
        counts = self.sizes[:, 3]
        starts = np.cumsum(counts) - counts
        self.codes = self.codes[ranges(starts[chosen], counts[chosen])]
        self.sizes = self.sizes[chosen]
        names = list(self.numbers)
        self.written = [self.written[k] for k in chosen.tolist()]
        self.numbers = {names[k]: n for n, k in enumerate(chosen.tolist())}


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every start, as many as its length says, one after another."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(lengths.sum())


def block_of(known: Words, texts: list[str | None]) -> tuple[list[dict], np.ndarray, np.ndarray]:
    """Sizes, digest and links of every text of a block; the block's distinct pairs and in how many texts each is linked.

    ``at`` are places in the distinct pairs, ``times`` how often the pair is linked in the text. Words met once in the
    block are forgotten where too many are known.
    """
    cut = [words_of(text) if text else [] for text in texts]
    numbers = known.known(cut)
    firsts = np.cumsum([0, *map(len, cut)])
    doc_of = np.repeat(np.arange(len(texts)), np.diff(firsts))
    words, place, often = np.unique(np.array(numbers, dtype=np.int64), return_inverse=True, return_counts=True)
    sizes = known.sizes[words]
    totals = np.stack([np.bincount(doc_of, weights=sizes[place, k], minlength=len(texts)) for k in range(5)], axis=1).astype(np.int64)
    fit = (totals[:, 4] == 0) & (np.diff(firsts) > 0)
    starts = (np.cumsum(known.sizes[:, 3]) - known.sizes[:, 3])[words]
    wide = max(1, len(words))
    used = fit[doc_of]
    spread, n_words = np.unique(doc_of[used] * wide + place[used], return_counts=True)
    word, doc = spread % wide, spread // wide
    each = sizes[word, 3]
    pairs, which = np.unique(known.codes[ranges(starts[word], each)], return_inverse=True)
    many = max(1, len(pairs))
    keys, back = np.unique(np.repeat(doc, each) * many + which, return_inverse=True)
    times = np.bincount(back, weights=np.repeat(n_words, each), minlength=len(keys)).astype(np.int32)
    at = (keys % many).astype(np.int32)
    cuts = np.searchsorted(keys, np.arange(len(texts) + 1) * many)
    rows = []
    for d in range(len(texts)):
        if not fit[d]:
            rows.append(dict(n_a=0, n_b=0, n_groups=0, n_links=0, groups_sha256="", at=b"", times=b""))
            continue
        written = "".join(map(known.written.__getitem__, numbers[firsts[d] : firsts[d + 1]])).rstrip(";")
        part = slice(cuts[d], cuts[d + 1])
        rows.append(dict(
            n_a=int(totals[d, 0]), n_b=int(totals[d, 1]), n_groups=int(totals[d, 2]), n_links=int(totals[d, 3]),
            groups_sha256=hashlib.sha256(written.encode()).hexdigest(), at=at[part].tobytes(), times=times[part].tobytes(),
        ))
    if len(known.numbers) > WORDS:
        known.keep(words[often > 1] if (often > 1).sum() <= WORDS else words[:0])
    return rows, pairs, np.bincount(at, minlength=len(pairs))


SIZES = ["n_a", "n_b", "n_groups", "n_links"]
BLOCKS = "block bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, at binary, times binary, pairs array<bigint>, held array<bigint>"
_BUILT: list[tuple[int, Aligner]] = []


def built(a_json: str, b_model: bytes) -> Aligner:
    """The aligner of two vocabularies, made once per Python worker."""
    key = hash((a_json, b_model))
    if not _BUILT or _BUILT[0][0] != key:
        _BUILT[:] = [(key, Aligner(a_json, b_model))]
    return _BUILT[0][1]


def spans(df: DataFrame, a_json: str, b_model: bytes) -> DataFrame:
    """``df`` with a_ids, a_ends, b_ids, b_ends of column ``text``: ids and byte ends in blank and text; null without tokens."""
    shared = df.sparkSession.sparkContext.broadcast((a_json, b_model))
    names = ["a_ids", "a_ends", "b_ids", "b_ends"]
    kept = df.drop(*names)
    added = [T.StructField(n, T.ArrayType(T.IntegerType())) for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = built(*shared.value)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                found = [aligner.tokens(" " + t) if t else None for t in part.column("text").to_pylist()]
                new = [pa.array([None if f is None else f[k] for f in found], pa.list_(pa.int32())) for k in range(4)]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, *names])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *added]))


def blocks(docs: DataFrame, a_json: str, b_model: bytes, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Stored rows of two kinds: one per document, and one per block with its distinct pairs and their documents."""
    shared = docs.sparkSession.sparkContext.broadcast((a_json, b_model))
    schema = T._parse_datatype_string(BLOCKS)
    names = schema.fieldNames()
    types = [pa.int64(), pa.int64(), *[pa.int64()] * 4, pa.string(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(names, types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words(built(*shared.value))
        block, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0

        def flush():
            rows, pairs, held = block_of(known, texts)
            for row, doc_id in zip(rows, ids):
                row.update(block=block, doc_id=doc_id)
            return batch_of([*rows, dict(block=block, pairs=pairs, held=held)])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids.append(doc_id)
                texts.append(text.as_py())
                size += len(texts[-1] or "") + 64
                if size >= block_bytes:
                    yield flush()
                    block, ids, texts, size = block + 1, [], [], 0
        if ids:
            yield flush()

    return stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema), "alignment")


def pair_counts(blocked: DataFrame) -> DataFrame:
    """a_id, b_id, documents, best: in how many documents a pair is linked, and whether no pair of its A id has more."""
    pairs = blocked.where("pairs IS NOT NULL").select(F.inline(F.arrays_zip("pairs", "held")))
    counts = pairs.groupBy("pairs").agg(F.sum("held").alias("documents"))
    counts = stored(counts.select("pairs", F.shiftright("pairs", SHIFT).alias("a_id"), "documents"), "pair-counts")
    # one row per id of the vocabulary file: a proven bound
    top = F.broadcast(counts.groupBy("a_id").agg(F.max("documents").alias("top")))
    return counts.join(top, "a_id").select(
        "pairs", "a_id", F.col("pairs").bitwiseAND(F.lit((1 << SHIFT) - 1)).alias("b_id"), "documents",
        (F.col("documents") == F.col("top")).alias("best"),
    )


def alignment_digests(docs: DataFrame, a_json: str, b_model: bytes, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    blocked = blocks(docs, a_json, b_model, block_bytes)
    rated = pair_counts(blocked).select("pairs", "documents", "best")
    asked = blocked.where("pairs IS NOT NULL").select(F.col("block").alias("asking"), F.posexplode("pairs").alias("at", "pairs"))
    answers = asked.join(rated, "pairs").select("asking", "at", "documents", "best")
    rows = blocked.where("pairs IS NULL").select("block", "doc_id", *SIZES, "groups_sha256", "at", "times")

    def summed(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        documents, best = np.zeros(len(right), dtype=np.int64), np.zeros(len(right), dtype=np.int64)
        documents[right["at"]], best[right["at"]] = right["documents"], right["best"]
        out = left[["doc_id", *SIZES]].copy()
        n_best, count_sum = [], []
        for at, times in zip(left["at"], left["times"]):
            at, times = np.frombuffer(at, dtype=np.int32), np.frombuffer(times, dtype=np.int32).astype(np.int64)
            n_best.append(int(best[at] @ times))
            count_sum.append(int(documents[at] @ times))
        out["n_best"], out["count_sum"] = np.array(n_best, dtype=np.int64), np.array(count_sum, dtype=np.int64)
        out["groups_sha256"] = left["groups_sha256"]
        return out

    # a block is bounded, so both sides of a group are
    return rows.groupBy("block").cogroup(answers.groupBy("asking")).applyInPandas(
        summed, "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    )
