"""Cross-tokenizer alignment: which tokens of two vocabularies end together, and how often each pair does.

Every text, with a space before it, is encoded by a byte-level BPE (A) and a piece BPE with byte fallback (B). The byte offsets at which
tokens of both end cut the text into groups; the two tokens that end there are linked. A link is one int64: B's id in the upper 32 bits,
A's in the lower ones.

Links are counted in three steps: ``np.unique`` counts of each partition, a global sort by ranges of the key, and a sum of the runs of
equal keys. The sorted counts are cut into shards, which every executor maps into memory; a document looks its links up by ``searchsorted``.
Two tokens that end together have bytes of which one is a suffix of the other's, so the vocabularies alone bound the number of pairs (``most_pairs``: some
200,000 for the public files), whatever the corpus. The counts are checked against that bound before they pass through the driver.

A's merges come in the order of its ids and run in tiktoken, except for texts with very long runs of white space, which its pattern can't
take; those go to the tokenizer itself. B is encoded word by word (spaces and what follows them), each distinct word once, if no piece of its
vocabulary has a space after another character; then no merge crosses the border of two words. Otherwise whole texts are encoded.

Defined cases: a text that is null or empty, or that a tokenizer does not give back byte by byte (U+2581 in B), has no tokens: all zeros
and an empty digest. Texts of any length are encoded whole. Rows stay rows, whatever ids they have; a null id stays null. Ties for a B id's highest count are
all best. An empty table gives no rows. Only ``doc_id`` and ``text`` are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packed import pack, unpack
from .storage import materialize
from .textkit import slices, tidy

#: The folder of the two vocabularies on every machine.
TOKENIZERS = "/opt/tokenizers"
FILE_A, FILE_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: A fixed value of A: how it cuts a text before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LONG_BLANK = re.compile(r"\s{10000}")
WORD = re.compile(" *[^ ]+| +")
#: Distinct words whose ids a task remembers, keys of links that it counts at a time, and pairs in a shard.
WORDS, KEYS, SHARD = 300_000, 1 << 22, 1 << 16
RANGES = 16
LINKS = "doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary"


def _byte_of() -> dict[str, int]:
    """The characters that byte-level vocabularies write for bytes: printable ones for themselves, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class Side:
    """One vocabulary: the bytes of each id, and the ids as text with what follows them inside a group and at its end."""

    def __init__(self, tokens: list[bytes], last: str) -> None:
        self.tokens = tokens
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.inner = np.array([f"{i}," for i in range(len(tokens))], object)
        self.last = np.array([f"{i}{last}" for i in range(len(tokens))], object)

    def exact(self, ids: list[int], target: bytes) -> bool:
        return b"".join(map(self.tokens.__getitem__, ids)) == target


class ByteSide(Side):
    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        special = {t.content for t in self.whole.get_added_tokens_decoder().values()}
        byte_of, vocabulary = _byte_of(), self.whole.get_vocab()
        tokens = [b""] * (max(vocabulary.values()) + 1)
        for text, i in vocabulary.items():
            tokens[i] = text.encode() if text in special else bytes(byte_of[c] for c in text)
        super().__init__(tokens, "|")
        ranks = {tokens[i]: i for text, i in vocabulary.items() if text not in special}
        self.fast = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if LONG_BLANK.search(text):
            return self.whole.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


class PieceSide(Side):
    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        tokens = [bytes([int(p[1:-1], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        super().__init__(tokens, ";")
        self.by_word = not any(re.search("[^▁]▁", p) for p in pieces)
        self.known: dict[str, list[int]] = {}
        self.blank = [self.model.piece_to_id("▁")]

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        if not self.by_word:
            return self.model.encode(texts, num_threads=1)
        words = [WORD.findall(" " + t) for t in texts]
        if len(self.known) > WORDS:
            self.known.clear()
        new = list(set(chain.from_iterable(words)).difference(self.known))
        # the model adds the first space itself; it has nothing to say of an empty text
        self.known.update(zip(new, self.model.encode([w[1:] for w in new], num_threads=1)))
        if " " in self.known:
            self.known[" "] = self.blank
        return [list(chain.from_iterable(map(self.known.__getitem__, w))) for w in words]


@lru_cache(maxsize=1)
def _sides(folder: str) -> tuple[ByteSide, PieceSide]:
    return ByteSide(os.path.join(folder, FILE_A)), PieceSide(os.path.join(folder, FILE_B))


def most_pairs(folder: str = TOKENIZERS) -> int:
    """Pairs of an A and a B token that can end together: the bytes of one are a suffix of the other's."""
    a, b = _sides(folder)
    count = 0
    for longer, other in ((a, b), (b, a)):
        by_bytes: dict[bytes, int] = {}
        for t in other.tokens:
            by_bytes[t] = by_bytes.get(t, 0) + 1
        proper = 0 if longer is a else 1  # equal bytes count once
        count += sum(by_bytes.get(t[k:], 0) for t in longer.tokens for k in range(proper, len(t)))
    return count


def aligned(a: ByteSide, b: PieceSide, ids_a: list[int], ids_b: list[int]) -> tuple[np.ndarray, str]:
    """The links of a text as packed pairs in order, and its groups as text."""
    x, y = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
    ends_a, ends_b = np.cumsum(a.size[x]), np.cumsum(b.size[y])
    at = np.searchsorted(ends_a, ends_b)  # both end at the text's last byte, so every place is inside
    together = ends_a[at] == ends_b
    last_a, last_b = at[together], np.flatnonzero(together)
    # groups in order, A's tokens before B's: a token moves up by the other side's tokens before it
    group_a, group_b = np.searchsorted(last_a, np.arange(len(x))), np.searchsorted(last_b, np.arange(len(y)))
    place_a = np.arange(len(x)) + np.r_[0, last_b + 1][group_a]
    place_b = np.arange(len(y)) + (last_a + 1)[group_b]
    parts = np.empty(len(x) + len(y), object)
    parts[place_a], parts[place_b] = a.inner[x], b.inner[y]
    parts[place_a[last_a]], parts[place_b[last_b]] = a.last[x[last_a]], b.last[y[last_b]]
    return y[last_b] << 32 | x[last_a], "".join(parts.tolist())[:-1]


def links(docs: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """A row for each row of ``docs``: doc_id, counts of tokens, groups and links, the groups' SHA-256, and the links, packed."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _sides(folder)
        for batch in batches:
            for part in slices(batch):
                texts = [t or "" for t in part.column("text").to_pylist()]
                rows = []
                for text, ids_b in zip(texts, b.encode_all(texts)):
                    target = (" " + text).encode()
                    ids_a = a.encode(" " + text) if text and b.exact(ids_b, target) else []
                    if ids_a and a.exact(ids_a, target):
                        keys, groups = aligned(a, b, ids_a, ids_b)
                        rows.append((len(ids_a), len(ids_b), len(keys), len(keys), hashlib.sha256(groups.encode()).hexdigest(), pack(keys.view(np.uint64))))
                    else:
                        rows.append((0, 0, 0, 0, "", b""))
                longs = [pa.array([r[k] for r in rows], pa.int64()) for k in range(4)]
                rest = [pa.array([r[4] for r in rows], pa.string()), pa.array([r[5] for r in rows], pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *longs, *rest], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), LINKS.format(kind=kind))


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct keys of a partition with their counts; what is held at a time is bounded."""
    keys, counts, waiting, held = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def merged():
        new, n = np.unique(np.concatenate(waiting), return_counts=True)
        every, at = np.unique(np.concatenate([keys, new]), return_inverse=True)
        return every, np.bincount(at, np.concatenate([counts, n]), len(every)).astype(np.int64)

    for batch in batches:
        for blob in batch.column("links").to_pylist():
            if blob:
                waiting.append(unpack(blob).view(np.int64))
                held += len(waiting[-1])
            if held > KEYS:
                keys, counts = merged()
                waiting, held = [], 0
    if waiting:
        keys, counts = merged()
    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["key", "n"])


def _sum_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of runs of equal keys in sorted rows; the last run of a batch waits for the next batch."""
    last_key, last_sum = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        keys = np.concatenate([last_key, batch.column("key").to_numpy()])
        n = np.concatenate([last_sum, batch.column("n").to_numpy()])
        if not len(keys):
            continue
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        keys, sums = keys[starts], np.add.reduceat(n, starts)
        last_key, last_sum = keys[-1:], sums[-1:]
        yield pa.RecordBatch.from_arrays([pa.array(keys[:-1]), pa.array(sums[:-1])], ["key", "n"])
    yield pa.RecordBatch.from_arrays([pa.array(last_key), pa.array(last_sum)], ["key", "n"])


def pair_counts(linked: DataFrame) -> DataFrame:
    """(key, n), each pair's links in the whole corpus: partitions are ranges of the key, sorted."""
    partial = linked.select("links").mapInArrow(tidy(_partial), "key long, n long")
    return partial.repartitionByRange(RANGES, "key").sortWithinPartitions("key").mapInArrow(_sum_runs, "key long, n long")


def _shards(counts: DataFrame, most: int) -> list[str]:
    """The sorted counts as numpy files (row 0 keys, row 1 counts) that every executor fetches; their names there."""
    spark = counts.sparkSession
    rows = counts.count()
    if rows > most:
        raise ValueError(f"{rows} pairs end together, but the vocabularies allow {most}")
    table = counts.sort("key").toArrow()
    both = np.stack([table.column("key").to_numpy(), table.column("n").to_numpy()])
    folder = os.path.realpath(tempfile.mkdtemp(prefix="pair-counts-"))
    names = []
    for at in range(0, rows, SHARD):
        names.append(f"pairs-{uuid.uuid4().hex}.npy")
        np.save(os.path.join(folder, names[-1]), both[:, at : at + SHARD])
        spark.sparkContext.addFile(os.path.join(folder, names[-1]))
    return names


class Lookup:
    """Counts of keys, and whether a key's count is the highest of its B id, from shards that are mapped, not read."""

    def __init__(self, names: list[str]) -> None:
        self.shards = [np.load(SparkFiles.get(n), mmap_mode="r") for n in names]
        self.first = np.array([s[0, 0] for s in self.shards], np.int64)
        self.best = np.zeros(1, np.int64)
        for shard in self.shards:
            b = np.asarray(shard[0]) >> 32
            starts = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
            if b[-1] >= len(self.best):
                self.best = np.pad(self.best, (0, int(b[-1]) + 1 - len(self.best)))
            self.best[b[starts]] = np.maximum(self.best[b[starts]], np.maximum.reduceat(shard[1], starts))

    def counts(self, keys: np.ndarray) -> np.ndarray:
        of = np.searchsorted(self.first, keys, "right") - 1
        out = np.zeros(len(keys), np.int64)
        for k in np.unique(of):
            mine = of == k
            out[mine] = self.shards[k][1][np.searchsorted(self.shards[k][0], keys[mine])]
        return out


def score(linked: DataFrame, names: list[str]) -> DataFrame:
    """``linked`` without its links, with n_best and count_sum."""
    kept = [c for c in linked.columns if c != "links"]
    kinds = ", ".join(f"{c} {linked.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Lookup(names)
        for batch in batches:
            best, total = [], []
            for blob in batch.column("links").to_pylist():
                keys = unpack(blob).view(np.int64) if blob else np.zeros(0, np.int64)
                n = found.counts(keys)
                best.append(int((n == found.best[keys >> 32]).sum()))
                total.append(int(n.sum()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(best, pa.int64()), pa.array(total, pa.int64())], [*kept, "n_best", "count_sum"])

    return linked.mapInArrow(tidy(run), f"{kinds}, n_best long, count_sum long")


def align(docs: DataFrame, folder: str = TOKENIZERS) -> tuple[DataFrame, DataFrame]:
    """A row for each row of ``docs`` (doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum), and all counts (id_a, id_b, n)."""
    linked = materialize(links(docs, folder), "links")
    counts = materialize(pair_counts(linked), "pair-counts")
    pairs = counts.select(F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("id_a"), F.shiftright("key", 32).cast("int").alias("id_b"), "n")
    return score(linked, _shards(counts, most_pairs(folder))), pairs
