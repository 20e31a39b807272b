"""Packing: first-fit decreasing over a tournament tree of bin capacities, in randomised groups.

Documents are tokenised and cut into whole sequences, which are done, and one remainder each.
Remainders are dealt at random (by a hash) to groups of about GROUP documents; each group packs its
own by first-fit decreasing, so groups are independent and any number of them run at once.
The tree's leaves hold the bins' free space and every inner node the larger of its two
children, so the first bin with room is found in log2(bins) steps.

Defined results: a null text is an empty one, so a document has at least its closing id;
rows may repeat or have null ids, each row being packed as a document of its own; other
columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.arrays import SPACED, Batch, ragged, release, slices
from edgeloom.llm.frames import cut

LENGTH = 2048
END_ID = 1
#: Marks of the vocabulary's special tokens: a word that holds one isn't plain.
SPECIAL = b"<|"
GROUP = 4096
#: A worker keeps the ids of twice so many words at the most: those seen since the last change of
#: generations, and those of the generation before, from which words that come back are taken over.
WORDS_KEPT = 250_000


@cache
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


_ASCII = re.compile(r"[a-z]+|[0-9]|[!-/:-@\[-`{-~]+")  # what the vocabulary's split makes of ASCII without apostrophes
_CONTROL = re.compile(rb"[\x00-\x1f\x7f']")
_PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if it is visible, else the next unused one from U+0100."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in seen)}


_LETTERS = _byte_letters()


def _plain_parts(word: bytes) -> list[str] | None:
    """The word's parts as the tokenizer's normaliser and splitter make them, in byte letters; None if it isn't sure.

    Sure are ASCII without control characters and apostrophes, and words of Latin letters
    below U+0180 between ASCII punctuation (no composition, no context-dependent case).
    """
    if SPECIAL in word or _CONTROL.search(word):
        return None
    if word.isascii():
        return _ASCII.findall(word.decode().lower())
    try:
        text = word.decode()
    except UnicodeDecodeError:
        return None
    core = text.strip(_PUNCTUATION)
    if not core.isalpha() or max(core) >= "\u0180" or "\u0130" in core:
        return None
    at = text.index(core)
    parts = [text[:at], core.lower().encode().decode("latin-1").translate(_LETTERS), text[at + len(core) :]]
    return [p for p in parts if p]


class Encoder:
    """Token ids by word: this vocabulary never joins characters across white space, so each distinct word is encoded once."""

    def __init__(self, path: str):
        self.tokenizer, self.kept, self.before = _tokenizer(path), {}, {}
        self.model = self.tokenizer.model

    def _learn(self, words: list[bytes]) -> None:
        """Plain words go straight to the merge model; any other goes through the whole tokenizer."""
        merge, rest = self.model.tokenize, []
        for w in words:
            parts = _plain_parts(w)
            if parts is None:
                rest.append(w)
            else:
                self.kept[w] = np.array([t.id for p in parts for t in merge(p)], np.uint32).tobytes()
        for w, e in zip(rest, self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in rest], add_special_tokens=False)):
            self.kept[w] = np.array(e.ids, np.uint32).tobytes()

    def encode(self, batch: Batch) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents end to end, offsets of the documents); END_ID closes each."""
        starts, ends, doc = batch.words(SPACED)
        if len(starts):
            first, index = batch.distinct_words(SPACED, starts, ends)
            raw = batch.data.tobytes()
            words = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
            if len(self.kept) > WORDS_KEPT:
                self.kept, self.before = {}, self.kept
            missing = [w for w in words if w not in self.kept]
            if self.before:
                known = [w for w in missing if w in self.before]
                self.kept.update(zip(known, map(self.before.__getitem__, known)))
                missing = [w for w in missing if w not in self.kept]
            self._learn(missing)
            blobs = [self.kept[w] for w in words]
            sizes = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
            table = np.frombuffer(b"".join(blobs), np.uint32)
            begin = np.cumsum(sizes) - sizes
            lengths = sizes[index]
            ids = table[ragged(begin[index], lengths)]
            per = np.bincount(doc, lengths, batch.n).astype(np.int64)
        else:
            ids, per = np.zeros(0, np.uint32), np.zeros(batch.n, np.int64)
        before = np.concatenate([[0], np.cumsum(per)])
        return np.insert(ids, before[1:], END_ID).astype(np.uint32), before + np.arange(batch.n + 1)


class Tournament:
    """Bins in order; find(size) gives the first with that much room, opening a new one at the end."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1
        while self.leaves < bins:
            self.leaves *= 2
        self.tree = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """(bin, free space before) of the first bin with room for size, which it then holds."""
        tree, at = self.tree, 1
        while at < self.leaves:
            at *= 2
            if tree[at] < size:
                at += 1
        free = tree[at]
        tree[at] = free - size
        chosen = at - self.leaves
        while at > 1:
            at //= 2
            tree[at] = max(tree[2 * at], tree[2 * at + 1])
        return chosen, free


def pack(sizes: np.ndarray, capacity: int = LENGTH) -> list[tuple[int, int]]:
    """(bin, offset) of each size by first-fit decreasing; ties by position."""
    out = [(0, 0)] * len(sizes)
    bins = Tournament(max(1, len(sizes)), capacity)
    for i in np.argsort(-sizes, kind="stable").tolist():
        chosen, free = bins.place(int(sizes[i]))
        out[i] = (chosen, capacity - free)
    return out


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, salt long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pieces(documents: DataFrame, tokenizer_path: str, length: int = LENGTH) -> DataFrame:
    """One row for each whole sequence and remainder of a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, row = Encoder(tokenizer_path), 0
        for whole in batches:
            for batch in slices(whole, "text", 2_000_000):
                ids, offsets = encoder.encode(Batch.of_arrow(batch.column("text")))
                view, out = memoryview(ids.astype("<u4").tobytes()), []
                for name, a, b in zip(batch.column("doc_id").to_pylist(), offsets.tolist(), offsets[1:].tolist()):
                    row += 1
                    salt = zlib.crc32(b"%d %d" % (name or 0, row))
                    for s in range(a, b, length):
                        part = view[4 * s : 4 * min(b, s + length)]
                        out.append((name, s - a, len(part) // 4, zlib.crc32(part), b - a, salt))
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "salt"])
        del encoder
        release()

    return documents.select("doc_id", "text").mapInArrow(run, PIECES)


def pack_group(rows: pa.Table, length: int = LENGTH) -> pa.Table:
    """The pieces of one group with their sequence (numbered within the group) and offset."""
    rows = rows.sort_by([("doc_id", "ascending"), ("salt", "ascending"), ("start", "ascending")])
    placed = np.array(pack(rows.column("length").to_numpy().astype(np.int64), length), np.int64).reshape(-1, 2)
    return rows.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens"]).append_column("sequence_id", pa.array(placed[:, 0])).append_column("offset", pa.array(placed[:, 1]))


def pack_documents(documents: DataFrame, tokenizer_path: str, group: int = GROUP, length: int = LENGTH) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of every piece.

    A piece that fills a sequence is one already and isn't shuffled, so a group holds at the
    most one piece of a document however long that is.
    """
    cutout = cut(pieces(documents, tokenizer_path, length))
    whole, rest = cutout.where(F.col("length") == length), cutout.where(F.col("length") < length)
    groups = max(1, -(-rest.count() // group))
    dealt = rest.withColumn("g", F.pmod(F.xxhash64("salt", F.lit(31)), F.lit(groups)))

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        out = pack_group(rows, length)
        shifted = pc.add(out.column("sequence_id"), pa.scalar(key[0].as_py() << 32, pa.int64()))
        return out.set_column(5, "sequence_id", shifted)

    full = whole.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.lit(-1) - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return dealt.groupBy("g").applyInArrow(run, PACKED).unionByName(full)
