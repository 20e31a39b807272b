"""N-gram Jaccard join: MinHash bands to meet, full n-gram sets to verify.

A document's set holds its word 5-grams (words are runs of ASCII letters, digits and
non-ASCII characters, A-Z lower-cased; a text of one to four words has its one sequence).
Documents with equal sets (by 128 bits from two independent hashes of every word) are one
class.  Band hashes of a class's MinHash signature deal it to buckets; buckets with the same
members are compared once, and a pair is verified in the first bucket that holds it.  Large
buckets are split into blocks whose pairs are separate tasks, and a task reports counts and
a spanning forest, never its pairs.

Verifying tasks get the words themselves: words are told apart byte for byte and n-grams
word for word, so no link rests on a hash.

Defined results: a text without words (or null) has no set, links with nothing and is its
own class; rows without an id count as members of their text's class, which takes part
only if another row of it has an id; rows that repeat count as documents of their own, and
rows that share an id but not a text are told apart; other columns are ignored.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.arrays import WORDS, Batch, grams, mix, release
from edgeloom.llm.components import components, forest
from edgeloom.llm.frames import cut, fresh_name, map_texts, quoted, text_md5

GRAM, SIMILARITY = 5, 0.8
#: Chance that a pair of exactly SIMILARITY meets in a bucket; higher for closer pairs.
RECALL, ROWS = 0.9999, 4
#: A verifying task holds two blocks: of so many members and about so many n-grams each.
BLOCK, BLOCK_GRAMS = 1024, 2_000_000
#: Largest list of ids that is broadcast to the texts; beyond it the texts are shuffled to it.
BROADCAST_BYTES = 32_000_000


def bands_for(similarity: float, recall: float, rows: int) -> int:
    """Bands of `rows` rows that let a pair of this similarity meet with probability `recall`."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def _sequences(words: np.ndarray, doc: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of every k-gram, and of the one sequence of each document of fewer words."""
    counts = np.bincount(doc, minlength=n)
    begin = np.cumsum(counts) - counts
    parts = [grams(words, doc, k)]
    for few in range(1, k):
        if len(some := begin[counts == few]):
            gram, at = grams(words, doc, few)
            keep = np.isin(at, some)
            parts.append((gram[keep], at[keep]))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _distinct(gram: np.ndarray, owner: np.ndarray, n: int, *also: np.ndarray) -> tuple[np.ndarray, ...]:
    """(sorted, distinct n-grams, offsets by document, and what goes along with each)."""
    order = np.lexsort((gram, owner))
    gram, owner = gram[order], owner[order]
    fresh = np.ones(len(gram), bool)
    fresh[1:] = (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])
    gram, owner = gram[fresh], owner[fresh]
    return gram, np.searchsorted(owner, np.arange(n + 1)), *(x[order][fresh] for x in also)


def gram_sets(batch: Batch, k: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit n-grams, offsets by document, independent hashes of the same n-grams): sorted, distinct sets."""
    starts, ends, doc = batch.words(WORDS)
    gram, at = _sequences(batch.word_hashes(WORDS, starts, ends), doc, batch.n, k)
    second, _ = _sequences(batch.word_hashes(WORDS, starts, ends, 1), doc, batch.n, k)
    return _distinct(gram, doc[at], batch.n, second)


def set_keys(gram: np.ndarray, offsets: np.ndarray, second: np.ndarray) -> list[bytes | None]:
    """128 bits that tell sets apart, half of them from each hash; None for an empty one."""
    sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(x), dtype=np.uint64)]) for x in (gram, second)]
    one, two = (mix(s[offsets[1:]] - s[offsets[:-1]] + np.diff(offsets).astype(np.uint64)) for s in sums)
    return [struct.pack("<QQ", a, b) if n else None for a, b, n in zip(one.tolist(), two.tolist(), np.diff(offsets).tolist())]


def band_hashes(gram: np.ndarray, offsets: np.ndarray, bands: int, rows: int, seed: int = 17) -> np.ndarray:
    """Documents x bands: hashes of `rows` minima each; empty documents get zeros."""
    full = np.flatnonzero(np.diff(offsets))
    out = np.zeros((len(offsets) - 1, bands), np.int64)
    if not len(full):
        return out
    odd = mix(np.arange(bands * rows, dtype=np.uint64) + np.uint64(seed << 20)) | np.uint64(1)
    begin = offsets[:-1][full]
    for b in range(bands):
        h = np.full(len(full), b, np.uint64)
        for r in range(b * rows, (b + 1) * rows):
            h = mix(h ^ (np.minimum.reduceat((gram ^ odd[-1 - r]) * odd[r], begin) >> np.uint64(8)))
        out[full, b] = h.view(np.int64)
    return out


def signatures(documents: DataFrame, bands: int, rows: int, k: int = GRAM) -> DataFrame:
    """doc_id, text_md5, key, n and bands of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        gram, offsets, second = gram_sets(Batch.of_arrow(batch.column("text")), k)
        hashes = band_hashes(gram, offsets, bands, rows)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(hashes) + 1) * bands, pa.int32()), pa.array(hashes.ravel()))
        columns = [batch.column("doc_id"), batch.column("text_md5"), pa.array(set_keys(gram, offsets, second), pa.binary()), pa.array(np.diff(offsets), pa.int64()), lists]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "text_md5", "key", "n", "bands"])

    rows_ = documents.select("doc_id", "text", text_md5().alias("text_md5"))
    return map_texts(rows_, run, "doc_id long, text_md5 binary, key binary, n long, bands array<long>")


def plain_words(batch: Batch) -> list[bytes]:
    """Each document's words, lower-cased and joined by one space."""
    starts, ends, doc = batch.words(WORDS)
    padded = batch._blocks(WORDS)[0].tobytes()
    words = [padded[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
    cuts = np.searchsorted(doc, np.arange(batch.n + 1)).tolist()
    return [b" ".join(words[a:b]) for a, b in zip(cuts, cuts[1:])]


def exact_sets(texts: list[str], k: int = GRAM) -> list[np.ndarray]:
    """The texts' n-gram sets as sorted numbers that are equal exactly if the words are."""
    batch = Batch.of_strings(texts)
    starts, ends, doc = batch.words(WORDS)
    _, word = batch.distinct_words(WORDS, starts, ends)
    gram, at = _sequences(mix(word.astype(np.uint64)), doc, batch.n, k)
    _, first, name = np.unique(gram, return_index=True, return_inverse=True)
    counts = np.bincount(doc, minlength=batch.n)
    last = np.cumsum(counts)[doc[at]] if len(at) else at
    parts = np.stack([np.where(at + j < last, word[np.minimum(at + j, len(word) - 1)], -1) for j in range(k)], axis=1) if len(at) else np.zeros((0, k), np.int64)
    if (parts != parts[at_first := first[name]]).any():  # two n-grams share a hash
        del at_first
        _, name = np.unique(parts, axis=0, return_inverse=True)
    gram, offsets = _distinct(name.ravel().astype(np.uint64), doc[at], batch.n)
    return [gram[a:b] for a, b in zip(offsets, offsets[1:])]


def shared(grams_: list[np.ndarray]) -> np.ndarray:
    """The numbers of n-grams that each two sets have in common."""
    g = len(grams_)
    owner = np.repeat(np.arange(g), [len(x) for x in grams_])
    _, index, counts = np.unique(np.concatenate(grams_), return_inverse=True, return_counts=True)
    everywhere = int((counts == g).sum())
    some = (counts > 1) & (counts < g)
    place = np.cumsum(some) - 1
    keep = some[index]
    column, owner = place[index[keep]], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.full((g, g), everywhere, np.int64)
    width = max(256, 8_000_000 // g)
    for a in range(0, int(some.sum()), width):
        x, y = np.searchsorted(column, (a, a + width))
        part = np.zeros((g, min(width, int(some.sum()) - a)), np.float32)
        part[owner[x:y], column[x:y] - a] = 1
        out += (part @ part.T).astype(np.int64)  # exact: a part has at most `width` columns, under 2^24
    return out


def verify(members: list[dict], similarity: float) -> list[tuple[bytes, int, bytes]]:
    """(key, linked documents, smallest key that links reach in the task) of the members with links in this task."""
    band, (i, j) = members[0]["band"], members[0]["task"]
    sizes = np.array([len(m["set"]) for m in members]) // 8
    common = shared([np.frombuffer(m["set"], np.uint64) for m in members])
    share = Fraction(str(similarity))  # in whole numbers: a tie is a link at any size
    linked = share.denominator * common >= share.numerator * (sizes[:, None] + sizes - common)
    np.fill_diagonal(linked, False)
    hashes = np.array([m["bands"] for m in members])
    for b in range(band):  # met before, so verified there
        linked &= hashes[:, b][:, None] != hashes[:, b]
    if i != j:
        side = np.array([m["block"] for m in members]) == i
        linked &= side[:, None] != side
    weight = np.array([m["size"] for m in members], np.int64)
    links = linked @ weight
    a, b = np.nonzero(linked)
    keys = [m["key"] for m in members]
    order = sorted(range(len(keys)), key=keys.__getitem__)
    place = np.empty(len(keys), np.int64)
    place[order] = np.arange(len(keys))
    root = forest(len(keys), place[a], place[b])
    return [(keys[m], int(links[m]), keys[order[root[place[m]]]]) for m in np.flatnonzero(links)]


def _parts(df: DataFrame) -> int:
    return max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def classes_of(documents: DataFrame, similarity: float = SIMILARITY, k: int = GRAM, recall: float = RECALL, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_md5 and key of every row; key, rep, size, links and component of every class).

    rep is the smallest (doc_id, text_md5) of a class, and component that of what links reach.
    """
    bands = bands_for(similarity, recall, rows)
    signed = cut(signatures(documents, bands, rows, k))
    row = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_md5"))
    classes = signed.where("key is not null").groupBy("key").agg(F.min(row).alias("rep"), F.count("*").alias("size"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    # one shuffle by bucket serves both to count its members and to name them; all else about a class joins those that met
    dealt = classes.where("rep is not null").select("key", "n", F.posexplode("bands").alias("band", "h")).repartition(_parts(documents), "band", "h")
    met = dealt.groupBy("band", "h").agg(F.count("*").alias("c"), F.sum("n").alias("grams"), F.bit_xor(F.xxhash64("key")).alias("one"), F.bit_xor(F.xxhash64(F.lit(5), "key")).alias("two")).where("c > 1")
    once = met.groupBy("one", "two", "c").agg(F.min(F.struct("band", "h", "grams")).alias("s")).select("s.*", "c")
    blocks = F.greatest(F.ceil(F.col("c") / BLOCK), F.ceil(F.col("grams") / BLOCK_GRAMS)).cast("int")
    members = cut(dealt.select("key", "band", "h").join(once.select("band", "h", blocks.alias("blocks")), ["band", "h"]))
    among = cut(members.select("key").distinct().join(classes, "key").select("key", "size", "bands", F.col("rep.doc_id").alias("doc_id"), F.col("rep.text_md5").alias("text_md5")))
    members = members.join(among.select("key", "size", "bands"), "key")

    reps = among.select("doc_id", "text_md5", "key")
    few = reps.count() * 64 <= BROADCAST_BYTES
    md5 = text_md5()
    texts = documents.select("doc_id", "text", md5.alias("text_md5")).join(F.broadcast(reps) if few else reps, ["doc_id", "text_md5"]).select("key", "text")

    def plain(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("key"), pa.array([w.decode() for w in plain_words(Batch.of_arrow(batch.column("text")))], pa.string())], ["key", "words"])

    found = map_texts(texts, plain, "key binary, words string").groupBy("key").agg(F.first("words").alias("words"))
    block = F.pmod(F.xxhash64("key", F.lit(3)), F.col("blocks")).cast("int")
    tasks = (
        members.withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", "size", "bands", "band", "h", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
        .join(found, "key")
    )
    names = ("band", "h", "i", "j")
    tasks = tasks.repartition(_parts(documents), *names).sortWithinPartitions(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, name, out = [], None, []
        names = ("key", "size", "bands", "band", "h", "block", "i", "j", "words")

        def flush():
            if len(group) > 1:
                for m, s in zip(group, exact_sets([m["words"] for m in group], k)):
                    m["set"] = s.tobytes()
                out.extend(verify(group, similarity))
            if len(out) > 5000 or name is None and out:
                columns = list(zip(*out))
                out.clear()
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.binary()))], ["key", "links", "root"])
            return None

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in names)):
                m = dict(zip(names, row))
                m["task"] = (m["i"], m["j"])
                at = (m["band"], m["h"], m["i"], m["j"])
                if at != name:
                    if (done := flush()) is not None:
                        yield done
                    group, name = [], at
                group.append(m)
        name = None
        if (done := flush()) is not None:
            yield done
        group.clear()
        release()

    verified = cut(tasks.mapInArrow(run, "key binary, links long, root binary"))
    links = verified.groupBy("key").agg(F.sum("links").alias("links"))
    reached = components(verified.select(F.col("key").alias("a"), F.col("root").alias("b")))
    least = reached.join(classes.select(F.col("key").alias("node"), "rep"), "node").groupBy("component").agg(F.min("rep").alias("least"))
    reached = reached.join(least, "component").select(F.col("node").alias("key"), "least")
    about = classes.select("key", "rep", "size").join(links, "key", "left").join(reached, "key", "left")
    return signed.select("doc_id", "text_md5", "key"), about.select("key", "rep", "size", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("least", "rep").alias("component"))


def join(documents: DataFrame, similarity: float = SIMILARITY, k: int = GRAM, recall: float = RECALL, rows: int = ROWS) -> DataFrame:
    """doc_id, class_id, n_links, component_id and kept of every row.

    n_links counts the other rows at `similarity` or more, members of the own class
    included; component_id is the smallest id reachable by links.
    """
    signed, classes = classes_of(documents, similarity, k, recall, rows)
    about = classes.select("key", F.col("rep.doc_id").alias("class_id"), (F.col("size") - 1 + F.col("links")).alias("n_links"), F.col("component.doc_id").alias("component_id"))
    own = signed.join(about, "key", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return own.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(documents: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents, all columns, with one of each group that links connect.

    That is the row of the smallest (doc_id, md5 of the text); rows are told apart by both,
    so what shares an id with a removed text stays.  Rows without an id come after all others
    and count as documents like them.  Of rows that agree in both one stays.
    """
    id_, digest, seen = (fresh_name(documents, c) for c in ("_id", "_digest", "_seen"))
    # a row without an id gets a large one from its text, so that its class takes part
    made = F.coalesce(F.col("doc_id"), F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64("text"), 3))
    md5 = text_md5()
    signed, classes = classes_of(documents.select(made.alias("doc_id"), "text"), similarity)
    alone = classes.where("size = 1 and links = 0").select("key")
    grouped = signed.where("key is not null").join(alone, "key", "left_anti").groupBy("key", "doc_id", "text_md5").agg(F.count("*").alias("n"))
    chosen = F.struct("doc_id", "text_md5").eqNullSafe(F.col("component"))
    decided = cut(grouped.join(classes.select("key", "component"), "key").select("doc_id", "text_md5", "n", chosen.alias("chosen")).where("not chosen or n > 1"))
    gone = decided.where("not chosen").select(F.col("doc_id").alias(id_), F.col("text_md5").alias(digest))
    again = decided.where("chosen").select(F.col("doc_id").alias(id_), F.col("text_md5").alias(digest), F.lit(True).alias(seen))
    few = decided.count() * 64 <= BROADCAST_BYTES
    gone, again = (F.broadcast(gone), F.broadcast(again)) if few else (gone, again)
    left = documents.withColumn(id_, made).withColumn(digest, md5).join(gone, [id_, digest], "left_anti").join(again, [id_, digest], "left")
    once = left.where(F.col(seen).isNull()).select(*map(quoted, documents.columns))
    if not decided.where("chosen").take(1):
        return once
    return once.unionByName(left.where(F.col(seen)).dropDuplicates([id_, digest]).select(*map(quoted, documents.columns)))

