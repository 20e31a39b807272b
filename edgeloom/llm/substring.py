"""Substring de-duplication with a log-structured fingerprint index.

Every window of WINDOW words gets a fingerprint of 88 bits: a 48-bit sort key and a 40-bit
check, from two independent hashes of the words' bytes.  Documents come in batches, in the
order of their ids.  Each slice of a batch sends its fingerprints, sorted and delta-coded, to
the key ranges; a task merges those of one range with the index's runs of historical window
hashes in the same range, and a key met before is verified on the check.  What starts later
is reported to its slice, which turns window starts into word intervals; what the range
hadn't seen becomes the batch's own run, sorted and never changed.  Runs of like size are
compacted into one, and ranges are split when they have grown.

A run is a table bucketed by range, so history is merged where it lies and isn't shuffled.
The index's state is a manifest in its folder: whoever opens the folder goes on from there,
and what a batch wrote without a manifest doesn't count.

History holds fingerprints only: whatever is in the index was there before the batch.
Within a batch the order is (doc_id, start), a null id first.  A slice sends a repeated
fingerprint once (its first), so a passage in a third of all rows costs one entry a slice.

Defined results: a null text has no words and keeps the empty text; texts shorter than a
window lose nothing; rows that repeat a doc_id are one document as far as order goes, so
they don't remove each other's words; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.llm.arrays import SPACED, Batch, release, runs, slices, trim
from edgeloom.llm.frames import cut, map_texts
from edgeloom.plans.lineage import delete, shared_folder

WINDOW = 20
KEY_BITS, CHECK_BITS = 48, 40
#: Text bytes for each key range: what one merge task holds at a time; and windows for which a range of an index is split.
RANGE_BYTES = 5_000_000
RANGE_WINDOWS = 2_000_000
#: Text bytes of a slice.
SLICE_BYTES = 4_000_000
#: Buckets of a run's table at the most; a bucket holds whole ranges.
BUCKETS = 20_000
#: Batches in which deduplicate() gives a table to its index.
BATCHES = 3
#: How a run's table is written: cells are large, so the writer looks at its size with every row, and random.
PARQUET = {"compression": "uncompressed", "parquet.enable.dictionary": "false", "parquet.block.size": str(8 << 20), "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "1", "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}
#: Executions in the index clear away their shuffle files when they end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Largest table of intervals that is broadcast; beyond it the texts are shuffled to them.
BROADCAST_BYTES = 32_000_000
_NULL_ID = -(1 << 63)


def _pack(*parts: np.ndarray) -> bytes:
    """Arrays of any integer type, each with its type and length before it."""
    out = []
    for p in parts:
        raw = np.ascontiguousarray(p).tobytes()
        out += [struct.pack("<cxxxi", p.dtype.char.encode(), len(raw)), raw]
    return b"".join(out)


def _unpack(blob: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(blob):
        kind, size = struct.unpack_from("<cxxxi", blob, at)
        out.append(np.frombuffer(blob, np.dtype(kind.decode()), size // np.dtype(kind.decode()).itemsize, at + 8))
        at += 8 + size
    return out


def _narrow(x: np.ndarray) -> np.ndarray:
    """Numbers in as few bytes each as the largest needs; how many comes first."""
    size = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    wide = np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)
    return np.concatenate([np.array([size], np.uint8), wide[:, :size].ravel()])


def _widened(packed: np.ndarray) -> np.ndarray:
    size = int(packed[0])
    wide = np.zeros(((len(packed) - 1) // size, 8), np.uint8)
    wide[:, :size] = packed[1:].reshape(-1, size)
    return wide.view("<u8").ravel()


def _sorted_blob(keys: np.ndarray, checks: np.ndarray, *more: np.ndarray) -> bytes:
    return _pack(_narrow(np.diff(keys, prepend=np.uint64(0))), _narrow(checks), *more)


def _read_blob(blob: bytes) -> tuple[np.ndarray, ...]:
    deltas, checks, *more = _unpack(blob)
    return np.cumsum(_widened(deltas), dtype=np.uint64), _widened(checks), *more


def _places(row: np.ndarray, start: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """Where windows start: the documents that occur, by their rows in the slice and ids, and for each window which and where.

    A blob carries only the documents it needs, so its size follows its windows however many ranges there are.
    """
    some, which = np.unique(row, return_inverse=True)
    known = ids[some].view(np.uint64)
    base = ids[some].min(keepdims=True)
    return _narrow(which), _narrow(start), _narrow(np.diff(some, prepend=0)), base, _narrow(known - base.view(np.uint64))


def _read_places(which: np.ndarray, start: np.ndarray, steps: np.ndarray, base: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row in the slice, first word within it, id) of each window."""
    at = _widened(which).astype(np.int64)
    ids = (_widened(known) + base.view(np.uint64)).view(np.int64)
    return np.cumsum(_widened(steps).astype(np.int64))[at], _widened(start).astype(np.int64), ids[at]


def _cuts(ranges: int) -> np.ndarray:
    """The first keys of the ranges but the first."""
    return np.array([-(-(r << KEY_BITS) // ranges) for r in range(1, ranges)], np.uint64)


def fingerprints(batch: Batch, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, checks, index of each window's first word, doc of each word, words' count by doc)."""
    starts, ends, doc = batch.words(SPACED)
    counts = np.bincount(doc, minlength=batch.n)
    n = len(starts)
    if n < window:
        z = np.zeros(0, np.uint64)
        return z, z, np.zeros(0, np.int64), doc, counts
    at = np.flatnonzero(doc[: n - window + 1] == doc[window - 1 :])
    keys, checks = (runs(batch.word_hashes(SPACED, starts, ends, seed), window)[at] for seed in (0, 1))
    return keys >> np.uint64(64 - KEY_BITS), checks >> np.uint64(64 - CHECK_BITS), at, doc, counts


def _whole(text: bytes) -> bytes:
    return hashlib.sha256(b" ".join(text.split())).digest()


def _runs(documents: DataFrame, ranges: int, window: int) -> DataFrame:
    """Rows (r, slice, kind, blob): a slice's run for each key range, and one row about its documents."""

    cuts = _cuts(ranges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name = TaskContext.get().partitionId() << 32
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                found = Batch.of_arrow(batch.column("text"))
                ids = batch.column("doc_id").fill_null(_NULL_ID).to_numpy().astype(np.int64)
                keys, checks, at, doc, counts = fingerprints(found, window)
                begin = np.cumsum(counts) - counts
                in_order = (np.diff(ids) > 0).all()  # then text order is document order
                order = np.lexsort((checks, keys)) if in_order else np.lexsort((at - begin[doc[at]], ids[doc[at]], checks, keys))
                keys, checks, at = keys[order], checks[order], at[order]
                again = np.zeros(len(keys), bool)
                again[1:] = (keys[1:] == keys[:-1]) & (checks[1:] == checks[:-1])
                if again.any():  # not one that starts where its first does: a repeated row
                    first = np.maximum.accumulate(np.where(again, 0, np.arange(len(keys))))
                    same = again & (ids[doc[at]] == ids[doc[at[first]]]) & (at - begin[doc[at]] == at[first] - begin[doc[at[first]]])
                    later, send = again & ~same, ~again | same
                else:
                    later, send = again, ~again
                local = np.sort(at[later])
                keys, checks, at = keys[send], checks[send], at[send]
                digests = b"".join(_whole(found.data[a:b].tobytes()) for a, b in zip(found.offsets, found.offsets[1:]))
                rows = [(int(name % ranges), name, 0, _pack(ids, counts, local, np.frombuffer(digests, np.uint8)))]
                row = doc[at]
                start = at - begin[row]
                edges = np.searchsorted(keys, cuts).tolist()
                for r, (a, b) in enumerate(zip([0, *edges], [*edges, len(keys)])):
                    if b > a:
                        rows.append((r, name, 1, _sorted_blob(keys[a:b], checks[a:b], *_places(row[a:b], start[a:b], ids))))
                name += 1
                for k in range(0, len(rows), 64):
                    part = list(zip(*rows[k : k + 64]))
                    yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.int64()), pa.array(part[1], pa.int64()), pa.array(part[2], pa.int32()), pa.array(part[3], pa.binary())], ["r", "slice", "kind", "blob"])
                del found, keys, checks, at, doc, row, start, order, again, later, send, rows
                trim()
        release()

    return documents.select("doc_id", "text").mapInArrow(run, "r long, slice long, kind int, blob binary")


def _merge(runs: list[tuple[int, bytes]], history: list[bytes]) -> tuple[dict[int, np.ndarray], bytes | None]:
    """(for each slice, the first words of the windows that were met before; the run of what is new)."""
    keys, checks, ids, starts, slice_, refs = [], [], [], [], [], []
    for name, blob in runs:
        key, check, *places = _read_blob(blob)
        row, start, id_ = _read_places(*places)
        keys.append(key)
        checks.append(check)
        ids.append(id_)
        starts.append(start)
        slice_.append(np.full(len(key), name))
        refs.append(row << 32 | start)
    if not runs:
        return {}, None
    known = [_read_blob(b) for b in history]
    keys = np.concatenate([*(k for k, _ in known), *keys])
    checks = np.concatenate([*(c for _, c in known), *checks])
    old = sum(len(k) for k, _ in known)
    del known
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    twin = np.zeros(len(k), bool)
    same = k[1:] == k[:-1]
    twin[1:] |= same
    twin[:-1] |= same
    some = order[twin]  # only keys that occur twice are verified
    fresh = np.ones(len(keys), bool)
    fresh[:old] = False
    del k, same, twin
    out: dict[int, np.ndarray] = {}
    if len(some):
        ids, starts, slice_, refs = (np.concatenate(x) for x in (ids, starts, slice_, refs))
        new = some >= old
        i = np.maximum(some - old, 0)
        place = np.lexsort((np.where(new, starts[i], 0), np.where(new, ids[i], 0), new, checks[some], keys[some]))
        some, new, i = some[place], new[place], i[place]
        head = np.ones(len(some), bool)
        head[1:] = (keys[some][1:] != keys[some][:-1]) | (checks[some][1:] != checks[some][:-1])
        fresh[some[~head]] = False
        first = np.maximum.accumulate(np.where(head, np.arange(len(some)), 0))
        here = new & ~head
        here &= ~(new[first] & (ids[i] == ids[i[first]]) & (starts[i] == starts[i[first]]))
        where, what = slice_[i[here]], refs[i[here]]
        place = np.lexsort((what, where))
        where, what = where[place], what[place]
        for name, a in zip(*np.unique(where, return_index=True)):
            out[int(name)] = what[a : np.searchsorted(where, name, "right")]
    order = order[fresh[order]]
    return out, _sorted_blob(keys[order], checks[order]) if len(order) else None


ROWS = "r long, slice long, kind int, blob binary"
_TYPES = (pa.int64(), pa.int64(), pa.int32(), pa.binary())


def _table(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) or [()] * 4
    return pa.table({n: pa.array(c, t) for n, c, t in zip(("r", "slice", "kind", "blob"), columns, _TYPES)})


def _merged(runs: DataFrame, history: DataFrame | None) -> DataFrame:
    """What a batch makes of every key range: rows about documents (kind 0) that pass through, reports to slices (1), its run (2)."""

    def one(table: pa.Table, old: list[bytes]) -> pa.Table:
        new, out = [], []
        for r, name, kind, blob in zip(*(table.column(c).to_pylist() for c in ("r", "slice", "kind", "blob"))):
            if kind == 0:
                out.append((r, name, 0, blob))
            else:
                new.append((name, blob))
        found, run = _merge(new, old)
        trim()
        r = table.column("r")[0].as_py() if table.num_rows else 0
        out += [(r, name, 1, _pack((ref >> 32).astype(np.uint32), (ref & 0xFFFFFFFF).astype(np.uint32))) for name, ref in found.items()]
        return _table(out + ([(r, 0, 2, run)] if run else []))

    if history is None:
        return runs.groupBy("r").applyInArrow(lambda table: one(table, []), ROWS)

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        return one(left, [b for c in right.column_names if c != "r" for b in right.column(c).to_pylist() if b is not None])

    return runs.groupBy("r").cogroup(history.groupBy("r")).applyInArrow(both, ROWS)


INTERVALS = "doc_id long, n_words long, n_removed long, whole binary, intervals binary"


def _intervals(reports: DataFrame, window: int) -> DataFrame:
    """Per document of each slice: its words, and the intervals of words to remove."""

    def one(table: pa.Table) -> pa.Table:
        found = []
        for kind, blob in zip(table.column("kind").to_pylist(), table.column("blob").to_pylist()):
            if kind == 0:
                ids, counts, local, digests = _unpack(blob)
            else:
                found.append(_unpack(blob))
        begin = np.cumsum(counts) - counts
        at = np.unique(np.concatenate([local, *(begin[row] + start for row, start in found)]))
        doc = np.searchsorted(begin + counts, at, "right")
        head = np.ones(len(at), bool)
        head[1:] = (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + window)
        tail = np.ones(len(at), bool)
        tail[:-1] = head[1:]
        a, b, owner = at[head], at[tail] + window, doc[head]
        removed = np.bincount(owner, b - a, len(ids)).astype(np.int64)
        a, b = a - begin[owner], b - begin[owner]
        edges = np.searchsorted(owner, np.arange(len(ids) + 1)).tolist()
        blobs = [_pack(a[x:y], b[x:y]) if y > x else None for x, y in zip(edges, edges[1:])]
        whole = [digests[32 * i : 32 * i + 32].tobytes() for i in range(len(ids))]
        names = pa.array(ids, pa.int64(), mask=ids == _NULL_ID)
        return pa.table({"doc_id": names, "n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(removed), "whole": pa.array(whole, pa.binary()), "intervals": pa.array(blobs, pa.binary())})

    return reports.groupBy("slice").applyInArrow(one, INTERVALS)


def ranges_of(documents: DataFrame) -> int:
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-size // RANGE_BYTES))


def _kept(text: bytes, intervals: bytes) -> bytes:
    words, out, done = text.split(), [], 0
    for a, b in zip(*_unpack(intervals)):
        out += words[done:a]
        done = b
    return b" ".join([*out, *words[done:]])


def remove(documents: DataFrame, found: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, the kept text (words joined by one space) of every row.

    `found` is what _intervals() gave, cut.  Only documents that lose words are read again,
    unless the kept texts are asked for.
    """
    touched = found.where("intervals is not null")
    if with_text:
        touched = found
    few = touched.select(F.col("doc_id").alias("_id"), "n_words", "n_removed", "whole", "intervals").dropDuplicates(["_id", "whole"])
    size = few.agg(F.sum(F.lit(64) + F.coalesce(F.octet_length("intervals"), F.lit(0)))).first()[0] or 0
    joined = documents.select("doc_id", "text").join(F.broadcast(few) if size <= BROADCAST_BYTES else few, F.col("doc_id").eqNullSafe(F.col("_id")))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for name, text, n, gone, whole, intervals in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "n_words", "n_removed", "whole", "intervals"))):
            raw = (text or "").encode()
            if _whole(raw) == whole:  # rows that share an id with another text have a row of their own
                kept = _kept(raw, intervals) if intervals else b" ".join(raw.split())
                rows.append((name, n, gone, hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None))
        columns = list(zip(*rows)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    rewritten = map_texts(joined, run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
    if with_text:
        return rewritten
    same = found.where("intervals is null").select("doc_id", "n_words", "n_removed", F.lower(F.hex("whole")).alias("kept_sha256"))
    return same.unionByName(rewritten.drop("kept"))


def deduplicate(documents: DataFrame, window: int = WINDOW, with_text: bool = False, batches: int = BATCHES) -> DataFrame:
    """The table in batches by id, each against the index of those before; see remove() for the columns."""
    spark = documents.sparkSession
    shares = [(k + 1) / batches for k in range(batches - 1)]
    bounds = (documents.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, shares)), F.lit(1000)).alias("b")).first()["b"] or []) if shares else []
    index = FingerprintIndex(spark, f"{shared_folder(spark)}/fingerprints-{uuid.uuid4().hex}", window, ranges_of(documents))
    out, at = None, None
    for bound in [*sorted(set(bounds)), None]:
        low = F.lit(True) if at is None else F.col("doc_id") >= at
        high = F.lit(True) if bound is None else F.col("doc_id") < bound
        if at is None:
            high = high | F.col("doc_id").isNull()
        part = index.add(documents.where(low & high), with_text)
        out = part if out is None else out.unionByName(part)
        at = bound
    index.drop()
    return out


class FingerprintIndex:
    """Runs in a shared folder, for documents that arrive in batches; a folder that holds an index is gone on with.

    Layout: run-<name>/ are tables (r, slice, kind, blob) bucketed by r, of which the rows of
    kind 2 are a run: for each range one sorted blob of keys and checks.  manifest-<number>.json
    names the runs that count, their tiers and the ranges; the highest number is the state.
    """

    def __init__(self, spark: SparkSession, folder: str, window: int = WINDOW, ranges: int = 1):
        self.spark, self.folder = spark, folder
        found = self._manifests()
        self.state = json.loads(self.spark.read.text(found[-1], wholetext=True).first()[0]) if found else {"number": 0, "window": window, "ranges": ranges, "runs": []}
        if self.state["window"] != window:
            raise ValueError(f"the index in {folder} has windows of {self.state['window']} words")

    @property
    def runs(self) -> list[dict]:
        """name, tier, windows and ranges of every run that counts, the oldest first."""
        return self.state["runs"]

    def _files(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _manifests(self) -> list[str]:
        where, files = self._files(self.folder)
        if not files.exists(where):
            return []
        return sorted(str(f.getPath().toString()) for f in files.listStatus(where) if f.getPath().getName().startswith("manifest-"))

    def _commit(self, runs: list[dict], **more) -> None:
        """The next state: written under another name first, so that a manifest is whole or not there."""
        old = self._manifests()
        self.state = self.state | more | {"number": self.state["number"] + 1, "runs": runs}
        draft, files = self._files(f"{self.folder}/draft-{uuid.uuid4().hex}")
        out = files.create(draft)
        out.write(bytearray(json.dumps(self.state).encode()))
        out.close()
        files.rename(draft, self._files(f"{self.folder}/manifest-{self.state['number']:08d}.json")[0])
        for path in old:
            delete(self.spark, path)

    def _buckets(self) -> int:
        return min(BUCKETS, self.state["ranges"])

    def _write(self, rows: DataFrame) -> str:
        """Writes rows as a table bucketed by range; its name."""
        name = uuid.uuid4().hex
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            rows.write.bucketBy(self._buckets(), "r").format("parquet").options(**PARQUET).option("path", f"{self.folder}/run-{name}").saveAsTable(f"edgeloom_run_{name}")
        finally:
            self.spark.conf.set(CLEANUP, before)
        return name

    def _read(self, name: str) -> DataFrame:
        if not self.spark.catalog.tableExists(f"edgeloom_run_{name}"):  # written in another session
            ranges = next((x["ranges"] for x in self.runs if x["name"] == name), self.state["ranges"])
            self.spark.sql(f"CREATE TABLE edgeloom_run_{name} (r BIGINT, slice BIGINT, kind INT, blob BINARY) USING parquet OPTIONS (path '{self.folder}/run-{name}') CLUSTERED BY (r) INTO {min(BUCKETS, ranges)} BUCKETS")
        return self.spark.table(f"edgeloom_run_{name}")

    def _forget(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS edgeloom_run_{name}")
        delete(self.spark, f"{self.folder}/run-{name}")

    def drop(self) -> None:
        """Deletes the index; results that add() gave stay."""
        for x in self.runs:
            self._forget(x["name"])
        delete(self.spark, self.folder)

    def history(self, runs: list[dict] | None = None) -> DataFrame | None:
        """r and a blob for each run (null where a run has nothing in the range): joined where the buckets lie."""
        out = None
        for k, x in enumerate(self.runs if runs is None else runs):
            one = self._read(x["name"]).where("kind = 2").select("r", F.col("blob").alias(f"blob{k}"))
            out = one if out is None else out.join(one, "r", "full")
        return out

    def add(self, documents: DataFrame, with_text: bool = False) -> DataFrame:
        """Rewrites the batch against all earlier batches and itself; its fingerprints are in the index then."""
        words = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        known = sum(x["windows"] for x in self.runs)
        wanted = self.state["ranges"]
        while wanted < max((known + words // 6) // RANGE_WINDOWS, 1):
            wanted *= 2
        if wanted > self.state["ranges"]:
            self.compact(wanted)
        runs = _runs(documents, self.state["ranges"], self.state["window"]).repartition(self._buckets(), "r")
        name = self._write(_merged(runs, self.history()))
        written = self._read(name)
        found = cut(_intervals(written.where("kind < 2").select("slice", "kind", "blob"), self.state["window"]))
        windows = found.agg(F.sum(F.greatest(F.col("n_words") - self.state["window"] + 1, F.lit(0)))).first()[0] or 0
        self._commit([*self.runs, {"name": name, "tier": 0, "windows": windows, "ranges": self.state["ranges"]}])
        while len(self.runs) > 1 and self.runs[-1]["tier"] >= self.runs[-2]["tier"]:
            self._join(self.runs[-2:])
        return remove(documents, found, with_text)

    def _join(self, runs: list[dict]) -> None:
        """One run in place of these."""
        old = self.history(runs)

        def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1)
                    yield from _table([(row.column("r")[0].as_py(), 0, 2, _one_run([c[0].as_py() for c in row.columns[1:] if c[0].is_valid]))]).to_batches()

        name = self._write(old.mapInArrow(one, ROWS))
        made = {"name": name, "tier": max(x["tier"] for x in runs) + 1, "windows": sum(x["windows"] for x in runs), "ranges": self.state["ranges"]}
        gone = {x["name"] for x in runs}
        self._commit([x for x in self.runs if x["name"] not in gone] + [made])
        for x in gone:
            self._forget(x)

    def compact(self, ranges: int | None = None) -> None:
        """One run in place of all; ranges: in so many from now on."""
        ranges = ranges or self.state["ranges"]
        if not self.runs or len(self.runs) == 1 and ranges == self.state["ranges"]:
            self.state["ranges"] = ranges
            return
        if ranges == self.state["ranges"]:
            self._join(self.runs)
            return
        cuts, runs, old = _cuts(ranges), self.runs, None
        for x in runs:
            one = self._read(x["name"]).where("kind = 2").select("blob")
            old = one if old is None else old.unionByName(one)

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for blob in batch.column("blob").to_pylist():
                    keys, checks = _read_blob(blob)
                    first, last = (int(np.searchsorted(cuts, k, "right")) for k in (keys[0], keys[-1]))
                    edges = [0, *np.searchsorted(keys, cuts[first:last]).tolist(), len(keys)]
                    yield from _table([(r, 0, 2, _sorted_blob(keys[a:b], checks[a:b])) for r, a, b in zip(range(first, last + 1), edges, edges[1:]) if b > a]).to_batches()

        def whole(table: pa.Table) -> pa.Table:
            return _table([(table.column("r")[0].as_py(), 0, 2, _one_run(table.column("blob").to_pylist()))])

        self.state["ranges"] = ranges
        parts = old.mapInArrow(split, ROWS).repartition(self._buckets(), "r")
        name = self._write(parts.groupBy("r").applyInArrow(whole, ROWS))
        self._commit([{"name": name, "tier": max(x["tier"] for x in runs) + 1, "windows": sum(x["windows"] for x in runs), "ranges": ranges}])
        for x in runs:
            self._forget(x["name"])


def _one_run(blobs: list[bytes]) -> bytes:
    keys, checks = (np.concatenate(x) for x in zip(*map(_read_blob, blobs)))
    order = np.lexsort((checks, keys))
    keys, checks = keys[order], checks[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (checks[1:] != checks[:-1])
    return _sorted_blob(keys[fresh], checks[fresh])


__all__ = ["FingerprintIndex", "deduplicate", "fingerprints", "remove"]
