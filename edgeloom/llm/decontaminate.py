"""Benchmark decontamination: a prefix-filtered set join, in DataFrame operations only.

Every benchmark item gives its windows of WINDOW words (a shorter item is one window); equal
windows of any items are one, and items are attached to what was found at the end.  A window's
word shingles are put in order of rarity - by the least count of their words over the whole
corpus, which bounds a shingle's own - and only the rarest, the prefix that containment
makes necessary, is joined with the documents' shingles; a window with a word that the corpus
doesn't have is out at once.  A meeting fixes where the window would have to start: positional
and length bounds drop it if it wouldn't fit, and the words themselves are compared for the rest.

Joined tables derive from the benchmark alone.  Up to BLOCK_ROWS rows they are broadcast; a
larger benchmark's prefixes meet the documents' shingles in a shuffled join, whose candidates
are then verified at the texts.

Defined results: a null or wordless text has no words, no hits and isn't contaminated; a
null or wordless item has no window; items that share an id count once, and an item
without an id is left out of the list of items though its words are hits; rows that share
a doc_id (or have none) are told apart by their texts, each judged by itself; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.frames import cut, fresh_name, text_md5

WINDOW, SHINGLE = 13, 5
#: Rows and bytes of words up to which a table of the benchmark is broadcast.
BLOCK_ROWS = 200_000
BROADCAST_BYTES = 32_000_000
#: Contaminated from this share of hit words: one in SHARE.
SHARE = 20

_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAPS_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text: A-Z lower-cased, split where ASCII is neither letter nor digit."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _CAPITALS, _SMALL), _GAPS), "")


def shingle(w: Column, at: Column, k: int) -> Column:
    """The hash of the k words from place `at` on."""
    return F.xxhash64(F.lit(k), *[F.get(w, at + j) for j in range(k)])


def windows(benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(wid, win, n, k and sid of every distinct window: its words, their number, the size of its shingles, its set of items; sid and items)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - window + 1))
    every = items.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, window))).alias("win"))
    whole = every.groupBy("win").agg(F.array_sort(F.collect_set("item")).alias("items"))
    sid, wid = F.md5(F.to_json("items").cast("binary")), F.md5(F.array_join("win", " ").cast("binary"))
    whole = cut(whole.select(wid.alias("wid"), "win", F.size("win").alias("n"), F.least(F.lit(SHINGLE), F.size("win")).alias("k"), sid.alias("sid"), "items"))
    return whole.drop("items"), whole.groupBy("sid").agg(F.first("items").alias("items"))


def _is_small(df: DataFrame, size: Column) -> bool:
    count, taken = df.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return count <= BLOCK_ROWS and taken <= BROADCAST_BYTES


def _prefixes(documents: DataFrame, wins: DataFrame) -> DataFrame:
    """h, off, wid, win, n and k: the rarest shingle of every window whose words the corpus has."""
    vocabulary = wins.select(F.explode("win").alias("word")).distinct()
    seen = documents.select(F.explode(words(F.col("text"))).alias("word"))
    if _is_small(vocabulary, F.octet_length("word")):
        seen = seen.join(F.broadcast(vocabulary), "word")
    often = vocabulary.join(seen.groupBy("word").agg(F.count("*").alias("often")), "word", "left")
    placed = wins.select("wid", F.posexplode("win").alias("at", "word")).join(often, "word")
    counts = placed.groupBy("wid").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("often", F.lit(0)).alias("often")))).alias("c"))
    counts = counts.select("wid", F.transform("c", lambda x: x["often"]).alias("c")).where(F.array_min("c") > 0)
    rarest = F.array_min(F.transform(F.sequence(F.lit(0), F.col("n") - F.col("k")), lambda i: F.struct(F.array_min(F.slice("c", i + 1, F.col("k"))).alias("often"), i.alias("off"))))
    return wins.join(counts, "wid").select("wid", "win", "n", "k", rarest["off"].alias("off"))


def occurrences(documents: DataFrame, wins: DataFrame) -> DataFrame:
    """doc_id, text_md5, start (0-based word), n and sid of every occurrence of a window in a document."""
    prefix = cut(_prefixes(documents, wins.drop("sid")))
    sizes = [r["k"] for r in prefix.select("k").distinct().collect()]  # at most SHINGLE of them
    found = None
    for k in sorted(sizes):
        mine = prefix.where(F.col("k") == k).select(shingle(F.col("win"), F.col("off"), k).alias("h"), "off", "wid", "win", "n")
        texts = documents.select("doc_id", text_md5().alias("text_md5"), words(F.col("text")).alias("w")).where(F.size("w") >= k)
        placed = texts.select("doc_id", "text_md5", "w", F.explode(F.sequence(F.lit(0), F.size("w") - k)).alias("pos"))
        start = F.col("pos") - F.col("off")
        fits = (start >= 0) & (start + F.col("n") <= F.size("w"))
        if _is_small(mine, F.octet_length(F.array_join("win", " "))):
            near = placed.withColumn("h", shingle(F.col("w"), F.col("pos"), k)).join(F.broadcast(mine), "h").where(fits)
        else:
            hashed = placed.select("doc_id", "text_md5", "pos", F.size("w").alias("size"), shingle(F.col("w"), F.col("pos"), k).alias("h"))
            near = hashed.join(mine.drop("win"), "h").where((start >= 0) & (start + F.col("n") <= F.col("size")))
            near = near.select(F.col("doc_id").alias("_id"), F.col("text_md5").alias("_md5"), "pos", "off", "wid").distinct().join(mine.select("wid", "win", "n"), "wid")
            near = texts.join(near, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_md5") == F.col("_md5")))
        same = F.slice("w", start + 1, F.col("n")) == F.col("win")
        part = near.where(same).select("doc_id", "text_md5", start.alias("start"), "n", "wid")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = documents.limit(0).select("doc_id", text_md5().alias("text_md5"), F.lit(0).alias("start"), F.lit(0).alias("n"), F.lit("").alias("wid"))
    sids = wins.select("wid", "sid")
    return found.distinct().join(F.broadcast(sids) if _is_small(sids, F.lit(64)) else sids, "wid").drop("wid")


def hits(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text_md5, n_hit and items (ids as sorted strings) of every text with an occurrence."""
    wins, sets = windows(benchmark, window)
    found = cut(occurrences(documents, wins))
    covered = F.size(F.array_distinct(F.flatten(F.transform(F.collect_set(F.struct("start", "n")), lambda s: F.sequence(s["start"], s["start"] + s["n"] - 1)))))
    per = found.groupBy("doc_id", "text_md5").agg(covered.cast("long").alias("n_hit"))
    listed = found.select("doc_id", "text_md5", "sid").distinct().join(sets, "sid").select("doc_id", "text_md5", F.explode("items").alias("item"))
    listed = listed.groupBy("doc_id", "text_md5").agg(F.array_sort(F.collect_set("item")).alias("items"))
    listed = listed.select(F.col("doc_id").alias("_id"), F.col("text_md5").alias("_md5"), "items")
    per = per.join(listed, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_md5") == F.col("_md5")), "left")
    return per.select("doc_id", "text_md5", "n_hit", F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (ids as sorted strings) and contaminated of every document row."""
    per = hits(documents, benchmark, window).select(F.col("doc_id").alias("_id"), F.col("text_md5").alias("_md5"), "n_hit", "items")
    counted = documents.select("doc_id", text_md5().alias("text_md5"), F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), _GAPS_ANY_CASE), "")).cast("long").alias("n_words"))
    out = counted.join(per, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_md5") == F.col("_md5")), "left")
    out = out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return out.withColumn("n_items", F.size("items").cast("long")).withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """The documents, all columns, that aren't contaminated; only texts with a hit are counted."""
    id_, digest = fresh_name(documents, "_id"), fresh_name(documents, "_digest")
    found = cut(hits(documents, benchmark, window).select(F.col("doc_id").alias(id_), F.col("text_md5").alias(digest), "n_hit"))
    few = found.count() * 64 <= BROADCAST_BYTES
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (text_md5() == F.col(digest))
    n_words = F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), _GAPS_ANY_CASE), ""))
    suspects = documents.select("doc_id", "text").join(F.broadcast(found) if few else found, same)
    bad = cut(suspects.where(share * F.col("n_hit") >= n_words).select(id_, digest).distinct())
    return documents.join(F.broadcast(bad) if few else bad, same, "left_anti")
