"""N-gram Jaccard join by a token-group matrix, and its connected components.

A document's set holds its distinct shingles of four words. Two documents link if
``100 * intersection >= 85 * union``. Linked documents are found exactly:

1. Equal sets are one (by a 128-bit digest). Shingles that many sets hold are counted; the
   most frequent ones form a bounded table that only orders shingles: rare ones first, of
   equal ones long ones first, since few texts share those by chance.
2. In that order, linked sets share one of their first ``n - ceil(0.85 n) + 1`` shingles, so
   only these first shingles are compared over the corpus. Shingles of a single set go.
3. Sets are partitioned into groups of similar ones: each joins the set that leads most of
   its shingles (the least one that holds them). The matrix of shingles and groups holds
   each group's union of first shingles, however many members share one. For a set and a
   group, the number of its first shingles in that union bounds the overlap with every
   member; a group is opened for the sets that can reach what a link needs, no others.
4. Opened groups are compared in blocks of bounded size, by postings over whole sets. A
   block reports a spanning tree of its links, never all pairs.
5. Trees become components by alternating large and small stars.

Cases: a null text, or one without words, has no shingles and links with nothing; its
component is its own id. With fewer than four words the whole sequence is the one shingle.
Repeated rows and equal ids are members like others. Null ids take part; a component of
null ids only has a null id. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kerbside.llm.common import WordHashes, raw_texts, sequence_hashes, slices, write_table

WORDS, PERCENT = 4, 85

#: Bound of the table of frequent shingles, which orders shingles and decides nothing else.
FREQUENT = 200_000

#: Shingles counted at a time within a task; one counts as frequent there from this number on.
CHUNK, OFTEN = 1_000_000, 3

#: A set joins its leader's group if that leads at least this share of its first shingles.
LED_PERCENT = 20

#: Members and shingles per block of an opened group.
BLOCK_SETS, BLOCK_SHINGLES = 1024, 1 << 18

#: Digests a task remembers, to pass over repeated texts.
SEEN = 100_000


def shingles(text: bytes | None, hashes: WordHashes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    found = (text or b"").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    if len(found) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(found), seed=len(found))], np.uint64)
    return np.unique(sequence_hashes(hashes.of(found), tuple(range(words))))


def ordered_shingles(
    text: bytes | None, hashes: WordHashes, words: int, frequent: tuple[np.ndarray, np.ndarray],
) -> tuple[np.ndarray, np.ndarray]:
    """The sorted shingles of a text, and the same in the order common to all sets."""
    found = (text or b"").lower().split()
    tokens = shingles(text, hashes, words)
    if len(found) < words:
        return tokens, tokens
    lengths = np.convolve(np.fromiter(map(len, found), np.int64, len(found)), np.ones(words, np.int64), "valid")
    own, first = np.unique(sequence_hashes(hashes.of(found), tuple(range(words))), return_index=True)
    common, counts = frequent
    rank = np.zeros(len(own), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, own), len(common) - 1)
        rank = np.where(common[at] == own, counts[at], 0)
    return tokens, own[np.lexsort((own, -lengths[first], rank))]


def _digest(tokens: np.ndarray) -> bytes | None:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest() if len(tokens) else None


def _key(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def first_shingles(n: int, percent: int) -> int:
    """How many shingles in order a set of ``n`` shares at least one of with any linked set."""
    return n - (percent * n + 99) // 100 + 1


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")


def _write_sets(docs: DataFrame, words: int) -> DataFrame:
    """Per row its id, number of shingles and digest; beside them counts of shingles that
    a task has met often (rows with ``token``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen, chunk, size = WordHashes(), set(), [], 0
        names = ["doc_id", "text_hash", "n", "digest", "key", "token", "count"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]

        def often() -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate(chunk), return_counts=True)
            tokens, counts = tokens[counts >= OFTEN], counts[counts >= OFTEN]
            blank = [pa.nulls(len(tokens), k) for k in kinds[:5]]
            return pa.RecordBatch.from_arrays([*blank, pa.array(tokens.view(np.int64)), pa.array(counts.astype(np.int64))], names)

        for b in slices(batches):
            sizes, digests = [], []
            for text in raw_texts(b):
                tokens = shingles(text, hashes, words)
                digest = _digest(tokens)
                sizes.append(len(tokens))
                digests.append(digest)
                if digest is not None and digest not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(digest)
                    chunk.append(tokens)
                    size += len(tokens)
            nothing = [pa.nulls(b.num_rows, pa.int64())] * 2
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_hash"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                 pa.array([d and _key(d) for d in digests], pa.int64()), *nothing], names)
            if size >= CHUNK:
                yield often()
                chunk, size = [], 0
        if chunk:
            yield often()

    schema = "doc_id bigint, text_hash bigint, n bigint, digest binary, key bigint, token bigint, count bigint"
    return docs.sparkSession.read.parquet(write_table(_source(docs).mapInArrow(run, schema), "shingle-sets"))


def _frequent(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, sorted, and their counts: at most ``FREQUENT``."""
    rows = sets.filter("token is not null").groupBy("token").agg(F.sum("count").alias("n")) \
        .orderBy(F.desc("n"), "token").limit(FREQUENT).collect()
    tokens = np.array([r["token"] for r in rows], np.int64).view(np.uint64)
    counts = np.array([r["n"] for r in rows], np.int64)
    order = np.argsort(tokens)
    return tokens[order], counts[order]


def _shared_shingles(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], words: int, percent: int) -> DataFrame:
    """``token, key, leader``: first shingles that at least two sets have among theirs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(), set()
        for b in slices(batches):
            firsts, keys = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
            for text in raw_texts(b):
                tokens, ordered = ordered_shingles(text, hashes, words, frequent)
                digest = _digest(tokens)
                if digest is None or digest in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(digest)
                k = first_shingles(len(tokens), percent)
                firsts.append(ordered[:k])
                keys.append(np.full(k, _key(digest), np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(firsts).view(np.int64)), pa.array(np.concatenate(keys))], ["token", "key"])

    rows = docs.select("text").mapInArrow(run, "token bigint, key bigint")
    by_token = W.partitionBy("token")
    shared = rows.withColumn("leader", F.min("key").over(by_token)).withColumn("last", F.max("key").over(by_token)) \
        .filter("leader != last").select("token", "key", "leader").distinct()
    return docs.sparkSession.read.parquet(write_table(shared, "shared-shingles"))


def _needed(n: Column, m: Column, percent: int) -> Column:
    """Least number of common first shingles of linked sets of ``n`` and ``m`` shingles.

    They have ``percent / (100 + percent) * (n + m)`` shingles in common. All but those of the
    set whose first shingles end earlier in the order lie within both sets' first ones.
    """
    def later(x: Column) -> Column:
        return F.ceil(x * percent / 100) - 1

    return F.ceil((n + m) * percent / (100 + percent)) - F.greatest(later(n), later(m))


def _units(shared: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """``unit, key``: which sets are compared in which block of opened groups.

    ``sizes`` has ``key, n``. A unit names two groups and a block of each.
    """
    spark = shared.sparkSession
    led = shared.groupBy("key", "leader").agg(F.count("*").alias("c")) \
        .groupBy("key").agg(F.max(F.struct("c", (-F.col("leader")).alias("minus"))).alias("most"))
    firsts = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    groups = led.join(sizes, "key").select("key", "n", F.when(
        100 * F.col("most.c") >= LED_PERCENT * firsts, -F.col("most.minus")).otherwise(F.col("key")).alias("group"))
    groups = spark.read.parquet(write_table(groups, "set-groups"))
    spans = groups.groupBy("group").agg(F.min("n").alias("least"), F.max("n").alias("most"))

    members = spark.read.parquet(write_table(
        shared.select("token", "key").join(groups, "key"), "group-members"))
    matrix = members.groupBy("token", "group").agg(F.count("*").alias("held"))
    met = members.withColumnRenamed("group", "own").join(matrix, "token").filter((F.col("own") != F.col("group")) | (F.col("held") > 1))
    overlap = met.groupBy("key", "n", "own", "group").agg(F.count("*").alias("overlap")).join(spans, "group")
    n = F.col("n")
    low, high = F.greatest(F.col("least"), F.ceil(n * percent / 100)), F.least(F.col("most"), F.floor(n * 100 / percent))
    # What is needed is least at one end of the sizes, but for rounding by one in between.
    opened = overlap.filter(low <= high).filter(
        F.col("overlap") >= F.least(_needed(n, low, percent), _needed(n, high, percent)) - 1)
    pair = F.array_sort(F.array("own", "group"))
    opened = opened.select("key", "n", "own", F.get(pair, F.lit(0)).alias("g"), F.get(pair, F.lit(1)).alias("h"))
    opened = spark.read.parquet(write_table(opened, "opened"))

    blocks = opened.groupBy("g", "h", "own").agg(F.greatest(
        F.lit(1), F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    on_g, on_h = blocks.filter("own = g"), blocks.filter("own = h")
    both = on_g.select("g", "h", F.col("blocks").alias("g_blocks")).join(
        on_h.select("g", "h", F.col("blocks").alias("h_blocks")), ["g", "h"])
    placed = opened.join(both, ["g", "h"])
    own_blocks = F.when(F.col("own") == F.col("g"), F.col("g_blocks")).otherwise(F.col("h_blocks"))
    other_blocks = F.when(F.col("own") == F.col("g"), F.col("h_blocks")).otherwise(F.col("g_blocks"))
    placed = placed.select(
        "key", "g", "h", "own", F.pmod(F.xxhash64("key"), own_blocks).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), other_blocks - 1)).alias("other"))
    first = F.when(F.col("g") == F.col("h"), F.least("block", "other")).when(
        F.col("own") == F.col("g"), F.col("block")).otherwise(F.col("other"))
    second = F.when(F.col("g") == F.col("h"), F.greatest("block", "other")).when(
        F.col("own") == F.col("g"), F.col("other")).otherwise(F.col("block"))
    return placed.select(F.struct("g", first.alias("i"), "h", second.alias("j")).alias("unit"), "key")


def _links(sets: list[np.ndarray], percent: int) -> tuple[list[int], int]:
    """Roots of the trees of linked sets, and how many sets are linked with some other."""
    root = list(range(len(sets)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    sizes = np.array([len(s) for s in sets], np.int64)
    tokens, ids, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    held = counts[ids] > 1
    overlap = np.bincount(owner[held], minlength=len(sets))
    open_set = 100 * overlap >= percent * sizes
    keep = held & open_set[owner]
    ids, owner = ids[keep], owner[keep]
    order = np.argsort(ids, kind="stable")
    postings, ends = owner[order], np.searchsorted(ids[order], np.arange(len(tokens) + 1))
    bounds = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(sets)))])
    linked = 0
    for x in np.flatnonzero(open_set):
        mine = ids[bounds[x]:bounds[x + 1]]
        if not len(mine):
            continue
        common = np.bincount(np.concatenate([postings[ends[t]:ends[t + 1]] for t in mine]), minlength=len(sets))
        fits = np.flatnonzero(100 * common >= percent * (sizes + sizes[x] - common))
        linked += len(fits) > 1
        for y in fits:
            if y < x and (p := find(int(x))) != (q := find(int(y))):
                root[max(p, q)] = min(p, q)
    return [find(x) for x in range(len(sets))], linked


def _edges(docs: DataFrame, units: DataFrame, representatives: DataFrame, words: int, percent: int) -> DataFrame:
    """``a, b``: digests of linked sets, a spanning tree per unit. Texts of the sets that are
    compared, and of no others, go to their units."""
    wanted = units.select("key").distinct().join(representatives, "key")
    found = _source(docs).alias("d").join(wanted.alias("w"), (
        F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.text_hash") == F.col("w.text_hash"))))
    texts = found.select("key", "text")
    rows = units.join(texts, "key").select(
        F.col("unit.g").alias("g"), F.col("unit.i").alias("i"), F.col("unit.h").alias("h"), F.col("unit.j").alias("j"), "text")
    rows = rows.repartition("g", "i", "h", "j").sortWithinPartitions("g", "i", "h", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, current, sets = WordHashes(), None, {}

        def close() -> pa.RecordBatch:
            digests = list(sets)
            roots, _ = _links(list(sets.values()), percent) if len(digests) > 1 else ([], 0)
            pairs = [(digests[r], digests[k]) for k, r in enumerate(roots) if r != k]
            return pa.RecordBatch.from_arrays(
                [pa.array([p[k] for p in pairs], pa.binary()) for k in (0, 1)], ["a", "b"])

        for batch in slices(batches):
            names = zip(*(batch.column(c).to_pylist() for c in "gihj"), strict=True)
            for unit, text in zip(names, raw_texts(batch), strict=True):
                if unit != current and sets:
                    yield close()
                    sets = {}
                current = unit
                tokens = shingles(text, hashes, words)
                sets[_digest(tokens)] = tokens
        if sets:
            yield close()

    return rows.mapInArrow(run, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of all nodes of ``a, b``: the least node of each connected component.

    Large and small stars in turn until nothing changes; every round's edges are written.
    """
    spark = edges.sparkSession

    def stored(df: DataFrame) -> DataFrame:
        return spark.read.parquet(write_table(df, "stars"))

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    current = stored(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while (now := state(current)) != before:
        before = now
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = F.least(F.col("a"), F.min("b").over(W.partitionBy("a")))
        large = both.withColumn("m", least).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = F.min("b").over(W.partitionBy("a"))
        small = large.filter("b < a").withColumn("m", least)
        small = small.select("a", F.col("m").alias("b")).unionByName(
            small.select(F.col("b").alias("a"), F.col("m").alias("b"))).filter("a != b").distinct()
        current = stored(small)
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        current.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def join_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id, text_hash, n_shingles, digest, root, component_id`` per row of ``docs``.

    ``root`` is the least digest of a component and its identity; ids may be null or repeated.
    """
    spark: SparkSession = docs.sparkSession
    table = _write_sets(docs, words)
    sets = table.filter("token is null").drop("token", "count")
    distinct = spark.read.parquet(write_table(
        sets.filter("digest is not null").groupBy("digest", "key").agg(
            F.min(F.struct("doc_id", "text_hash")).alias("first"), F.min("doc_id").alias("least_id"), F.max("n").alias("n")),
        "distinct-sets"))
    shared = _shared_shingles(docs, _frequent(table), words, percent)
    units = spark.read.parquet(write_table(
        _units(shared, distinct.groupBy("key").agg(F.max("n").alias("n")), percent), "opened-groups"))
    representatives = distinct.select("key", "first.doc_id", "first.text_hash")
    roots = components(spark.read.parquet(write_table(
        _edges(docs, units, representatives, words, percent), "set-links")))
    rooted = distinct.join(roots, distinct["digest"] == roots["node"], "left").select(
        "digest", F.coalesce("root", "digest").alias("root"), "least_id")
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = spark.read.parquet(write_table(
        rooted.join(least, "root").select("digest", "root", "component_id"), "set-components"))
    linked = sets.filter("digest is not null").join(named, "digest")
    alone = sets.filter("digest is null").withColumn("root", F.lit(None).cast("binary")).withColumn("component_id", F.col("doc_id"))
    return linked.unionByName(alone).select(
        "doc_id", "text_hash", F.col("n").alias("n_shingles"), "digest", "root", "component_id")


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows, all columns as they are, of the least document of each component. Documents
    without words are linked with nothing and stay."""
    found = join_components(docs, words, percent).filter("digest is not null")
    per_component = found.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
    chosen = per_component.select("first.*")
    repeats = found.groupBy("doc_id", "text_hash").agg(F.count("*").alias("_rows"))
    same = chosen["doc_id"].eqNullSafe(repeats["doc_id"]) & (chosen["text_hash"] == repeats["text_hash"])
    chosen = chosen.join(repeats, same).select(
        chosen["doc_id"].alias("_kept_id"), chosen["text_hash"].alias("_kept_hash"), "_rows")
    spark = docs.sparkSession
    chosen = spark.read.parquet(write_table(chosen, "kept-documents"))

    def rows_of(some: DataFrame) -> DataFrame:
        return docs.join(some, docs["doc_id"].cast("bigint").eqNullSafe(some["_kept_id"]) & (
            F.xxhash64(docs["text"]) == some["_kept_hash"]), "left_semi")

    single = rows_of(chosen.filter("_rows = 1"))
    repeated = rows_of(chosen.filter("_rows > 1")).dropDuplicates(["doc_id", "text"])
    wordless = docs.filter(F.coalesce(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(True)))
    return single.unionByName(repeated).unionByName(wordless)
