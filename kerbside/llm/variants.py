"""Spelling variants by an index of variable-length grams.

Words are counted over the corpus; two are near if they differ by one inserted, deleted or
replaced code point. Near words are found exactly, without comparing all words:

1. Grams of two to ``LONGEST`` code points are counted over the distinct words, with a mark
   at both ends. The dictionary holds all pairs, and longer grams only behind a frequent
   one: frequent lists are cut up, rare ones stay whole. Its size is bounded by the alphabet
   and ``FREQUENT_GRAMS``, not by the words.
2. A word falls into the longest gram of the dictionary at each place, less those inside the
   gram before. For every possible edit the dictionary tells which of these grams it can
   affect: those over the place, those that could grow over it, those that a gram from
   beyond it could swallow. ``affected`` is the largest number of them; all others are, at
   the same or the next place, grams of every near word.
3. So near words share one of their ``affected + 1`` rarest grams, and only these lists are
   merged: by gram, length and place. Lists of frequent grams are cut further by the half of
   the word that the edit does not touch. Pairs of two words all of whose grams one edit
   can affect have no list; they meet by halves alone.
4. Words that meet are verified letter by letter, in blocks.

The form of a word is its near word with the largest count, if that is ``RATIO`` times its
own; forms are followed by doubling steps, as many as counts allow.

Cases: a null text has no words. A null id is the empty string where damage is drawn.
Repeated rows count as often as they occur. Ties of counts go to the word that is smallest
in code points. An empty table, or one without words, gives an empty result. Other columns
are ignored. Words may be of any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.llm.common import slices, write_table

#: A word has so many code points and occurrences at least; a form is so many times as frequent.
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5

#: Longest gram, and how many grams of a length can count as frequent at most.
LONGEST, FREQUENT_GRAMS = 4, 4096

#: A gram in more words than this has its lists cut by halves of words.
LONG_LIST = 4096

#: Rows compared at a time, and how many code points are compared as a table; longer words one by one.
BLOCK, WIDTH = 50_000, 64

#: Fixed value: one run in so many loses a letter, as the contract of the query has it.
DAMAGED = 199

_ASCII = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def count_words(docs: DataFrame) -> DataFrame:
    """``word, n``: what runs of letters become by damage, long and frequent enough. Words are
    Latin-1 bytes, whose order is that of code points."""
    runs = F.regexp_extract_all(F.translate("text", *_ASCII), F.lit(rf"[a-zÀ-ÿ]{{{LEAST_LENGTH},}}+"), F.lit(0))
    one = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    run, fate = F.col("run"), F.crc32(F.concat("id", F.lit(":"), "run"))
    at = (fate % F.length(run)).cast("int")
    word = F.when(fate % DAMAGED == 0, F.concat(run.substr(F.lit(1), at), run.substr(at + 2, F.length(run)))).otherwise(run)
    return one.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n")) \
        .filter((F.col("n") >= LEAST_COUNT) & (F.length("word") >= LEAST_LENGTH)) \
        .select(F.encode("word", "ISO-8859-1").alias("word"), "n")


class Grams:
    """The dictionary: grams from rare to frequent, and what an edit beside a gram can do."""

    def __init__(self, counts: dict[str, int]) -> None:
        self.rank = {g: k for k, g in enumerate(sorted(counts, key=lambda g: (counts[g], g)))}
        self.long_lists = {g for g, n in counts.items() if n > LONG_LIST}
        self.grows = {g[:-1] for g in counts if len(g) > 2}
        self.swallowed = {g[k:] for g in counts for k in range(1, len(g))}

    def parts(self, marked: str) -> list[tuple[str, int]]:
        """Grams and places of a marked word."""
        out, end, n, rank = [], 0, len(marked), self.rank
        for p in range(n - 1):
            e = p + 2
            while e < n and e - p < LONGEST and marked[p:e + 1] in rank:
                e += 1
            if e > end:
                out.append((marked[p:e], p))
                end = e
        return out

    def affected(self, marked: str, parts: list[tuple[str, int]]) -> int:
        """How many grams one edit can affect at most. A site is a code point that is replaced
        or deleted, or one before which another is inserted; the marks stay."""
        n = len(marked)
        replaced, inserted = [0] * (n + 1), [0] * (n + 1)
        for gram, p in parts:
            e = p + len(gram)
            for i in range(p, e):
                replaced[i] += 1
            for i in range(p + 1, e):
                inserted[i] += 1
            if len(gram) < LONGEST and gram in self.grows:
                replaced[e] += 1
                inserted[e] += 1
            for i in range(max(1, e - LONGEST), p):
                replaced[i] += marked[i + 1:e] in self.swallowed
            for i in range(max(1, e - LONGEST + 1), p + 1):
                inserted[i] += marked[i:e] in self.swallowed
        return max(max(replaced[1:n - 1]), max(inserted[1:n]))

    def lists(self, word: str) -> list[tuple[int, bool]]:
        """The lists a word is in, and whether as the longer one of a pair. A list is for the
        length of the shorter word and the place in it."""
        marked, n = f"<{word}>", len(word)
        parts = self.parts(marked)
        affected = self.affected(marked, parts)
        parts.sort(key=lambda part: (self.rank[part[0]], part[1]))
        out: list[tuple[int, bool]] = []

        def add(longer: bool, *name: object) -> None:
            out.append((xxhash.xxh3_64_intdigest("\0".join(map(str, name))) - (1 << 63), longer))

        def halves(size: int) -> tuple[tuple[str, str], tuple[str, str]]:
            return ("first", word[:size // 2]), ("last", word[n - (size - size // 2):])

        for gram, p in parts[:affected + 1]:
            for longer, size, place in ((False, n, p), (True, n - 1, p), (True, n - 1, p - 1)):
                if gram in self.long_lists:
                    for half in halves(size):
                        add(longer, gram, size, place, *half)
                else:
                    add(longer, gram, size, place)
        if affected >= len(parts):
            for longer, size in ((False, n), (True, n - 1)):
                for half in halves(size):
                    add(longer, "", size, *half)
        return out


def gram_counts(words: DataFrame) -> dict[str, int]:
    """The dictionary's grams and in how many places of words each lies: pairs, and longer
    grams that extend a frequent one. Bounded by the alphabet, whatever the words."""
    marked = F.concat(F.lit("<"), F.decode("word", "ISO-8859-1"), F.lit(">"))

    def of_size(q: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length("marked") - (q - 1)), lambda i: F.col("marked").substr(i, F.lit(q)))

    grams = words.select(marked.alias("marked")).select(
        F.explode(F.concat(*[of_size(q) for q in range(2, LONGEST + 1)])).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    grams = words.sparkSession.read.parquet(write_table(grams, "grams"))
    places = grams.filter(F.length("gram") == 2).agg(F.sum("n")).first()[0] or 0
    least = max(places // FREQUENT_GRAMS, 8)
    # Of each length at most FREQUENT_GRAMS grams lie in more places than that.
    frequent = F.broadcast(grams.filter((F.col("n") > least) & (F.length("gram") < LONGEST)).select(F.col("gram").alias("head")))
    head = F.col("gram").substr(F.lit(1), F.length("gram") - 1)
    rows = grams.filter("length(gram) = 2").unionByName(
        grams.filter("length(gram) > 2 and n > 1").join(frequent, head == F.col("head"), "left_semi"))
    return {r["gram"]: r["n"] for r in rows.collect()}


def near(a: bytes, b: bytes) -> bool:
    """Whether two different words are one edit apart."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[k + (len(a) == len(b)):] == b[k + 1:]


def near_pairs(keys: np.ndarray, words: list[bytes], longer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of near words that share a list. ``keys`` is sorted; two longer ones of a list
    are not compared."""
    n = len(keys)
    lengths = np.fromiter(map(len, words), np.int64, n)
    width = int(min(WIDTH, lengths.max(initial=1))) + 1
    table = np.zeros((n, width), np.uint8)
    flat = np.frombuffer(b"".join(w[:width] for w in words), np.uint8)
    table[np.arange(width) < lengths[:, None]] = flat
    ends = np.searchsorted(keys, keys, "right")
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]

    def verify(i: np.ndarray, j: np.ndarray) -> None:
        keep = ~(longer[i] & longer[j])
        i, j = i[keep], j[keep]
        i, j = np.where(lengths[i] <= lengths[j], i, j), np.where(lengths[i] <= lengths[j], j, i)
        more = lengths[j] - lengths[i]
        wide = lengths[j] >= width
        same = (more == 0) & ~wide
        equal = table[i[same]] != table[j[same]]
        fits = np.zeros(len(i), bool)
        fits[same] = equal.sum(1) == 1
        one = (more == 1) & ~wide
        a, b = table[i[one]], table[j[one]]
        inside = np.arange(width) < lengths[i[one]][:, None]
        first = np.argmax(np.concatenate([(a != b) & inside, np.ones((len(a), 1), bool)], 1), 1)
        shifted = np.zeros_like(b)
        shifted[:, :-1] = b[:, 1:]
        wrong = (a != shifted) & inside & (np.arange(width) >= first[:, None])
        fits[one] = ~wrong.any(1)
        for k in np.flatnonzero(wide):
            fits[k] = near(words[i[k]], words[j[k]])
        left.append(i[fits])
        right.append(j[fits])

    alive, step, todo, size = np.arange(n), 1, [], 0
    while len(alive := alive[alive + step < ends[alive]]):
        todo.append((alive, alive + step))
        size += len(alive)
        step += 1
        if size >= BLOCK:
            verify(*(np.concatenate(x) for x in zip(*todo, strict=True)))
            todo, size = [], 0
    if todo:
        verify(*(np.concatenate(x) for x in zip(*todo, strict=True)))
    return np.concatenate(left), np.concatenate(right)


def near_words(words: DataFrame) -> DataFrame:
    """``word, n, near, near_n``: every pair of near words, in both directions."""
    grams = Grams(gram_counts(words))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            lists = [grams.lists(w.decode("latin-1")) for w in b.column("word").to_pylist()]
            owner = pa.array(np.repeat(np.arange(b.num_rows), [len(x) for x in lists]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for x in lists for k, _ in x], pa.int64()), pa.array([k for x in lists for _, k in x], pa.bool_()),
                 b.column("word").take(owner), b.column("n").take(owner)], ["list", "longer", "word", "n"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(t: pa.Table) -> pa.RecordBatch:
            words, n = t.column("word").to_pylist(), t.column("n").to_numpy()
            i, j = near_pairs(t.column("list").to_numpy(), words, t.column("longer").to_numpy())
            swap = np.array([words[x] > words[y] for x, y in zip(i, j, strict=True)], bool)
            i, j = np.where(swap, j, i).astype(np.int64), np.where(swap, i, j).astype(np.int64)
            found = {(words[x], words[y], n[x], n[y]) for x, y in zip(i, j, strict=True)}
            columns = list(zip(*found, strict=True)) or [()] * 4
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.binary(), pa.int64(), pa.int64()), strict=True)],
                ["a", "b", "a_n", "b_n"])

        waiting: list[pa.RecordBatch] = []
        for b in batches:
            waiting.append(b)
            if sum(w.num_rows for w in waiting) < BLOCK:
                continue
            t = pa.Table.from_batches(waiting).combine_chunks()
            keys = t.column("list").to_numpy()
            whole = int(np.searchsorted(keys, keys[-1]))
            waiting = t.slice(whole).to_batches()
            if whole:
                yield pairs(t.slice(0, whole))
        if waiting:
            yield pairs(pa.Table.from_batches(waiting))

    lists = words.mapInArrow(index, "list bigint, longer boolean, word binary, n bigint")
    pairs = lists.repartition("list").sortWithinPartitions("list").mapInArrow(
        merge, "a binary, b binary, a_n bigint, b_n bigint").distinct()
    both = F.array(*[F.struct(F.col(x).alias("word"), F.col(f"{x}_n").alias("n"), F.col(y).alias("near"), F.col(f"{y}_n").alias("near_n"))
                     for x, y in (("a", "b"), ("b", "a"))])
    return pairs.select(F.explode(both).alias("p")).select("p.*")


def roots(forms: DataFrame, largest: int) -> DataFrame:
    """``word, root`` from ``word, form``: counts grow ``RATIO``-fold with each form, so the
    largest count bounds the steps, and every round doubles them."""
    spark = forms.sparkSession
    reach = forms.select("word", F.col("form").alias("root"))
    steps, done = 1, 1
    while RATIO ** steps <= largest:
        steps += 1
    while done < steps:
        reach = spark.read.parquet(write_table(reach, "roots"))
        beyond = reach.select(F.col("word").alias("root"), F.col("root").alias("next"))
        reach = reach.join(beyond, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
        done *= 2
    return reach


def group_variants(words: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of all words of ``word, n`` (Latin-1 bytes)."""
    spark = words.sparkSession
    words = spark.read.parquet(write_table(words, "words"))
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), "near"))
    met = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    joined = words.join(met, "word", "left")
    is_form = -F.col("best.minus") >= RATIO * F.col("n")
    table = spark.read.parquet(write_table(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"),
        F.when(is_form, -F.col("best.minus")).alias("form_n")), "word-forms"))
    largest = words.agg(F.max("n")).first()[0] or 1
    rooted = table.join(roots(table.filter("form is not null").select("word", "form"), largest), "word", "left")

    def text(c: str) -> Column:
        return F.decode(c, "ISO-8859-1").alias(c)

    return rooted.withColumn("root", F.coalesce("root", "word")).select(
        text("word"), text("form"), text("root"), "n", "n_near", "form_n")
