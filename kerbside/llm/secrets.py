"""Secret scan with corpus-wide ownership frequency, in column expressions alone.

Patterns of two strengths find candidates. Base kinds always count. Weak kinds, that is
key-like strings without a telling name, count if their value looks owner-specific: hashes of
all candidate values are counted over the whole corpus by distinct repositories and distinct
owners, and what many owners or very many repositories hold is a copied example, not a live
credential. Every found span says which of both it is.

A document is a repository and its source the owner; both are parameters. Positions count
code points from 0, ends are exclusive. They come from the lengths of what lies between
matches, since the built-in functions return matches only.

Cases: a null text is empty and has no spans. Null owners and null repositories count as one
owner or repository each. Repeated rows have results of their own; the same row twice is one
repository. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.llm.common import write_table


@dataclass(frozen=True)
class Kind:
    """A pattern; ``value`` is the group that holds the secret, ``least`` its least length,
    ``holds`` what the whole secret must have in it, however long it is."""

    name: str
    pattern: str
    value: int = 0
    least: int = 1
    base: bool = True
    holds: tuple[str, ...] = ()


#: The base kinds, in the order in which ties of a start are listed. Runs of a
#: class that are too short are left out by the pattern itself where that changes nothing.
BASE = (
    Kind("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Kind("access", r"AKIA[A-Z0-9]{16,}"),
    Kind("hex", r"[0-9a-f]{24,}"),
)

#: Key-like strings that count only if owner-specific: known prefixes, signed tokens, and long
#: runs of letters and digits that mix cases and digits.
WEAK = (
    Kind("prefixed", r"\b(?:gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk_live_|rk_live_|sk-|AIza)[A-Za-z0-9_-]{16,}", base=False),
    Kind("signed", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", base=False),
    Kind("opaque", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}", base=False, holds=("[a-z]", "[A-Z]", "[0-9]")),
)

KINDS = BASE + WEAK

#: From so many owners, or so many repositories, on a value is a copied example.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 3, 20

_SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


#: Entries of a block in which running values are folded: a fold copies its list at every step.
BLOCK = 256


def _with(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` and lambdas inside it use it."""
    return F.transform(F.array(value), f)[0]


def _running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """What ``combine`` makes of the first 1, 2, .. entries of an array of int, as an array.

    Each block is folded by itself, then the blocks' last values, and every entry meets what
    the blocks before it gave, so that the work grows with the array and not with its square.
    """
    def fold(entries: Column) -> Column:
        return F.aggregate(F.slice(entries, 2, F.size(entries)), F.slice(entries, 1, 1),
                           lambda done, v: F.array_append(done, combine(F.element_at(done, -1), v)))

    def blocked(all_values: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(all_values), F.lit(BLOCK))
        return F.transform(starts, lambda s: fold(F.slice(all_values, s, BLOCK)))

    def joined(blocks: Column) -> Column:
        ends = fold(F.transform(blocks, lambda e: F.element_at(e, -1)))
        return _with(ends, lambda before: F.flatten(F.transform(blocks, lambda e, k: F.when(k == 0, e).otherwise(
            _with(F.get(before, k - 1), lambda v: F.transform(e, lambda x: combine(v, x)))))))

    none = F.array().cast("array<int>")
    return _with(values, lambda v: F.when(F.size(v) == 0, none).when(F.size(v) <= BLOCK, fold(v)).otherwise(
        _with(blocked(v), joined)))


def _spans_of(text: Column, k: int, kind: Kind) -> Column:
    """``start, kind, end, value`` of every match, by running sums over the gaps between matches."""
    pattern = F.lit(kind.pattern)
    gaps = F.transform(F.split(text, kind.pattern, -1), lambda g: F.length(g))
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    values = F.regexp_extract_all(text, pattern, F.lit(kind.value)) if kind.value else matches
    # The last gap has no match after it, and no value then.
    rows = F.filter(F.zip_with(
        gaps, F.arrays_zip(matches.alias("match"), values.alias("value")),
        lambda g, m: F.struct(g.alias("gap"), F.length(m["match"]).alias("size"), m["value"].alias("value"))),
        lambda r: r["size"].isNotNull())

    def spans(r: Column) -> Column:
        ends = _running(F.transform(r, lambda m: m["gap"] + m["size"]), lambda x, y: x + y)
        return F.zip_with(r, ends, lambda m, end: F.struct(
            (end - m["size"]).alias("start"), F.lit(k).alias("kind"), end.alias("end"), m["value"].alias("value")))

    def counts(s: Column) -> Column:
        fits = F.length(s["value"]) >= kind.least
        for c in kind.holds:
            fits = fits & s["value"].rlike(c)
        return fits

    return F.when(text.rlike(kind.pattern), F.filter(_with(rows, spans), counts)).otherwise(F.array().cast(_SPAN))


def _apart(found: Column, others: Column) -> Column:
    """The spans of ``found`` that touch none of ``others``, in order: along all spans by start,
    the farthest end of others so far lies before a span that is apart, and the next start of
    others, sought from the back, behind it."""
    def kept(f: Column, o: Column) -> Column:
        line = F.array_sort(F.concat(
            F.transform(o, lambda s: F.struct(s["start"].alias("start"), F.lit(0).alias("own"), s["end"].alias("end"), s.alias("span"))),
            F.transform(f, lambda s: F.struct(s["start"].alias("start"), F.lit(1).alias("own"), s["end"].alias("end"), s.alias("span")))))

        def swept(spans: Column) -> Column:
            reach = _running(F.transform(spans, lambda s: F.when(s["own"] == 0, s["end"]).otherwise(-1)), F.greatest)
            last = F.lit(2 ** 31 - 1)
            upcoming = F.reverse(_running(F.reverse(F.transform(
                spans, lambda s: F.when(s["own"] == 0, s["start"]).otherwise(last))), F.least))
            marked = F.zip_with(spans, F.arrays_zip(reach.alias("reach"), upcoming.alias("next")), lambda s, m: F.struct(
                s["span"].alias("span"),
                ((s["own"] == 1) & (m["reach"] <= s["start"]) & (m["next"] >= s["end"])).alias("clear")))
            return F.transform(F.filter(marked, lambda m: m["clear"]), lambda m: m["span"])

        return _with(line, swept)

    return _with(found, lambda f: _with(others, lambda o: F.when((F.size(f) == 0) | (F.size(o) == 0), f).otherwise(kept(f, o))))


def candidate_spans(text: Column) -> Column:
    """All candidate spans of a text, by start and kind. Weak ones that touch a base span, or
    a weak one of an earlier kind, are left out. The work grows with the number of matches."""
    text = F.coalesce(text, F.lit(""))
    base = F.concat(*[_spans_of(text, k, kind) for k, kind in enumerate(KINDS) if kind.base])
    weak = F.concat(*[_spans_of(text, k, kind) for k, kind in enumerate(KINDS) if not kind.base])

    def of_kind(alone: Column, k: int) -> Column:
        return _apart(F.filter(alone, lambda w: w["kind"] == k), F.filter(alone, lambda w: w["kind"] < k))

    def settled(b: Column, alone: Column) -> Column:
        kept = [of_kind(alone, k) for k in range(len(BASE), len(KINDS))]
        return F.when(F.size(alone) == 0, F.array_sort(b)).otherwise(F.array_sort(F.concat(b, *kept)))

    return _with(base, lambda b: _with(_apart(weak, b), lambda alone: settled(b, alone)))


def ownership(values: DataFrame) -> DataFrame:
    """``digest, owners, repositories`` from rows of ``digest, owner, repository``.

    Rows are combined on the map side by all three columns first, so that a value held by a
    third of all documents reaches the last step as one row per owner and task.
    """
    held = values.groupBy("digest", "owner", "repository").agg(F.lit(1).alias("one"))
    by_owner = held.groupBy("digest", "owner").agg(F.count("*").alias("n"))
    return by_owner.groupBy("digest").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"))


def find_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    owner_col: str = "source", repository_col: str = "doc_id",
    example_owners: int = EXAMPLE_OWNERS, example_repositories: int = EXAMPLE_REPOSITORIES,
) -> DataFrame:
    """``doc_id, spans``: per row its spans ``start, kind, end, digest, live``, sorted.

    Candidates are written once, without the texts; all further steps read that small table.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(owner_col).cast("string").alias("owner"),
        F.col(repository_col).cast("string").alias("repository"),
        F.transform(candidate_spans(F.col(text_col)), lambda s: F.struct(
            s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"),
            F.sha2(s["value"], 256).alias("digest"))).alias("spans"))
    table = spark.read.parquet(write_table(
        rows.withColumn("row_key", F.monotonically_increasing_id()), "secret-candidates"))
    single = table.select("row_key", "doc_id", "owner", "repository", F.explode("spans").alias("s")) \
        .select("row_key", "doc_id", "owner", "repository", "s.*")
    verdict = spark.read.parquet(write_table(ownership(single), "secret-owners")).select(
        "digest", ((F.col("owners") < example_owners) & (F.col("repositories") < example_repositories)).alias("live"))
    is_base = F.col("kind") < len(BASE)
    judged = single.join(verdict, "digest").filter(is_base | F.col("live"))
    span = F.struct("start", "kind", "end", "digest", "live")
    found = judged.groupBy("row_key").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    some = table.filter(F.size("spans") > 0).select("row_key", "doc_id").join(found, "row_key", "left")
    none = F.array().cast("array<struct<start:int,kind:int,end:int,digest:string,live:boolean>>")
    return some.select("doc_id", F.coalesce("spans", none).alias("spans")).unionByName(
        table.filter(F.size("spans") == 0).select("doc_id", none.alias("spans")))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k.name) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_digests(found: DataFrame) -> DataFrame:
    """Counts per base kind, the digest of the base spans and the list of all spans."""
    def count(keep: Callable[[Column], Column]) -> Column:
        return F.size(F.filter("spans", keep)).cast("bigint")

    def of_kind(k: int) -> Column:
        return count(lambda s: s["kind"] == k)

    return found.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        *[of_kind(k).alias(f"n_{kind.name}") for k, kind in enumerate(BASE)],
        F.sha2(_listed(F.filter("spans", lambda s: s["kind"] < len(BASE))), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
        count(lambda s: s["live"]).alias("n_live"), count(lambda s: ~s["live"]).alias("n_example"))


#: What stands for a removed secret.
MASK = "[SECRET]"


def redact(docs: DataFrame, mask: str = MASK) -> DataFrame:
    """The rows with every found secret in ``text`` replaced by ``mask``; all columns stay.

    Verdicts come from the counts over all candidates, as in ``find_secrets``. Rows are written
    once with their candidates, so that patterns are sought once. Rows without weak candidates
    need no verdict; the few others meet those on their values.
    """
    spark, columns = docs.sparkSession, docs.columns
    text = F.coalesce(F.col("text"), F.lit(""))
    spans, key = "_secret_spans", "_secret_key"
    with_spans = spark.read.parquet(write_table(
        docs.withColumn(spans, candidate_spans(F.col("text"))).withColumn(key, F.monotonically_increasing_id()), "secret-rows"))
    weak = F.exists(spans, lambda s: s["kind"] >= len(BASE))
    values = with_spans.select(
        F.col("source").cast("string").alias("owner"), F.col("doc_id").cast("string").alias("repository"),
        F.explode(spans).alias("s")) \
        .select("owner", "repository", F.sha2("s.value", 256).alias("digest"))
    live = spark.read.parquet(write_table(
        ownership(values).filter((F.col("owners") < EXAMPLE_OWNERS) & (F.col("repositories") < EXAMPLE_REPOSITORIES))
        .select("digest"), "secret-live"))

    def masked(found: Column) -> Column:
        merged = F.aggregate(
            found, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
            lambda state, s: F.when(s["start"] >= state["at"], F.struct(
                s["end"].alias("at"),
                F.concat(state["out"], F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.lit(mask)).alias("out")))
            .otherwise(F.struct(F.greatest(s["end"], state["at"]).alias("at"), state["out"].alias("out"))),
            lambda state: F.concat(state["out"], F.substring(text, state["at"] + 1, F.length(text))))
        return F.when(F.size(found) > 0, merged).otherwise(F.col("text"))

    plain = with_spans.filter(~weak).withColumn("text", masked(F.col(spans))).select(columns)
    doubtful = with_spans.filter(weak)
    kept_live = (
        doubtful.select(key, F.explode(F.filter(spans, lambda s: s["kind"] >= len(BASE))).alias("s"))
        .select(key, F.sha2("s.value", 256).alias("digest")).distinct().join(live, "digest")
        .groupBy(key).agg(F.collect_set("digest").alias("_secret_live")))
    joined = doubtful.join(kept_live, key, "left")
    sure = F.filter(spans, lambda s: (s["kind"] < len(BASE)) | F.coalesce(
        F.array_contains("_secret_live", F.sha2(s["value"], 256)), F.lit(False)))
    return plain.unionByName(joined.withColumn("text", masked(sure)).select(columns))
