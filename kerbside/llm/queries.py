"""The registered queries of this package and their SQL, where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from kerbside.llm import (
    bpe, conversations, language, ngram_join, packing, pages, quality, secrets, token_counts, token_matrix, topk, toxicity,
    variants,
)
from kerbside.llm.common import table
from kerbside.session import new_table_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_bpe_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op2_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality.evaluate(table(spark, sf, "documents"))


@query
def op3_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.secret_digests(secrets.find_secrets(table(spark, sf, "documents")))


@query
def op4_ngram_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_join.join_components(table(spark, sf, "documents")).select("doc_id", "n_shingles", "component_id")


@query
def op5_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.classify(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op6_concatenate_and_cut(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op9_token_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """The matrix is written; the rows come from the files."""
    return token_matrix.matrix_digests(token_matrix.written_matrix(
        table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), new_table_path(spark, "token-matrix")))


@query
def op10_language(spark: SparkSession, sf: str) -> DataFrame:
    return language.identify(table(spark, sf, "documents"))


@query
def op7_main_text(spark: SparkSession, sf: str) -> DataFrame:
    return pages.extract(table(spark, sf, "pages"))


@query
def op8_exact_top_k(spark: SparkSession, sf: str) -> DataFrame:
    return topk.top_k(table(spark, sf, "embeddings"))


@query
def op11_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    return variants.group_variants(variants.count_words(table(spark, sf, "documents")))


@query
def op12_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op13_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    return conversations.repair_digests(conversations.damage(table(spark, sf, "conversations")))


SQL["op8_exact_top_k"] = """
with v as (
  select row_number() over () as n, vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v
  from embeddings
  where vec_id is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.n, q.vec_id as query_id, c.vec_id as vec_id,
    cast(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) as bigint) as score
  from v q join v c on c.n <> q.n and len(c.v) = len(q.v)
  where q.vec_id % 100 = 0),
ranked as (
  select *, row_number() over (partition by n order by score desc, vec_id) as place from scored)
select query_id, cast(place as int) as rank, vec_id, score from ranked where place <= 10
"""


#: What the contract calls a word, and the separators that a menu has.
_WORD = r"[^\x20\x09-\x0D]+"

_PHRASES = "|".join(quality.BOILERPLATE)

SQL["op2_quality_rules"] = rf"""
with texts as (
  select row_number() over () as k, doc_id, coalesce(text, '') as text,
    regexp_extract_all(coalesce(text, ''), '{_WORD}') as w from documents),
lines as (
  select k, line, regexp_extract_all(line, '{_WORD}') as lw
  from (select k, unnest(string_split(text, chr(10))) as line from texts)),
counted as (
  select k, line, len(lw) as words, length(array_to_string(lw, '')) as chars,
    length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) as symbols,
    length(regexp_replace(line, '[^!?]', '', 'g')) as shouts,
    len(list_filter(lw, lambda x: x in ('|', '»', '›', '•', '·', '>', '/'))) as items,
    regexp_matches(line, '{_PHRASES}', 'i') as stock
  from lines where len(lw) > 0),
judged as (
  select *, (items >= 3 and 5 * items >= words) or (10 * symbols > chars and symbols >= 3)
    or (shouts >= 4 and 2 * shouts > words) or stock as failed from counted),
per_text as (
  select k, count(*) - count(distinct line) as n_dup_lines, count(*) filter (where failed) as n_failed_lines,
    coalesce(sum(chars) filter (where failed), 0) as lost_chars from judged group by 1),
windows as (
  select k, i, array_to_string(w[i:i + 7], ' ') as win
  from (select k, w, unnest(range(1, len(w) - 6)) as i from texts where len(w) >= 8)),
often as (select k, i from windows qualify count(*) over (partition by k, win) > 1),
repeated as (
  select k, count(distinct i + j) as n_repeat_words from often, (select unnest(range(0, 8)) as j) group by 1),
base as (
  select t.doc_id, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
    cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    cast(coalesce(n_dup_lines, 0) as bigint) as n_dup_lines, cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words,
    cast(coalesce(n_failed_lines, 0) as bigint) as n_failed_lines, cast(coalesce(lost_chars, 0) as bigint) as lost_chars
  from texts t left join per_text using (k) left join repeated using (k))
select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
  not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and 100 * lost_chars <= 50 * word_chars as kept from base
"""


def _spans_sql(number: int, kind: secrets.Kind, pattern: str, also: str = "true") -> str:
    """Matches of one kind with their places: the lengths of what lies between them, added up."""
    pattern = pattern.replace("'", "''")
    return f"""
  select k, {number} as kind, length(v[i]) as size, v[i] as value,
    cast(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) as int) as start,
    length(m[i]) as span
  from (select *, unnest(range(1, len(m) + 1)) as i from (
    select k, regexp_extract_all(text, '{pattern}', 0) as m, regexp_extract_all(text, '{pattern}', {kind.value}) as v,
      string_split_regex(text, '{pattern}') as g from texts where regexp_matches(text, '{pattern}')))
  where length(v[i]) >= {kind.least} and {also}"""


#: The last weak kind without looking around: a run is whole anyway, what it must hold is asked after.
_RUN = r"[A-Za-z0-9+/_-]{32,}"
_MIXED = " and ".join(f"regexp_matches(m[i], '{c}')" for c in ("[a-z]", "[A-Z]", "[0-9]"))
_BASE_KINDS = len(secrets.BASE)

SQL["op3_secret_scan"] = f"""
with texts as (
  select row_number() over () as k, doc_id, coalesce(text, '') as text, coalesce(source, chr(0)) as owner,
    coalesce(cast(doc_id as varchar), '') as repository from documents),
found as ({" union all ".join(
    _spans_sql(n, kind, _RUN if kind.name == "opaque" else kind.pattern, _MIXED if kind.name == "opaque" else "true")
    for n, kind in enumerate(secrets.KINDS))}),
spans as (select k, kind, start, start + span as stop, value from found),
alone as (
  select * from spans s where kind < {_BASE_KINDS} or not exists (
    select 1 from spans b where b.k = s.k and b.kind < {_BASE_KINDS} and s.start < b.stop and b.start < s.stop)),
candidates as (
  select * from alone s where kind < {_BASE_KINDS} or not exists (
    select 1 from alone e where e.k = s.k and e.kind >= {_BASE_KINDS} and e.kind < s.kind and s.start < e.stop and e.start < s.stop)),
owned as (
  select value, count(distinct owner) as owners, count(distinct owner || chr(1) || repository) as repositories
  from candidates join texts using (k) group by 1),
judged as (
  select *, owners < {secrets.EXAMPLE_OWNERS} and repositories < {secrets.EXAMPLE_REPOSITORIES} as live,
    {list(k.name for k in secrets.KINDS)}[kind + 1] || ':' || start || ':' || stop as item
  from candidates join owned using (value)),
kept as (select * from judged where kind < {_BASE_KINDS} or live),
per_text as (
  select k, {", ".join(f"count(*) filter (where kind = {n}) as n_{kind.name}" for n, kind in enumerate(secrets.BASE))},
    string_agg(item, ',' order by start, kind) filter (where kind < {_BASE_KINDS}) as base,
    string_agg(item, ',' order by start, kind) as spans,
    count(*) filter (where live) as n_live, count(*) filter (where not live) as n_example
  from kept group by 1)
select doc_id, {", ".join(f"coalesce(n_{kind.name}, 0) as n_{kind.name}" for kind in secrets.BASE)},
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans,
  coalesce(n_live, 0) as n_live, coalesce(n_example, 0) as n_example
from texts left join per_text using (k)
"""


SQL["op4_ngram_jaccard"] = rf"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') as w from documents),
sets as (
  select doc_id, case when len(w) >= 4 then list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))
    when len(w) > 0 then [array_to_string(w, ' ')] else [] end as s from words),
members as (select doc_id, len(s) as n, unnest(s) as shingle from sets),
links as (
  select a.doc_id as x, b.doc_id as y from members a join members b
    on a.shingle = b.shingle and a.doc_id <> b.doc_id and 100 * a.n >= 85 * b.n and 100 * b.n >= 85 * a.n
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach as (select doc_id as x, doc_id as y from sets union select r.x, l.y from reach r join links l on r.y = l.x)
select doc_id, cast(len(s) as bigint) as n_shingles, least_id as component_id
from sets join (select x, min(y) as least_id from reach group by 1) on x = doc_id
"""


def _crc32(text: str) -> str:
    """Unsigned crc32 of a string of code points below 2048: eight shifts for every byte."""
    steps = (f"flatten(list_transform(flatten(list_transform(string_split({text}, ''), lambda c: case when unicode(c) < 128 "
             "then [unicode(c)] else [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] end)), "
             "lambda x: [x, -1, -1, -1, -1, -1, -1, -1, -1]))")
    return (f"xor(list_reduce(list_prepend(cast(4294967295 as bigint), list_transform({steps}, lambda x: cast(x as bigint))), "
            "lambda c, x: case when x >= 0 then xor(c, x) else xor(c >> 1, 3988292384 * (c & 1)) end), 4294967295)")


SQL["op11_spelling_variants"] = f"""
with recursive runs as (
  select coalesce(cast(doc_id as varchar), '') as id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) as run
  from documents where text is not null),
single as (select id, run, count(*) as c from runs where length(run) >= 6 group by 1, 2),
hashed as (select run, c, {_crc32("id || ':' || run")} as h from single),
words as (
  select case when h % 199 = 0 then left(run, h % length(run)) || substr(run, h % length(run) + 2) else run end as word,
    cast(sum(c) as bigint) as n from hashed group by 1 having sum(c) >= 5 and length(word) >= 6),
places as (select word, n, unnest(range(1, length(word) + 1)) as i from words),
less as (select distinct word, n, left(word, i - 1) || substr(word, i + 1) as k from places),
changed as (select word, n, left(word, i - 1) || '_' || substr(word, i + 1) as k from places),
near as (
  select a.word, a.n, b.word as near, b.n as near_n from changed a join changed b on a.k = b.k and a.word <> b.word
  union all select a.word, a.n, b.word, b.n from less a join words b on a.k = b.word
  union all select b.word, b.n, a.word, a.n from less a join words b on a.k = b.word),
best as (
  select word, count(*) over (partition by word) as n_near, near, near_n,
    row_number() over (partition by word order by near_n desc, near) as place, n from near),
forms as (
  select w.word, w.n, coalesce(n_near, 0) as n_near, case when near_n >= 5 * w.n then near end as form,
    case when near_n >= 5 * w.n then near_n end as form_n
  from words w left join (select * from best where place = 1) b on b.word = w.word),
reach as (
  select word, word as stop from forms
  union all select r.word, f.form from reach r join forms f on f.word = r.stop where f.form is not null)
select f.word, f.form, r.stop as root, f.n, f.n_near, f.form_n
from forms f join reach r on r.word = f.word join forms g on g.word = r.stop where g.form is null
"""


#: Costs by state (nothing yet, system, user, assistant) before a row, from those behind it.
def _kept(initials: dict[str, int]) -> str:
    cases = " ".join(f"when sound and initial = '{i}' then extra + s{to}" for i, to in initials.items())
    return f"case {cases} else 1000000000 end"


_BARE = [
    f"least(4 + s{q}, {_kept(kept)}, case when sound then extra + 3 + s{to} else 1000000000 end) as b{q}"
    for q, kept, to in ((0, {"s": 1, "u": 2}, 2), (1, {"u": 2}, 2), (2, {"a": 3}, 3), (3, {"u": 2}, 2))]

SQL["op13_conversation_repair"] = f"""
with recursive keyed as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    {_crc32("coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ')")} % 20 as fate from conversations),
damaged as (
  select conv_id, turn, case when fate = 4 then 'user' else role end as role,
    case when fate = 1 then '' when fate = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from keyed, (select unnest([1, 2]) as copy) where fate <> 0 and (copy = 1 or fate = 3)),
placed as (
  select *, left(role, 1) as initial, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) as last,
    row_number() over (partition by conv_id order by turn nulls first, role, md5(length(role) || ':' || role || ':' || text)) as k from damaged),
faults as (
  select *, case when last = '' then 'blank' when row_number() over (partition by conv_id, role, text order by k) > 1 then 'duplicate'
    when last not in ('.', '!', '?') then 'truncated' else '' end as fault,
    coalesce(lag(initial) over (partition by conv_id order by k) || initial not in ('su', 'ua', 'au'), false) as illegal from placed),
marked as (
  select *, fault in ('', 'truncated') as sound, case when fault = 'truncated' then 3 else 0 end as extra from faults),
counted as (
  select conv_id, count(*) as rows, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
    count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
    count(*) filter (fault = 'truncated') as truncated, count(*) filter (illegal) as illegal from marked group by 1),
costs as (
  select conv_id, rows as k, 0 as s0, 6 as s1, 3 as s2, 0 as s3 from counted
  union all
  select conv_id, k, least(b0, 3 + least(b2, 3 + b3)), least(b1, 3 + least(b2, 3 + b3)), least(b2, 3 + b3), least(b3, 3 + b2) from (
    select m.conv_id, m.k - 1 as k, {", ".join(_BARE)}
    from costs c join marked m on m.conv_id is not distinct from c.conv_id and m.k = c.k)),
followed as (
  select conv_id, cast(0 as bigint) as k, 0 as state, '' as audit, '' as made from counted
  union all
  select conv_id, case when edit = 'I' then k else k + 1 end,
    case edit when 'D' then state when 'K' then case initial when 's' then 1 when 'u' then 2 else 3 end
      else case when state = 2 then 3 else 2 end end,
    audit || edit,
    made || case edit when 'D' then '' when 'K' then chr(10) || role || ':' || text
      else chr(10) || case when state = 2 then 'assistant:' else 'user:' end || case when edit = 'I' then '' else text end end
  from (
    select f.*, m.initial, m.role, m.text, case
      when m.k is null then 'I'
      when [c.s0, c.s1, c.s2, c.s3][state + 1] = 4 + [d.s0, d.s1, d.s2, d.s3][state + 1] then 'D'
      when [c.s0, c.s1, c.s2, c.s3][state + 1] = 3 + case when state = 2 then c.s3 else c.s2 end then 'I'
      when sound and [c.s0, c.s1, c.s2, c.s3][state + 1] = extra + case
        when initial = 's' and state = 0 then d.s1 when initial = 'u' and state <> 2 then d.s2
        when initial = 'a' and state = 2 then d.s3 else 1000000000 end then 'K'
      else 'R' end as edit
    from followed f join costs c on c.conv_id is not distinct from f.conv_id and c.k = f.k
    left join marked m on m.conv_id is not distinct from f.conv_id and m.k = f.k + 1
    left join costs d on d.conv_id is not distinct from f.conv_id and d.k = f.k + 1
    where m.k is not null or state in (1, 2))),
done as (
  select f.* from followed f join counted n on n.conv_id is not distinct from f.conv_id and f.k = n.rows where state in (0, 3))
select o.conv_id, coalesce(n.gaps, 0) as gaps, coalesce(n.blank, 0) as blank, coalesce(n.duplicate, 0) as duplicate,
  coalesce(n.truncated, 0) as truncated, coalesce(n.illegal, 0) as illegal, cast(coalesce(c.s0, 0) as bigint) as cost,
  coalesce(f.audit, '') as audit, sha256(substr(coalesce(f.made, ''), 2)) as repaired_sha256
from (select distinct conv_id from conversations) o
left join counted n on n.conv_id is not distinct from o.conv_id
left join costs c on c.conv_id is not distinct from o.conv_id and c.k = 0
left join done f on f.conv_id is not distinct from o.conv_id
"""
