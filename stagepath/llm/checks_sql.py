"""DuckDB SQL that computes the text queries by another route, where SQL can express them."""

WORDS = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
A_TO_Z = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

QUALITY_RULES = rf"""
with docs as (
  select row_number() over () as r, doc_id, source, coalesce(text, '') as text from documents
),
parts as (
  select r, doc_id, source, text, {WORDS.format("text")} as ws,
    list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as ls
  from docs
),
windows as (
  select r, i, ws[i] || chr(32) || ws[i + 1] || chr(32) || ws[i + 2] as gram
  from (select r, ws, unnest(range(1, len(ws) - 1)) as i from parts where len(ws) >= 3)
),
repeated as (
  select r, i from (select r, i, count(*) over (partition by r, gram) as n from windows) where n >= 2
),
covered as (
  select r, count(distinct p) as n
  from (select r, unnest([i, i + 1, i + 2]) as p from repeated) group by r
),
lines as (
  select r, source, text, lower(array_to_string({WORDS.format("l")}, ' ')) as line,
    len({WORDS.format("l")}) as n
  from (select r, source, text, unnest(ls) as l from parts)
),
hosts as (
  select source, count(distinct text) as n from lines group by source
),
frequent as (
  select x.source, x.line
  from (select source, line, count(distinct text) as n from lines group by source, line) x
  join hosts h on h.source is not distinct from x.source
  where x.n > 20 and x.n > 0.05 * h.n
),
removed as (
  select r, sum(l.n) as words, count(*) as lines
  from lines l join frequent f on f.source is not distinct from l.source and f.line = l.line
  group by r
),
measured as (
  select p.doc_id, cast(len(ws) as bigint) as n_words,
    cast(coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0) as bigint) as word_chars,
    cast(length(text) - length(translate(text, '#*$%&|<>', '')) as bigint) as n_symbols,
    cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines,
    cast(coalesce(c.n, 0) as bigint) as n_repeat_words,
    cast(coalesce(m.words, 0) as bigint) as removed_words,
    cast(coalesce(m.lines, 0) as bigint) as removed_lines
  from parts p left join covered c using (r) left join removed m using (r)
)
select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words or removed_words > 0.5 * n_words) as kept
from measured
"""

WARC = """
with paged as (
  select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as hex,
    max(page_id) over (partition by coalesce(html, '')) as stored
  from pages
)
select page_id, cast(strlen(html) as bigint) as payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((cast('0x' || substr(hex, (i // 4) * 5 + 1, 5) as bigint) >> (15 - 5 * (i % 4))) & 31) + 1, 1)),
    '') as payload_digest,
  case when page_id = stored then 'response' else 'revisit' end as record_type,
  case when page_id <> stored then stored end as refers_to
from paged
"""

SHARDING = """
with crc_table as (
  select list_transform(range(0, 256), lambda b: list_reduce(
    list_prepend(b, range(0, 8)),
    lambda c, k: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t
),
bytes as (
  select doc_id, coalesce(text, '') as text, hex(encode(coalesce(text, ''))) as h from documents
),
sized as (
  select doc_id, cast(len(h) // 2 + 1 as bigint) as size,
    xor(list_reduce(
      list_prepend(cast(4294967295 as bigint), list_transform(range(0, len(h) // 2),
        lambda i: cast('0x' || substr(h, 2 * i + 1, 2) as bigint))),
      lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) as text_crc32
  from bytes, crc_table
),
placed as (
  select *, sum(size) over (order by doc_id, text_crc32, size
      rows between unbounded preceding and current row) - size as start,
    sum(size) over () as total
  from sized
),
cut as (
  select *, cast((2 * start + size) * 8 // (2 * total) as integer) as shard from placed
)
select doc_id, size, text_crc32, 'bytes' as law, shard,
  row_number() over (partition by shard order by doc_id, text_crc32, size) - 1 as slot,
  cast(null as integer) as grown_shard
from cut
"""

NGRAM_JACCARD = rf"""
with recursive texts as (
  select doc_id, {WORDS.format("translate(coalesce(text, ''), " + A_TO_Z + ")")} as ws from documents
),
sets as (
  select doc_id, case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
    else list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) end as s
  from texts
),
grams as (select doc_id, len(s) as n, unnest(s) as gram from sets),
links as (
  select a.doc_id as a, b.doc_id as b
  from grams a join grams b on a.gram = b.gram and a.doc_id < b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n
  having 100 * count(*) >= 75 * (a.n + b.n - count(*))
),
reached as (
  select doc_id as a, doc_id as b from sets
  union
  select r.a, case when l.a = r.b then l.b else l.a end
  from reached r join links l on l.a = r.b or l.b = r.b
)
select doc_id, cast(len(s) as bigint) as n_shingles, least as component_id
from sets join (select a, min(b) as least from reached group by a) on a = doc_id
"""


LEXICAL_SEARCH = rf"""
with terms as (
  select r, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), {A_TO_Z}),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from (select row_number() over () as r, doc_id, text from documents)
),
lengths as (select r, doc_id, count(*) as n from terms group by r, doc_id),
corpus as (select count(*) as docs, cast(sum(n) as bigint) as words from lengths),
wanted as (
  select distinct item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), {A_TO_Z}),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from benchmark
),
held as (
  select r, term, count(*) as tf from terms where term in (select term from wanted) group by r, term
),
weights as (
  select term, cast(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) as bigint) as w
  from held, corpus group by term, docs
),
scored as (
  select i.item_id, l.r, l.doc_id,
    cast(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // words)))) as bigint) as score
  from wanted i join held h using (term) join weights using (term) join lengths l using (r), corpus
  group by i.item_id, l.r, l.doc_id
),
ranked as (
  select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id nulls first) as int) as rank,
    doc_id, score
  from scored where score > 0
)
select item_id, rank, doc_id, score from ranked where rank <= 10
"""


COLLOCATIONS = rf"""
with pieces as (
  select row_number() over () as p, lang, piece
  from (
    select coalesce(lang, 'und') as lang,
      unnest(string_split_regex(translate(coalesce(text, ''), {A_TO_Z}), '[.,;:!?\x0A-\x0D]')) as piece
    from documents
  )
),
words as (
  select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') as ws from pieces
),
places as (select lang, ws, unnest(range(1, len(ws) + 1)) as i from words where len(ws) > 0),
grams as (
  select lang, k, array_to_string(ws[i : i + k - 1], ' ') as gram, ws[i] as first, ws[i + k - 1] as last,
    array_to_string(ws[i : i + k - 2], ' ') as front, array_to_string(ws[i + 1 : i + k - 1], ' ') as back
  from places, (select unnest([1, 2, 3]) as k) where i + k - 1 <= len(ws)
),
f as (
  select lang, k, gram, any_value(first) as first, any_value(last) as last, any_value(front) as front,
    any_value(back) as back, count(*) as f
  from grams group by lang, k, gram
),
totals as (select lang, cast(sum(f) as bigint) as n from f where k = 1 group by lang),
candidates as (select * from f where k >= 2 and f >= 10),
longer as (
  select lang, gram, max(f) as f
  from (
    select lang, front as gram, f from candidates where k = 3
    union all select lang, back, f from candidates where k = 3
  ) group by lang, gram
),
cuts as (
  select c.lang, c.gram, c.f as a, 1 as cut, l.f as l, r.f as r
  from candidates c
  join f l on l.lang = c.lang and l.k = 1 and l.gram = c.first
  join f r on r.lang = c.lang and r.k = c.k - 1 and r.gram = c.back
  union all
  select c.lang, c.gram, c.f, 2, l.f, r.f
  from candidates c
  join f l on c.k = 3 and l.lang = c.lang and l.k = 2 and l.gram = c.front
  join f r on r.lang = c.lang and r.k = 1 and r.gram = c.last
),
scored as (
  select *, cast(cast(1000000 as hugeint) * a * a // (cast(l as hugeint) * r) as bigint) as score from cuts
),
lowest as (
  select * from scored
  qualify row_number() over (partition by lang, gram order by score, cut) = 1
),
ranked as (
  select s.*, row_number() over (partition by s.lang order by s.score desc, s.a desc, encode(s.gram)) as rank
  from lowest s left join longer o on o.lang = s.lang and o.gram = s.gram
  where o.f is null or 100 * o.f < 50 * s.a
)
select lang, rank, gram as phrase, a, l, r, n, score from ranked join totals using (lang) where rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": QUALITY_RULES,
        "op6_warc": WARC,
        "op7_sharding": SHARDING,
        "op9_ngram_jaccard": NGRAM_JACCARD,
        "op12_lexical_search": LEXICAL_SEARCH,
        "op13_collocations": COLLOCATIONS,
    }
