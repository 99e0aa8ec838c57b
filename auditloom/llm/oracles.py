"""SQL that must give the rows of the queries it can express."""

from __future__ import annotations

from auditloom.llm import lines

# Words [^\x20\x09-\x0D]+ of every text; a window is 20 of them in a row.
OP1 = r"""
with texts as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
words as (
  select doc_id, words, len(words) as n from texts),
starts as (
  select doc_id, unnest(range(1, n - 18)) as pos, words from words where n >= 20),
windows as (
  select doc_id, pos, row_number() over (
    partition by array_to_string(words[pos : pos + 19], ' ') order by doc_id, pos) as turn
  from starts),
gone as (
  select distinct doc_id, unnest(range(pos, pos + 20)) as i from windows where turn > 1),
single as (
  select doc_id, unnest(words) as word, unnest(range(1, n + 1)) as i from words),
left_over as (
  select s.doc_id, count(g.i) as n_removed, string_agg(s.word, ' ' order by s.i) filter (g.i is null) as kept
  from single s left join gone g using (doc_id, i) group by s.doc_id)
select w.doc_id, w.n as n_words, coalesce(l.n_removed, 0) as n_removed, sha256(coalesce(l.kept, '')) as kept_sha256
from words w left join left_over l using (doc_id)
"""

OP7 = rf"""
with cleaned as (
  select page_id, html, nullif(lower(regexp_extract(coalesce(url, ''),
      '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/:?#@]+)', 1)), '') as host,
    string_split(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
      '{lines._HIDDEN}', '', 'g'), '{lines._BREAKS}', chr(10), 'g'), '{lines._TAGS}', '', 'g'), chr(10)) as raw
  from pages),
pages_of as (
  select row_number() over () as page, page_id, host,
    list_filter(list_transform(raw, lambda x: trim(regexp_replace(x, '[\t\r ]+', ' ', 'g'))), lambda x: x <> '') as lines
  from cleaned),
sites as (
  select host, count(*) as pages from pages_of group by host having count(*) >= 5),
carried as (
  select host, line, count(*) as carriers
  from (select host, unnest(list_distinct(lines)) as line from pages_of) group by host, line),
common as (
  select c.host, c.line from carried c join sites s on c.host is not distinct from s.host
  where c.carriers > 0.3::double * s.pages),
placed as (
  select page, page_id, host, unnest(lines) as line, unnest(range(len(lines))) as pos from pages_of),
judged as (
  select p.*, c.line is not null as gone from placed p
  left join common c on p.host is not distinct from c.host and p.line = c.line),
shown as (
  select page, count(*) as n_lines, count(*) filter (gone) as n_dropped,
    string_agg(line, chr(10) order by pos) filter (not gone) as text
  from judged group by page)
select p.page_id, p.host, coalesce(s.n_lines, 0) as n_lines, coalesce(s.n_dropped, 0) as n_dropped,
  coalesce(s.text, '') as text
from pages_of p left join shown s using (page)
"""

# CRC-32, byte by byte: a table of 256 values made by eight shifts each, then one look-up a byte.
_CRC = """
crc_table as (
  select list(c order by b) as crc from (
    select b, list_reduce(list_prepend(b, range(8)),
      lambda x, k: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end) as c
    from (select unnest(range(256)) as b))),
texts as (
  select row_number() over () as row, doc_id, source, encode(coalesce(text, '')) as data from documents),
bytes as (
  select row, doc_id, source, octet_length(data) as n_bytes, hex(data) as digits from texts),
numbers as (
  select row, doc_id, source, n_bytes, list_transform(range(n_bytes),
    lambda i: ('0x' || substr(digits, 2 * i + 1, 2))::bigint) as codes
  from bytes),
summed as (
  select row, doc_id, source, n_bytes, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, codes),
    lambda x, b: xor(x >> 8, crc[1 + (xor(x, b) & 255)]))) as text_crc32
  from numbers, crc_table)"""

OP9 = f"""
with recursive {_CRC},
counts as (
  select source, count(*) as n from documents group by source),
roots as (
  select source, n, cast(floor(1000 * sqrt(n)) as bigint) as root, (select cast(sum(floor(1000 * sqrt(n))) as bigint) from counts) as every
  from counts),
raw as (
  select source, n, greatest(1, case when every > 65536 then root * 65536 // every else root end) as w from roots),
shares as (
  select source, n, cast(w // (select list_reduce(list(w), lambda x, y: gcd(x, y)) from raw) as bigint) as w,
    row_number() over (order by source nulls first) as i from raw),
lists as (
  select list(w order by i) as q, cast(sum(w) as bigint) as total,
    max(((n + 7) // 8 * (select sum(w) from shares) + w - 1) // w) as slots from shares),
edf as (
  select -1 as slot, 0::bigint as pick, 0::bigint as k, list_transform(q, lambda x: 0::bigint) as sent, q, total, slots from lists
  union all
  select slot + 1, chosen, sent[chosen], list_transform(sent, lambda x, k: x + case when k = chosen then 1 else 0 end),
    q, total, slots
  from (select slot, sent, q, total, slots, list_min(list_transform(range(1, len(q) + 1), lambda k:
      case when sent[k] * total // q[k] <= slot + 1
        then ((sent[k] + 1) * total + q[k] - 1) // q[k] * 100000 + k end)) % 100000 as chosen
    from edf where slot < slots - 1)),
ranked as (
  select doc_id, source, row_number() over (partition by source order by
    md5(concat(coalesce(cast(doc_id as varchar), 'null'), ':', cast(text_crc32 as varchar)))) - 1 as pos
  from summed)
select r.doc_id, r.source, r.pos // 8 as block,
  (r.pos // 8) * l.total // q.w as release,
  ((r.pos // 8 + 1) * l.total + q.w - 1) // q.w as deadline,
  cast(t.slot as bigint) as slot, cast(t.slot as bigint) * 8 + r.pos % 8 as position
from ranked r join shares q on r.source is not distinct from q.source
join edf t on t.slot >= 0 and t.pick = q.i and t.k = r.pos // 8, lists l
"""

OP10 = f"""
with {_CRC},
costs as (
  select row, doc_id, n_bytes + 16 as size, text_crc32, unnest(range(41)) as shard from summed),
drawn as (
  select *, -ln((('0x' || substr(md5(concat(coalesce(cast(doc_id as varchar), 'null'), ':',
      cast(shard as varchar))), 1, 13))::bigint + 0.5::double) / 4503599627370496) as cost from costs),
placed as (
  select doc_id, size, text_crc32, arg_min(shard, cost) filter (shard < 40) as shard,
    arg_min(shard, cost) as grown_shard
  from drawn group by row, doc_id, size, text_crc32)
select doc_id, size, text_crc32, 'key' as law, cast(shard as integer) as shard,
  row_number() over (partition by shard order by substr(md5(concat_ws(':',
    coalesce(cast(doc_id as varchar), 'null'), cast(text_crc32 as varchar), cast(size as varchar),
    cast(grown_shard as varchar))), 1, 3), doc_id, text_crc32, size, grown_shard) - 1 as slot,
  cast(grown_shard as integer) as grown_shard
from placed
"""

OP12 = r"""
with texts as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
marks as (
  select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
flags as (
  select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
    (len(words) < 200)::int + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::int
    + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text))::int
    + 8 * regexp_matches(text, '[#$%&*|]')::int
    + 16 * coalesce(t.doc_id > min(t.doc_id) over (partition by text), false)::int as mask
  from texts t left join marks m on t.doc_id = m.doc_id),
cells as (
  select part, mask, count(*) as n, sum(good) as good, sum(toxic) as toxic from flags group by part, mask),
filters as (
  select unnest(['A', 'B', 'C', 'D', 'E']) as f, unnest([1, 2, 4, 8, 16]) as bit),
orders as (
  select a.f || b.f || c.f || d.f || e.f as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits
  from filters a, filters b, filters c, filters d, filters e
  where a.bit + b.bit + c.bit + d.bit + e.bit = 31),
steps as (
  select filter_order, step, bits[step] as own, coalesce(list_sum(bits[1 : step - 1]), 0)::int as earlier
  from orders, (select unnest(range(1, 6)) as step)),
figures as (
  select part, filter_order, step, own,
    coalesce(sum(n) filter (mask & (earlier | own) = 0), 0) as kept,
    coalesce(sum(n) filter (mask & earlier = 0 and mask & own <> 0), 0) as removed,
    coalesce(sum(n) filter (mask & earlier <> 0 and mask & own <> 0), 0) as redundant,
    coalesce(sum(n) filter (mask = own), 0) as unique_fails,
    coalesce(sum(good) filter (mask & earlier = 0 and mask & own <> 0), 0) as good_lost,
    coalesce(sum(toxic) filter (mask & earlier = 0 and mask & own <> 0), 0) as toxic_lost
  from cells, steps group by part, filter_order, step, own)
select part, filter_order, step::int as step, kept::bigint as kept, removed::bigint as removed,
  redundant::bigint as redundant, unique_fails::bigint as unique_fails, good_lost::bigint as good_lost,
  toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, own))::bigint as shapley
from figures
"""

# The text without white space; the longest original stays, then the smallest doc_id.
OP13 = r"""
with texts as (
  select doc_id, length(coalesce(text, '')) as n_chars,
    regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as normal from documents),
ranked as (
  select doc_id, normal, count(*) over (partition by normal) as group_size,
    first_value(doc_id) over best as keep_id, row_number() over best as place
  from texts window best as (partition by normal order by n_chars desc, doc_id nulls last))
select doc_id, keep_id, group_size, place = 1 as kept, sha256(normal) as text_sha256 from ranked
"""

# Costs to come run backward as lists by state (nothing, s, u, a); then one edit a step.
OP11 = r"""
with recursive crc_table as (
  select list(c order by b) as crc from (
    select b, list_reduce(list_prepend(b, range(8)),
      lambda x, k: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end) as c
    from (select unnest(range(256)) as b))),
given as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    hex(encode(concat(coalesce(conv_id::varchar, ' '), ':', coalesce(turn::varchar, ' ')))) as digits
  from conversations),
hit as (
  select conv_id, turn, role, text, xor(4294967295, list_reduce(list_prepend(4294967295::bigint,
      list_transform(range(len(digits) // 2), lambda i: ('0x' || substr(digits, 2 * i + 1, 2))::bigint)),
    lambda x, b: xor(x >> 8, crc[1 + (xor(x, b) & 255)]))) % 20 as kind
  from given, crc_table),
damaged as (
  select conv_id, turn, case when kind = 4 then 'user' else role end as role,
    case when kind = 1 then '' when kind = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(range(case when kind = 3 then 2 else 1 end)) as copy
  from hit where kind <> 0),
placed as (
  select conv_id, dense_rank() over (order by conv_id nulls first) as c,
    row_number() over (partition by conv_id order by turn nulls first, role, text) as i, turn, role, text,
    not regexp_matches(text, '[^\x20\x09-\x0D]') as blank,
    not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') as unfinished
  from damaged),
judged as (
  select *, row_number() over (partition by c, role, text order by i) > 1 as again,
    substr(role, 1, 1) as r, lag(substr(role, 1, 1)) over (partition by c order by i) as before
  from placed),
turns as (
  select *, not blank and again as duplicate, not blank and not again and unfinished as truncated,
    not blank and not again as may_stay, case when unfinished then 1 else 0 end as t
  from judged),
figures as (
  select conv_id, c, count(*) as n,
    coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank,
    count(*) filter (duplicate) as duplicate, count(*) filter (truncated) as truncated,
    count(*) filter (i > 1 and before || r not in ('su', 'ua', 'au')) as illegal
  from turns group by conv_id, c),
back as (
  select c, n + 1 as i, [0, 4, 2, 0]::bigint[] as v from figures
  union all
  select c, i, [least(w[1], 2 + w[3], 4 + w[4]), least(w[2], 2 + w[3], 4 + w[4]), least(w[3], 2 + w[4]),
    least(w[4], 2 + w[3])] as v
  from (select p.c, p.i, [
      least(3 + v[1], case when may_stay then t + 2 + v[3] end, case when may_stay and r = 's' then t + v[2] end,
        case when may_stay and r = 'u' then t + v[3] end),
      least(3 + v[2], case when may_stay then t + 2 + v[3] end, case when may_stay and r = 'u' then t + v[3] end),
      least(3 + v[3], case when may_stay then t + 2 + v[4] end, case when may_stay and r = 'a' then t + v[4] end),
      least(3 + v[4], case when may_stay then t + 2 + v[3] end, case when may_stay and r = 'u' then t + v[3] end)] as w
    from back b join turns p on p.c = b.c and p.i = b.i - 1)),
steps as (
  select b.c, b.i, b.v, a.v as later, p.r, p.t, p.may_stay, p.role || ':' || p.text as line, p.text
  from back b left join back a on a.c = b.c and a.i = b.i + 1 left join turns p on p.c = b.c and p.i = b.i),
forward as (
  select c, 1::bigint as i, 1 as q, '' as audit, []::varchar[] as lines from figures
  union all
  select c, case when edit = 'I' then i else i + 1 end,
    case edit when 'D' then q when 'K' then kept else fresh end, audit || edit,
    case edit when 'D' then lines when 'K' then list_append(lines, line)
      when 'R' then list_append(lines, case when fresh = 3 then 'user:' else 'assistant:' end || text)
      else list_append(lines, case when fresh = 3 then 'user:' else 'assistant:' end) end
  from (select *, case when later is not null and v[q] = 3 + later[q] then 'D' when v[q] = 2 + v[fresh] then 'I'
      when may_stay and kept is not null and v[q] = t + later[kept] then 'K' when later is not null then 'R' end as edit
    from (select f.*, s.v, s.later, s.t, s.may_stay, s.line, s.text,
        case when q = 3 then 4 else 3 end as fresh,
        case when r = 's' and q = 1 then 2 when r = 'u' and q <> 3 then 3 when r = 'a' and q = 3 then 4 end as kept
      from forward f join steps s on s.c = f.c and s.i = f.i))
  where edit is not null),
ended as (
  select f.c, f.audit, f.lines from forward f join figures g on g.c = f.c and f.i = g.n + 1 and f.q in (1, 4)),
convs as (
  select distinct conv_id from conversations)
select o.conv_id, coalesce(g.gaps, 0) as gaps, coalesce(g.blank, 0) as blank, coalesce(g.duplicate, 0) as duplicate,
  coalesce(g.truncated, 0) as truncated, coalesce(g.illegal, 0) as illegal, coalesce(b.v[1], 0) as cost,
  coalesce(e.audit, '') as audit, sha256(coalesce(array_to_string(e.lines, chr(10)), '')) as repaired_sha256
from convs o left join figures g on g.conv_id is not distinct from o.conv_id
left join back b on b.c = g.c and b.i = 1 left join ended e on e.c = g.c
"""
