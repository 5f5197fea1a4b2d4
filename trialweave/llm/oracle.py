"""SQL of the operators' queries for another engine, where SQL can express them."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

NEAR = f"""
with recursive w as materialized (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') as l
  from {{docs}}
), s as materialized (
  select distinct doc_id, g from (
    select doc_id, unnest(case when len(l) >= 5
      then list_transform(range(1, len(l) - 3), lambda i: array_to_string(l[i:i+4], ' '))
      when len(l) > 0 then [array_to_string(l, ' ')] else [] end) as g
    from w)
), n as materialized (
  select w.doc_id, coalesce(c.n, 0) as n from w left join (select doc_id, count(*) as n from s group by 1) c using (doc_id)
), links as materialized (
  select x.a, x.b from (
    select p.doc_id as a, q.doc_id as b, count(*) as both
    from s p join s q on p.g = q.g and p.doc_id < q.doc_id group by 1, 2) x
  join n na on na.doc_id = x.a join n nb on nb.doc_id = x.b
  where 100 * x.both >= 75 * (na.n + nb.n - x.both)
), edges as materialized (
  select a, b from links union all select b, a from links
), reach as (
  select doc_id as a, doc_id as b from n
  union
  select r.a, e.b from reach r join edges e on r.b = e.a
), near as materialized (
  select n.doc_id, n.n as n_shingles, min(r.b) as component_id from n join reach r on r.a = n.doc_id group by 1, 2
)
"""

_ASSIGN = """(?i)(?:password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_KINDS = [
    (0, "assign", _ASSIGN, 1, 6),
    (1, "access", "AKIA[A-Z0-9]+", 0, 20),
    (2, "hex", "[0-9a-f]+", 0, 24),
    (3, "pem", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1),
    (4, "url", r"[a-z][a-z0-9+.-]{1,20}://[^\s:/@]{1,64}:([^\s/@]{6,200})@", 1, 1),
]


def _secrets() -> str:
    parts = [
        f"""select id, doc_id, source, {rank} as rank, '{kind}' as kind, unnest(list_transform(range(1, len(m) + 1), lambda i: struct_pack(
          start := list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0),
          size := length(m[i]), value := v[i]))) as s
        from (select id, doc_id, source, string_split_regex(t, '{pattern}') as b, regexp_extract_all(t, '{pattern}') as m,
          regexp_extract_all(t, '{pattern}', {group}) as v from d where regexp_matches(t, '{pattern}'))
        where true"""
        for rank, kind, pattern, group, least in _KINDS
    ]
    least = " ".join(f"when {rank} then {least}" for rank, _, _, _, least in _KINDS)
    return f"""
with d as materialized (
  select row_number() over () as id, doc_id, source, coalesce(text, '') as t from documents
), f as materialized (
  select id, doc_id, source, rank, kind, s.value as value, cast(s.start as bigint) as start, cast(s.start + s.size as bigint) as stop
  from ({' union all '.join(parts)}) where length(s.value) >= case rank {least} end
), o as (
  select value, count(distinct coalesce(source, '')) as owners from f group by 1
), l as (
  select doc_id, count(distinct value) filter (where owners < 3) as n_live,
    count(distinct value) filter (where owners >= 3) as n_copied
  from f join o using (value) group by 1
), j as (
  select id, count(*) filter (where rank = 0) as n_assign, count(*) filter (where rank = 1) as n_access,
    count(*) filter (where rank = 2) as n_hex,
    string_agg(kind || ':' || start || ':' || stop, ',' order by start, rank) filter (where rank < 3) as base,
    string_agg(kind || ':' || start || ':' || stop, ',' order by start, rank) as spans
  from f group by 1
)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans,
  coalesce(n_live, 0) as n_live, coalesce(n_copied, 0) as n_copied
from d left join j on j.id = d.id left join l on l.doc_id is not distinct from d.doc_id"""


def _leaks() -> str:
    units = (
        "kg mg g km cm mm m ml l s min h kb mb gb hz khz mhz w kw v a k percent dollars euros cents years year months "
        "month weeks week days day hours hour minutes minute seconds second meters metres miles feet inches pounds tons"
    ).replace(" ", "|")
    t = "translate(coalesce(text, ''), '#:_' || chr(1), '   ' || chr(1))"
    t = f"regexp_replace({t}, '([0-9])\\x20?({units})\\b', '\\1 #u:\\2 ', 'g')"
    for _ in range(2):
        t = f"regexp_replace({t}, '([0-9])[.,]([0-9])', '\\1_\\2', 'g')"
    t = f"regexp_replace({t}, '([0-9][0-9_]*)', ' #n:\\1 ', 'g')"
    t = f"regexp_replace({t}, '([\\p{{Ll}},;][\\x20\\x09-\\x0D])', '\\1' || chr(1), 'g')"
    t = f"regexp_replace({t}, chr(1) || '(\\p{{Lu}}\\p{{Ll}}+)', ' #p:\\1', 'g')"
    t = f"lower(replace({t}, chr(1), ''))"
    split = "list_filter(string_split_regex({}, '[^\\p{{L}}\\p{{N}}#:_]+'), lambda x: x != '')"
    bare = "regexp_replace(t, '(#[npu]):[\\p{L}\\p{N}_]+', '\\1', 'g')"

    def windows(name: str, source: str, key: str, width: str) -> str:
        return f"""{name} as materialized (
  select distinct id, pos, array_to_string(c[pos:pos + w - 1], ' ') as key,
    list_filter(m[pos:pos + w - 1], lambda x: x[1] = '#') as slots
  from (select *, unnest(range(1, len(c) - w + 2)) as pos from (
    select {key} as id, {split.format('t')} as m, {split.format(bare)} as c, {width} as w
    from (select {key}, {t} as t from {source})) where len(c) >= w)
)"""

    return f"""
with {windows('theirs', 'benchmark', 'item_id', 'least(len(c), 8)')}, {windows('own', 'documents', 'doc_id', '8')},
found as materialized (
  select distinct own.id as doc_id, theirs.id as item_id, own.pos - theirs.pos as place, theirs.pos as spot,
    own.slots as now, theirs.slots as was
  from own join theirs using (key)
), pairs as (
  select doc_id, item_id, place, was, min(now) as low, max(now) as high from (
    select doc_id, item_id, place, unnest(was) as was, unnest(now) as now from found) group by all
), per as (
  select doc_id, item_id, place, count(*) as slots, count(*) filter (where low != was) as changed,
    bool_or(low != high) as mixed from pairs group by all
), held as (
  select f.doc_id, f.item_id, count(distinct spot) as matched, max(coalesce(slots, 0)) as slots, max(coalesce(changed, 0)) as changed
  from found f left join per p on f.doc_id is not distinct from p.doc_id and f.item_id = p.item_id and f.place = p.place
  where not coalesce(mixed, false) group by 1, 2
), total as (select id, count(distinct pos) as windows from theirs group by 1)
select doc_id, item_id, windows, matched, cast(slots as bigint) as slots, cast(changed as bigint) as changed
from held join total on total.id = held.item_id where matched >= 0.5 * windows"""


LM = f"""
with d as materialized (
  select row_number() over () as id, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') as l from documents
), g as materialized (
  select id, n, e, array_to_string(l[e - n + 1:e], ' ') as g from (
    select id, l, n, unnest(range(n, len(l) + 1)) as e from d, (values (1), (2), (3)) t(n))
), own as materialized (select id, n, g, count(*) as c from g group by 1, 2, 3
), tot as materialized (select n, g, sum(c) as c from own group by 1, 2
), c as materialized (
  select g.id, g.n, g.e, tot.c - own.c as c from g join own using (id, n, g) join tot on tot.n = g.n and tot.g = g.g
), a as (
  select u.id, u.e, u.c as c1, b.c as c2, t.c as c3, p.c as p1, q.c as p2
  from c u left join c b on b.id = u.id and b.e = u.e and b.n = 2 left join c t on t.id = u.id and t.e = u.e and t.n = 3
    left join c p on p.id = u.id and p.e = u.e - 1 and p.n = 1 left join c q on q.id = u.id and q.e = u.e - 1 and q.n = 2
  where u.n = 1
), s as (
  select a.id, case when c3 > 0 then 3 when c2 > 0 then 2 else 1 end as k,
    case when c3 > 0 then ln(c3 / p2)
      when c2 > 0 then ln(c2 / p1) + case when e >= 3 then ln(0.4) else 0 end
      else ln(greatest(c1, 0.5) / greatest(w.n - len(d.l), 1)) + ln(0.4) * least(e - 1, 2) end as v
  from a join d using (id), (select sum(len(l)) as n from d) w
)
select d.doc_id, cast(len(d.l) as bigint) as n_words, count(*) filter (where k = 3) as order_3,
  count(*) filter (where k = 2) as order_2, count(*) filter (where k = 1) as order_1,
  round(coalesce(sum(v), 0.0), 4) as log_score, round(avg(v), 4) as mean_log_score
from d left join s using (id) group by d.id, d.doc_id, len(d.l)"""

# A byte's CRC table and a word's CRC from their bits, as there is no such function.
RESAMPLE = f"""
with docs as materialized (
  select row_number() over () as id, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as l
  from documents
), dw as materialized (
  select id, w, count(*) as c from (select id, unnest(l) as w from docs) group by 1, 2
), bw as materialized (
  select w, count(*) as c from (
    select unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) as w
    from benchmark) group by 1
), tab as materialized (
  select list(list_reduce(range(1, 9), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, b) order by b) as t
  from range(256) r(b)
), crc as materialized (
  select w, xor(list_reduce(
      list_transform(range(0, octet_length(encode(w))), lambda i: cast('0x' || substr(hex(encode(w)), cast(2 * i + 1 as integer), 2) as bigint)),
      lambda c, x: xor(c >> 8, t[cast(xor(c, x) & 255 as integer) + 1]), 4294967295::bigint), 4294967295) % 10000 as bucket
  from (select w from dw union select w from bw) cross join tab
), own as (select bucket, sum(c)::double as s from dw join crc using (w) group by 1
), target as (select bucket, sum(c)::double as t from bw join crc using (w) group by 1
), totals as (select coalesce((select sum(s) from own), 0) as s_all, coalesce((select sum(t) from target), 0) as t_all
), gain as materialized (
  select bucket, cast(floor(1000 * ln((coalesce(t, 0) + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000)))) as bigint) as g
  from own left join target using (bucket) cross join totals
), weights as (select id, sum(c * g) as weight from dw join crc using (w) join gain using (bucket) group by 1
), scored as materialized (
  select id, doc_id, len(l) as n, cast(coalesce(weight, 0) as bigint) as weight,
    cast(coalesce(weight, 0) + floor(-1000 * ln(-ln((cast('0x' || substr(sha256('2024:' || coalesce(cast(doc_id as varchar), 'null')), 1, 8) as bigint) + 0.5::double)
      / 4294967296::double))) as bigint) as score
  from docs left join weights using (id)
), ranked as (
  select id, row_number() over (order by score desc, doc_id nulls last, weight, n) as no, count(*) over () as fit from scored where n >= 20
)
select doc_id, cast(n as bigint) as n_features, weight, score, case when no <= 10 * fit // 100 then no end as rank
from scored left join ranked using (id)"""


def _codes(rounds: int = 4) -> str:
    """Each round of moved entries as a table of its own."""
    far = "list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = []
    for k in range(1, rounds + 2):
        steps.append(f"""
a{k} as materialized (
  select id, p, arg_min(e, (d, e)) as e, min(d) as d from (
    select v.id, v.p, b.e, cast({far} as bigint) as d from v join b{k - 1} b on v.p = b.p)
  group by 1, 2)""")
        if k <= rounds:
            steps.append(f"""
b{k} as materialized (
  select o.p, o.e, coalesce(n.x, o.x) as x from b{k - 1} o left join (
    select p, e, list(cast(floor(s / c) as bigint) order by j) as x from (
      select a.p, a.e, j, sum(v.x[j]) as s, count(*) as c
      from a{k} a join v on v.id = a.id and v.p = a.p cross join lateral (select unnest(range(1, len(v.x) + 1)) as j) t
      group by 1, 2, 3) group by 1, 2) n on n.p = o.p and n.e = o.e)""")
    last = rounds + 1
    return f"""
with k as materialized (
  select row_number() over (order by vec_id) as id, vec_id, label,
    list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as q
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), v as materialized (
  select id, p, q[p * (len(q) // 4) + 1 : (p + 1) * (len(q) // 4)] as x from k cross join range(4) r(p)
), b0 as materialized (
  select p, id - 1 as e, x from v where id <= 256
),{",".join(steps)}, book as (
  select sha256(string_agg(array_to_string(x, ','), ',' order by p, e)) as h from b{rounds}
), coded as (
  select id, string_agg(printf('%02x', e), '' order by p) as code, cast(sum(d) as bigint) as error from a{last} group by 1
)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, h as codebooks_sha256
from coded join k using (id) cross join book"""


SQL = {
    "op11_codes": _codes(),
    "op13_resample": RESAMPLE,
    "op9_lm": LM,
    "op8_secrets": _secrets(),
    "op10_decontaminate": _leaks(),
    "op5_near_dedup": NEAR.format(docs="documents")
    + "select doc_id, cast(n_shingles as bigint) as n_shingles, component_id, doc_id = component_id as kept from near",
}
