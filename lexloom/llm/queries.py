"""The queries of this package, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .collocations import op11_collocations
from .decontaminate import op10_decontaminate
from .licenses import op5_licenses
from .minhash import op8_minhash
from .mixing import op4_mixing
from .packing import op13_packing
from .periodic import op12_periodic
from .perplexity import op3_perplexity
from .pseudonyms import op7_pseudonyms
from .quality import op2_quality
from .suffix_dedup import op1_suffix_dedup
from .token_arrow import op6_token_arrow
from .token_counts import op9_token_counts


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_suffix_dedup, op2_quality, op3_perplexity, op4_mixing, op5_licenses, op6_token_arrow, op7_pseudonyms, op8_minhash, op9_token_counts, op10_decontaminate, op11_collocations, op12_periodic, op13_packing]
    return {f.__name__: f for f in found}


UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str, pattern: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{SMALL}'), '{pattern}')"


# Sets of shingles, all pairs that share one, links that are close enough, and the smallest id that links lead to.
OP8 = f"""with recursive w as (select doc_id, {_words('text', '[^\\x20\\x09-\\x0D]+')} as ws from documents),
    s as (select doc_id, case when len(ws) >= 3 then list_distinct(list_transform(generate_series(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end as g from w),
    e as (select doc_id, len(g) as n, unnest(g) as x from s), p as (select a.doc_id as a, b.doc_id as b, a.n as n, b.n as m, count(*) as c from e a join e b on a.x = b.x and a.doc_id < b.doc_id group by all),
    l as (select a, b from p where 100 * c >= 85 * (n + m - c)), two as (select a, b from l union all select b, a from l),
    reach(a, b) as (select doc_id, doc_id from documents union select r.a, t.b from reach r join two t on r.b = t.a), c as (select a, min(b) as component_id from reach group by a)
    select doc_id, cast(len(g) as bigint) as n_shingles, component_id, component_id = doc_id as kept from s join c on c.a = doc_id"""

# Every window of the benchmark, looked for at every place of every document.
OP10_WORDS = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
OP10 = f"""with d as (select doc_id, {_words('text', OP10_WORDS)} as ws from documents), i as (select item_id, {_words('text', OP10_WORDS)} as ws from benchmark where item_id is not null),
    k as (select item_id, ws, least(10, len(ws)) as n, unnest(generate_series(1, greatest(1, len(ws) - 9))) as k0 from i where len(ws) > 0), p as (select distinct item_id, n, array_to_string(list_slice(ws, k0, k0 + n - 1), ' ') as x from k),
    z as (select distinct n from p), f as (select doc_id, ws, n, unnest(generate_series(1, len(ws) - n + 1)) as k0 from d, z where len(ws) >= n), h as (select doc_id, k0, f.n, item_id from f join p on p.n = f.n and p.x = array_to_string(list_slice(ws, k0, k0 + f.n - 1), ' ')),
    q as (select doc_id, count(distinct pos) as n_hit from (select doc_id, unnest(generate_series(k0, k0 + n - 1)) as pos from h) group by doc_id), t as (select doc_id, list_sort(list(distinct cast(item_id as varchar))) as items from h group by doc_id)
    select d.doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(len(items), 0) as bigint) as n_items, sha256(coalesce(array_to_string(items, ','), '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated, coalesce(items, []) as items
    from d left join q using (doc_id) left join t using (doc_id)"""


# Phrases of each piece by language, their counts, the weakest cut, and what longer phrases leave.
OP11 = f"""with t as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{SMALL}'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
    w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from t), z as (select lang, cast(sum(len(ws)) as bigint) as n from w group by lang), ks as (select unnest([1, 2, 3]) as k),
    o as (select lang, k, ws, unnest(generate_series(1, len(ws) - k + 1)) as i from w, ks where len(ws) >= k), g as (select lang, list_slice(ws, i, i + k - 1) as p, k, count(*) as f from o group by all),
    c as (select * from g where k > 1 and f >= 10), u as (select lang, p, f, k, unnest(generate_series(1, k - 1)) as j0 from c),
    s as (select u.lang, u.p, u.f, u.j0, x.f as l, y.f as r, (1000000::hugeint * u.f * u.f) // (x.f::hugeint * y.f) as score from u join g x on x.lang = u.lang and x.p = u.p[:u.j0] join g y on y.lang = u.lang and y.p = u.p[u.j0 + 1:]),
    b as (select lang, p, any_value(f) as a, arg_min(struct_pack(score := score, l := l, r := r), (score, j0)) as cut from s group by lang, p),
    h as (select c.lang, c.p[j:j + 1] as p, max(c.f) as longer from c, (select unnest([1, 2]) as j) where c.k = 3 group by all),
    r as (select b.lang, array_to_string(b.p, ' ') as phrase, a, cut.l as l, cut.r as r, cut.score as score from b left join h on h.lang = b.lang and h.p = b.p where h.longer is null or 100 * h.longer < 50 * a),
    q as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from r)
    select q.lang, cast(rank as bigint) as rank, phrase, cast(a as bigint) as a, cast(l as bigint) as l, cast(r as bigint) as r, n, cast(score as bigint) as score from q join z on z.lang = q.lang where rank <= 2000"""


# Texts with loops, pairs of places where the same eight words begin, chains of such pairs on a lag, and no lag whose divisor
# has a chain around it.
CRC = "xor(list_reduce([4294967295::bigint] || list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint), lambda a, d: list_reduce([xor(a, d), 0, 0, 0, 0, 0, 0, 0, 0], lambda b, z: xor(b >> 1, case when b & 1 = 1 then 3988292384 else 0 end))), 4294967295)"
OP12 = f"""with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws, {CRC} as h from documents), n as (select *, len(ws) as n, h // 10 as g from d), a as (select *, case when n > 0 then g % n end as a0 from n),
    t as (select doc_id, n, case when h % 10 = 0 and n > 0 then list_transform(generate_series(0, n - 1), lambda i: ws[1 + case when i >= a0 then a0 + (i - a0) % (1 + (n - a0) // (3 + g % 8)) else i end]) else ws end as ws from a),
    g as (select doc_id, n, i, array_to_string(list_slice(ws, i + 1, i + 8), ' ') as x from (select doc_id, n, ws, unnest(generate_series(0, n - 8)) as i from t where n >= 24)),
    p as (select l.doc_id, r.i as i, r.i - l.i as q from g l join g r on l.doc_id = r.doc_id and l.x = r.x and l.i < r.i and 3 * (r.i - l.i) <= r.n), k as (select *, i - row_number() over (partition by doc_id, q order by i) as chain from p),
    c as (select doc_id, q, min(i) - q as s, max(i) + 8 - min(i) + q as m from k group by doc_id, q, chain), long as (select * from c where m >= greatest(24, 3 * q)),
    r as (select * from long x where not exists (select 1 from c y where y.doc_id = x.doc_id and y.q < x.q and x.q % y.q = 0 and y.s <= x.s and y.s + y.m >= x.s + x.m)),
    z as (select doc_id, count(*) as n_runs, arg_max(struct_pack(s := s, m := m, q := q), (m / q, -s, -q)) as best, string_agg(s || ',' || m || ',' || q || chr(10), '' order by s, q) as lines, list(struct_pack(a := s + q, b := s + m)) as gone from r group by doc_id)
    select t.doc_id, coalesce(n_runs, 0)::bigint as n_runs, best.s::bigint as start, best.m::bigint as length, best.q::bigint as period, (1000 * best.m // best.q)::bigint as exponent_milli, sha256(coalesce(lines, '')) as runs_sha256, n::bigint as n_words,
        sha256(case when gone is null then array_to_string(ws, ' ') else coalesce(array_to_string(list_filter(ws, lambda w, i: len(list_filter(gone, lambda x: i - 1 >= x.a and i - 1 < x.b)) = 0), ' '), '') end) as collapsed_sha256 from t left join z on z.doc_id = t.doc_id"""


def oracle_sql() -> dict[str, str]:
    """The queries that SQL can express on small tables; the rest are tested in tests/llm."""
    return {"op8_minhash": OP8, "op10_decontaminate": OP10, "op11_collocations": OP11, "op12_periodic": OP12}
