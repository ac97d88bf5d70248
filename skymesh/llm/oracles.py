"""SQL (DuckDB) for the corpus queries that SQL can express."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACED = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def _words(pattern: str, lower: bool) -> str:
    text = "coalesce(text, '')"
    return f"regexp_extract_all({f'translate({text}, {_UPPER!r}, {_LOWER!r})' if lower else text}, {pattern})"


# CRC-32 by a table of a byte's eight steps
_CRC_TABLE = "list_transform(range(0, 256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda v, x: xor(v >> 1, (v & 1) * 3988292384)))"


def _crc(items: str, byte: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295, list_transform({items}, lambda x: cast({byte} as bigint))), lambda v, x: xor(v >> 8, tab[1 + (xor(v, x) & 255)])), 4294967295)"


ORACLES = {
    "op2_benchmark_decontamination": f"""
with b as (select row_number() over () item, cast(item_id as varchar) item_id, {_words(_ALNUM, True)} w from benchmark where item_id is not null),
bw as (select item, item_id, w, least(13, len(w)) n, unnest(range(1, len(w) - least(13, len(w)) + 2)) i from b where len(w) > 0),
bp as (select item, item_id, n, i, array_to_string(w[i:i + n - 1], ' ') s from bw),
bs as (select distinct item_id, n, s from bp),
d as (select doc_id, {_words(_ALNUM, True)} w from documents),
dw as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') s from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) i from d, (select distinct n from bs))),
hit as (select doc_id, i, dw.n, item_id from dw join bs on dw.n = bs.n and dw.s = bs.s),
cov as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + n)) p from hit) group by 1),
met as (select doc_id, item, item_id, dw.i - bp.i diagonal, dw.i, dw.n from dw join bp on dw.n = bp.n and dw.s = bp.s),
runs as (select *, i - row_number() over (partition by doc_id, item, diagonal order by i) run from met),
matches as (select doc_id, item_id, min(i) - 1 a, max(i) + n - min(i) words from runs group by doc_id, item, item_id, diagonal, run, n),
best as (select *, row_number() over (partition by doc_id order by words desc, a, item_id) r from matches),
it as (select doc_id, count(*) n_items, string_agg(item_id, ',' order by item_id) ids from (select distinct doc_id, item_id from hit) group by 1)
select d.doc_id, len(w) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(ids, '')) items_sha256,
 coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated, best.words longest_words, best.item_id longest_item, best.a longest_start
from d left join cov on cov.doc_id = d.doc_id left join it on it.doc_id = d.doc_id left join best on best.doc_id = d.doc_id and best.r = 1""",
    "op3_substring_recompression": f"""
with d as (select doc_id, {_words(_SPACED, False)} w from documents),
win as (select doc_id, i, array_to_string(w[i:i + 12], ' ') s from (select doc_id, w, unnest(range(1, len(w) - 11)) i from d)),
first as (select s, min(doc_id) f from win group by s),
gone as (select distinct doc_id, p from (select doc_id, unnest(range(i, i + 13)) p from win join first on first.s = win.s where f < doc_id)),
words as (select doc_id, unnest(w) x, generate_subscripts(w, 1) p from d),
kept as (select words.doc_id, string_agg(x, ' ' order by words.p) kept, count(*) n from words anti join gone on gone.doc_id = words.doc_id and gone.p = words.p group by 1)
select d.doc_id, len(w) n_words, len(w) - coalesce(n, 0) n_removed, sha256(coalesce(kept, '')) kept_sha256
from d left join kept on kept.doc_id = d.doc_id""",
    "op4_arc_to_warc": """
with p as (select page_id, strlen(coalesce(html, '')) payload_bytes, sha1(coalesce(html, '')) payload_digest from pages),
g as (select payload_digest, max(page_id) last from p where payload_bytes >= 1000 group by 1)
select page_id, payload_bytes, p.payload_digest, case when last is null or last = page_id then 'response' else 'revisit' end record_type,
 case when last <> page_id then last end refers_to
from p left join g on g.payload_digest = p.payload_digest and payload_bytes >= 1000""",
    "op7_minmax_near_dedup": f"""
with recursive d as (select doc_id, {_words(_SPACED, True)} w from documents),
sh as (select distinct doc_id, array_to_string(w[i:i + 2], ' ') s from (select doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) i from d where len(w) > 0)),
n as (select doc_id, count(*) n from sh group by 1),
pairs as (select a.doc_id a, b.doc_id b, count(*) n from sh a join sh b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
links as (select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b where 100 * pairs.n >= 85 * (x.n + y.n - pairs.n)),
reach(a, b) as (select doc_id, doc_id from d union select reach.a, links.b from reach join links on links.a = reach.b)
select d.doc_id, coalesce(n.n, 0) n_shingles, c.component_id, c.component_id = d.doc_id kept
from d join (select a, min(b) component_id from reach group by 1) c on c.a = d.doc_id left join n on n.doc_id = d.doc_id""",
    "op6_suffix_array_dedup": """
with d as (select doc_id, hex(encode(coalesce(text, ''))) h, strlen(coalesce(text, '')) n from documents),
win as (select doc_id, i, md5_number(substr(h, 2 * i - 1, 200)) s from (select doc_id, h, unnest(range(1, n - 98)) i from d)),
later as (select doc_id, i from (select doc_id, i, row_number() over (partition by s order by doc_id, i) r from win) where r > 1),
edges as (select doc_id, i, max(i + 99) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding) reach from later),
spans as (select doc_id, i, sum(case when reach is null or i > reach + 1 then 1 else 0 end) over (partition by doc_id order by i) k from edges),
gone as (select doc_id, k, min(i) a, max(i) + 99 b from spans group by 1, 2),
pieces as (select doc_id, b + 1 a, lead(a) over (partition by doc_id order by a) - 1 z from (select doc_id, a, b from gone union all select doc_id, 0, 0 from d)),
kept as (select d.doc_id, string_agg(substr(h, 2 * a - 1, 2 * (coalesce(z, n) - a + 1)), '' order by a) k from pieces join d on d.doc_id = pieces.doc_id where a <= coalesce(z, n) group by 1)
select d.doc_id, n n_bytes, n - cast(coalesce(length(k), 0) // 2 as bigint) n_removed, coalesce(m, 0) n_spans, sha256(unhex(coalesce(k, ''))) kept_sha256
from d left join kept on kept.doc_id = d.doc_id left join (select doc_id, count(*) m from gone group by 1) g on g.doc_id = d.doc_id""",
    "op10_quality_divergence": f"""
with d as (select doc_id, lang, coalesce(text, '') t, {_words(_SPACED, False)} w, {_words(_SPACED, True)} v from documents),
five as (select doc_id, i, array_to_string(w[i:i + 4], ' ') s from (select doc_id, w, unnest(range(1, len(w) - 3)) i from d)),
again as (select doc_id, s from five group by 1, 2 having count(*) > 1),
covered as (select doc_id, count(distinct p) n from (select doc_id, unnest(range(i, i + 5)) p from five semi join again using (doc_id, s)) group by 1),
c as (select *, {", ".join(f"cast(length(regexp_replace(t, '[^{x}]', '', 'g')) as bigint) k{i}" for i, x in enumerate(("#*$%&|<>", "a-z", "A-Z", "0-9", r"\x20\x09-\x0D", ".,;:!?''\"()\\-")))},
 cast(length(regexp_replace(t, '[\x00-\x7F]', '', 'g')) as bigint) k7, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {_SPACED})) lines from d),
chars as (select doc_id, lang, unnest(range(0, 8)) bin, unnest([k0, k1, k2, k3, k4, k5, length(t) - k0 - k1 - k2 - k3 - k4 - k5 - k7, k7]) n from c),
totals as (select lang, x, count(*) n from (select lang, unnest(v) x from d where lang is not null) group by 1, 2),
common as (select distinct x from (select x, row_number() over (partition by lang order by n desc, x) r from totals) where r <= 64),
counts as (select doc_id, lang, coalesce(common.x, '') bin, count(*) n from (select doc_id, lang, unnest(v) x from d) u left join common on common.x = u.x group by 1, 2, 3),
langs as (select distinct lang from d where lang is not null),
hist as (select 'c' kind, doc_id, lang, cast(bin as varchar) bin, n from chars union all select 'w', doc_id, lang, bin, n from counts),
q as (select kind, lang, bin, n / sum(n) over (partition by kind, lang) q from (select kind, lang, bin, sum(n) n from hist where lang is not null group by 1, 2, 3)),
p as (select kind, doc_id, bin, n / sum(n) over (partition by kind, doc_id) p from hist where n > 0),
met as (select p.kind, doc_id, langs.lang, p, coalesce(q, 0) q from p cross join langs left join q on q.kind = p.kind and q.lang = langs.lang and q.bin = p.bin),
js as (select kind, doc_id, lang, sqrt(least(1, greatest(0, (sum(p * log2(2 * p / (p + q))) + sum(case when q > 0 then q * log2(2 * q / (p + q)) else 0 end) + 1 - sum(q)) / 2))) j from met group by 1, 2, 3),
near as (select d.doc_id, langs.lang, coalesce(a.j, 0) a, coalesce(b.j, 0) b, row_number() over (partition by d.doc_id order by coalesce(a.j, 0) + coalesce(b.j, 0), langs.lang) r
 from d cross join langs left join js a on a.kind = 'c' and a.doc_id = d.doc_id and a.lang = langs.lang left join js b on b.kind = 'w' and b.doc_id = d.doc_id and b.lang = langs.lang),
o as (select c.doc_id, cast(len(w) as bigint) n_words, cast(length(array_to_string(w, '')) as bigint) word_chars, k0 n_symbols, cast(len(lines) - len(list_distinct(lines)) as bigint) n_dup_lines, coalesce(n, 0) n_repeat_words,
 near.lang ref_lang, coalesce(a, 0) a, coalesce(b, 0) b, length(t) chars from c left join covered on covered.doc_id = c.doc_id left join near on near.doc_id = c.doc_id and r = 1)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 or 100 * n_repeat_words > 20 * n_words base_failed,
 not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and (n_words < 50 or chars < 200 or (a <= 0.28 and b <= 0.5)) kept, ref_lang, round(a, 6) js_chars, round(b, 6) js_words
from o""",
    "op11_gram_variants": f"""
with recursive crc as (select {_CRC_TABLE} tab),
runs as (select r, count(*) k, concat(doc_id, ':', r) s from (select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]{{7,}}')), {_UPPER!r}, {_LOWER!r}) r from documents) group by doc_id, r),
hashed as (select r, k, {_crc("range(0, strlen(s))", "'0x' || substr(hex(encode(s)), 2 * x + 1, 2)")} h from runs, crc),
known as (select w, cast(sum(k) as bigint) n from (select case when h % 31 = 0 then substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) else r end w, k from hashed) where length(w) >= 7 group by 1 having sum(k) >= 2),
cut as (select w, n, i, substr(w, 1, i - 1) || substr(w, i + 1) d from (select w, n, unnest(range(1, length(w) + 1)) i from known)),
near as (select distinct a.w, b.w v, b.n from cut a join cut b on a.i = b.i and a.d = b.d and a.w <> b.w
 union select cut.w, k.w, k.n from cut join known k on k.w = cut.d union select k.w, cut.w, cut.n from cut join known k on k.w = cut.d),
best as (select w, count(*) m, arg_min(v, (-n, v)) v, max(n) n from near group by 1),
forms as (select known.w, known.n, coalesce(m, 0) m, case when best.n >= 10 * known.n then v end form, case when best.n >= 10 * known.n then best.n end form_n from known left join best on best.w = known.w),
ways(w, r) as (select w, w from forms union all select ways.w, forms.form from ways join forms on forms.w = ways.r where forms.form is not null)
select forms.w word, forms.form, r.r root, forms.n, forms.m n_near, forms.form_n
from forms join ways r on r.w = forms.w join forms last on last.w = r.r and last.form is null""",
    "op13_euler_prefix_trie": f"""
with crc as (select {_CRC_TABLE} tab),
o as (select conv_id c, coalesce(role, '') role, coalesce(text, '') text, row_number() over (partition by conv_id order by turn nulls first, role, text) r from conversations where conv_id is not null),
k as (select c, n, {_crc("string_split(cast(c as varchar), '')", "ascii(x)")} % 6 h, c - c % 100 b from (select c, count(*) n from o group by 1), crc),
t as (select k.c, r p, role, text from k join o on o.c = k.b where r <= h
 union all select k.c, least(k.h, coalesce(base.n, 0)) + r - k.h, role, text from k join o on o.c = k.c left join k base on base.c = k.b where r > k.h),
mem as (select c, p d, string_agg(sha256(role) || sha256(text), '') over (partition by c order by p) q, length(text) size from t union all select c, 0, '', 0 from k),
nd as (select d, q, min(c) rep, count(*) n, max(size) size from mem group by 1, 2),
loc as (select mem.c, d, rep from mem join nd using (d, q)),
par as (select nd.d, nd.rep, n, size, loc.rep parent from nd left join loc on loc.c = nd.rep and loc.d = nd.d - 1),
kids as (select parent rep, d - 1 d, count(*) n from par where d > 0 group by 1, 2),
sub as (select loc.rep, loc.d, sum((par.n - 1) * size) saved, count(*) filter (kids.n is null) leaves
 from par join loc on loc.c = par.rep and loc.d <= par.d left join kids on kids.rep = par.rep and kids.d = par.d group by 1, 2),
stop as (select rep, d, string_agg(cast(loc.c as varchar), ',' order by loc.c) ids from loc join (select c, max(d) d from mem group by 1) last using (c, d) group by 1, 2)
select par.rep conv_id, cast(par.d as bigint) depth, parent parent_conv_id, par.n n_convs, coalesce(kids.n, 0) n_children, leaves n_leaves, cast(saved as bigint) saved_tokens, sha256(coalesce(ids, '')) ends_sha256
from par join sub on sub.rep = par.rep and sub.d = par.d left join kids on kids.rep = par.rep and kids.d = par.d left join stop on stop.rep = par.rep and stop.d = par.d""",
}
