"""Paged text: documents cut into pages of a few lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import paged_text as pt
from tallyloom.plans.catalog import query, table

PAGE = 6
VALUES = ["the", "and", "there", "Customer", "worthless", "le", "de"]


def _pages(spark, sf):
    return pt.cut_pages(table(spark, sf, "documents"), "doc_id", "text", PAGE)


def _conversion(spark, sf):
    """A re-wrapped copy: every third line break is gone, one word is lost, and a line is put before each text."""
    lines = F.transform(
        F.split("text", "\n"), lambda line, i: F.concat(line, F.when(i % 3 == 2, F.lit(" ")).otherwise(F.lit("\n")))
    )
    text = F.concat(F.lit("Converted copy\n"), F.replace(F.array_join(lines, ""), F.lit(" this "), F.lit(" ")))
    return pt.cut_pages(table(spark, sf, "documents").withColumn("text", text), "doc_id", "text", PAGE)


def _norm(x: str) -> str:
    line = rf"trim(regexp_replace({x}, '[\s\x0b\x1c-\x1f\x85\p{{Z}}]+', ' ', 'g'))"
    masked = rf"replace(regexp_replace({line}, '[\d,.]+', '#', 'g'), '$ #', '$#')"
    return f"case when length({masked}) >= 6 then {masked} else '' end"


def _paged(source: str) -> str:
    return f"""
l as (select doc_id, ((ord - 1) // {PAGE})::int as page_no, ((ord - 1) % {PAGE})::int as line_no, line from (
  select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as ord from {source})),
n as (select doc_id, page_no, line_no, {_norm('line')} as norm from l),
d as (select distinct doc_id, page_no, norm from n where norm <> ''),
f as (select doc_id, page_no from d group by 1, 2 having count(*) >= 3),
p as (select doc_id, count(*) as pages from f group by 1),
b as (select doc_id, norm from (select d.doc_id, d.norm, count(*) as c from d join f using (doc_id, page_no) group by 1, 2) join p using (doc_id)
  where c >= greatest(2, floor(pages * 0.6::double)))
"""


_LINES = _paged("documents")


@query("select doc_id, page_no, line_no, length(line)::int as chars from (with " + _LINES + " select * from l)")
def cut_pages(spark, sf):
    return _pages(spark, sf).select("doc_id", "page_no", "line_no", F.length("line").alias("chars"))


@query("with " + _LINES + " select doc_id, norm from b")
def boilerplate(spark, sf):
    return pt.boilerplate(_pages(spark, sf), "doc_id")


@query("with " + _LINES + """, c as (select doc_id, page_no, count(*) as content from n where norm <> '' and (doc_id, norm) not in (select doc_id, norm from b) group by 1, 2)
select g.doc_id, g.page_no, coalesce(content, 0) as content from (select distinct doc_id, page_no from l) g left join c using (doc_id, page_no)
where coalesce(content, 0) <= 3
""")
def sparse_pages(spark, sf):
    return pt.sparse_pages(_pages(spark, sf), "doc_id")


_VALUES = ", ".join(f"('{v}')" for v in VALUES)
_OWNED = f""",
v(value) as (values {_VALUES}),
h as (select distinct doc_id, page_no, value from l join v on contains(line, value)),
o as (select * from h where not exists (select 1 from h g where g.doc_id = h.doc_id and g.page_no = h.page_no and g.value <> h.value and contains(g.value, h.value))),
i as (select *, page_no - row_number() over (partition by doc_id, value order by page_no) as island from o),
r as (select doc_id, value, min(page_no) as first_pos, max(page_no) as last_pos, count(*) as run_length from i group by doc_id, value, island),
s as (select * from (select *, row_number() over (partition by doc_id, value order by run_length desc, first_pos) as rn from r) where rn = 1)
"""
_SPANS = _LINES + _OWNED


@query("with " + _SPANS + " select doc_id, value, first_pos, last_pos, run_length from s")
def group_spans(spark, sf):
    return pt.group_spans(_pages(spark, sf), "doc_id", VALUES)


@query("with " + _SPANS + """, k as (select o.doc_id, o.value, o.page_no from o join s on o.doc_id = s.doc_id and o.value = s.value
  where o.page_no >= first_pos and o.page_no < last_pos),
m as (select doc_id, page_no, arg_max(norm, line_no) as mark from n where norm <> '' and (doc_id, norm) not in (select doc_id, norm from b) group by 1, 2)
select k.doc_id, value, k.page_no, coalesce(mark, '') as mark from k left join m on k.doc_id = m.doc_id and k.page_no = m.page_no
""")
def group_breaks(spark, sf):
    return pt.group_breaks(_pages(spark, sf), "doc_id", VALUES)


def _found(pattern: str) -> str:
    bare = f"list_transform(regexp_extract_all(t, '{pattern}', 1), lambda m: regexp_replace(m, '[^\\d.]', '', 'g'))"
    return f"list_distinct(list_filter({bare}, lambda m: m <> ''))"


@query(f"""
with q as (select doc_id, string_split(text, chr(10)) as a, ((doc_id * 7919) % 9000)::varchar || '.50' as amount from documents),
ot as (select doc_id, array_to_string(list_concat(list_concat(a[1:{PAGE - 1}], ['Invoices totalling $' || amount || ' are due.', 'Total: $' || amount]),
  a[{PAGE}:]), chr(10)) as text from q),""" + _paged("ot") + _OWNED + f""",
pt as (select doc_id, page_no, string_agg(line, chr(10) order by line_no) as t from l group by 1, 2),
am as (select doc_id, page_no, {_found(pt.STATED_TOTAL)} as stated, {_found(pt.TOTAL_AMOUNT)} as totals, {_found(pt.ANY_MONEY)} as money from pt),
ow as (select o.doc_id, o.page_no, arg_max(o.value, list_position({VALUES!r}, o.value)) as owner from o join s on o.doc_id = s.doc_id and o.value = s.value
  where o.page_no between first_pos and last_pos group by 1, 2),
co as (select doc_id, page_no, count(*) as content, bool_or(regexp_matches(norm, '{pt.TOTAL_MARKER}')) as marked from n
  where norm <> '' and (doc_id, norm) not in (select doc_id, norm from b) group by 1, 2),
pg as (select am.*, owner, content, marked, case when len(stated) > 0 then stated else money end as claims
  from am left join ow using (doc_id, page_no) left join co using (doc_id, page_no)),
j as (select c.doc_id, c.page_no, c.owner, c.content, c.marked, c.totals, e.owner as e_owner, e.claims as e_claims, e.stated as e_stated,
  len(e.stated) > 0 and not list_has_any(e.stated, e.totals) and list_has_any(e.stated, c.totals) as declared
  from pg c join pg e on c.doc_id = e.doc_id and c.page_no = e.page_no + 1)
select doc_id, case when declared then coalesce(e_owner, list_min(e_stated)) else e_owner end as owner, page_no from j
where declared or (content between 1 and 8 and marked and owner is null and e_owner is not null
  and not (len(totals) > 0 and len(e_claims) > 0 and not list_has_any(e_claims, totals)))
""")
def orphan_totals(spark, sf):
    """Totals are planted: the last line of the first page states one, the next page begins with it."""
    amount = F.concat(((F.col("doc_id") * 7919) % 9000).cast("string"), F.lit(".50"))
    lines = F.split("text", "\n")
    planted = F.array_join(
        F.concat(
            F.slice(lines, 1, PAGE - 1), F.array(F.concat(F.lit("Invoices totalling $"), amount, F.lit(" are due."))),
            F.array(F.concat(F.lit("Total: $"), amount)), F.slice(lines, F.lit(PAGE), F.size(lines)),
        ),
        "\n",
    )
    paged = pt.cut_pages(table(spark, sf, "documents").withColumn("text", planted), "doc_id", "text", PAGE)
    return pt.orphan_totals(paged, "doc_id", VALUES)


_BOTH = _LINES + f""",
ct as (select doc_id, 'Converted copy' || chr(10) || replace(array_to_string(list_transform(string_split(text, chr(10)),
  lambda x, i: x || case when i % 3 = 0 then ' ' else chr(10) end), ''), ' this ', ' ') as text from documents),
cl as (select doc_id, ((ord - 1) // {PAGE})::int as page_no, ((ord - 1) % {PAGE})::int as line_no, line from (
  select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as ord from ct)),
cn as (select doc_id, page_no, line_no, {_norm('line')} as norm from cl)
"""


@query("with " + _BOTH + f""",
pg as (select doc_id, page_no, {_norm("string_agg(line, ' ' order by line_no)")} as t from cl group by 1, 2),
st as (select doc_id, replace(string_agg(t, '' order by page_no), ' ', '') as stream from pg group by 1),
a as (select doc_id, norm, min(page_no) as page_no from n where norm <> '' group by 1, 2),
c as (select doc_id, norm, min(page_no) as new_page from cn where norm <> '' group by 1, 2)
select a.doc_id, a.norm, a.page_no, case when new_page = a.page_no then 'same' when new_page is not null then 'moved'
  when contains(stream, replace(a.norm, ' ', '')) then 'wrapped' else 'missing' end as state, new_page
from a left join c on a.doc_id = c.doc_id and a.norm = c.norm join st on st.doc_id = a.doc_id
""")
def line_parity(spark, sf):
    return pt.line_parity(_pages(spark, sf), _conversion(spark, sf), "doc_id")


def _page_sets(lines: str, page: str) -> str:
    return f"""select doc_id, page_no as {page}, sig, len(sig) as size, row_number() over (partition by doc_id, sig order by page_no) as copy
  from (select doc_id, page_no, list_sort(list(distinct norm)) as sig from {lines} where norm <> '' group by 1, 2)"""


@query("with " + _BOTH + f""",
pa as ({_page_sets('n', 'page_a')}), pb as ({_page_sets('cn', 'page_b')}),
la as (select doc_id, page_a, size, sig, unnest(sig) as norm from pa where copy = 1),
lb as (select doc_id, page_b, size, sig, unnest(sig) as norm from pb where copy = 1),
sh as (select la.doc_id, la.sig as sig_a, lb.sig as sig_b, page_a, page_b, count(*) as shared, count(*) / least(min(la.size), min(lb.size)) as overlap,
  -abs(min(la.size) - min(lb.size)) as near
  from la join lb on la.doc_id = lb.doc_id and la.norm = lb.norm group by 1, 2, 3, 4, 5),
ok as (select * from sh where overlap >= 0.4::double),
ba as (select doc_id, sig_a, arg_max(sig_b, (overlap, shared, near, -page_b)) as sig_b from ok group by 1, 2),
bb as (select doc_id, sig_b, arg_max(sig_a, (overlap, shared, near, -page_a)) as sig_a from ok group by 1, 2),
mu as (select ok.doc_id, sig_a, sig_b, overlap from ok join ba using (doc_id, sig_a, sig_b) join bb using (doc_id, sig_a, sig_b))
select mu.doc_id, pa.page_a, pb.page_b, round(overlap, 4) as overlap from mu join pa on pa.doc_id = mu.doc_id and pa.sig = mu.sig_a
  join pb on pb.doc_id = mu.doc_id and pb.sig = mu.sig_b and pb.copy = pa.copy
""")
def pair_pages(spark, sf):
    return pt.pair_pages(_pages(spark, sf), _conversion(spark, sf), "doc_id")


@query("with recursive " + _BOTH.strip().removeprefix("with") + f""",
pa as (select doc_id, page_no as page_a, list(distinct norm) as lines from n where norm <> '' group by 1, 2),
pb as (select doc_id, page_no as page_b, list(distinct norm) as lines from cn where norm <> '' group by 1, 2),
la as (select doc_id, page_a, len(lines) as size, unnest(lines) as norm from pa), lb as (select doc_id, page_b, len(lines) as size, unnest(lines) as norm from pb),
ok as (select * from (select la.doc_id, page_a, page_b, count(*) / least(min(la.size), min(lb.size)) as overlap from la join lb
  on la.doc_id = lb.doc_id and la.norm = lb.norm group by 1, 2, 3) where overlap >= 0.4::double),
rk as (select *, dense_rank() over (partition by doc_id order by page_b) as step from ok),
walk as (
  select doc_id, 0::bigint as step, -1 as last, null::int as page_a, null::int as page_b, null::double as overlap from (select distinct doc_id from rk)
  union all
  select w.doc_id, w.step + 1, coalesce(c.p.page_a, w.last), c.p.page_a, c.p.page_b, c.p.overlap from walk w
  join (select doc_id, max(step) as steps from rk group by 1) m on m.doc_id = w.doc_id and w.step < m.steps
  left join lateral (select arg_max({{'page_a': rk.page_a, 'page_b': rk.page_b, 'overlap': rk.overlap}}, (rk.overlap, -rk.page_a)) as p from rk
    where rk.doc_id = w.doc_id and rk.step = w.step + 1 and rk.page_a >= w.last) c on true
)
select doc_id, page_a, page_b, round(overlap, 4) as overlap from walk where page_a is not null
""")
def pair_pages_forward(spark, sf):
    return pt.pair_pages_forward(_pages(spark, sf), _conversion(spark, sf), "doc_id")
