"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import dates, logic, numbers, text
from tallyloom.plans.catalog import query, table


@query("""
select c_custkey, case when c_acctbal < 0 then 'debit' else 'credit' end as side,
  case when c_acctbal > 9000 then 1 else 0 end as rich, nullif(c_mktsegment, 'BUILDING') is null as no_segment,
  case nullif(c_mktsegment, 'BUILDING') when 'MACHINERY' then 'M' when 'FURNITURE' then 'F' else case when c_mktsegment = 'BUILDING' then 'none' else '?' end end as code,
  case when c_acctbal < 1000 then 'low' when c_acctbal < 5000 then 'mid' end as band, c_acctbal >= 500 and not c_nationkey = 3 as flagged
from customer
""")
def conditional_functions(spark, sf):
    bal, seg = F.col("c_acctbal"), F.nullif("c_mktsegment", F.lit("BUILDING"))
    return table(spark, sf, "customer").select(
        "c_custkey", logic.iif(bal < 0, "debit", "credit").alias("side"), logic.iif(bal > 9000, 1, kind="number").alias("rich"),
        logic.is_null(seg).alias("no_segment"), logic.decode(seg, None, "none", "MACHINERY", "M", "FURNITURE", "F", "?").alias("code"),
        logic.switch(bal < 1000, "low", bal < 5000, "mid").alias("band"),
        (logic.compare(bal, ">=", 500) & ~logic.compare(F.col("c_nationkey"), "=", 3)).alias("flagged"),
    )


@query(r"""
select p_partkey, p_name || '/' || p_brand as joined, substring(p_name, 2, 4) as middle, substring(p_name, 3, 4) as java_sub, instr(p_name, 'e')::int as pos,
  length(p_name)::int as len, upper(p_name) as up, lower(p_brand) as low, ltrim('  ' || p_name || '  ') as lt, rtrim('  ' || p_name || '  ') as rt,
  trim('  ' || p_name || '  ') as bt, left(p_name, 3) as head, right(p_name, 3) as tail, replace(p_name, 'e', '3') as changed,
  regexp_replace(p_name, '[aeiou]+', '*', 'g') as ereplaced, p_brand = 'Brand#1' as eq, lower(p_type) = 'small' as eq_ci, contains(p_name, 'bolt') as has_bolt,
  starts_with(p_name, 'red') as is_red, chr(65 + p_size % 26) as letter, ascii(p_name) as code, p_size::varchar as size_text,
  format('{:,.2f}', p_retailprice) as price_text, 'Part ' || p_name || ' of ' || p_brand || '.' as message
from part
""")
def text_functions(spark, sf):
    name, brand, padded = F.col("p_name"), F.col("p_brand"), F.concat(F.lit("  "), "p_name", F.lit("  "))
    return table(spark, sf, "part").select(
        "p_partkey", text.concat(name, F.lit("/"), brand).alias("joined"), text.substr(name, 2, 4).alias("middle"),
        text.java_substring(name, 2, 6).alias("java_sub"), text.instr(name, "e").alias("pos"), text.length(name).alias("len"),
        text.upper(name).alias("up"), text.lower(brand).alias("low"), text.ltrim(padded).alias("lt"), text.rtrim(padded).alias("rt"),
        text.trim(padded).alias("bt"), text.left(name, 3).alias("head"), text.right(name, 3).alias("tail"),
        text.change(name, "e", "3").alias("changed"), text.ereplace(name, "[aeiou]+", "*").alias("ereplaced"),
        text.equals(brand, "Brand#1").alias("eq"), text.equals(F.col("p_type"), "Small", ignore_case=True).alias("eq_ci"),
        text.contains(name, "bolt").alias("has_bolt"), text.starts_with(name, "red").alias("is_red"),
        text.chr_(F.lit(65) + F.col("p_size") % 26).alias("letter"), text.asc(name).alias("code"), text.to_text(F.col("p_size")).alias("size_text"),
        text.to_text(F.col("p_retailprice"), 2).alias("price_text"), text.message("Part {0} of {1}.", name, brand).alias("message"),
    )


@query("""
select p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') as proper from part
""")
def proper_case(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.proper_case(F.col("p_name")).alias("proper"))


@query("select o_orderkey, o_orderpriority as repaired, o_orderpriority as kept from orders")
def repair_byteswapped(spark, sf):
    swapped = F.decode(F.encode("o_orderpriority", "UTF-16LE"), "UTF-16BE")
    return table(spark, sf, "orders").select(
        "o_orderkey", text.repair_byteswapped(swapped).alias("repaired"), text.repair_byteswapped(F.col("o_orderpriority")).alias("kept")
    )


@query(r"""
with l as (select conv_id, turn, trim(regexp_replace('March ' || turn || ', 2024: $ ' || length(text) || '  items', '\s+', ' ', 'g')) as x from conversations)
select conv_id, turn, replace(regexp_replace(replace(x, 'March', 'Mar'), '[\d,.]+', '#', 'g'), '$ #', '$#') as norm from l
""")
def normal_line(spark, sf):
    line = F.concat(F.lit("March "), F.col("turn").cast("string"), F.lit(", 2024: $ "), F.length("text").cast("string"), F.lit("  items"))
    return table(spark, sf, "conversations").select("conv_id", "turn", text.normal_line(line).alias("norm"))


@query("""
select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when l_linenumber > 1 then l_quantity end as parsed, l_partkey % 7 - 3 as signed_mod,
  abs(l_discount - 0.05::double) as dist, round(l_extendedprice, 0) as whole, floor(l_extendedprice)::bigint as below, trunc(l_extendedprice) as cut,
  sqrt(l_quantity) as root, round(exp(l_tax), 9) as grown, round(ln(l_quantity), 9) as logged, least(l_quantity, l_linenumber) as low,
  greatest(l_quantity, l_linenumber) as high, l_tax * 100 / nullif(l_discount, 0) as percentage,
  (coalesce(case when l_tax > 0 then l_tax end, 0) + l_discount) / ((l_tax > 0)::int + 1) as mean
from lineitem
""")
def numeric_functions(spark, sf):
    c = F.col
    parsed = F.when(c("l_linenumber") > 1, F.concat(F.lit(" "), c("l_quantity").cast("string"))).otherwise("n/a")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", numbers.to_number(parsed).alias("parsed"),
        (numbers.mod(c("l_partkey"), F.lit(7)) - 3).alias("signed_mod"), F.abs(c("l_discount") - 0.05).alias("dist"),
        numbers.round_(c("l_extendedprice")).alias("whole"), numbers.int_(c("l_extendedprice")).alias("below"),
        numbers.truncate(c("l_extendedprice")).alias("cut"), numbers.sqr(c("l_quantity")).alias("root"),
        F.round(numbers.exp(c("l_tax")), 9).alias("grown"), F.round(numbers.log(c("l_quantity")), 9).alias("logged"),
        numbers.minimum(c("l_quantity"), c("l_linenumber")).alias("low"), numbers.maximum(c("l_quantity"), c("l_linenumber")).alias("high"),
        numbers.percentage(c("l_tax"), c("l_discount")).alias("percentage"),
        numbers.average_of(F.when(c("l_tax") > 0, c("l_tax")), c("l_discount")).alias("mean"),
    )


@query(r"""
select c_custkey, regexp_replace(regexp_replace(printf('%.6f', c_acctbal), '0+$', ''), '\.$', '') as plain,
  regexp_replace(regexp_replace(printf('%.6f', -abs(c_acctbal)), '0+$', ''), '\.$', '') as wrapped, c_custkey::varchar as padded, null::varchar as code
from customer
""")
def canonical_number(spark, sf):
    bal = F.col("c_acctbal")
    grouped = F.format_number(bal, 2)
    return table(spark, sf, "customer").select(
        "c_custkey", numbers.canonical_number(F.concat(F.when(bal < 0, "").otherwise("$ "), grouped)).alias("plain"),
        numbers.canonical_number(F.concat(F.lit("("), F.format_number(F.abs(bal), 2), F.lit(")"))).alias("wrapped"),
        numbers.canonical_number(F.lpad(F.col("c_custkey").cast("string"), 12, "0")).alias("padded"),
        numbers.canonical_number(F.concat(F.lit("ACC-"), F.col("c_custkey"))).alias("code"),
    )


@query("select count(*) as rows, count(*) as ints, count(*) as units, count(*) as words, count(*) as texts, count(*) as days, true as repeatable from orders")
def random_functions(spark, sf):
    """Values for all orders, on two partitionings: a value counts if it is in range and the same on both."""
    words = ["Ada", "Ben", "Cleo", "Dov"]

    def values(keys, suffix):
        key = F.col("o_orderkey")
        made = {
            "i": numbers.random_int(5, 9, 1, key), "u": numbers.random_unit(2, key), "w": numbers.random_pick(words, 3, key),
            "t": numbers.random_text(6, 4, key), "d": numbers.random_date("2020-01-01", "2020-12-31", 5, key), "r": numbers.random_int(1, 100, 6, key),
        }
        return keys.select("o_orderkey", *(v.alias(n + suffix) for n, v in made.items()))

    keys = table(spark, sf, "orders").select("o_orderkey")
    both = values(keys.repartition(7), "").join(values(keys.distinct(), "_again"), "o_orderkey", "left")
    same = lambda name, ok: F.count_if(ok & (F.col(name) == F.col(f"{name}_again")))
    return both.agg(
        F.count(F.lit(1)).alias("rows"), same("i", F.col("i").between(5, 9)).alias("ints"),
        same("u", (F.col("u") >= 0) & (F.col("u") < 1)).alias("units"), same("w", F.col("w").isin(words)).alias("words"),
        same("t", F.col("t").rlike("^[A-Za-z0-9]{6}$")).alias("texts"),
        same("d", F.col("d").between("2020-01-01", "2020-12-31")).alias("days"),
        F.bool_and(F.coalesce(F.col("r") == F.col("r_again"), F.lit(False))).alias("repeatable"),
    )


@query("""
select o_orderkey, date '2001-06-15' as today, o_orderdate as parsed, strftime(o_orderdate, '%Y%m%d') as stamp, year(o_orderdate)::int as y,
  month(o_orderdate)::int as m, day(o_orderdate)::int as d, dayofweek(o_orderdate)::int + 1 as weekday, isodow(o_orderdate)::int as monday_first,
  make_date(year(o_orderdate), month(o_orderdate), 1)::date as month_start, (make_date(year(o_orderdate) + 1, 1, 1) - 1)::date as year_end,
  o_orderdate::date as made, date_diff('day', o_orderdate, timestamp '2001-06-15')::int as days,
  date_diff('month', o_orderdate, timestamp '2001-06-15')::int as months, date_diff('year', o_orderdate, timestamp '2001-06-15')::int as years,
  (o_orderdate::date + 45)::date as later, (o_orderdate::date + interval 1 month)::date as next_month,
  sign(date_diff('day', timestamp '1998-01-01', o_orderdate::date))::int as side, o_orderkey % 10 <> 0 as is_date
from orders
""")
def date_functions(spark, sf):
    day, ref = F.col("o_orderdate"), dates.today("2001-06-15")
    as_text = F.date_format(day, "MM/dd/yyyy")
    return table(spark, sf, "orders").select(
        "o_orderkey", ref.alias("today"), dates.to_date(as_text, "MM/DD/YYYY").cast("timestamp_ntz").alias("parsed"),
        dates.to_char(day, "YYYYMMDD").alias("stamp"), dates.part(day, "Year").alias("y"), dates.part(day, "Month").alias("m"),
        dates.part(day, "Day").alias("d"), dates.weekday(day).alias("weekday"), dates.weekday(day, first=2).alias("monday_first"),
        dates.make(F.year(day), F.month(day), F.lit(1)).alias("month_start"), dates.make(F.year(day), F.lit(13), F.lit(0)).alias("year_end"),
        dates.to_day(F.date_format(day, "yyyy-MM-dd")).alias("made"), dates.diff("d", day, ref).alias("days"),
        dates.diff("m", day, ref).alias("months"), dates.diff("yyyy", day, ref).alias("years"),
        dates.add("d", day, 45).alias("later"), dates.add("m", day, 1).alias("next_month"),
        dates.compare(day, F.lit("1998-01-01").cast("date")).alias("side"),
        dates.is_date(F.when(F.col("o_orderkey") % 10 == 0, "13/45/2000").otherwise(as_text), "MM/dd/yyyy").alias("is_date"),
    )


@query("""
with d as (select o_orderkey, o_orderdate as a, timestamp '2001-06-15' as b from orders),
m as (select *, (year(b) - year(a)) * 12 + month(b) - month(a) as n, day(b) - day(a) as left_days from d
union all select -o_orderkey, b, a, (year(a) - year(b)) * 12 + month(a) - month(b), day(a) - day(b) from d),
w as (select o_orderkey, n - case when n > 0 and left_days < 0 then 1 when n < 0 and left_days > 0 then -1 else 0 end as whole from m)
select o_orderkey, whole::int as months, (sign(whole) * (abs(whole) // 12))::int as years from w
""")
def date_elapsed(spark, sf):
    ref, orders = dates.today("2001-06-15"), table(spark, sf, "orders")
    span = lambda a, b: [dates.elapsed("m", a, b).alias("months"), dates.elapsed("yyyy", a, b).alias("years")]
    forward = orders.select("o_orderkey", *span(F.col("o_orderdate"), ref))
    return forward.unionAll(orders.select(-F.col("o_orderkey"), *span(ref, F.col("o_orderdate"))))


@query("""
select event_id, ts::date as day, date_trunc('second', ts) as stamp, strftime(ts, '%H:%M:%S') as clock, ts::date::timestamp as midnight, event_type = 'click' as yes from events
""")
def encoded_dates(spark, sf):
    serial = (F.unix_date(F.to_date("ts")) + dates.EPOCH_SERIAL).cast("long")
    seconds = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    packed = F.shiftleft(seconds.cast("long"), 32).bitwiseOR(serial)
    broken = F.shiftleft(F.lit(90_000).cast("long"), 32).bitwiseOR(serial)
    return table(spark, sf, "events").select(
        "event_id", dates.serial_to_date(serial).alias("day"), dates.packed_to_timestamp(packed).cast("timestamp_ntz").alias("stamp"),
        dates.seconds_to_time(seconds).alias("clock"), dates.packed_to_timestamp(broken).cast("timestamp_ntz").alias("midnight"),
        numbers.decode_boolean(F.when(F.col("event_type") == "click", " TRUE ").otherwise("0")).alias("yes"),
    )
