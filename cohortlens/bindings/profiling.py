"""Profiling operators on orders, customers and marked line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.bindings.registry import query, rounded, table
from cohortlens.bindings.views import DIRTY_SQL, LINE_FEATURES, dirty_lines
from cohortlens.operators import clean, profile

STATUSES = ["F", "O", "P"]


@query("shape", "select count(*) as n_rows, 6::bigint as n_columns, 'o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority' as column_names from orders")
def shape(spark, sf):
    return profile.shape(table(spark, sf, "orders"))


@query("distinct_values", "select distinct o_orderpriority from orders")
def distinct_values(spark, sf):
    return profile.distinct_values(table(spark, sf, "orders"), "o_orderpriority")


@query("n_distinct", "select count(distinct l_partkey) as n_distinct from lineitem")
def n_distinct(spark, sf):
    return profile.n_distinct(table(spark, sf, "lineitem"), "l_partkey")


@query("value_counts", "select o_orderpriority, count(*) as n from orders where o_orderpriority is not null group by 1 order by n desc, 1")
def value_counts(spark, sf):
    return profile.value_counts(table(spark, sf, "orders"), "o_orderpriority")


@query(
    "value_percentages_non_null",
    """with t as (select case when o_orderpriority = '5-LOW' then null else o_orderpriority end as p from orders)
       select p, count(*) as n, round(100.0::double * count(*) / (select count(p) from t), 6) as pct
       from t where p is not null group by p""",
)
def value_percentages_non_null(spark, sf):
    return _percentages(spark, sf, "non_null")


@query(
    "value_percentages_rows",
    """with t as (select case when o_orderpriority = '5-LOW' then null else o_orderpriority end as p from orders)
       select p, count(*) as n, round(100.0::double * count(*) / (select count(*) from t), 6) as pct
       from t where p is not null group by p""",
)
def value_percentages_rows(spark, sf):
    return _percentages(spark, sf, "rows")


def _percentages(spark, sf, denominator):
    priority = F.col("o_orderpriority")
    p = table(spark, sf, "orders").select(F.when(priority != "5-LOW", priority).alias("p"))
    return rounded(profile.value_percentages(p, "p", denominator), ["pct"])


@query(
    "demographic_columns",
    """with t as (select o_orderpriority as "Stage", o_orderstatus as "Sex", o_custkey as "Age" from orders),
       c as (select 'Stage' as column_name, count(distinct "Stage") as n_distinct from t
             union all select 'Sex', count(distinct "Sex") from t
             union all select 'Age', count(distinct "Age") from t)
       select * from c where n_distinct > 1 and n_distinct <= 10""",
)
def demographic_columns(spark, sf):
    people = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("Stage"), F.col("o_orderstatus").alias("Sex"), F.col("o_custkey").alias("Age"), "o_totalprice"
    )
    return profile.demographic_columns(people)


@query(
    "crosstab",
    """select o_orderpriority, count(*) filter (where o_orderstatus = 'F') as "F",
              count(*) filter (where o_orderstatus = 'O') as "O", count(*) filter (where o_orderstatus = 'P') as "P"
       from orders where o_orderpriority is not null and o_orderstatus is not null group by 1""",
)
def crosstab(spark, sf):
    return profile.crosstab(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", STATUSES)


@query(
    "crosstab_pct",
    """with c as (select o_orderpriority as p, o_orderstatus as s, count(*) as n from orders
                  where o_orderpriority is not null and o_orderstatus is not null group by 1, 2),
       w as (select p, s, 100.0::double * n / sum(n) over (partition by s) as pct from c)
       select p as o_orderpriority, round(coalesce(sum(pct) filter (where s = 'F'), 0), 6) as "F",
              round(coalesce(sum(pct) filter (where s = 'O'), 0), 6) as "O",
              round(coalesce(sum(pct) filter (where s = 'P'), 0), 6) as "P"
       from w group by p""",
)
def crosstab_pct(spark, sf):
    return rounded(profile.crosstab_pct(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", STATUSES), STATUSES)


@query(
    "missing_report",
    f"""with {DIRTY_SQL}
        select 'price' as column_name, count(*) filter (where price is null) as n_missing from cleaned
        union all select 'l_returnflag', count(*) filter (where l_returnflag is null) from cleaned""",
)
def missing_report(spark, sf):
    return profile.missing_report(clean.clean_numeric(dirty_lines(spark, sf), ["price"]), ["price", "l_returnflag"])


@query(
    "removal_report",
    f"""with {DIRTY_SQL}
        select count(*) as n_rows, count(*) filter (where price is null) as n_removed,
               count(*) filter (where price is null) as n_missing_cells, count(price) as n_kept,
               round(100.0::double * count(*) filter (where price is null) / count(*), 6) as pct_removed
        from cleaned""",
)
def removal_report(spark, sf):
    cleaned = clean.clean_numeric(dirty_lines(spark, sf), ["price"])
    return rounded(profile.removal_report(cleaned, ["price"]), ["pct_removed"])
