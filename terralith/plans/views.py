"""Domain tables as views over the relational test tables: one set of expressions for Spark and for the SQL checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import table

#: name: (table, expressions). The expressions are portable SQL; numbers are written as doubles.
VIEWS: dict[str, tuple[str, list[str]]] = {
    "v_sites": ("customer", [
        "c_custkey as rec",
        "case when c_custkey % 10 = 0 then 'cosore' else 'srdb' end as source",
        "case when c_custkey % 4 = 0 then -125e0 + (c_custkey % 12) * 5e0 else 25e0 + (c_custkey % 31) * 5e0 end + (c_custkey % 7) * 1.25e-2 as longitude",
        "case when c_custkey % 4 = 0 then 24e0 + (c_custkey % 5) * 5e0 else -10e0 + (c_custkey % 18) * 5e0 end + (c_custkey % 5) * 1.25e-2 as latitude",
        "c_acctbal as rs_annual",
        "case c_mktsegment when 'BUILDING' then 'Fertilized' when 'MACHINERY' then 'Control' when 'FURNITURE' then ' Baseline ' else null end as manipulation",
    ]),
    "v_flux": ("events", ["user_id as port", "ts as t", "value as flux"]),
    "v_cells": ("part", ["cast(p_partkey % 50 as int) as c", "cast(floor(p_partkey / 5e1) as int) as r", "case when p_size = 1 then null else p_retailprice end as v", "p_size as code"]),
    "v_feat": ("lineitem", [
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        "l_quantity - 20e0 as bio01", "l_quantity - 8e0 as bio05", "l_quantity - 35e0 as bio06", "l_extendedprice / 4e1 as bio12", "l_tax * 1e3 as bio14", "l_tax * 3e3 as bio17",
        "case when l_partkey % 97 = 0 then null else l_discount * 1e2 end as nitrogen", "l_quantity as soc", "l_discount * 1e3 as clay", "l_tax * 1e3 - 2e1 as sand", "l_quantity * 3e-1 as phh2o",
        "cast(l_suppkey % 19 as int) as landcover", "l_returnflag as stratum",
    ]),
    "v_pred": ("orders", ["o_orderkey as id", "o_custkey", "o_orderpriority as stratum", "o_orderstatus as status", "ln(o_totalprice) as y", "avg(ln(o_totalprice)) over (partition by o_custkey) as p"]),
    "v_px": ("part", [
        "cast(p_partkey % 50 as int) as px", "cast(floor(p_partkey / 5e1) as int) as py", "cast((p_partkey * 37) % 256 as int) as r", "cast((p_partkey * 91) % 256 as int) as g", "cast((p_partkey * 53) % 256 as int) as b",
        "cast(case when p_size % 5 = 0 then 0 else 255 end as int) as a", "5e-1 + (p_partkey % 1000) / 1e3 as ratio",
    ]),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, exprs = VIEWS[name]
    return table(spark, sf_dir, source).selectExpr(*exprs)


def with_views(sql: str) -> str:
    """The SQL with the views that it names put before it."""
    used = [n for n in VIEWS if n in sql]
    ctes = [f"{n} as (select {', '.join(VIEWS[n][1])} from {VIEWS[n][0]})" for n in used]
    if not ctes:
        return sql
    body = sql.strip()
    if body.lower().startswith("with "):
        return "with " + ",\n".join(ctes) + ",\n" + body[5:]
    return "with " + ",\n".join(ctes) + "\n" + body
