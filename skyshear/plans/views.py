"""Radar-shaped inputs projected from the driver's tables.

The text of a view is the same for Spark and for the SQL that results are
compared with, but for the few functions in DIALECT; operators stand on top.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

DIALECT = {
    "spark": {"EPOCH": "unix_timestamp(date_trunc('second', {0}))", "STAMP": "date_format({0}, 'yyyyMMddHHmmss')"},
    "duckdb": {"EPOCH": "CAST(floor(epoch({0})) AS BIGINT)", "STAMP": "strftime({0}, '%Y%m%d%H%M%S')"},
}
TABLES = ("lineitem", "orders", "part", "supplier", "customer", "nation", "region", "events", "embeddings", "documents")
VIEWS = {
    "gates": """SELECT radar, sweep, ray, gate, round(avg(vr), 6) + 0e0 AS vr, max(dbz) AS dbz FROM (
        SELECT CAST(l_linenumber % 2 + 1 AS INT) AS radar, CAST(l_suppkey % 6 AS INT) AS sweep, CAST(l_orderkey % 360 AS INT) AS ray, CAST(l_partkey % 100 AS INT) AS gate,
          l_quantity - 255e-1 AS vr, round(l_extendedprice / 15e2 - 1e1, 6) + 0e0 AS dbz FROM lineitem) GROUP BY radar, sweep, ray, gate""",
    "cells": """SELECT k, j, i, (i - 10) * 5e3 AS x, (j - 10) * 5e3 AS y, 5e2 + 5e2 * k AS z, round(v1, 6) + 0e0 AS vr1, round(v2, 6) + 0e0 AS vr2, d1 AS dbz1, d2 AS dbz2 FROM (
        SELECT CAST(l_suppkey % 5 AS INT) AS k, CAST(l_partkey % 21 AS INT) AS j, CAST(l_orderkey % 21 AS INT) AS i,
          avg(CASE WHEN l_linenumber % 2 = 0 THEN l_quantity - 255e-1 END) AS v1, avg(CASE WHEN l_linenumber % 2 = 1 THEN l_quantity - 255e-1 END) AS v2,
          max(CASE WHEN l_linenumber % 2 = 0 THEN round(l_extendedprice / 15e2 - 1e1, 6) + 0e0 END) AS d1, max(CASE WHEN l_linenumber % 2 = 1 THEN round(l_extendedprice / 15e2 - 1e1, 6) + 0e0 END) AS d2
        FROM lineitem WHERE (7 * (l_orderkey % 21) + 3 * (l_partkey % 21) + 5 * (l_suppkey % 5) + l_linenumber % 2) % 11 <> 0
        GROUP BY 1, 2, 3)""",
    "wind": """SELECT k, j, i, x, y, z, vr1 AS u, vr2 AS v, round(vr1 + vr2, 6) + 0e0 AS w, greatest(dbz1, dbz2) AS dbz, (vr1 IS NOT NULL AND vr2 IS NOT NULL) AS valid FROM cells""",
    "field": """SELECT t, j, i, round(CAST(sum(p) AS DOUBLE) / count(*) / 7919e3, 6) + 0e0 AS v FROM (
        SELECT CAST(extract(month FROM o_orderdate) % 6 AS INT) AS t, CAST(o_custkey % 15 AS INT) AS j, CAST(o_orderkey % 15 AS INT) AS i, CAST(round(o_totalprice * 1e2) AS BIGINT) AS p FROM orders
        WHERE (o_orderkey % 15 + 2 * (o_custkey % 15)) % 7 <> 3) GROUP BY t, j, i""",
    "scans": """SELECT DISTINCT CAST(user_id % 2 + 1 AS INT) AS station, EPOCH(ts) AS sec FROM events""",
    "profile": """SELECT CAST(p_size AS INT) AS level, round(avg(p_retailprice) / 1e2, 6) + 0e0 AS speed, CAST(max(p_partkey) % 360 AS INT) AS direction, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY p_size""",
    "features": """SELECT s_suppkey AS id, (s_suppkey % 37) * 25e2 - 45e3 AS fx, (s_suppkey % 29) * 3e3 - 42e3 AS fy, 6e2 + (s_suppkey % 5) * 45e1 AS fz, s_acctbal AS strength FROM supplier""",
    "names": """SELECT DISTINCT concat('Z9', CAST(100 + user_id % 7 AS VARCHAR(9)), '_', STAMP(ts), CASE WHEN event_id % 13 = 0 THEN '' ELSE 'Z' END, '_', CASE WHEN event_id % 11 = 0 THEN 'ProductIndex' ELSE 'PPI' END, '_0', CAST(1 + user_id % 6 AS VARCHAR(9)),
        CASE WHEN event_id % 17 = 0 THEN '' WHEN event_id % 3 = 0 THEN '_019' WHEN event_id % 3 = 1 THEN '_026' ELSE '_999' END) AS name FROM events""",
    "tensor": """SELECT CAST(vec_id AS BIGINT) AS row, CAST(pos AS INT) AS col, label, CAST(val AS DOUBLE) AS value FROM TENSOR""",
}
NEEDS = {"wind": ("cells",)}


def text(name: str, dialect: str) -> str:
    sql = VIEWS[name]
    for word, form in DIALECT[dialect].items():
        sql = re.sub(rf"\b{word}\(([^()]*)\)", lambda m, form=form: form.format(m[1]), sql)
    if dialect == "spark":
        return sql.replace("FROM TENSOR", "FROM (SELECT vec_id, label, posexplode(embedding) AS (pos, val) FROM embeddings)")
    return sql.replace("FROM TENSOR", "FROM (SELECT vec_id, label, unnest(embedding) AS val, unnest(range(len(embedding))) AS pos FROM embeddings)")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """View ``name`` as a DataFrame; unused columns and tables never leave the scan."""
    sql = text(name, "spark")
    used = [t for t in TABLES if re.search(rf"\bFROM {t}\b", sql)]
    args = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used} | {v: view(spark, sf_dir, v) for v in NEEDS.get(name, ())}
    for t in args:
        sql = re.sub(rf"\bFROM {t}\b", f"FROM {{{t}}}", sql)
    return spark.sql(sql, **args)


def oracle(names: str, body: str, recursive: bool = False) -> str:
    """SQL for DuckDB: the views that ``body`` needs, then ``body``."""
    wanted: list[str] = []
    for name in names.split():
        wanted += [x for x in (*NEEDS.get(name, ()), name) if x not in wanted]
    views = ",\n".join(f"{n} AS ({text(n, 'duckdb')})" for n in wanted)
    return f"WITH {'RECURSIVE ' if recursive else ''}{views}{', ' if body.lstrip().startswith('+') else ' '}{body.lstrip().removeprefix('+')}"
