"""Evaluation tables (tasks, attempts, gradings, grading plan) seen in the star-schema tables of a scale-factor directory.

The same SQL defines them for Spark and for the oracle, so queries over them can be compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyweave.sources.tables import table

#: By name: the tables read, and the definition. Ids order the attempts of a task by day, then part, supplier and line.
EVALUATION = {
    "tasks": (
        ["orders"],
        """SELECT o_orderkey AS task_id, concat('task ', CAST(o_orderkey AS STRING)) AS task_name,
             CASE o_orderstatus WHEN 'O' THEN 'fmwc' WHEN 'F' THEN 'modeloff' ELSE 'wsp' END AS task_source,
             CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS difficulty,
             CASE WHEN o_orderkey % 17 = 0 THEN TRUE WHEN o_orderkey % 13 = 0 THEN NULL ELSE FALSE END AS deprecated,
             o_totalprice AS chars
           FROM orders""",
    ),
    "attempts": (
        ["lineitem"],
        """SELECT CAST(date_diff_days AS BIGINT) * 10000000000000 + l_partkey * 1000000 + l_suppkey * 10 + l_linenumber AS attempt_id,
             l_orderkey AS task_id, concat('agent', CAST(l_suppkey % 5 AS STRING)) AS agent, CAST(l_linenumber % 2 AS INT) AS prompt_version,
             CASE WHEN l_returnflag = 'R' THEN TRUE WHEN l_tax = 0 THEN NULL ELSE FALSE END AS failed,
             CASE WHEN l_discount > 0.08 THEN TRUE WHEN l_discount = 0 THEN NULL ELSE FALSE END AS deprecated,
             CASE WHEN l_quantity < 5 THEN NULL ELSE l_extendedprice / 1000 END AS minutes,
             CASE l_linenumber % 7 WHEN 0 THEN NULL WHEN 1 THEN '[]' WHEN 2 THEN '["notes.txt"]' WHEN 3 THEN '["a.xlsx", "b.XLSX"]' WHEN 4 THEN concat('[', chr(123), '"filename": "m.xlsm", "url": "u"', chr(125), ', ', chr(123), '"name": "n.txt"', chr(125), ']') WHEN 5 THEN 'folder/old.xls' ELSE '["model.XLSX"]' END AS files,
             l_shipdate AS created_at, l_quantity, l_discount, l_tax
           FROM (SELECT *, DATEDIFF_EXPR AS date_diff_days FROM lineitem) d""",
    ),
    "gradings": (
        ["lineitem"],
        """SELECT attempt_id * 2 + k AS grading_id, attempt_id, task_id,
             CASE WHEN l_tax > 0.07 AND k = 0 THEN NULL ELSE l_quantity * 2 END AS accuracy, l_discount * 1000 + k AS formula, l_tax * 1000 AS format,
             CASE WHEN l_quantity > 45 THEN TRUE WHEN l_quantity < 3 THEN NULL ELSE FALSE END AS failed, FALSE AS deprecated,
             CASE WHEN l_discount < 0.02 THEN TRUE ELSE FALSE END AS context_reduced, created_at
           FROM attempts_all CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k) kk
           WHERE l_quantity % 3 > 0 AND (k = 0 OR l_quantity % 2 = 1)""",
    ),
}


def definition(name: str, spark: bool) -> str:
    """The SQL text of one evaluation table, in Spark's or in the oracle's words for a number of days."""
    days = "datediff(CAST(l_shipdate AS DATE), DATE '1992-01-01')" if spark else "(CAST(l_shipdate AS DATE) - DATE '1992-01-01')"
    text = EVALUATION[name][1].replace("DATEDIFF_EXPR", days)
    if "attempts_all" in text:
        text = text.replace("attempts_all", f"({definition('attempts', spark)}) attempts_all")
    return text if spark else text.replace("AS STRING", "AS VARCHAR")


def evaluation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The evaluation table `name`, lazily."""
    needed = EVALUATION[name][0]
    return spark.sql("WITH " + ", ".join(f"{t} AS (SELECT * FROM {{{t}_}})" for t in needed) + " " + definition(name, True), **{f"{t}_": table(spark, sf_dir, t) for t in needed})


def oracle_with(*names: str) -> str:
    """The WITH clause, without a final comma, that gives the oracle these tables."""
    return "WITH " + ", ".join(f"{n} AS ({definition(n, False)})" for n in names)
