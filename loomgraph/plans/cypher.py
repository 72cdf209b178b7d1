"""A small graph-query subset translated to Spark SQL over views of nodes and edges.

``MATCH (n)``, ``(n:L)``, ``(n {k: 'v'})``, ``(a)-[r:T]->(b)``; ``WHERE`` with
``=``, ``CONTAINS``, ``AND``, ``OR``; ``RETURN`` with ``COALESCE``,
``labels(x)[0]`` and ``AS``; ``ORDER BY``; ``LIMIT``. Literals become parameters.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_NODE = r"\(\s*(\w+)\s*(?::\s*(\w+))?\s*(?:\{([^}]*)\})?\s*\)"
_QUERY = re.compile(rf"^\s*MATCH\s+{_NODE}\s*(?:-\s*\[\s*(\w*)\s*(?::\s*(\w+))?\s*\]\s*->\s*{_NODE}\s*)?(?:WHERE\s+(.+?)\s+)?RETURN\s+(.+?)(?:\s+ORDER\s+BY\s+(.+?))?(?:\s+LIMIT\s+(\d+))?\s*;?\s*$", re.S | re.I)
#: Property names of the query language and the columns that hold them.
COLUMNS = {"filePath": "file_path", "startLine": "start_line", "endLine": "end_line", "contentHash": "content_hash", "isExported": "is_exported", "symbolCount": "symbol_count", "stepCount": "step_count"}


def translate(query: str, nodes: str = "nodes", edges: str = "edges") -> tuple[str, dict[str, str]]:
    """SQL text and its parameters."""
    values: dict[str, str] = {}

    def hold(m: re.Match) -> str:
        values[f"p{len(values)}"] = m[1].replace("''", "'")
        return f":p{len(values) - 1}"

    m = _QUERY.match(re.sub(r"'((?:[^']|'')*)'", hold, query))
    if not m:
        raise ValueError(f"not in the supported subset: {query}")
    a, a_label, a_props, r, r_type, b, b_label, b_props, where, returns, order, limit = m.groups()

    def sql(text: str) -> str:
        text = re.sub(r"\blabels\((\w+)\)\[0\]", r"\1.label", text)
        text = re.sub(r"([\w.]+)\s+CONTAINS\s+(:p\d+)", r"contains(\1, \2)", text, flags=re.I)
        return re.sub(r"\.(\w+)\b", lambda x: "." + COLUMNS.get(x[1], x[1]), text)

    tests = [sql(where)] if where else []
    for name, label, props in ((a, a_label, a_props), (b, b_label, b_props)):
        if label:
            tests.append(f"{name}.label = '{label}'")
        for k, v in re.findall(r"(\w+)\s*:\s*(:p\d+|\d+)", props or ""):
            tests.append(f"{name}.{COLUMNS.get(k, k)} = {v}")
    source = f"{nodes} {a}"
    if b:
        r = r or "_r"
        source = f"{edges} {r} JOIN {nodes} {a} ON {r}.src = {a}.id JOIN {nodes} {b} ON {r}.dst = {b}.id"
        if r_type:
            tests.append(f"{r}.rel_table = '{r_type}'")
    text = f"SELECT {sql(returns)} FROM {source}" + (" WHERE " + " AND ".join(f"({t})" for t in tests) if tests else "")
    return text + (f" ORDER BY {sql(order)}" if order else "") + (f" LIMIT {limit}" if limit else ""), values


def run(spark: SparkSession, query: str, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    nodes.createOrReplaceTempView("loom_nodes")
    edges.createOrReplaceTempView("loom_edges")
    text, values = translate(query, "loom_nodes", "loom_edges")
    return spark.sql(text, args=values)
