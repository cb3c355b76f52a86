"""Physical plans as rows: metrics, graded findings, tuning advice; and what a DDL statement would endanger."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tidewell.plans import tree

#: Shares of time at which a node is graded, and misestimates.
GRADES = ((40.0, "critical"), (25.0, "high"), (15.0, "medium"))
SKEWS = ((10.0, "critical"), (4.0, "high"), (2.0, "medium"))
#: From which time and size on a node is graded, and how far an estimate may be off.
LEAST_MS, LEAST_BYTES, MISESTIMATE = 1_000, 1 << 20, 10


#: Metrics of a node's own time; generated code counts as the node that holds it. Nanoseconds, if their name is listed as such.
TIMES = ("pipelineTime", "shuffleWriteTime", "fetchWaitTime", "pythonTotalTime", "buildTime", "collectTime", "broadcastTime")


def _plan_nodes(node, depth: int = 0, sizes: list[int] | None = None):
    name = node.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        yield from _plan_nodes(node.executedPlan(), depth)
        return
    if name.endswith("QueryStageExec"):
        found = node.mapStats() if name == "ShuffleQueryStageExec" else None
        yield from _plan_nodes(node.plan(), depth, list(found.get().bytesByPartitionId()) if found is not None and found.isDefined() else None)
        return
    yield node, depth, sizes
    for child in tree.items(node.children()):
        yield from _plan_nodes(child, depth + 1)


def _estimated_bytes(node) -> int | None:
    link = node.logicalLink()
    return int(str(link.get().stats().sizeInBytes())) if link.isDefined() else None


def physical_nodes(df: DataFrame) -> list[dict]:
    """The physical plan's nodes from the root down; after an action with what each of them counted.

    time_ms is a node's own time over all tasks, share its part of all nodes' times in percent, partitions the bytes of an
    exchange's partitions, misestimate how many times larger or smaller they are than the optimizer thought.
    """
    out = []
    for node, depth, sizes in _plan_nodes(df._jdf.queryExecution().executedPlan()):
        name = node.nodeName().strip()
        text = node.simpleStringWithNodeId() if hasattr(node, "simpleStringWithNodeId") else node.toString().split("\n")[0]
        kind = "scan" if "Scan" in name else "exchange" if "Exchange" in name else "join" if "Join" in name or "Cartesian" in name else "sort" if name == "Sort" else "aggregate" if "Aggregate" in name else "python" if re.search("Python|Pandas|Arrow", name) else "generate" if name == "Generate" else "window" if name.startswith("Window") else "other"
        metrics, time_ms = {}, 0.0
        found = node.metrics().iterator()
        while found.hasNext():
            pair = found.next()
            metrics[pair._1()] = pair._2().value()
            if pair._1() in TIMES:
                time_ms += max(0, pair._2().value()) / (1e6 if pair._2().metricType() == "nsTiming" else 1)
        detail = node.toString().split("\n")[0] if kind == "scan" else ""
        size = metrics.get("dataSize", 0)
        thought = _estimated_bytes(node) if kind == "exchange" and size else None
        out.append({"depth": depth, "name": name, "kind": kind, "rows": metrics.get("numOutputRows"), "spill": metrics.get("spillSize", 0), "data_size": size, "pushed": bool(re.search(r"(PushedFilters|PartitionFilters): \[[^\]]", detail)), "time_ms": time_ms, "partitions": sizes, "misestimate": max(thought / size, size / thought) if thought else None, "text": text[:200]})
    total = sum(n["time_ms"] for n in out)
    for n in out:
        n["share"] = 100 * n["time_ms"] / total if total else 0.0
    return out


def metrics(df: DataFrame, run: bool = True) -> dict:
    """Counts by kind of node; with ``run`` the query is executed without keeping its rows, so counts of rows are there too."""
    if run:
        df._jdf.queryExecution().toRdd().count()  # this very plan, so that its own metrics count
    nodes = physical_nodes(df)
    kinds = [n["kind"] for n in nodes]
    return {
        "scans": kinds.count("scan"),
        "filtered_scans": sum(n["kind"] == "scan" and n["pushed"] for n in nodes),
        "exchanges": kinds.count("exchange"),
        "joins": kinds.count("join"),
        "python": kinds.count("python"),
        "cartesian": sum("Cartesian" in n["name"] or "NestedLoop" in n["name"] for n in nodes),
        "spill_bytes": sum(n["spill"] or 0 for n in nodes),
        "nodes": nodes,
    }


def grade(value: float, steps=GRADES) -> str:
    return next((name for least, name in steps if value >= least), "low")


def skew_grade(rows: list[int]) -> tuple[float, str]:
    """The largest partition against the mean, and its grade."""
    mean = sum(rows) / len(rows) if rows else 0
    ratio = max(rows) / mean if mean else 1.0
    return ratio, grade(ratio, SKEWS)


def findings(found: dict) -> list[dict]:
    """What stands out in a plan's metrics, the gravest first."""
    out = []
    if found["cartesian"]:
        out.append({"severity": "critical", "what": "a join without an equality compares all pairs of rows"})
    if found["spill_bytes"]:
        out.append({"severity": "high", "what": f"{found['spill_bytes']} bytes were spilled: use more or smaller partitions"})
    if found["scans"] > found["filtered_scans"]:
        out.append({"severity": "medium", "what": f"{found['scans'] - found['filtered_scans']} of {found['scans']} scans read whole tables"})
    if found["exchanges"] > 2 * max(1, found["joins"]):
        out.append({"severity": "medium", "what": f"{found['exchanges']} exchanges: bucket or pre-partition the tables by their join keys"})
    for n in found.get("nodes", ()):
        if n["time_ms"] >= LEAST_MS and grade(n["share"]) != "low":
            out.append({"severity": grade(n["share"]), "what": f"{n['name']} takes {n['share']:.0f} % of the plan's time ({n['time_ms']:.0f} ms)"})
        filled = [p for p in n["partitions"] or () if p]
        if sum(filled) >= LEAST_BYTES and len(filled) > 1:
            ratio, step = skew_grade(filled)
            if step != "low":
                out.append({"severity": step, "what": f"{n['name']}: its largest partition is {ratio:.1f} times the mean"})
        if n["misestimate"] and n["data_size"] >= LEAST_BYTES and n["misestimate"] >= MISESTIMATE:
            out.append({"severity": "medium", "what": f"{n['name']} moved {n['misestimate']:.0f} times more or less than was estimated: compute the tables' statistics"})
    if found["python"]:
        out.append({"severity": "medium", "what": "Python takes part in the plan: built-in functions stay in generated code"})
    return sorted(out, key=lambda f: ("critical", "high", "medium", "low").index(f["severity"]))


def deep_analysis(spark: SparkSession, sql: str, run: bool = True, policy=None) -> dict:
    from tidewell.operators.policy import Policy, check

    check(spark, sql, policy or Policy())
    found = metrics(spark.sql(sql), run)
    return {"metrics": {k: v for k, v in found.items() if k != "nodes"}, "findings": findings(found), "nodes": [{k: n[k] for k in ("depth", "name", "kind", "rows", "time_ms", "share", "spill", "misestimate")} | {"grade": grade(n["share"])} for n in found["nodes"]], "shape": sql_shape(spark, sql)}


def sql_shape(spark: SparkSession, sql: str) -> dict:
    """Names of WITH queries and of functions in FROM."""
    nodes = list(tree.walk(tree.parsed(spark, sql)))
    return {
        "with": [r._1() for n in nodes if tree.kind(n) == "UnresolvedWith" for r in tree.items(n.cteRelations())],
        "table_functions": [tree.items(n.name())[-1] for n in nodes if tree.kind(n) == "UnresolvedTableValuedFunction"],
    }


def tune(spark: SparkSession, sql: str) -> dict:
    """The analysis with a sentence that sums it up."""
    found = deep_analysis(spark, sql)
    worst = found["findings"][:1]
    return found | {"summary": f"{len(found['findings'])} findings; first: {worst[0]['what']}." if worst else "Nothing stands out."}


def ddl_safety(spark: SparkSession, ddl: str) -> list[dict]:
    """Risks of a DDL statement by its parsed commands; one that does not parse is critical."""
    unchecked = re.compile(r"\s+NOT\s+VALID\b", re.I)
    try:
        plan = tree.parsed(spark, unchecked.sub("", ddl))
    except Exception as e:
        return [{"severity": "CRITICAL", "what": f"it does not parse: {str(e).splitlines()[0][:120]}"}]
    out = []
    for node in tree.walk(plan):
        name = tree.kind(node)
        if name in ("DropTable", "DropView", "DropNamespace", "DropDatabase", "DropFunction", "DropTableCommand", "DropDatabaseCommand"):
            out.append({"severity": "CRITICAL", "what": "drops an object with all of its data"})
        elif name in ("TruncateTable", "TruncatePartition"):
            out.append({"severity": "CRITICAL", "what": "removes all rows"})
        elif name in ("AlterColumn", "AlterColumns", "AlterTableAlterColumn", "ReplaceColumns"):
            out.append({"severity": "CRITICAL" if re.search(r"\bTYPE\b", ddl, re.I) or name == "ReplaceColumns" else "MEDIUM", "what": "changes a column in place"})
        elif name == "DropColumns":
            out.append({"severity": "HIGH", "what": "drops a column with its data"})
        elif name == "AddConstraint":
            foreign = re.search(r"\bFOREIGN\s+KEY\b", ddl, re.I)
            if foreign and not unchecked.search(ddl):
                out.append({"severity": "HIGH", "what": "checks all rows of both tables while they are locked: add the key NOT VALID and validate it later"})
            elif not foreign:
                out.append({"severity": "HIGH" if not unchecked.search(ddl) else "LOW", "what": "checks all rows of the table while it is locked"})
        elif name in ("CreateIndex", "ReplaceTable", "ReplaceTableAsSelect"):
            out.append({"severity": "CRITICAL", "what": "rebuilds an object while it is in use"})
    return out
