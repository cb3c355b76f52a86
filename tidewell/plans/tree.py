"""Walking Catalyst trees from Python, read only."""

from __future__ import annotations

from collections.abc import Iterator

SUBQUERIES = ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "DynamicPruningSubquery", "FunctionTableSubqueryArgumentExpression")


def items(seq) -> list:
    """A Scala sequence as a list."""
    return [seq.apply(i) for i in range(seq.size())]


def kind(node) -> str:
    return node.getClass().getSimpleName()


def parsed(spark, sql: str):
    return spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)


def expressions(node) -> Iterator:
    """Every expression of a plan node, from its roots down; not into subqueries' plans."""
    todo = items(node.expressions())
    while todo:
        e = todo.pop()
        yield e
        todo += items(e.children())


def inner_plans(node) -> Iterator:
    """Plans that a node holds beside its children: WITH queries and subqueries in expressions."""
    if kind(node) == "UnresolvedWith":
        for relation in items(node.cteRelations()):
            yield relation._2()
    if kind(node) == "ExplainCommand":
        yield node.logicalPlan()
    for e in expressions(node):
        if kind(e) in SUBQUERIES:
            yield e.plan()


def walk(plan) -> Iterator:
    """All plan nodes, also those inside WITH queries and subqueries."""
    todo = [plan]
    while todo:
        node = todo.pop()
        yield node
        todo += items(node.children())
        todo += inner_plans(node)
