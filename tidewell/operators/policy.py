"""What a statement may do: allowed roots by access mode, tables, columns and functions.

Statements are judged on Spark's own unresolved plan: all that is not listed is refused, and a statement that does not parse is
refused too. Plans are walked into WITH queries and subqueries.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tidewell.plans import tree

READ, WRITE, ADMIN = "read", "write", "admin"
#: Stands for a protected value.
REDACTED = "<redacted>"

READ_NODES = frozenset(
    "Project Filter Aggregate Sort GlobalLimit LocalLimit LimitAll Offset Distinct Union Except Intersect Join LateralJoin SubqueryAlias UnresolvedSubqueryColumnAliases UnresolvedWith UnresolvedRelation LocalRelation OneRowRelation OneRowRelation$ UnresolvedInlineTable UnresolvedHaving WithWindowDefinition Generate Pivot Unpivot UnresolvedTableValuedFunction Sample ExplainCommand Window ResolvedInlineTable UnresolvedTVFAliases UnresolvedOrdinal UnionLoop Deduplicate".split()
)
WRITE_NODES = frozenset("InsertIntoStatement DeleteFromTable UpdateTable MergeIntoTable UpdateAction DeleteAction InsertAction Assignment".split())
ADMIN_NODES = frozenset("CreateTable CreateTableAsSelect ReplaceTable DropTable TruncateTable RenameTable AddColumns DropColumns RenameColumn AlterColumn AlterColumns SetTableProperties AnalyzeTable AnalyzeColumn RepairTable CreateIndex DropIndex UnresolvedIdentifier UnresolvedTable UnresolvedTableOrView CommentOnTable".split())

#: Functions that call arbitrary code or read files.
FORBIDDEN_FUNCTIONS = frozenset("reflect java_method try_reflect read_files input_file_name".split())
#: First parts of names that mean files or sources instead of tables.
FILE_SOURCES = frozenset("parquet csv json orc text avro binaryfile delta jdbc libsvm xml".split())


class PolicyError(ValueError):
    """A statement that the policy refuses, with the reason."""


@dataclass(frozen=True)
class Policy:
    mode: str = READ
    allow_schemas: tuple[str, ...] = ()
    deny_schemas: tuple[str, ...] = ()
    deny_tables: tuple[str, ...] = ()
    pii_columns: tuple[str, ...] = ()
    default_schema: str = "public"

    def __post_init__(self):
        """Names in rules are compared without case, as Spark compares them."""
        for rule in ("allow_schemas", "deny_schemas", "deny_tables", "pii_columns"):
            object.__setattr__(self, rule, tuple(x.lower() for x in getattr(self, rule)))
        object.__setattr__(self, "default_schema", self.default_schema.lower())

    def parts(self, ref: str) -> tuple[str, str]:
        """Schema and name of a table: the last two parts of what a statement calls it, whatever catalog stands before them."""
        *before, name = ref.lower().split(".")
        return before[-1] if before else self.default_schema, name

    def allows(self, ref: str) -> bool:
        schema, name = self.parts(ref)
        return self.schema_allowed(schema) and not any(denied(schema, name, glob) for glob in self.deny_tables)

    def schema_allowed(self, schema: str) -> bool:
        schema = schema.lower()
        return schema not in self.deny_schemas and (not self.allow_schemas or schema in self.allow_schemas)

    @property
    def protected(self) -> set[tuple[str, str]]:
        """Table and column of each protected column."""
        return {tuple(c.rsplit(".", 2)[-2:]) for c in self.pii_columns}

    def protects(self, ref: str, column: str) -> bool:
        return (self.parts(ref)[1], column.lower()) in self.protected


def denied(schema: str, name: str, glob: str) -> bool:
    """A glob has a schema and a name, either of them * or exact; without a dot it means a name in any schema. All in lower case."""
    own_schema, own_name = glob.rsplit(".", 2)[-2:] if "." in glob else ("*", glob)
    return all(g in ("*", x) for g, x in ((own_schema, schema), (own_name, name)))


def denied_column(schema: Column, name: Column, glob: Column) -> Column:
    """The same rule on columns."""
    parts = F.split(glob, r"\.", 2)
    own_schema = F.when(F.contains(glob, F.lit(".")), parts[0]).otherwise("*")
    own_name = F.when(F.contains(glob, F.lit(".")), F.try_element_at(parts, F.lit(2))).otherwise(glob)
    return ((own_schema == "*") | (own_schema == schema)) & ((own_name == "*") | (own_name == name))


def relations(plan) -> list[str]:
    """The tables of a plan, in order and once each, without the names of WITH queries."""
    own = {r._1().lower() for node in tree.walk(plan) if tree.kind(node) == "UnresolvedWith" for r in tree.items(node.cteRelations())}
    found: dict[str, None] = {}
    for node in tree.walk(plan):
        if tree.kind(node) in ("UnresolvedRelation", "UnresolvedTable", "UnresolvedTableOrView", "UnresolvedIdentifier"):
            parts = tree.items(node.multipartIdentifier() if hasattr(node, "multipartIdentifier") and tree.kind(node) != "UnresolvedIdentifier" else node.nameParts())
            name = ".".join(parts)
            if len(parts) > 1 or name.lower() not in own:
                found[name] = None
    return list(found)


def check(spark: SparkSession, sql: str, policy: Policy = Policy()) -> list[str]:
    """The tables that a permitted statement names; raises PolicyError for any other."""
    try:
        plan = tree.parsed(spark, sql)
    except Exception as e:
        raise PolicyError(f"it does not parse: {str(e).splitlines()[0][:200]}") from None
    allowed = READ_NODES | (WRITE_NODES if policy.mode in (WRITE, ADMIN) else frozenset()) | (ADMIN_NODES if policy.mode == ADMIN else frozenset())
    nodes = list(tree.walk(plan))
    for node in nodes:
        if tree.kind(node) not in allowed:
            raise PolicyError(f"{tree.kind(node)} is not allowed in {policy.mode} mode")
        for e in tree.expressions(node):
            if tree.kind(e) == "UnresolvedFunction" and tree.items(e.nameParts())[-1].lower() in FORBIDDEN_FUNCTIONS:
                raise PolicyError(f"the function {tree.items(e.nameParts())[-1]} is not allowed")
        if tree.kind(node) == "UnresolvedTableValuedFunction" and tree.items(node.name())[-1].lower() not in ("range", "explode", "posexplode", "inline", "stack", "json_tuple", "explode_outer", "posexplode_outer", "inline_outer"):
            raise PolicyError("this table function is not allowed")
    names = relations(plan)
    for name in names:
        if "." in name and name.split(".")[0].lower() in FILE_SOURCES:
            raise PolicyError(f"{name} is a file, not a table")
        if not policy.allows(name):
            raise PolicyError(f"the table {name} is not allowed")
    return names


