"""The engine's tools under one roof: a session over connections, each with tables, a catalog and an index.

A connection names Parquet folders and a CatalogSpec of their keys and comments. ``Engine.call(tool, **arguments)`` runs a tool by
name; every result is plain JSON data. Tools that would need a server's credentials, roles or real indexes are listed in
``UNAVAILABLE`` with the reason.
"""

from __future__ import annotations

import threading
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import advise, diff, graph, lookup, profile, search, statements, write
from tidewell.operators.policy import ADMIN, READ, WRITE, Policy, PolicyError, check
from tidewell.operators.select import Caps, dialect, guarded, run_select
from tidewell.plans import analysis
from tidewell.sources import exports, store
from tidewell.sources.catalog import CatalogSpec, fingerprint, from_frames, list_objects, object_hashes, prefix_completion

UNAVAILABLE = {
    "setup_connection": "sessions are made by Spark's launcher, which holds the credentials",
    "save_profile": "no credentials are kept here",
    "test_profile": "no credentials are kept here",
    "export_profile": "no credentials are kept here",
    "import_profile": "no credentials are kept here",
    "list_roles": "Spark's session catalog has no roles",
    "create_index_concurrently": "Parquet tables have no indexes; partition or bucket the table instead",
}

TOOLS = {
    "list_connections": (READ, "connections and which one is active"),
    "list_databases": (READ, "databases of a connection"),
    "list_schemas": (READ, "schemas that the policy lets through"),
    "list_objects": (READ, "objects of a schema by kind"),
    "get_current_context": (READ, "the active connection, its mode and caps"),
    "switch_connection": (READ, "makes another connection active"),
    "run_select": (READ, "runs one guarded read query"),
    "explain_query": (READ, "the plan of a query as text"),
    "discover_tools": (READ, "tools by words in their name or description"),
    "run_doctor": (READ, "checks of the session and the index"),
    "resolve_target": (READ, "which connection or object a hint means"),
    "orient": (READ, "a digest of the schema"),
    "inspect_or_search": (READ, "objects that fit a query, described"),
    "search_all_databases": (READ, "objects that fit a query in all connections"),
    "search_schema": (READ, "objects that fit a query"),
    "describe_object": (READ, "an object with columns, keys and labels of its references"),
    "get_join_path": (READ, "the shortest way to join two objects"),
    "sample_values": (READ, "values of a column"),
    "rebuild_index": (READ, "profiles the tables and writes the search index"),
    "refresh_index": (READ, "brings the index up to date, profiling only what changed"),
    "get_index_status": (READ, "whether the index exists and still fits"),
    "get_ddl": (READ, "the definition of an object"),
    "table_stats": (READ, "size, files and column statistics of a table"),
    "index_usage": (READ, "how often indexes were used"),
    "list_running_queries": (READ, "jobs at work"),
    "find_blocking_locks": (READ, "who waits for whom"),
    "slow_queries": (READ, "the slowest statements of this session"),
    "db_health_check": (READ, "a few signs of trouble"),
    "db_dashboard": (READ, "an overview in sections"),
    "list_extensions": (READ, "jars and packages of the session"),
    "server_settings": (READ, "settings that matter"),
    "suggest_indexes": (READ, "tables and keys that a layout would help"),
    "find_unused_indexes": (READ, "indexes that nothing uses"),
    "bloat_report": (READ, "tables with many dead rows or small files"),
    "find_missing_fks": (READ, "keys that names tell and nobody declared"),
    "export_query": (READ, "a query's rows as CSV, JSON or INSERT statements"),
    "db_schema_completions": (READ, "references that start with a prefix"),
    "deep_plan_analysis": (READ, "metrics and graded findings of a query's plan"),
    "schema_diff": (READ, "differences of two schemas"),
    "generate_migration": (READ, "statements that turn one schema into another"),
    "auto_tune_query": (READ, "plan findings with advice, summed up"),
    "check_ddl_safety": (READ, "risks of a DDL statement"),
    "execute_sql": (WRITE, "runs one data-changing statement, dry by default"),
    "edit_row": (WRITE, "inserts, updates or deletes one row"),
    "import_data": (WRITE, "appends rows"),
    "apply_ddl": (ADMIN, "runs one DDL statement"),
    "run_maintenance": (ADMIN, "computes statistics of a table"),
    "terminate_query": (ADMIN, "cancels a job group"),
}

#: Settings that server_settings shows.
SETTINGS = ("spark.master", "spark.driver.memory", "spark.executor.memory", "spark.executor.cores", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.files.maxPartitionBytes", "spark.sql.ansi.enabled", "spark.sql.session.timeZone", "spark.sql.warehouse.dir", "spark.checkpoint.dir", "spark.serializer", "spark.memory.fraction", "spark.sql.cbo.enabled", "spark.sql.ansi.doubleQuotedIdentifiers")


#: Answers of searches that are kept for each version of an index.
KEPT_ANSWERS = 256
#: Most distinct values of a column that orient calls an enumeration.
ENUM_VALUES = 20


@dataclass
class Connection:
    """Tables by name (folders), their catalog, and statistics relations that other systems may fill."""

    tables: dict[str, str]
    spec: CatalogSpec | None = None
    policy: Policy = field(default_factory=Policy)
    caps: Caps = field(default_factory=Caps)
    host: str = ""
    database: str = ""
    index_root: str | None = None
    stats: dict[str, DataFrame] = field(default_factory=dict)


def _rows(df: DataFrame, limit: int = 1000) -> list[dict]:
    return [{k: exports.cell(v) for k, v in r.asDict().items()} for r in df.limit(limit).collect()]


class Engine:
    def __init__(self, spark: SparkSession, connections: dict[str, Connection]):
        self.spark, self.connections = spark, connections
        self.active = next(iter(connections))
        self.log: list[tuple[str, float, int]] = []
        self._loaded: dict[tuple[str, str], dict] = {}
        self._lock = threading.Lock()
        self._warm()

    # --- session

    @property
    def now(self) -> Connection:
        return self.connections[self.active]

    def _warm(self) -> None:
        for name in self.now.tables:
            self.table(name).createOrReplaceTempView(name)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.now.tables[name.split(".")[-1]])

    def spec(self) -> CatalogSpec:
        if self.now.spec is None:
            self.now.spec = from_frames({n: self.table(n) for n in self.now.tables})
        return self.now.spec

    def _visible(self, df: DataFrame, column: str = "ref") -> DataFrame:
        """Only objects that the policy lets through."""
        hidden = [t.ref for t in self.spec().tables if not self.now.policy.allows(t.ref)]
        return df.where(~F.col(column).isin(hidden)) if hidden else df

    def call(self, tool: str, **arguments):
        if tool in UNAVAILABLE:
            raise NotImplementedError(f"{tool}: {UNAVAILABLE[tool]}")
        if tool not in TOOLS:
            raise KeyError(f"no tool {tool}")
        order = (READ, WRITE, ADMIN)
        if order.index(self.now.policy.mode) < order.index(TOOLS[tool][0]):
            raise PolicyError(f"{tool} needs {TOOLS[tool][0]} mode")
        return exports.columnarize(getattr(self, f"_{tool}")(**arguments), keep=("path", "objects", "enums"))

    def _list_connections(self):
        return [{"name": n, "host": c.host, "database": c.database, "mode": c.policy.mode, "active": n == self.active} for n, c in self.connections.items()]

    def _get_current_context(self):
        c = self.now
        return {"connection": self.active, "database": c.database, "mode": c.policy.mode, "row_limit": c.caps.row_limit(None), "tables": len(c.tables)}

    def _switch_connection(self, connection: str):
        if connection not in self.connections:
            raise KeyError(f"no connection {connection}")
        for name in self.now.tables:
            self.spark.catalog.dropTempView(name)
        self.active = connection
        self._warm()
        return self._get_current_context()

    def _list_databases(self):
        return sorted({self.now.database or "default", *(d.name for d in self.spark.catalog.listDatabases())})

    def _list_schemas(self):
        return [s for s in sorted({t.schema for t in self.spec().tables}) if self.now.policy.schema_allowed(s)]

    def _list_objects(self, schema: str | None = "public", kind: str | None = None):
        return _rows(list_objects(self._visible(self.spec().objects(self.spark)), schema, kind))

    def _discover_tools(self, query: str = "", category: str | None = None):
        words = query.lower()
        return [{"name": n, "mode": m, "description": d} for n, (m, d) in TOOLS.items() if (words in n or words in d.lower()) and (category is None or m == category)]

    # --- reads

    def _timed(self, sql: str, work):
        start = time.perf_counter()
        out = work()
        with self._lock:
            self.log.append((sql, (time.perf_counter() - start) * 1000, getattr(out, "total_count", 0) or 0))
        return out

    def _estimates(self) -> dict[str, float]:
        return {k: t.row_estimate for t in self.spec().tables for k in (t.name, t.ref)}

    def _run_select(self, sql: str, parameters: list | None = None, limit: int | None = None, fmt: str = "columnar", timeout_ms: int | None = None, resolve_refs: bool = False):
        c = self.now
        r = self._timed(sql, lambda: run_select(self.spark, sql, c.policy, c.caps, parameters, limit, fmt, timeout_ms, self._estimates()))
        out = {"columns": r.columns, "rows": r.rows, "limit": r.limit, "total_count": r.total_count, "has_more": r.has_more, "truncated": r.truncated, "piiRedactedColumns": r.redacted, "critique": r.critique, "text": r.text}
        if resolve_refs:
            out["labels"] = self._labels(check(self.spark, sql, c.policy), r.columns, r.rows)
        return out

    def _labels(self, tables: list[str], columns: list[str], rows: list[list], most: int = lookup.MOST_IDS) -> dict:
        """Labels of the ids in foreign key columns of a result, by column and id."""
        specs, out = {t.name: t for t in self.spec().tables}, {}
        for name in tables:
            for key in specs[name.split(".")[-1]].foreign_keys if name.split(".")[-1] in specs else ():
                target = specs.get(key.ref.split(".")[-1])
                if len(key.columns) != 1 or key.columns[0] not in columns or target is None or target.name not in self.now.tables or not self.now.policy.allows(target.ref):
                    continue
                label = lookup.label_column([(c.name, c.type) for c in target.columns if not c.pii], tuple(key.ref_columns))
                ids = {r[columns.index(key.columns[0])] for r in rows} - {None}
                if label and 0 < len(ids) <= most:
                    found = self.table(target.name).where(F.col(key.ref_columns[0]).isin(list(ids))).select(key.ref_columns[0], label).collect()
                    out[key.columns[0]] = {str(a): exports.cell(b) for a, b in found}
        return out

    def _explain_query(self, sql: str, mode: str = "formatted"):
        check(self.spark, sql, self.now.policy)
        return self.spark._jvm.PythonSQLUtils.explainString(self.spark.sql(sql)._jdf.queryExecution(), mode)

    def _export_query(self, sql: str, fmt: str = "csv", table: str | None = None, path: str | None = None):
        """A query's rows as text, at most the cap of rows and characters, which the result tells; or all rows as files in a new folder.

        With a path the rows stay distributed: each task writes lines, one for a row; the CSV header is returned, not written.
        """
        c = self.now
        if fmt == "sqlinsert" and not table:
            raise ValueError("INSERT statements need a table")
        if path is None:
            r = run_select(self.spark, sql, c.policy, c.caps, limit=c.caps.most_rows)
            text = exports.insert_statements(r.columns, r.rows, *self._named(table)) if fmt == "sqlinsert" else exports.render(r.columns, r.rows, fmt)
            text, cut = exports.cap(text, c.caps.characters)
            return {"format": fmt, "content": text, "row_count": len(r.rows), "total_count": r.total_count, "truncated": cut or r.has_more, "piiRedactedColumns": r.redacted}
        df, hidden = guarded(self.spark, sql, c.policy)
        if fmt == "sqlinsert":
            lines = exports.insert_lines(df, *self._named(table))
        elif fmt in ("csv", "markdown"):
            lines = exports.csv_lines(df) if fmt == "csv" else exports.markdown_lines(df)
        elif fmt == "json":
            lines = df.select(F.to_json(F.struct(*[F.col(f"`{n}`") for n in df.columns])).alias("line"))
        else:
            raise ValueError(f"{fmt} cannot be written as files")
        lines.write.text(path)
        return {"format": fmt, "path": path, "header": exports.csv_header(df) if fmt == "csv" else None, "truncated": False, "piiRedactedColumns": hidden}

    def _named(self, table: str) -> tuple[str, str]:
        schema, _, name = table.rpartition(".")
        return schema or self.now.policy.default_schema, name

    def _sample_values(self, ref: str, col: str, limit: int = 20):
        self._require_column(ref, col)
        return [r["value"] for r in profile.sample_values(self.table(ref), col, limit).collect()]

    def _require_column(self, ref: str, col: str) -> None:
        full = ref if "." in ref else f"{self.now.policy.default_schema}.{ref}"
        if not self.now.policy.allows(full) or self.now.policy.protects(full, col) or any(t.ref == full and c.name == col and c.pii for t in self.spec().tables for c in t.columns):
            raise PolicyError(f"{full}.{col} is not allowed")

    # --- search

    def _frames(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        s = self.spec()
        return self._visible(s.objects(self.spark)), self._visible(s.columns(self.spark)), s.keys(self.spark)

    def _index(self) -> dict | None:
        """The stored index of the active connection while it fits the catalog: its relations, kept in memory by version."""
        if not self.now.index_root:
            return None
        version = store.version(self.spark, self.now.index_root)
        if version is None:
            return None
        key = (self.now.index_root, version)
        if key not in self._loaded:
            kept = store.read(self.spark, self.now.index_root)
            if kept["fingerprint"] != self._fingerprint():
                return None  # an index of another catalog would name what is not there
            relations = {n: df.cache() if n in ("postings", "synonyms", "values", "embeddings", "objects", "edges") else df for n, df in kept["relations"].items()}
            for old in [k for k in self._loaded if k[0] == key[0]]:
                for df in self._loaded.pop(old)["relations"].values():
                    df.unpersist()
            self._loaded[key] = {"relations": relations, "tables": relations["objects"].where("kind = 'table'").count(), "hits": {}}
        return self._loaded[key]

    def _search_schema(self, query: str, limit: int = search.TOP, semantic: bool = False):
        """Objects by words, names, comments and values; with ``semantic`` fused with the nearest vectors where the index has some.

        The stored postings, synonyms and values are read if there are any. Answers are kept with the index's version and the
        policy, so the same question is not worked out twice.
        """
        index, rules = self._index(), self.now.policy
        asked_for = (query, limit, semantic, rules)
        if index and asked_for in index["hits"]:
            return index["hits"][asked_for]
        asked = self.spark.createDataFrame([(query,)], "query string")
        if index:
            r = index["relations"]
            objects = self._visible(r["objects"])
            hits = search.search_postings(asked, self._visible(r["postings"]), r["synonyms"], objects, index["tables"], limit, self._visible(r["values"]), self._visible(r["embeddings"]) if semantic and "embeddings" in r else None)
        else:
            objects, columns, _ = self._frames()
            hits = search.search(asked, objects, columns, search.synonyms(self.spark, objects, columns), limit)
        out = _rows(hits.select("ref", "kind", "score", "rank").orderBy("rank"))
        if index:
            if len(index["hits"]) >= KEPT_ANSWERS:
                index["hits"].pop(next(iter(index["hits"])))
            index["hits"][asked_for] = out
        return out

    def _inspect_or_search(self, query: str, limit_objects: int = 3):
        return [h | {"object": self._describe_object(h["ref"])} for h in self._search_schema(query, max(1, min(20, limit_objects)))]

    def _search_all_databases(self, query: str, limit_per_database: int = 3, limit_connections: int = 20):
        active, out = self.active, []
        try:
            for name in list(self.connections)[:limit_connections]:
                self.active = name
                out += [h | {"connection": name} for h in self._search_schema(query, max(1, min(10, limit_per_database)))]
        finally:
            self.active = active
        return sorted(out, key=lambda h: (-h["score"], h["ref"], h["connection"]))

    def _resolve(self, ref: str) -> str:
        objects, _, _ = self._frames()
        r = lookup.resolve_refs(self.spark.createDataFrame([(ref,)], "asked string"), objects.where("NOT excluded").select("ref")).first()
        if r.ref is None:
            raise KeyError(f"{ref} is {r.status}: {r.choices or r.suggestion or 'nothing is near'}")
        return r.ref

    def _describe_object(self, ref: str, resolve_refs: bool = False):
        ref = self._resolve(ref)
        t = next(t for t in self.spec().tables if t.ref == ref)
        out = {"ref": ref, "kind": t.kind, "comment": t.comment, "row_estimate": t.row_estimate, "columns": [{"name": c.name, "type": c.type, "not_null": c.not_null, "is_pk": c.is_pk, "is_fk": any(c.name in k.columns for k in t.foreign_keys), "comment": c.comment} for c in t.columns], "foreign_keys": [{"columns": list(k.columns), "ref": k.ref, "ref_columns": list(k.ref_columns)} for k in t.foreign_keys], "definition": t.definition}
        if resolve_refs and t.name in self.now.tables:
            sample = self.table(t.name).limit(20)
            out["labels"] = self._labels([t.name], sample.columns, [[exports.cell(v) for v in r] for r in sample.collect()])
        return out

    def _get_join_path(self, a: str, b: str):
        start, end = self._resolve(a), self._resolve(b)
        objects, columns, keys = self._frames()
        edges = self._visible(self._visible(graph.join_graph(objects, columns, keys), "src"), "dst")
        r = graph.join_paths(edges, self.spark.createDataFrame([(start,)], "node string")).where(F.col("dst") == end).first()
        return {"path": r.path.split(" > "), "hops": r.hops} if r else {"path": None, "message": f"no way within {graph.MAX_HOPS} hops"}

    def _resolve_target(self, hint: str, object_hint: str | None = None):
        rows = [(n, n, c.host, c.database) for n, c in self.connections.items()]
        candidates = self.spark.createDataFrame(rows, "connection string, name string, host string, database string")
        scores = None
        if object_hint:
            best = {h["connection"]: h["score"] for h in reversed(self._search_all_databases(object_hint))}
            scores = self.spark.createDataFrame(list(best.items()) or [("", 0.0)], "connection string, top_score double")
        found = _rows(lookup.resolve_target(candidates, hint, scores))
        if found and not found[0]["ambiguous"]:
            self._switch_connection(found[0]["connection"])
        return found

    def _orient(self, focus: str | None = None):
        objects, columns, keys = self._frames()
        if focus:
            objects = objects.where(F.lower("ref").contains(focus.lower()))
        out = {"objects": _rows(graph.orient(objects, columns, graph.join_graph(objects, columns, keys))), "enums": {}, "notes": []}
        total = objects.where("NOT excluded").count()
        if total > len(out["objects"]):
            out["notes"].append(f"{len(out['objects'])} of {total} objects are shown; name a focus for others")
        status, index = self._get_index_status(), self._index()
        if not status["exists"]:
            out["notes"].append("there is no index: rebuild_index makes one, with profiles and values")
        elif status["drift"]:
            out["notes"].append("the catalog has changed since the index was built: refresh_index")
        if index and "profiles" in index["relations"]:
            r, shown = index["relations"], {o["ref"] for o in out["objects"]}
            few = profile.enum_like(self._visible(r["top"]), self._visible(r["profiles"]), ENUM_VALUES)
            out["enums"] = {f"{x.ref}.{x.col}": x["values"].split(", ") for x in few.collect() if x.ref in shown and not self.now.policy.protects(x.ref, x.col)}
        return out

    def _db_schema_completions(self, prefix: str):
        return [r["ref"] for r in prefix_completion(self._frames()[0].where("NOT excluded"), prefix).collect()]

    # --- the index

    def _profiled(self, refs: set[str] | None = None) -> tuple[DataFrame | None, DataFrame | None]:
        """Profiles and common values of the visible tables (of ``refs`` only, if given)."""
        profiles, top = None, None
        for t in self.spec().tables:
            if t.name not in self.now.tables or not self.now.policy.allows(t.ref) or refs is not None and t.ref not in refs:
                continue
            open_columns = [c.name for c in t.columns if not c.pii and not self.now.policy.protects(t.ref, c.name)]
            one = profile.profile(self.table(t.name), t.ref, open_columns, approximate=True)
            texts = [c.name for c in t.columns if c.name in open_columns and c.type in ("string", "varchar", "text")]
            profiles = one if profiles is None else profiles.unionAll(one)
            if texts:
                few = profile.top_values(self.table(t.name), t.ref, texts)
                top = few if top is None else top.unionAll(few)
        return profiles, top

    def _rebuild_index(self, old: dict | None = None, refs: set[str] | None = None):
        """Profiles every visible table and writes objects, columns, keys, postings, synonyms, edges, values, profiles and vectors."""
        objects, columns, keys = self._frames()
        hashes = object_hashes(objects, columns, keys)
        profiles, top = self._profiled(refs)
        relations = {"objects": objects, "columns": columns, "keys": keys, "postings": search.postings(objects, columns), "synonyms": search.synonyms(self.spark, objects, columns), "edges": graph.join_graph(objects, columns, keys), "hashes": hashes}
        relations["embeddings"] = search.build_embeddings(search.embedding_document(objects, columns), hashes, old.get("embeddings") if old else None)
        if old is not None:
            # what did not change keeps its rows; objects that are gone lose theirs
            same = objects.select("ref").where(~F.col("ref").isin(sorted(refs))) if refs else objects.select("ref")
            profiles, top = (kept if new is None else kept.unionByName(new) for kept, new in ((old[n].join(same, "ref", "left_semi").select(old[n].columns), x) for n, x in (("profiles", profiles), ("top", top))))
        if profiles is not None:
            relations["profiles"] = profiles
        relations["top"] = top if top is not None else self.spark.createDataFrame([], "ref string, col string, value string, freq long, share double, rank int")
        relations["values"] = search.values_index(relations["top"])
        return {"version": store.save(self.spark, self.now.index_root, relations, self._fingerprint()), "relations": sorted(relations), "profiled": sorted(refs) if refs is not None else "all"}

    def _refresh_index(self):
        """Profiles and embeds again only objects whose definition has changed or that are new; all of them if there is no index."""
        if not self._get_index_status()["exists"]:
            return self._rebuild_index()
        old = store.load(self.spark, self.now.index_root)
        if not {"hashes", "profiles", "top", "embeddings"} <= old.keys():
            return self._rebuild_index()
        objects, columns, keys = self._frames()
        changed = {r.ref for r in store.changed_objects(old["hashes"], object_hashes(objects, columns, keys)).collect()}
        gone = old["hashes"].join(objects, "ref", "left_anti").count()
        if not changed and not gone and not self._get_index_status()["drift"]:
            return {"version": store.version(self.spark, self.now.index_root), "relations": sorted(old), "profiled": []}
        return self._rebuild_index(old, changed)

    def _fingerprint(self) -> str:
        return fingerprint(self.spec().objects(self.spark)).first()[0]

    def _get_index_status(self):
        return store.status(self.spark, self.now.index_root, self._fingerprint()) if self.now.index_root else {"exists": False, "drift": None}

    # --- definitions and monitoring

    def _get_ddl(self, ref: str):
        ref = self._resolve(ref)
        t = next(t for t in self.spec().tables if t.ref == ref)
        if t.definition:
            return t.definition
        lines = [f'  "{c.name}" {c.type}' + (" NOT NULL" if c.not_null else "") + (f" DEFAULT {c.default}" if c.default else "") for c in t.columns]
        key = [f'"{c.name}"' for c in t.columns if c.is_pk]
        lines += [f"  PRIMARY KEY ({', '.join(key)})"] if key else []
        lines += [f"  FOREIGN KEY ({', '.join(k.columns)}) REFERENCES {k.ref} ({', '.join(k.ref_columns)})" for k in t.foreign_keys]
        return f'CREATE TABLE "{t.schema}"."{t.name}" (\n' + ",\n".join(lines) + "\n);"

    def _table_stats(self, ref: str):
        full = self._resolve(ref)
        df = self.table(full)
        size = df.select("_metadata.file_path", "_metadata.file_size").distinct().agg(F.count("*").alias("files"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes")).first()
        hidden = {c.name for t in self.spec().tables if t.ref == full for c in t.columns if c.pii}
        return {"ref": full, "files": size.files, "bytes": size.bytes, "columns": _rows(profile.profile(df, full, [c for c in df.columns if c not in hidden], approximate=True))}

    def _stat(self, name: str) -> DataFrame:
        if name not in self.now.stats:
            raise LookupError(f"no relation {name} is given for this connection")
        return self.now.stats[name]

    def _index_usage(self, ref: str):
        return _rows(advise.index_usage(self._stat("index_stats"), ref))

    def _find_unused_indexes(self, limit: int | None = None):
        return _rows(advise.unused_indexes(self._stat("index_stats"), self._stat("constraints"), limit))

    def _find_blocking_locks(self):
        return _rows(advise.blocking_locks(self._stat("locks")))

    def _bloat_report(self, limit: int | None = None):
        return _rows(advise.bloat(self._stat("table_stats"), limit))

    def _list_running_queries(self):
        tracker = self.spark.sparkContext.statusTracker()
        return [{"job": j, "status": info.status, "stages": list(info.stageIds)} for j in tracker.getActiveJobsIds() if (info := tracker.getJobInfo(j))]

    def _slow_queries(self, limit: int = 10):
        """Statements of this session by their mean time, at least five runs each."""
        if not self.log:
            return []
        log = self.spark.createDataFrame(self.log, "query string, ms double, rows long")
        statements = log.groupBy("query").agg(F.count("*").alias("calls"), F.avg("ms").alias("mean_ms"), F.sum("ms").alias("total_ms"), F.max("rows").alias("rows")).withColumn("queryid", F.substring(F.sha1("query"), 1, 12))
        return _rows(advise.slow_queries(statements, max(1, min(50, limit))))

    def _server_settings(self):
        return {k: v for k in SETTINGS if (v := self.spark.conf.get(k, None) or self.spark.sparkContext.getConf().get(k)) is not None}

    def _list_extensions(self):
        conf = self.spark.sparkContext.getConf()
        return {"version": self.spark.version, "jars": conf.get("spark.jars", ""), "packages": conf.get("spark.jars.packages", "")}

    def _db_health_check(self):
        sections = {"objects": lambda: self.spec().objects(self.spark).groupBy("kind").count()}
        for name, build in (("bloat", lambda: advise.bloat(self._stat("table_stats"))), ("scans", lambda: advise.high_sequential_scans(self._stat("table_stats"))), ("locks", lambda: advise.blocking_locks(self._stat("locks")))):
            sections[name] = build
        return advise.sections(sections) | {"running": self._list_running_queries()}

    def _db_dashboard(self):
        more = {"connections": lambda: advise.connection_states(self._stat("activity")), "unused_indexes": lambda: advise.unused_indexes(self._stat("index_stats"), self._stat("constraints")), "unindexed_keys": lambda: graph.unindexed_keys(self.spec().keys(self.spark), self.spec().indexes(self.spark))}
        return self._db_health_check() | advise.sections(more) | {"slow": self._slow_queries(), "settings": self._server_settings()}

    def _run_doctor(self):
        mode = self.now.policy.mode
        return [
            {"check": "version", "ok": self.spark.version >= "4", "detail": self.spark.version},
            {"check": "read_only", "ok": mode == READ, "detail": mode},
            {"check": "time_limit", "ok": self.now.caps.timeout_ms <= 3_600_000, "detail": self.now.caps.timeout_ms},
            {"check": "quoted_identifiers", "ok": self.spark.conf.get("spark.sql.ansi.doubleQuotedIdentifiers") == "true", "detail": "\"x\" must name a column"},
            {"check": "index", "ok": self._get_index_status()["exists"], "detail": self._get_index_status()},
        ]

    # --- advice

    def _suggest_indexes(self, limit: int | None = None, sql: str | None = None):
        sections = {"whole_scans": lambda: advise.high_sequential_scans(self._stat("table_stats"), limit), "unindexed_keys": lambda: graph.unindexed_keys(self.spec().keys(self.spark), self.spec().indexes(self.spark))}
        out = advise.sections(sections) | {"slow": self._slow_queries()}
        out["advice"] = [f"bucket or sort {r['ref']} by {r['cols']}: a key without an index" for r in (out["unindexed_keys"] if isinstance(out["unindexed_keys"], list) else [out["unindexed_keys"]]) if "cols" in r]
        if sql:
            out["plan"] = analysis.deep_analysis(self.spark, sql, policy=self.now.policy)["findings"]
        return out

    def _find_missing_fks(self, limit: int = 20):
        objects, columns, keys = self._frames()
        return _rows(graph.missing_keys(graph.join_graph(objects, columns, keys)).orderBy("src", "via").limit(advise.clamp(limit)))

    def _deep_plan_analysis(self, sql: str, analyze: bool = True):
        return analysis.deep_analysis(self.spark, sql, analyze, self.now.policy)

    def _auto_tune_query(self, sql: str):
        check(self.spark, sql, self.now.policy)
        return analysis.tune(self.spark, sql)

    def _check_ddl_safety(self, ddl: str):
        return analysis.ddl_safety(self.spark, ddl)

    def _sides(self, source: str, target: str) -> tuple[DataFrame, DataFrame]:
        def side(schema: str) -> DataFrame:
            own = [(t.name, c.name, c.type, c.not_null, c.default) for t in self.spec().tables if t.schema == schema for c in t.columns]
            return self.spark.createDataFrame(own, "table_name string, name string, type string, not_null boolean, default_value string")

        return side(source), side(target)

    def _parts(self, schema: str) -> DataFrame:
        """Keys and indexes of a schema as table_name, kind, name, definition."""
        rows = []
        for t in (t for t in self.spec().tables if t.schema == schema):
            primary = [c.name for c in t.columns if c.is_pk]
            if primary:
                rows.append((t.name, "primary_key", f"{t.name}_pkey", f"PRIMARY KEY ({', '.join(primary)})"))
            for k in t.foreign_keys:
                ref = k.ref if k.ref.split(".")[0] != schema else k.ref.split(".", 1)[1]  # a key inside the schema is the same in both
                rows.append((t.name, "foreign_key", k.name or f"{t.name}_{k.columns[0]}_fkey", f"FOREIGN KEY ({', '.join(k.columns)}) REFERENCES {ref} ({', '.join(k.ref_columns)})"))
            rows += [(t.name, "index", f"{t.name}_{'_'.join(i)}_idx", f"({', '.join(i)})") for i in t.indexes]
        return self.spark.createDataFrame(rows, "table_name string, kind string, name string, definition string")

    def _schema_diff(self, source: str, target: str):
        a, b = self._sides(source, target)
        parts = _rows(diff.ordered(diff.part_diff(self._parts(source), self._parts(target)), "table_name", "kind", "name"))
        return {
            "tables": _rows(diff.ordered(diff.table_diff(a, b), "table_name")), "columns": _rows(diff.ordered(diff.schema_diff(a, b), "table_name", "name")),
            "constraints": [p for p in parts if p["kind"] != "index"], "indexes": [p for p in parts if p["kind"] == "index"],
        }

    def _generate_migration(self, source: str, target: str):
        a, b = self._sides(source, target)
        steps = diff.migration(diff.schema_diff(a, b), diff.table_diff(a, b), source).unionByName(diff.part_migration(diff.part_diff(self._parts(source), self._parts(target)), diff.table_diff(a, b), source))
        # keys to a table come after all tables, whatever its name
        return "\n".join(r.statement for r in steps.orderBy(F.col("step") >= 6, "table_name", "step", "statement").collect())

    # --- edits

    def _edit_row(self, table: str, action: str, values=None, pk: dict | None = None, dry_run: bool = True):
        t = next((t for t in self.spec().tables if t.name == table.split(".")[-1]), None)
        keys = [c.name for c in t.columns if c.is_pk] if t else None
        out = write.edit(self.spark, self.now.tables[table.split(".")[-1]], table, action, self.now.policy, pk, values, keys or None, dry_run)
        if not dry_run:
            self._warm()
        if not out["rows_affected"] and pk:
            out["critique"] = [{"signal": "zero_rows", "column": k, "value": exports.cell(v), "observed": self._sample_values(table, k, 5)} for k, v in pk.items()]
        return out

    def _import_data(self, table: str, rows: list[dict], columns: list[str] | None = None):
        path = self.now.tables[table.split(".")[-1]]
        schema = self.spark.read.parquet(path).schema
        unknown = {k for r in rows for k in (columns or r)} - set(schema.names)
        if unknown:
            raise ValueError(f"no such columns: {sorted(unknown)}")
        n = write.import_rows(self.spark, rows, schema, path, self.now.policy, table, schema.names)
        self._warm()
        return {"rows_affected": n}

    def _execute_sql(self, sql: str, dry_run: bool = True):
        """INSERT, UPDATE, DELETE or MERGE, rewritten as edits of folders."""
        sql = dialect(sql)
        check(self.spark, sql, self.now.policy)
        specs = {t.name.lower(): t for t in self.spec().tables}

        def path_of(ref: str) -> str:
            name = next((n for n in self.now.tables if n.lower() == self.now.policy.parts(ref)[1]), None)
            if name is None:
                raise KeyError(f"no table {ref}")
            return self.now.tables[name]

        def keys_of(ref: str) -> list[str]:
            t = specs.get(self.now.policy.parts(ref)[1])
            return [c.name for c in t.columns if c.is_pk] if t else []

        out = statements.execute(self.spark, sql, self.now.policy, path_of, keys_of, dry_run)
        if not dry_run:
            self._warm()
        elif not out["rows_affected"]:
            out["critique"] = [{"signal": "zero_rows", "hint": "no row fits the condition"}]
        return exports.cell(out)

    def _apply_ddl(self, ddl: str, dry_run: bool = True):
        check(self.spark, ddl, self.now.policy)
        risks = analysis.ddl_safety(self.spark, ddl)
        if not dry_run:
            self.spark.sql(ddl)
        return {"risks": risks, "dry_run": dry_run}

    def _run_maintenance(self, table: str):
        check(self.spark, f"ANALYZE TABLE {table} COMPUTE STATISTICS FOR ALL COLUMNS", self.now.policy)
        self.spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS FOR ALL COLUMNS")
        return {"table": table, "done": True}

    def _terminate_query(self, group: str):
        self.spark.sparkContext.cancelJobGroup(group)
        return {"group": group, "cancelled": True}
