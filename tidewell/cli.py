"""python -m tidewell.cli query DIR SQL [--format csv] | diff DIR SOURCE TARGET [--migration] | tool DIR NAME [key=value ...]"""

from __future__ import annotations

import argparse
import json
import os

from tidewell.engine import Connection, Engine
from tidewell.session import build


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tidewell", description=__doc__)
    parser.add_argument("command", choices=["query", "diff", "tool"])
    parser.add_argument("folder", help="holds one Parquet file or folder a table")
    parser.add_argument("rest", nargs="+")
    parser.add_argument("--format", default="markdown", choices=["markdown", "json", "csv", "columnar"])
    parser.add_argument("--migration", action="store_true")
    args = parser.parse_args(argv)
    spark = build(os.environ.get("TIDEWELL_MASTER", "local[*]"))
    tables = {f.removesuffix(".parquet"): os.path.join(args.folder, f) for f in sorted(os.listdir(args.folder)) if f.endswith(".parquet")}
    engine = Engine(spark, {"local": Connection(tables)})
    if args.command == "query":
        print(engine.call("run_select", sql=args.rest[0], fmt=args.format)["text"])
    elif args.command == "diff":
        tool = "generate_migration" if args.migration else "schema_diff"
        out = engine.call(tool, source=args.rest[0], target=args.rest[1])
        print(out if isinstance(out, str) else json.dumps(out, indent=2))
    else:
        print(json.dumps(engine.call(args.rest[0], **dict(x.split("=", 1) for x in args.rest[1:])), indent=2, default=str))


if __name__ == "__main__":
    main()
