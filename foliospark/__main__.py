"""check, read and search from a command line: python -m foliospark check docs/*.md --schema docs.folio.yml."""

from __future__ import annotations

import argparse
import json
import os
import sys
from pathlib import Path

from .functions.text import escape_human
from .plans import render


def _session():
    from pyspark.sql import SparkSession

    top = str(Path(__file__).resolve().parents[1])
    os.environ["PYTHONPATH"] = os.pathsep.join([top, *filter(None, [os.environ.get("PYTHONPATH")])])
    spark = SparkSession.builder.config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _say(message: str) -> None:
    sys.stderr.write(f"foliospark: {message}\n")


def _discovered(path: str, suffix: str) -> str | None:
    """The nearest schema upwards of a document: <stem><suffix> before <suffix>."""
    p = Path(path).resolve()
    return next((str(f) for folder in p.parents for f in (folder / (p.stem + suffix), folder / suffix) if f.is_file()), None)


def check(args) -> int:
    """Checks each input with its schema; inputs without a schema or that can't be read are operational errors."""
    from .plans.jsonschema import SchemaInvalid, read_json, references
    from .plans.schema import SchemaErrors, load
    from .plans.validate import operational_errors, validate

    def linked(schema: str, text: str) -> dict:
        out, todo = {}, [line.split(":", 1)[1].strip().strip("'\"") for line in text.splitlines() if line.strip().startswith("schema:") and line.strip().endswith(".json")]
        while todo:
            name = todo.pop()
            f = Path(schema).parent / name
            if name not in out and f.is_file():
                out[name] = read_json(f.read_text())
                todo += [os.path.normpath(os.path.join(os.path.dirname(name), r.partition("#")[0])) for r in references(out[name]) if isinstance(r, str) and r.partition("#")[0] and "://" not in r]
        return out

    groups: dict[str, list[tuple[int, str, bytes]]] = {}
    failed = 0
    for i, path in enumerate(args.paths):
        schema = args.schema or (_discovered(path, args.suffix) if path != "-" else None)
        try:
            if schema is None:
                raise OSError("no schema found" if path != "-" else "standard input needs --schema")
            groups.setdefault(schema, []).append((i, path, sys.stdin.buffer.read() if path == "-" else Path(path).read_bytes()))
        except OSError as x:
            failed += 1
            _say(f"{escape_human(path)}: {x}")
    rows: dict[int, tuple[str, str]] = {}
    shown, counts = [], {"files": 0, "documents": 0, "schemas": 0, "diagnostics": 0}
    for schema, inputs in groups.items():
        text = Path(schema).read_text()
        try:
            resources = linked(schema, text)
            load(text, resources)
        except (SchemaErrors, SchemaInvalid) as x:
            found = [{"id": e.id, "message": e.message, "location": {"line": e.line, "column": e.col}} for e in getattr(x, "errors", [])]
            rows[inputs[0][0]] = schema, json.dumps({"kind": "schema", "path": schema, "schema": schema, "diagnostics": found}, ensure_ascii=False, separators=(",", ":"))
            counts["schemas"] += 1
            counts["diagnostics"] += len(found)
            shown += [(inputs[0][0], render.human_report(schema, [{"line": d["location"]["line"], "col": d["location"]["column"], "id": d["id"], "message": d["message"]} for d in found]))]
            continue
        spark = _session()
        docs = spark.createDataFrame([(i, p, bytearray(b)) for i, p, b in inputs], "doc_id int, path string, source binary")
        bad = {r.doc_id: r.error for r in operational_errors(docs, text, resources).collect()}
        for i, p, _ in inputs:
            if i in bad:
                failed += 1
                _say(f"{escape_human(p)}: {bad[i]}")
        diagnostics = validate(docs, text, resources)
        names = {i: p for i, p, _ in inputs}
        for r in render.results(docs, diagnostics, schema).collect():
            if r.doc_id not in bad:
                rows[r.doc_id] = names[r.doc_id], r.json.replace(f'"path":"{r.doc_id}"', '"path":' + json.dumps(names[r.doc_id], ensure_ascii=False), 1)
                counts["documents"] += 1
        by_doc: dict[int, list[dict]] = {}
        for d in diagnostics.orderBy("doc_id", "ord").collect():
            by_doc.setdefault(d.doc_id, []).append(d.asDict())
            counts["diagnostics"] += 1
        shown += [(i, render.human_report(names[i], x)) for i, x in by_doc.items()]
    counts["files"] = len(rows)
    if args.format == "json":
        sys.stdout.write(render.envelope([rows[i][1] for i in sorted(rows)], counts))
    else:
        sys.stdout.write("".join(x for _, x in sorted(shown)))
    return render.exit_status(counts["diagnostics"], failed)


def read(args) -> int:
    from .operators.document import decode, parse
    from .operators.paths import PathFailure, Paths, PathSyntax, parse_path

    path = args.path if args.path.startswith("$") else "$" + args.path
    try:
        p = Paths(parse(decode(Path(args.file).read_bytes()), detail=False))
    except (OSError, UnicodeDecodeError) as x:
        _say(f"{args.file}: {x}")
        return 2
    out = sys.stdout if args.format == "json" else sys.stderr
    try:
        steps = parse_path(path)
    except PathSyntax as x:
        error = {"kind": "syntax", "path": path, "message": str(x), "offset": x.offset, "suggestions": p.of_heading(path)}
        out.write(render.path_failure(error, args.format, args.file))
        return 1
    try:
        node = p.resolve(steps)
    except PathFailure as x:
        out.write(render.path_failure(p.failure(steps, x, args.file), args.format, args.file))
        return 1
    if args.tree:
        entries = [{**p.entry(n), "label": p.label(n, args.file)} for n in p.tree(node, args.depth, args.blocks)]
        sys.stdout.write(render.tree_text(entries, args.format, args.file, p.of[id(node)]))
        return 0
    text = p.content(node, args.depth)
    sys.stdout.write(render.content_text({"mdpath": p.of[id(node)], "bytes": len(text.encode()), "content": text}, args.format, args.file))
    return 0


def search(args) -> int:
    """Refreshes the index of the folder's repository and searches below the folder."""
    from pyspark.sql import functions as F

    from .operators.search import Busy, Index
    from .sources import files

    top, prefix = files.locate(args.root)
    spark = _session()
    index = Index(spark, str(top / ".folio" / "search"))
    listed, notes, complete = files.walk(top / prefix)
    rows = [(prefix + p, n, s, None) for p, n, s in listed]
    table = spark.createDataFrame(rows, "path string, mtime long, size long, source binary").withColumn("mtime", F.timestamp_micros(F.floor(F.col("mtime") / 1000))).drop("source")
    content = files.read_markdown(spark, str(top / prefix), None).select(F.concat(F.lit(prefix), "path").alias("path"), "source")
    try:
        index.refresh(table.join(content, "path"), complete, prefix)
    except Busy as x:
        index.notes.append(str(x))
    for n in [*index.notes, *notes]:
        _say(n)
    out, note = render.search_text(index.search(" ".join(args.words), args.limit, prefix), args.format)
    sys.stdout.write(out)
    if note:
        sys.stderr.write(note)
    return 0 if out and '"hits":[]' not in out else 1


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="foliospark")
    commands = top.add_subparsers(required=True)
    c = commands.add_parser("check")
    c.add_argument("paths", nargs="+")
    c.add_argument("--schema")
    c.add_argument("--suffix", default=".folio.yml")
    c.add_argument("--format", choices=("human", "json"), default="human")
    c.set_defaults(run=check)
    r = commands.add_parser("read")
    r.add_argument("file")
    r.add_argument("path", nargs="?", default="$")
    r.add_argument("--tree", action="store_true")
    r.add_argument("--blocks", action="store_true")
    r.add_argument("--depth", type=int)
    r.add_argument("--format", choices=("human", "json", "compact"), default="human")
    r.set_defaults(run=read)
    s = commands.add_parser("search")
    s.add_argument("words", nargs="+")
    s.add_argument("--root", default=".")
    s.add_argument("--limit", type=int, default=10)
    s.add_argument("--format", choices=("human", "json", "compact"), default="human")
    s.set_defaults(run=search)
    args = top.parse_args(argv)
    return args.run(args)


if __name__ == "__main__":
    sys.exit(main())
