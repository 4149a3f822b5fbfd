"""Results as text: JSON envelopes, compact records and reports. They take what a command shows, a bounded number of rows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import escape_compact, escape_human, size_text


def _dump(x) -> str:
    return json.dumps(x, ensure_ascii=False, separators=(",", ":")) + "\n"


def diagnostic_json(diagnostics: DataFrame, schema_path: str) -> DataFrame:
    """diagnostics with json: each as the object of the validation envelope; absent members are left out. JVM only."""
    place = lambda line, col: F.struct(line.alias("line"), col.alias("column"))
    x = F.struct("id", "message", place(F.col("line"), F.col("col")).alias("location"))
    raw = lambda name, column: F.when(column.isNotNull(), F.concat(F.lit(f',"{name}":'), column)).otherwise("")
    involved = F.transform("involved", lambda h: F.struct(h["header_path"].alias("header_path"), place(h["line"], h["col"]).alias("location")))
    at = F.when(F.col("schema_line").isNotNull(), F.to_json(F.struct(F.lit(schema_path).alias("path"), F.col("schema_line").alias("line"), F.col("schema_col").alias("column"))))
    head = F.to_json(x)
    tail = F.concat(
        raw("target", F.col("target")), raw("schema_node", F.col("schema_node")), raw("schema_location", at),
        raw("involved_headers", F.when(F.size("involved") > 0, F.to_json(involved))), raw("references", F.when(F.size("refs") > 0, F.concat(F.lit("["), F.array_join("refs", ","), F.lit("]")))),
    )
    return diagnostics.withColumn("json", F.concat(head.substr(F.lit(1), F.length(head) - 1), tail, F.lit("}")))


def results(docs: DataFrame, diagnostics: DataFrame, schema_path: str, key: str = "doc_id") -> DataFrame:
    """(key, json): one result object per document with its diagnostics in order; a document's rows are gathered, no more."""
    each = diagnostic_json(diagnostics, schema_path).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("ord", "json"))).alias("x"))
    wide = docs.select(key).join(each, key, "left")
    listed = F.concat(F.lit("["), F.coalesce(F.array_join(F.transform("x", lambda y: y["json"]), ","), F.lit("")), F.lit("]"))
    head = F.to_json(F.struct(F.lit("document").alias("kind"), F.col(key).cast("string").alias("path"), F.lit(schema_path).alias("schema")))
    return wide.select(key, F.concat(head.substr(F.lit(1), F.length(head) - 1), F.lit(',"diagnostics":'), listed, F.lit("}")).alias("json"))


def envelope(rows: list[str], summary: dict) -> str:
    """The validation envelope of result objects already written as JSON."""
    return '{"version":2,"results":[' + ",".join(rows) + '],"summary":' + json.dumps(summary, separators=(",", ":")) + "}\n"


def human_report(path: str, diagnostics: list[dict]) -> str:
    """One document's diagnostics as lines."""
    return "".join(f"{escape_human(path)}:{d['line']}:{d['col']} [{d['id']}] {escape_human(d['message'])}\n" for d in diagnostics)


def exit_status(diagnostics: int, operational: int = 0) -> int:
    return 2 if operational else 1 if diagnostics else 0


def _hit_size(h: dict) -> tuple[str, str | None]:
    return size_text(h["bytes"]), size_text(h["section_bytes"]) if h["section_bytes"] is not None else None


def search_text(found: dict, form: str = "human") -> tuple[str, str]:
    """(output, notes) of a search result as the Index gives it."""
    hits = found["hits"]
    if form == "json":
        return _dump(found), ""
    if not hits:
        counts = found.get("term_counts")
        listed = ", ".join(f"{c['term']} {c['blocks']}" for c in counts or [])
        if form == "compact":
            return "", f"no block contains all words; {listed}\n" if counts else "no search hits\n"
        if counts:
            return "", f"no block contains all of: {escape_human(found['query'])}\n  {listed}\n  (a block must contain every word; drop or change the rarest words)\n"
        return "", f"no search hits for: {escape_human(found['query'])}\n"
    more = f"({len(hits)} of {found['total']} matching blocks; use --limit to see more)\n" if len(hits) < found["total"] else ""
    if form == "compact":
        lines = ["\t".join((escape_compact(h["path"]), h["mdpath"], "/".join(x for x in _hit_size(h) if x), escape_compact(h["snippet"]))) for h in hits]
        return "".join(x + "\n" for x in lines), more
    out = []
    for h in hits:
        size, section = _hit_size(h)
        out.append(f"{escape_human(h['path'])} {h['mdpath']} {size}" + (f" (section {section})" if section else "") + "\n" + (f"  {escape_human(h['snippet'])}\n" if h["snippet"] else "") + "\n")
    return "".join(out) + more, ""


#: Members of a listed node, in order.
MEMBERS = ("mdpath", "kind", "level", "text", "items", "preview", "bytes")


def tree_text(entries: list[dict], form: str = "human", file: str = "", path: str = "$") -> str:
    """A listing; entries have mdpath, bytes, label and the members of their kind."""
    if form == "json":
        return _dump({"version": 1, "file": file, "mdpath": path, "nodes": [{k: e[k] for k in MEMBERS if k in e} for e in entries]})
    if form == "compact":
        return "".join("\t".join((e["mdpath"], size_text(e["bytes"]), escape_compact(e["label"]))) + "\n" for e in entries)
    width = max((len(e["mdpath"]) for e in entries), default=0)
    return "".join(f"{e['mdpath']:<{width}}  {size_text(e['bytes'])}  {escape_human(e['label'])}\n" for e in entries)


def content_text(row: dict, form: str = "human", file: str = "") -> str:
    if form == "json":
        return _dump({"version": 1, "file": file, "mdpath": row["mdpath"], "bytes": row["bytes"], "content": row["content"]})
    return row["content"]


def path_failure(error: dict, form: str = "human", file: str = "") -> str:
    """How a path led nowhere (see Paths.failure), with a listing and what might have been meant."""
    if form == "json":
        bare = {k: [{m: e[m] for m in MEMBERS if m in e} for e in v] if k in ("nodes", "candidates") else v for k, v in error.items()}
        return _dump({"version": 1, "error": bare})
    spell = escape_compact if form == "compact" else escape_human
    path, listed = spell(error["path"]), error.get("candidates") or error.get("nodes") or []
    if error["kind"] == "syntax":
        head = f"invalid document path '{path}': {spell(error['message'])} at byte {error['offset']}"
    elif error["kind"] == "ambiguous":
        head = f"ambiguous document path {path} in {spell(file)}: {len(listed)} sections match '{spell(error['step'])}'"
    else:
        head = f"cannot resolve {path} in {spell(file)}: {spell(error['step'])} not found under {error['resolved']}"
    return f"foliospark: {head}\n" + tree_text(listed, form) + "".join(f"did you mean {s}?\n" for s in error["suggestions"])
