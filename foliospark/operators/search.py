"""Ranked full-text search over index units: postings, conjunctive matching, BM25, list exclusion, and an index on disk."""

from __future__ import annotations

import json
import math
import re
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stem import analyze, stem_column, tokens_column
from .parse import units as units_of
from .query import Tree, holding, is_plain, parse_query

FORMAT = 2
#: Hits by default and at most; bytes of a file at most; characters of a snippet; what the context adds to a score.
LIMIT, MOST, FILE, SNIPPET, BOOST = 10, 1000, 4 << 20, 160, 2.0
K1, B = 1.2, 0.75
#: Segments that a refresh leaves; more are merged into one. Seconds after which a lock counts as left behind, and for which
#: merged segments stay for readers of an older manifest. Skipped files that are named.
SEGMENTS, STALE, NAMED = 8, 6 * 3600, 20


def postings(units: DataFrame, stemmed: bool = True) -> DataFrame:
    """(path, mdpath, parent_list, field, term, tf, dl): how often each unit has each term. Tokens are counted within a
    unit by expressions on its own row, so nothing is shuffled; only distinct tokens of a unit reach the stemmer."""
    both = F.array(*(F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f), F.lit("")).alias("text")) for f in ("body", "context")))
    x = units.select("path", "mdpath", "parent_list", F.explode(both).alias("x")).select("path", "mdpath", "parent_list", "x.field", tokens_column(F.col("x.text")).alias("tokens"))
    x = x.withColumn("dl", F.size("tokens")).select("path", "mdpath", "parent_list", "field", "dl", F.explode("tokens").alias("token"))
    x = x.withColumn("term", stem_column("token") if stemmed else F.col("token"))
    return x.groupBy("path", "mdpath", "parent_list", "field", "term").agg(F.count("*").alias("tf"), F.max("dl").cast("long").alias("dl"))


def statistics(units: DataFrame, found: DataFrame, terms: list[str]) -> dict:
    """Units, their average length, and units of each term: a few numbers, summed where the data are. Units of an index have
    their length in n_tokens; of others it is counted."""
    size = F.col("n_tokens") if "n_tokens" in units.columns else _size()
    n, total = units.agg(F.count("*"), F.sum(size)).first()
    df = {r[0]: r[1] for r in found.where(F.col("term").isin(terms) & (F.col("field") == "body")).groupBy("term").agg(F.count("*")).collect()}
    return {"n": n, "avgdl": (total or 0) / n if n else 0.0, "df": df}


def _size():
    return F.size(tokens_column(F.coalesce("body", F.lit("")))).cast("long")


def ranked(found: DataFrame, stats: dict, terms: list[str]) -> DataFrame:
    """(path, mdpath, score) of each unit whose body has all terms, without lists one of whose items has them all.

    found is filtered to the terms first, so that only their postings are shuffled. Equal scores are left to the caller.
    """
    gain = _gain(stats, terms)
    body, context = F.col("field") == "body", F.col("field") == "context"
    hits = found.where(F.col("term").isin(terms)).groupBy("path", "mdpath", "parent_list").agg(
        F.sum(F.when(body, gain)).alias("gain"), F.count(F.when(body, 1)).alias("n_body"), F.count(F.when(context, 1)).alias("n_context")
    )
    return _scored(hits.where(F.col("n_body") == len(terms)).withColumn("in_context", F.col("n_context") == len(terms)))


def ranked_query(found: DataFrame, units: DataFrame, stats: dict, tree: Tree) -> DataFrame:
    """As ranked, for a query that is more than words; a range adds nothing to a score."""
    return _scored(holding(found, units, tree, _gain(stats, sorted({t for x in tree.leaves() for t in x.terms}))))


def _gain(stats: dict, terms: list[str]) -> Column:
    """What a posting adds to a score; nothing for other terms."""
    idf = {t: math.log(1 + (stats["n"] - d + 0.5) / (d + 0.5)) for t in terms for d in [stats["df"].get(t, 0)]}
    weight = F.coalesce(*(F.when(F.col("term") == t, F.lit(idf[t])) for t in terms), F.lit(0.0))
    return weight * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(max(stats["avgdl"], 1e-9))))


def _scored(hits: DataFrame) -> DataFrame:
    """(path, mdpath, score) of hits, more where the context has all terms too, without lists one of whose items is a hit."""
    hits = hits.withColumn("score", F.col("gain") + F.when(F.col("in_context"), BOOST).otherwise(0.0))
    lists = hits.where("parent_list is not null").select("path", F.col("parent_list").alias("mdpath")).distinct()
    return hits.join(lists, ["path", "mdpath"], "left_anti").select("path", "mdpath", "score")


def top(hits: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The best hits; equal scores by path and document path. Rows are kept per task, so no full sort."""
    if not 1 <= limit <= MOST:
        raise ValueError(f"limit must be 1 to {MOST}")
    return hits.orderBy(F.desc("score"), "path", "mdpath").limit(limit)


def term_counts(found: DataFrame, terms: list[str]) -> DataFrame:
    """Units other than items of each term."""
    return found.where(F.col("term").isin(terms) & (F.col("field") == "body") & F.col("parent_list").isNull()).groupBy("term").agg(F.count("*").alias("blocks"))


def query_terms(query: str) -> list[str]:
    """Distinct analysed terms, in order."""
    return list(dict.fromkeys(analyze(query)))


def simple_terms(query: str) -> list[str] | None:
    """The words of a query of plain words alone, else None."""
    words = query.split()
    return words if words and all(w.isalnum() and w not in ("AND", "OR", "NOT") for w in words) else None


def snippet(text: str, terms: set[str], most: int = SNIPPET) -> str:
    """The part of text, at most that many characters, with the most terms; an ellipsis where text is left out."""
    if len(text) <= most:
        return text
    words = [(m.start(), m.end(), (analyze(m[0]) or [""])[0]) for m in re.finditer(r"\w+", text)]
    hits = [(a, b, t) for a, b, t in words if t in terms]
    best, at = (0, 0), 0
    for i, (a, _, _) in enumerate(hits):
        inside = {t for x, b, t in hits[i : i + 60] if b <= a + most}
        if (len(inside), -a) > best or not i:
            best, at = (len(inside), -a), a
    start = max(0, min(at - 30, len(text) - most)) if hits else 0
    while 0 < start < len(text) and text[start - 1].isalnum():
        start += 1
    end = min(len(text), start + most)
    while start < end < len(text) and text[end].isalnum() and text[end - 1].isalnum():
        end -= 1
    return ("…" if start else "") + text[start:end].strip() + ("…" if end < len(text) else "")


def refresh_plan(listed: DataFrame, indexed: DataFrame, complete: bool = True, prefix: str = "") -> DataFrame:
    """(path, action) of files to index anew (new or changed) and to remove (gone, if the listing is complete). Both sides
    have path, mtime, size. Files outside prefix are left as they are."""
    old = indexed.select("path", F.col("mtime").alias("old_mtime"), F.col("size").alias("old_size"))
    both = listed.select("path", "mtime", "size", F.lit(True).alias("here")).join(old.withColumn("there", F.lit(True)), "path", "full_outer")
    changed = F.col("there").isNull() | ~(F.col("mtime").eqNullSafe(F.col("old_mtime")) & F.col("size").eqNullSafe(F.col("old_size")))
    action = F.when(F.col("here") & changed, "index").when(F.col("here").isNull() & F.lit(complete) & F.col("path").startswith(prefix), "remove")
    return both.select("path", action.alias("action")).where("action is not null")


class Busy(RuntimeError):
    """Another process refreshes the index."""


class Index:
    """An index in a folder that driver and executors share: segments of units and postings, and a manifest that names the
    live ones. A refresh reads the manifest behind its lock, writes a segment of what changed, then a new manifest. Readers
    keep the one they opened: segments that were merged stay for STALE seconds. Postings are sorted by term, so a query
    reads the row groups of its terms."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder, self.notes = spark, folder.rstrip("/"), []
        jvm = spark._jvm
        self._path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        self.fs = jvm.org.apache.hadoop.fs.Path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self.manifest = self._open()

    def _read(self) -> dict | None:
        """The manifest as it is now; None if there is none."""
        if not self.fs.exists(self._path("manifest.json")):
            return None
        found = json.loads("".join(r[0] for r in self.spark.read.text(f"{self.folder}/manifest.json").collect()))
        if found.get("format") != FORMAT:
            raise ValueError("format changed")
        return found

    def _open(self) -> dict:
        empty = {"format": FORMAT, "segments": [], "files": None, "retired": []}
        try:
            if found := self._read():
                return found
            self.fs.mkdirs(self._path(""))
            self.notes.append(f"created search index at {self.folder}")
        except Exception as x:
            why = str(x) if str(x) == "format changed" else "index could not be opened"
            self.notes.append(f"rebuilt search index at {self.folder} ({why})")
        return empty

    def _write(self, manifest: dict) -> None:
        name = f".manifest-{uuid.uuid4().hex}"
        out = self.fs.create(self._path(name), True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        overwrite = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        options = gateway.new_array(overwrite, 1)
        options[0] = overwrite.OVERWRITE
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark._jsc.hadoopConfiguration())
        files.rename(self.fs.makeQualified(self._path(name)), self.fs.makeQualified(self._path("manifest.json")), options)  # all or nothing
        self.manifest = manifest

    def files(self) -> DataFrame:
        """(path, mtime, size, segment) of each indexed file."""
        if self.manifest["files"] is None:
            return self.spark.createDataFrame([], "path string, mtime timestamp, size long, segment string")
        return self.spark.read.parquet(f"{self.folder}/{self.manifest['files']}")

    def _live(self, kind: str) -> DataFrame:
        if not self.manifest["segments"]:
            rows = self.spark.createDataFrame([], "path string, mdpath string, parent_list string, kind string, bytes long, section_bytes long, context string, body string, snippet string, n_tokens long, segment string")
            return postings(rows).limit(0) if kind == "postings" else rows
        rows = self.spark.read.option("mergeSchema", "false").parquet(*(f"{self.folder}/{s}/{kind}" for s in self.manifest["segments"]))
        return rows.join(self.files().select("path", "segment"), ["path", "segment"], "left_semi")

    def refresh(self, listed: DataFrame, complete: bool = True, prefix: str = "") -> None:
        """Brings the index up to the listed files (path, mtime, size, source). Files that can't be read lose their units; notes
        tell of them. Raises Busy while another process refreshes."""
        lock = self._path(".lock")
        if self.fs.exists(lock) and time.time() * 1000 - self.fs.getFileStatus(lock).getModificationTime() > STALE * 1000:
            self.fs.delete(lock, False)  # left by a process that died
        if not self.fs.createNewFile(lock):
            raise Busy("search index is being refreshed by another process; searching the existing index")
        try:
            try:
                self.manifest = self._read() or self.manifest  # others may have refreshed since this was opened
            except ValueError:
                pass  # a broken or older one, which __init__ has told of, is replaced
            self._refresh(listed, complete, prefix)
            self._sweep()
        finally:
            self.fs.delete(lock, False)

    def _refresh(self, listed: DataFrame, complete: bool, prefix: str) -> None:
        segment = f"segment-{int(time.time() * 1000)}-{uuid.uuid4().hex[:8]}"
        plan = refresh_plan(listed, self.files(), complete, prefix)
        plan.write.parquet(f"{self.folder}/{segment}/plan")
        plan = self.spark.read.parquet(f"{self.folder}/{segment}/plan")
        if plan.isEmpty():
            self.fs.delete(self._path(segment), True)
            return
        fresh = plan.where("action = 'index'").select("path")
        source = F.col("source").cast("binary")
        large, broken = F.col("size") > FILE, ~F.is_valid_utf8(source)
        some = listed.join(fresh, "path", "left_semi")
        self._note(some.where(large | broken).select("path", F.when(large, f"over {FILE} bytes").otherwise("not valid UTF-8").alias("why")))
        units_of(some.where(~large & ~broken), "path", "source").withColumn("n_tokens", _size()).withColumn("segment", F.lit(segment)).write.parquet(f"{self.folder}/{segment}/units")
        own = self.spark.read.parquet(f"{self.folder}/{segment}/units")
        self._by_term(postings(own).withColumn("segment", F.lit(segment))).write.parquet(f"{self.folder}/{segment}/postings")
        kept = self.files().join(plan.select("path"), "path", "left_anti")
        kept.unionByName(listed.join(fresh, "path", "left_semi").select("path", "mtime", "size", F.lit(segment).alias("segment"))).write.parquet(f"{self.folder}/{segment}/files")
        self._write({**self.manifest, "segments": [*self.manifest["segments"], segment], "files": f"{segment}/files"})
        if len(self.manifest["segments"]) > SEGMENTS:
            self._merge()

    @staticmethod
    def _by_term(found: DataFrame) -> DataFrame:
        return found.repartitionByRange("term", "path").sortWithinPartitions("term", "path")

    def _note(self, skipped: DataFrame) -> None:
        """Names files that were passed over, the first NAMED of them, and how many more there are."""
        rows = skipped.orderBy("path").limit(NAMED).collect()
        self.notes += [f"skipped {r['path']}: {r['why']}" for r in rows]
        if len(rows) == NAMED and (more := skipped.count() - NAMED):
            self.notes.append(f"skipped {more} more files")

    def _merge(self) -> None:
        """One segment of all live rows; the old ones are retired."""
        old, segment, now = self.manifest["segments"], f"segment-{int(time.time() * 1000)}-{uuid.uuid4().hex[:8]}", time.time()
        self._live("units").withColumn("segment", F.lit(segment)).write.parquet(f"{self.folder}/{segment}/units")
        self._by_term(self._live("postings").withColumn("segment", F.lit(segment))).write.parquet(f"{self.folder}/{segment}/postings")
        self.files().withColumn("segment", F.lit(segment)).write.parquet(f"{self.folder}/{segment}/files")
        self._write({**self.manifest, "segments": [segment], "files": f"{segment}/files", "retired": [*self.manifest["retired"], *([s, now] for s in old)]})

    def _sweep(self) -> None:
        """Deletes segments that were retired long enough ago, once the manifest no longer names them."""
        gone = [s for s, t in self.manifest["retired"] if time.time() - t > STALE]
        if gone:
            self._write({**self.manifest, "retired": [x for x in self.manifest["retired"] if x[0] not in gone]})
            for s in gone:
                self.fs.delete(self._path(s), True)

    def search(self, query: str, limit: int = LIMIT, prefix: str = "") -> dict:
        """total and hits of a query, as the search command gives them; term_counts if there is no hit. At most limit rows
        reach the driver."""
        if not query.strip():
            raise ValueError("the query is empty")
        plain = is_plain(query)
        tree = None if plain else parse_query(query)
        terms = query_terms(query) if plain else sorted({t for x in tree.leaves() for t in x.terms}) if tree else []
        scope = F.col("path").startswith(prefix) if prefix else F.lit(True)
        found, units = self._live("postings").where(scope), self._live("units").where(scope)
        out: dict = {"version": 1, "query": query, "total": 0, "hits": []}
        if terms or tree:
            stats = statistics(units, found, terms)
            hits = ranked(found, stats, terms) if plain else ranked_query(found, units, stats, tree)
            out["total"] = hits.count()
            best = top(hits, limit).join(units.select("path", "mdpath", "bytes", "section_bytes", "snippet"), ["path", "mdpath"])
            for r in best.orderBy(F.desc("score"), "path", "mdpath").collect():
                out["hits"].append({"path": r["path"], "mdpath": r["mdpath"], "bytes": r["bytes"], "section_bytes": r["section_bytes"], "score": r["score"], "snippet": snippet(r["snippet"] or "", set(terms))})
        if not out["hits"]:
            words = simple_terms(query) if plain else None
            counts = {r[0]: r[1] for r in term_counts(found, terms).collect()} if words and terms else {}
            out["term_counts"] = None if words is None else [{"term": w, "blocks": counts.get((analyze(w) or [""])[0], 0)} for w in words]
        return out
