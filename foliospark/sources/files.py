"""Markdown files as tables, what a walk leaves out, and where schemas and indexes are found."""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a file at most; folder names that a walk skips beside hidden ones.
MOST = 4 << 20
SKIPPED = (".git",)
#: Ignore files; of two in one folder the later one decides.
IGNORE_FILES = (".gitignore", ".ignore")
MARKDOWN = ("md", "markdown")


def read_markdown(spark: SparkSession, folder: str, most: int | None = MOST, ignore: bool = True) -> DataFrame:
    """(path, mtime, size, source) of the Markdown files below a folder that Spark can list, path relative to it.

    Extensions count without case; files over most bytes are dropped by their length, so their content is never read.
    With ignore, the ignore files at and below the folder hold as in Git: they are read once, and paths are held against
    them where they are. Empty files, which Spark's reader leaves out, come from the same listing. Spark itself lists no
    file and no folder whose name begins with a dot or an underscore, so a pattern can't bring those back here; walk can.
    """
    top = folder.rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(_cases(MARKDOWN)) + "}").load(folder)
    plain = top.split(":", 1)[1].lstrip("/") if re.match(r"[a-z0-9]+:/", top) else top.lstrip("/")
    path = F.regexp_extract("path", r"\A(?:[a-z0-9]+:/*)?" + re.escape(plain) + r"(.*)\z", 1)
    files = files.select(path.alias("path"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), F.col("content").alias("source"))
    rules, empty = _listed(spark, folder)
    if empty:
        more = spark.createDataFrame(empty, "path string, ms long").select("path", F.timestamp_millis("ms").alias("mtime"), F.lit(0).cast("long").alias("size"), F.lit(b"").alias("source"))
        files = files.unionByName(more)
    files = files.where(~F.col("path").rlike(r"(?:\A|/)[._]"))
    if ignore and rules:
        files = files.where(_kept(rules)(F.col("path")))
    return files if most is None else files.where(F.col("size") <= most)


def _cases(extensions: tuple[str, ...]) -> list[str]:
    return ["".join(f"[{c.lower()}{c.upper()}]" for c in e) for e in extensions]


def read_text(spark: SparkSession, text: str, name: str = "-") -> DataFrame:
    """A table of one document given as text."""
    return spark.createDataFrame([(name, text)], "doc_id string, source string")


def decoded(files: DataFrame) -> DataFrame:
    """files with source as a string without byte order mark; null where the bytes are not UTF-8."""
    bare = F.when(F.substring("source", 1, 3) == F.lit(b"\xef\xbb\xbf"), F.expr("substring(source, 4)")).otherwise(F.col("source"))
    return files.withColumn("source", F.when(F.is_valid_utf8(bare), F.decode(bare, "UTF-8")))


class Ignore:
    """The patterns of one ignore file, as Git reads them, relative to its folder."""

    def __init__(self, text: str) -> None:
        self.rules: list[tuple[bool, bool, re.Pattern]] = []
        for line in text.splitlines():
            line = re.sub(r"(?<!\\) +$", "", line)
            if not line or line.startswith("#"):
                continue
            keep = line.startswith("!")
            line = line[1:] if keep else line.removeprefix("\\") if line.startswith(("\\#", "\\!")) else line
            folder, line = line.endswith("/"), line.rstrip("/")
            anchored, line = "/" in line, line.lstrip("/")
            self.rules.append((keep, folder, re.compile(("" if anchored else "(?:.*/)?") + self._pattern(line) + r"\Z")))

    @staticmethod
    def _pattern(glob: str) -> str:
        out, i = [], 0
        while i < len(glob):
            if glob.startswith("**/", i):
                out.append("(?:.*/)?")
                i += 3
            elif glob.startswith("/**", i) and i + 3 == len(glob):
                out.append("/.*")
                i += 3
            elif glob[i] == "*":
                out.append("[^/]*")
                i += 1
            elif glob[i] == "?":
                out.append("[^/]")
                i += 1
            elif glob[i] == "[" and (end := glob.find("]", i + 2)) > 0:
                out.append(glob[i : end + 1].replace("[!", "[^"))
                i = end + 1
            else:
                if glob[i] == "\\" and i + 1 < len(glob):
                    i += 1
                out.append(re.escape(glob[i]))
                i += 1
        return "".join(out)

    def verdict(self, path: str, folder: bool) -> bool | None:
        """True: ignored; False: kept whatever comes before; None: no rule."""
        for keep, only_folders, pattern in reversed(self.rules):
            if (folder or not only_folders) and pattern.match(path):
                return not keep
        return None


def _listed(spark: SparkSession, folder: str) -> tuple[dict[str, list[str]], list[tuple[str, int]]]:
    """The ignore files at and below a folder in any store that Spark reads: their texts by the folder they are in, relative
    to folder; and the empty Markdown files with their times. One listing, and one small file at a time, on the driver."""
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(folder)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    base, out, empty = fs.makeQualified(top).toUri().getPath().rstrip("/"), {}, []
    found = fs.listFiles(top, True)
    while found.hasNext():
        status = found.next()
        path = status.getPath()
        name = path.getName()
        if status.getLen() == 0 and "." in name and name.rpartition(".")[2].lower() in MARKDOWN:
            empty.append((path.toUri().getPath().removeprefix(base).lstrip("/"), status.getModificationTime()))
        elif name in IGNORE_FILES:
            stream = fs.open(path)
            try:
                text = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode(errors="replace")
            finally:
                stream.close()
            within = path.getParent().toUri().getPath().removeprefix(base).strip("/")
            out.setdefault(within, []).append((IGNORE_FILES.index(name), text))
    return {k: [t for _, t in sorted(v)] for k, v in out.items()}, empty


def _kept(texts: dict[str, list[str]]):
    """Whether each path is kept by the ignore files of the folders that it is in."""

    def judge():
        rules = {k: [Ignore(t) for t in v] for k, v in texts.items()}

        def verdict(path: str, is_dir: bool) -> bool | None:
            at = path
            while at:
                at = at.rpartition("/")[0]
                for r in reversed(rules.get(at, ())):
                    if (v := r.verdict(path[len(at) + 1 :] if at else path, is_dir)) is not None:
                        return v
            return None

        @functools.lru_cache(100_000)
        def open_(folder: str) -> bool:
            return not folder or open_(folder.rpartition("/")[0]) and not verdict(folder, True)

        return lambda path: open_(path.rpartition("/")[0]) and not verdict(path, False)

    @F.pandas_udf("boolean")
    def kept(x: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ok = judge()
        for paths in x:
            yield paths.map(ok)

    return kept


def walk(top: str | Path) -> tuple[list[tuple[str, int, int]], list[str], bool]:
    """(path, mtime in ns, size) of Markdown files below a local folder, notes, and whether the walk saw everything.

    For a checkout on the driver's own disk: hidden files need a kept pattern, links and index folders are skipped, ignore
    files hold as in Git. Tables of files on a cluster come from read_markdown.
    """
    top = Path(top)
    found, notes, complete = [], [], True
    repository = next((p for p in (top, *top.parents) if (p / ".git").exists()), top)
    inherited = [(p, Ignore((p / ".gitignore").read_text(errors="replace"))) for p in reversed((top, *top.parents)) if p.is_relative_to(repository) and p != top and (p / ".gitignore").is_file()]
    todo = [(top, inherited)]
    while todo:
        folder, rules = todo.pop()
        own = [Ignore((folder / n).read_text(errors="replace")) for n in IGNORE_FILES if (folder / n).is_file()]
        rules = [*rules, *((folder, r) for r in own)]
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError as x:
            notes.append(f"cannot walk: {x}")
            complete = False
            continue
        for e in entries:
            if e.is_symlink() or e.name in SKIPPED:
                continue
            is_dir = e.is_dir(follow_symlinks=False)
            verdict = next((v for base, r in reversed(rules) if (v := r.verdict(Path(e.path).relative_to(base).as_posix(), is_dir)) is not None), None)
            if verdict or verdict is None and e.name.startswith("."):
                continue
            if is_dir:
                todo.append((Path(e.path), rules))
            elif e.name.rpartition(".")[2].lower() in MARKDOWN and "." in e.name and e.is_file():
                try:
                    e.name.encode()
                    s = e.stat(follow_symlinks=False)
                except UnicodeEncodeError:
                    notes.append(f"skipping {e.name!a}: file name is not valid UTF-8")
                    continue
                except OSError as x:
                    notes.append(f"cannot stat {e.path}: {x}")
                    complete = False
                    continue
                found.append((Path(e.path).relative_to(top).as_posix(), s.st_mtime_ns, s.st_size))
    return sorted(found), notes, complete


def locate(folder: str | Path) -> tuple[Path, str]:
    """The nearest folder upwards with .git, else the folder itself, and the folder's path within it."""
    folder = Path(folder).resolve()
    top = next((p for p in (folder, *folder.parents) if (p / ".git").exists()), folder)
    prefix = folder.relative_to(top).as_posix()
    return top, "" if prefix == "." else prefix + "/"


def schema_for(documents: DataFrame, schemas: DataFrame, suffix: str = ".folio.yml") -> DataFrame:
    """(path, schema) of each document: of the schema files, <stem><suffix> before <suffix>, the nearest folder upwards first.

    Ancestor folders are made from the path itself, so it is one equi-join by folder and name.
    """
    parts = F.split("path", "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"(?<=.)\.[^.]*\z", "")
    folders = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("folder")))
    x = documents.select("path", stem.alias("_stem"), F.explode(folders).alias("f"))
    names = F.array(F.struct(F.lit(0).alias("rank"), F.concat("_stem", F.lit(suffix)).alias("name")), F.struct(F.lit(1).alias("rank"), F.lit(suffix).alias("name")))
    x = x.select("path", "f.depth", "f.folder", F.explode(names).alias("n"))
    x = x.select("path", "depth", "n.rank", F.when(F.col("folder") == "", F.col("n.name")).otherwise(F.concat_ws("/", "folder", "n.name")).alias("schema"))
    hits = x.join(schemas.select(F.col("path").alias("schema")), "schema")
    return hits.groupBy("path").agg(F.min_by("schema", F.struct(-F.col("depth"), F.col("rank"))).alias("schema"))


def linked_schemas(spark: SparkSession, folder: str, first: str, read=None) -> dict:
    """The JSON document named first and all that it links to by relative paths, by those paths: a walk over files on the driver."""
    import posixpath

    from ..plans.jsonschema import read_json, references

    read = read or (lambda p: "\n".join(r[0] for r in spark.read.text(f"{folder.rstrip('/')}/{p}", wholetext=True).collect()))
    out, todo = {}, [first]
    while todo:
        name = todo.pop()
        if name in out:
            continue
        out[name] = read_json(read(name))
        todo += [posixpath.normpath(posixpath.join(posixpath.dirname(name), r.partition("#")[0])) for r in references(out[name]) if isinstance(r, str) and r.partition("#")[0] and "://" not in r]
    return out
