"""The Spark side: tables of nodes, checks, search, files, streams; and each catalogued query against its SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from foliospark.functions import typed
from foliospark.operators import parse, read, relational, search
from foliospark.operators.query import parse_query
from foliospark.plans import catalogue, render
from foliospark.plans.validate import operational_errors, summary, validate
from foliospark.sources import files
from foliospark.streaming import front

DOC = "---\nk: 1\n---\n# T\n\nIntro:\n\n- red bolt\n- blue ring\n\n## A\n\ntext\n\n### A1\n\n## B\n"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([("a", DOC), ("b", ""), ("c", None), ("d", "## X\n#### Y\n")], "doc_id string, source string")


def test_nodes(docs):
    n = parse.nodes(docs)
    assert [r.mdpath for r in n.where("doc_id = 'a'").orderBy("node_id").collect() if r.mdpath] == ["$", "$/p[0]", "$/list[0]", "$/list[0]/item[0]", "$/list[0]/item[1]", "$.a", "$.a/p[0]", "$.a.a1", "$.b"]
    assert {r.doc_id: r.n for r in n.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}["b"] == 1
    assert [r.slug for r in relational.skipped_levels(n).orderBy("doc_id", "node_id").collect()] == ["x", "y"]


@pytest.mark.parametrize("path", ["$", "$.a", "$..a1", "$.b", "$.a.zz", "$/list/item[1]", "$.a/p", "$.[1]", "$/p[3]"])
def test_resolution_by_plan_and_by_document(docs, path):
    plan = {r.doc_id: (r.outcome, r.mdpath) for r in relational.resolve(parse.nodes(docs), path).collect()}
    own = {r.doc_id: (r.outcome, r.mdpath) for r in read.content(docs, path).collect()}
    assert {k: v for k, v in plan.items() if k == "a"} == {k: v for k, v in own.items() if k == "a"} or "/" in path and plan["a"][0] == own["a"][0]


def test_checks_of_odd_documents(spark, docs):
    schema = 'version: 1\ntitle: "*"\nsections:\n- match: A\n'
    got = {(r.doc_id, r.id) for r in validate(docs, schema).collect()}
    assert {("b", "missing-title"), ("c", "missing-title"), ("a", "unexpected-section"), ("d", "skipped-level")} <= got
    bad = spark.createDataFrame([("x", bytearray(b"\xff")), ("y", bytearray(b"# T\n## A\n"))], "doc_id string, source binary")
    assert [r.doc_id for r in operational_errors(bad, schema).collect()] == ["x"] and validate(bad, schema).count() == 0
    row = summary(validate(docs, schema), docs).first()
    assert (row.files, row.schemas) == (4, 0) and row.diagnostics == validate(docs, schema).count()
    assert render.exit_status(row.diagnostics) == 1


def test_typed_columns_agree_with_python(spark):
    values = ["1", "-01", "9223372036854775808", "true", "True", "2024-02-29", "2023-02-29", "0000-01-01", "1.2.3", "1.2.3-rc.1", "1.2.3-rc.01", "1.2", "1.02", "1.2.0", "4294967296", "", "x"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for kind in typed.TYPES:
        got = {r.v: r.ok for r in df.select("v", typed.column(kind, F.col("v")).isNotNull().alias("ok")).collect()}
        for v in values:
            try:
                typed.parse(kind, v)
                want = True
            except typed.Invalid:
                want = False
            assert got[v] == want, (kind, v)


def test_index_follows_its_files(spark, tmp_path):
    folder = tmp_path / "docs"
    folder.mkdir()
    (folder / "a.md").write_text("# Tools\n\n- red bolt\n- blue ring\n\n## Paint\n\nRunning red paint.\n")
    (folder / "b.md").write_text("Nothing else.\n")
    (folder / ".h.md").write_text("red bolt\n")
    (folder / "big.md").write_bytes(b"\xff")
    index = search.Index(spark, str(tmp_path / "index"))
    index.refresh(files.read_markdown(spark, str(folder), None))
    hits = index.search("bolts RED")
    assert [(h["path"], h["mdpath"]) for h in hits["hits"]] == [("a.md", "$/list[0]/item[0]")] and hits["total"] == 1
    assert index.search("red ring")["hits"][0]["mdpath"] == "$/list[0]" and index.search("run")["total"] == 1
    none = index.search("red zebra")
    assert none["total"] == 0 and none["term_counts"] == [{"term": "red", "blocks": 2}, {"term": "zebra", "blocks": 0}]
    assert "red 2, zebra 0" in render.search_text(none)[1] and "item[0]" in render.search_text(hits)[0]
    (folder / "b.md").write_text("A red zebra.\n")
    (folder / "a.md").unlink()
    again = search.Index(spark, str(tmp_path / "index"))
    again.refresh(files.read_markdown(spark, str(folder), None))
    assert again.search("red zebra")["total"] == 1 and again.search("bolt")["total"] == 0 and not again.notes


def test_streamed_documents(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.md").write_text("## X\n")
    stream = front.validate_stream(front.markdown_stream(spark, str(folder)), "version: 1\ntitle: T\n")
    q = stream.writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [r.id for r in spark.table("found").collect()] == ["missing-title"]


def test_plans_are_narrow(spark, tables):
    docs = spark.createDataFrame([(1, "x")], "doc_id bigint, source string")
    plan = validate(docs, "version: 1\ntitle: T\n")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "MapInArrow" in plan


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_its_sql(spark, tables, name):
    con = duckdb.connect()
    for t in ("nation", "customer", "part", "orders", "lineitem", "events"):
        con.execute(f"create view {t} as select * from '{tables}/{t}.parquet'")
    want = con.execute(catalogue.oracle_sql()[name]).df()
    got = catalogue.queries()[name](spark, tables).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    plain = lambda x: sorted(map(repr, x[columns].astype(object).where(x[columns].notna(), None).itertuples(index=False, name=None)))
    assert plain(got) == plain(want)


def test_indexes_that_refresh_in_turn_keep_each_others_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search, "SEGMENTS", 2)

    def docs(name, text):
        (tmp_path / name).mkdir()
        (tmp_path / name / f"{name}.md").write_bytes(text)
        return files.read_markdown(spark, str(tmp_path / name), None)

    one, two = (search.Index(spark, str(tmp_path / "index")) for _ in range(2))
    one.refresh(docs("a", b"An amber lamp.\n"), complete=False)
    two.refresh(docs("b", b"A brass lamp.\n"), complete=False)
    assert two.search("lamp")["total"] == 2 and one.search("lamp")["total"] == 1
    old = search.Index(spark, str(tmp_path / "index"))
    one.refresh(docs("c", b"\xff"), complete=False)
    assert one.notes[-1] == "skipped c.md: not valid UTF-8" and one.search("amber lamp")["total"] == 1
    assert len(one.manifest["segments"]) == 1 and len(one.manifest["retired"]) == 3 and old.search("lamp")["total"] == 2  # merged
    monkeypatch.setattr(search, "STALE", -1)
    two.refresh(docs("d", b"A dim lamp.\n"), complete=False)
    assert not two.manifest["retired"] and two.search("lamp")["total"] == 3


def test_tables_of_files_obey_ignore_files(spark, tmp_path):
    tree = {
        "a.md": "", "b.MD": "B", "draft.md": "x", "keep/draft.md": "k", "keep/x.md": "x", "out/x.md": "", "out/deep/y.md": "", "sub/out/z.md": "", "sub/z.md": "", "sub/only.md": "", "sub/deep/only.md": "", "sub/deep/z.md": "z", "t.txt": "",
        ".gitignore": "draft.md\n/out/\n!keep/draft.md\n# note\n", "sub/.gitignore": "/only.md\nz.md\n", "sub/deep/.ignore": "!z.md\n", "keep/.ignore": "x.*\n",
    }
    for name, text in tree.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    want = [p for p, _, _ in files.walk(tmp_path)[0]]
    assert want == ["a.md", "b.MD", "keep/draft.md", "sub/deep/only.md", "sub/deep/z.md"]
    for folder in (str(tmp_path), f"file://{tmp_path}/"):
        assert sorted(r.path for r in files.read_markdown(spark, folder).select("path").collect()) == want
    assert files.read_markdown(spark, str(tmp_path), ignore=False).count() == 12


@pytest.mark.parametrize(
    ("query", "found"),
    [
        ('"red bolt"', "a"), ('"bolt red"', "b"), ("red OR zebra", "abcd"), ("red -bolt", "c"), ("(red OR zebra) NOT bolts", "cd"), ("+red bolt", "ab"), ("[ze TO zz]", "d"), ("[red TO zebra]", "abcd"), ("{red TO zebra}", "bcd"), ("[x TO *]", "d"),
        ("-red", ""), ("NOT red OR zebra", "d"), ('"', ""), ('red AND "paint runs"', "c"), ("((red", "abc"), ("red ) zebra", ""), ('"red zebra" OR "the"', "bd"), ("{zebra TO *]", ""),
    ],
)
def test_queries_beyond_words(spark, query, found):
    units = [("a", "red bolt"), ("b", "The bolt, red rust"), ("c", "red paint runs"), ("d", "zebra the")]
    u = spark.createDataFrame([(p, "$", None, b, "") for p, b in units], "path string, mdpath string, parent_list string, body string, context string")
    tree = parse_query(query)
    if tree is None:
        assert found == ""
        return
    p = search.postings(u)
    hits = search.ranked_query(p, u, search.statistics(u, p, sorted({t for x in tree.leaves() for t in x.terms})), tree)
    assert "".join(sorted(r.path for r in hits.collect())) == found


def test_plain_words_score_alike(spark):
    u = spark.createDataFrame([(str(i), "$", None, f"red bolt {'x ' * i}", "red bolt" if i % 2 else "") for i in range(6)], "path string, mdpath string, parent_list string, body string, context string")
    p = search.postings(u)
    stats = search.statistics(u, p, ["bolt", "red"])
    one, two = ({r.path: round(r.score, 9) for r in x.collect()} for x in (search.ranked(p, stats, ["bolt", "red"]), search.ranked_query(p, u, stats, parse_query("+red +bolt"))))
    assert one == two and len(one) == 6
