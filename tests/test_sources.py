import json
import os

import graphs
import pytest
from pyspark.sql import functions as F

from codeloom.operators import changes, status
from codeloom.sources import ndjson, tree
from codeloom.storage import IndexNotReady, TableRoot, project_hash
from codeloom.streaming import changes as stream

NODE = '{"id":"%s","kind":"Function","name":"f","qualifiedName":"f","filePath":"a.ts","range":{"start":{"line":1,"col":0},"end":{"line":2,"col":3}},"exported":true,"language":"ts"}'
EDGE = '{"id":"e","fromId":"a","toId":"b","kind":"%s","source":"tree-sitter","resolved":false}'


def lines(spark, rows):
    return spark.createDataFrame([(r,) for r in rows], "value string")


def test_lines_are_classified(spark):
    c = ndjson.classify(lines(spark, [NODE % "a", NODE % "b" + "\r", EDGE % "CALLS", EDGE % "NOT_A_REAL_KIND", "{broken", "", "  "]))
    assert tuple(ndjson.counters(c).first()) == (2, 1, 2)
    nodes, edges, _, bad = ndjson.split(c)
    assert {(r["id"], r["endCol"], r["hasSyntaxErrors"]) for r in nodes.collect()} == {("a", 3, False), ("b", 3, False)}
    assert edges.count() == 1 and bad.count() == 2


def test_overloads_on_the_wire(spark):
    text = NODE % "a"
    three = ",".join('{"range":{"start":{"line":%d,"col":0},"end":{"line":%d,"col":1}},"hasBody":%s}' % (i, i, str(i == 2).lower()) for i in range(3))
    _, _, d, _ = ndjson.split(ndjson.classify(lines(spark, [text[:-1] + ',"declarations":[' + three + "]}"])))
    assert [(r["ordinal"], r["hasBody"]) for r in d.orderBy("ordinal").collect()] == [(0, False), (1, False), (2, True)]


def test_round_trip(spark, tmp_path):
    n = graphs.nodes(spark, [graphs.node("a", signature="f(ä)"), graphs.node("b", "Type")])
    ndjson.write_lines(ndjson.node_lines(n), f"file://{tmp_path}/out")
    back, _, _, bad = ndjson.split(ndjson.classify(ndjson.read_lines(spark, f"file://{tmp_path}/out")))
    assert bad.isEmpty() and changes.diff(n, back).isEmpty()


def test_nulls_stay_in_responses(spark):
    assert ndjson.response_json(spark.sql("select 1 a, cast(null as string) b")).first()[0] == '{"a":1,"b":null}'


def test_table_root(spark, tmp_path):
    root = TableRoot(spark, f"file://{tmp_path}", "/work/p")
    assert project_hash("/work/p") in root.root and root.read("nodes").count() == 0
    with pytest.raises(IndexNotReady):
        root.ready()
    root.commit({"nodes": graphs.nodes(spark, [graphs.node("a")]), "edges": graphs.edges(spark, [graphs.edge("a", "a")])}, bulkIndexedAt="now")
    assert root.ready()["bulkIndexedAt"] == "now" and root.read("edges").first()["kind"] == "CALLS"
    root.commit({"nodes": graphs.nodes(spark, [graphs.node("b")])})
    assert [r["id"] for r in root.read("nodes").collect()] == ["b"] and root.read("edges").count() == 1
    assert TableRoot(spark, f"file://{tmp_path}", "/work/p", schema_version="2").read("nodes").count() == 0


def test_a_crash_between_pointer_steps_keeps_the_index(spark, tmp_path, monkeypatch):
    root = TableRoot(spark, f"file://{tmp_path}", "p")
    root.commit({"nodes": graphs.nodes(spark, [graphs.node("a")])})
    root.commit({"nodes": graphs.nodes(spark, [graphs.node("b")])})
    p, fs = root._fs(root.root)

    class Crashing:
        """A file system whose rename never comes back."""

        def __getattr__(self, name):
            return getattr(fs, name)

        def rename(self, a, b):
            raise KeyboardInterrupt

    monkeypatch.setattr(root, "_fs", lambda path: (spark._jvm.org.apache.hadoop.fs.Path(path), Crashing()))
    with pytest.raises(KeyboardInterrupt):
        root.commit({"nodes": graphs.nodes(spark, [graphs.node("c")])})
    again = TableRoot(spark, f"file://{tmp_path}", "p")
    assert [r["id"] for r in again.read("nodes").collect()] == ["b"]
    again.commit({"nodes": graphs.nodes(spark, [graphs.node("d")])})
    assert [r["id"] for r in again.read("nodes").collect()] == ["d"]


def test_the_last_line_of_an_id_wins(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    named = lambda i, n: json.dumps(json.loads(NODE % i) | {"name": n})
    for i, names in enumerate((["one", "two"], ["three"])):
        (folder / f"{9 - i}.ndjson").write_text("\n".join(named("a", n) for n in names))
        os.utime(folder / f"{9 - i}.ndjson", (1_000_000 + i, 1_000_000 + i))
    root = TableRoot(spark, f"file://{tmp_path}/root", "p")
    stream.ingest(spark, str(folder), root, f"{tmp_path}/cp").awaitTermination()
    assert [r["name"] for r in root.read("nodes").collect()] == ["three"]


def test_stream_ingest_can_be_replayed(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.ndjson").write_text("\n".join([NODE % "a", NODE % "b", EDGE % "CALLS", "{bad"]))
    root = TableRoot(spark, f"file://{tmp_path}/root", "p")
    stream.ingest(spark, str(folder), root, f"{tmp_path}/cp").awaitTermination()
    (folder / "2.ndjson").write_text(NODE % "a")
    stream.ingest(spark, str(folder), root, f"{tmp_path}/cp").awaitTermination()
    stream.apply_lines(root, spark.read.text(str(folder)))
    assert root.read("nodes").count() == 2 and root.read("edges").count() == 1


def test_stream_equals_batch(spark, tmp_path):
    rows = [("a", 0.0), ("a", 0.1), ("a", 0.5), ("b", 0.2), ("a", 0.4), ("b", 0.5)]
    events = spark.createDataFrame(rows, "path string, s double").select("path", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")).alias("ts"))
    events.write.json(f"{tmp_path}/ev")
    far = spark.createDataFrame([("z", 100.0)], "path string, s double").select("path", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")).alias("ts"))
    far.write.mode("append").json(f"{tmp_path}/ev")
    for i in range(2):
        q = stream.debounce(stream.watch(spark, f"{tmp_path}/ev")).writeStream.format("memory").queryName("quiet").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp{i}").trigger(availableNow=True).start()
        q.awaitTermination()
    want = {tuple(r) for r in stream.debounce(events).collect()}
    assert {tuple(r) for r in spark.table("quiet").where("path != 'z'").collect()} == want
    assert sorted((r[0], r[3]) for r in want) == [("a", 2), ("a", 2), ("b", 1), ("b", 1)]  # exactly a gap apart is two


def test_ignore_rules(spark):
    paths = ["src/a.ts", "src/gen/a.ts", "src/gen/keep.ts", "node_modules/x.ts", "build/x.ts", "a/build/x.ts", "x.log", "a/.git/b.ts"]
    layers = {"": "# c\n\n/build\n*.log\n", "src": "gen/*\n!keep.ts\n"}
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r["p"] for r in df.where(~tree.ignored(F.col("p"), layers)).collect()] == ["src/a.ts", "src/gen/keep.ts", "a/build/x.ts"]


def test_tree(spark, tmp_path):
    for p in ("src/a.ts", "src/b.css", "node_modules/c.ts", "d.JS"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text("x")
    assert sorted(r["filePath"] for r in tree.read_tree(spark, f"file://{tmp_path}").collect()) == ["d.JS", "src/a.ts"]


def test_links(spark):
    rows = [("a", "/r/a"), ("z/a", "/r/a"), ("out", "/etc/x"), ("gone", None)]
    assert [r["filePath"] for r in tree.one_of_each(spark.createDataFrame(rows, "filePath string, realPath string"), "/r").collect()] == ["a"]


def test_humanize(spark):
    got = [r[0] for r in spark.createDataFrame([(s,) for s in (0, 59, 60, 7199, 86400, 200000)], "s long").select(status.humanize(F.col("s"))).collect()]
    assert got == ["just now", "just now", "1 minute ago", "1 hour ago", "1 day ago", "2 days ago"]


def test_coverage_of_nothing(spark):
    none = spark.createDataFrame([], "filePath string, mtime long")
    assert tuple(status.coverage(none, none, none, none).first()) == (0, 0, 1.0, 0)
