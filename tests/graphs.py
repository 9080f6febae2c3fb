"""Small graphs for tests."""

from codeloom import model


def node(i, kind="Function", file="a.ts", name=None, line=0, end=None, exported=True, native=None, qualified=None, signature=None, doc=None):
    return (i, kind, name or i, qualified or name or i, file, line, 0, line if end is None else end, 80, signature, exported, doc, "ts", native, False)


def edge(a, b, kind="CALLS", i=None, resolved=True):
    return (i or f"{a}-{b}-{kind}", a, b, kind, "tree-sitter", resolved, None)


def nodes(spark, rows):
    return spark.createDataFrame(rows, model.NODES)


def edges(spark, rows):
    return spark.createDataFrame(rows, model.EDGES)


DIAMOND = [("a", "b"), ("a", "d"), ("b", "c"), ("d", "c"), ("c", "e")]
