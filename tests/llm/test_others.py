import hashlib
import os
import random
import re
import zlib

import brute
import duckdb
import numpy as np
import pyarrow as pa
import pytest
from conftest import DATA
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeloom.llm import ann, decontaminate, packing, pii, quality, queries, toxicity, url_filter, warc

BIG = "/root/testdata/sf0.01"

# packing


@given(st.integers(1, 5000))
def test_pieces_cover(n):
    at = 0
    for start, length in packing.pieces(n):
        assert start == at and length & (length - 1) == 0 and length <= 1024
        at += length
    assert at == n


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=200))
def test_both_tokenizers_agree(text):
    e = packing._made.get("byte_bpe_50k.json") or packing._made.setdefault("byte_bpe_50k.json", packing.Encoder("byte_bpe_50k.json"))
    assert e.ids(text).tolist() == e.plain.encode(text, add_special_tokens=False).ids


def test_packing_round_trip(spark, docs_of):
    rows = [(1, "some words of text " * 400), (2, ""), (3, None), (None, "x"), (4, "a" * 9000), (4, "again")]
    out = packing.pack_documents(docs_of(rows), with_ids=True).collect()
    e = packing.Encoder("byte_bpe_50k.json")
    assert len({r["sequence_id"] for r in out}) == len(out) and {r["offset"] for r in out} == {0}
    whole = {}
    for r in sorted(out, key=lambda r: r["sequence_id"]):
        assert r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        whole.setdefault((r["doc_id"], r["doc_tokens"]), []).extend(r["ids"])
    want = sorted([*e.plain.encode(t or "", add_special_tokens=False).ids, 0] for _, t in rows)
    assert sorted(whole.values()) == want
    assert packing.pack_documents(docs_of([])).count() == 0
    with pytest.raises(ValueError):
        packing.pack_documents(docs_of([]), window=1000)


# personal data

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


CASES = [
    "a@b.c@d.e", "a@b.c_x@d.e", "x a.b+c@mail.example.com, y", "1.2.3.4.5.6.7.8", "256.1.1.1 001.2.3.255", "4111 1111 1111 1111", "4111111111111112", "+1 (456) 555-2186 and +44 1", "é😀 a@b.cc 1.2.3.4",
    "", None, "a@" * 5000, "1." * 20000, "9" * 30000, "x" * 50000 + "@y.zz", "a@b.cc " * 700, "+1((((((((" * 3000,
]


def test_base_spans_equal_plain_ones(docs_of):
    out = pii.find_pii(docs_of(list(enumerate(CASES)))).collect()
    for r in out:
        assert [f"{s['kind']}:{s['start']}:{s['end']}" for s in r["base"]] == plain_spans(CASES[r["doc_id"]]), CASES[r["doc_id"]][:40]
        assert {(s["kind"], s["start"]) for s in r["base"]} <= {(s["kind"], s["start"]) for s in r["spans"]}


@settings(max_examples=12, deadline=None)
@given(st.lists(st.text(alphabet="a@.+1 9-(é", max_size=60), min_size=1, max_size=40))
def test_base_spans_of_any_text(spark, docs_of, texts):
    for r in pii.find_pii(docs_of(list(enumerate(texts)))).collect():
        assert [f"{s['kind']}:{s['start']}:{s['end']}" for s in r["base"]] == plain_spans(texts[r["doc_id"]])


def test_added_spans_need_words_or_checksums(docs_of):
    rows = [(1, "call 555-123-4567 now"), (2, "item 555-123-4567 now"), (3, "iban DE89 3704 0044 0532 0130 00."), (4, "GB82WEST12345698765432"), (5, "GB83WEST12345698765432"), (6, "my amex card 378282246310005"), (7, "stamp 378282246310005")]
    found = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in pii.find_pii(docs_of(rows)).collect()}
    assert found == {1: [("phone", 5, 17)], 2: [], 3: [("iban", 5, 32)], 4: [("iban", 0, 22)], 5: [], 6: [("card", 13, 28)], 7: []}


def test_pii_query(spark):
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in pii.op8_pii(spark, DATA).collect():
        base = plain_spans(text[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert r["n_email"] == sum(b.startswith("email") for b in base) and r["n_phone"] == sum(b.startswith("phone") for b in base)


# decontamination


def test_containment_both_ways(docs_of, near_rows, spark):
    items = [(i, t) for i, t in near_rows if i < 12 or i >= 900] + [(50, near_rows[3][1])]
    long = (999, " ".join((near_rows[2][1], "filler " * 5000, near_rows[5][1])))
    rows = [*near_rows, long]
    it = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for d, t in rows:
        for i, q in items:
            a, b = brute.shingles(t), brute.shingles(q)
            if b and len(a & b) >= 0.75 * len(b):
                want.add((d, i, len(b), len(a & b)))
    for sent in (decontaminate.SENT_BYTES, 0):
        got = {(r["doc_id"], r["item_id"], r["n_item"], r["n_common"]) for r in decontaminate.contained_items(docs_of(rows), it, sent_bytes=sent).collect()}
        assert got == want
    assert decontaminate.contained_items(docs_of([]), it).count() == 0 and decontaminate.contained_items(docs_of(rows), it.limit(0)).count() == 0


def test_contaminated_documents_go(docs_of, spark):
    it = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    rows = docs_of([(1, "zero one two three four five six"), (2, "clean words"), (None, "one two three four five six"), (3, None)])
    for sent in (decontaminate.SENT_BYTES, 0):
        out = decontaminate.drop_contaminated(rows, it, sent_bytes=sent)
        assert out.columns == rows.columns and sorted(r[0] for r in out.collect()) == [2, 3]


def test_contaminated_rows_go_alone(docs_of, spark):
    it = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    rows = docs_of([(None, "one two three four five six"), (None, "clean null id"), (5, "x one two three four five six"), (5, "clean shared id"), (6, None)])
    for sent in (decontaminate.SENT_BYTES, 0):
        out = decontaminate.drop_contaminated(rows, it, sent_bytes=sent)
        assert out.columns == rows.columns and sorted(str(r[1]) for r in out.collect()) == ["None", "clean null id", "clean shared id"]


# urls


def test_urls(spark):
    urls = ["http://A.Example.NET/en/1", "https://example.net", "http://example.net/x", "x://sub.example.com/de/?q", "x://badexample.com/de/", "http://o.org/fr/", "http://o.org", "no scheme", None, "", "h://?x", "h://net/#"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("bound", F.lit(9))
    none = spark.createDataFrame([], "page_id long, bad int")
    out = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(df, none).collect()}
    assert out[0] == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert out[1] == ("example.net", "", None, "allow") and out[2][2:] == ("net/", "block")
    assert out[3] == ("sub.example.com", "/de/", "example.com/de/", "block") and out[4][2] is None
    assert out[5][2:] == ("org/fr/", "allow") and out[7][:2] == out[8][:2] == out[10][:2] == ("", "") and out[11] == ("net", "/", "net/", "block")
    assert url_filter.judge_urls(df.limit(0), none).count() == 0


def test_reputation_needs_evidence(spark):
    pages = [(i, "http://bad.spam.io/") for i in range(40)] + [(100 + i, f"http://h{i}.fine.io/") for i in range(60)] + [(300, "http://one.spam.io/")]
    df = spark.createDataFrame(pages, "page_id long, url string")
    bad = spark.createDataFrame([(i, 1 if i < 40 or i == 300 or i == 107 else 0) for i, _ in pages], "page_id long, bad int")
    out = {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(df, bad, []).collect()}
    assert out[0] == "block" and out[107] == "allow" and out[100] == "allow"


# archives


def test_archives_round_trip(spark, tmp_path):
    rows = [(1, "http://a/ü%20 x", "<p>ä</p>"), (2, None, "<p>ä</p>"), (3, "u\r\nv", None), (4, "", ""), (5, "u", "x\r\n\r\nWARC/1.1\r\n\r\n" * 3), (None, "n", "<p>ä</p>"), (6, "big", "z" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    warc.write_archives(pages, f"file://{tmp_path}/a")
    got = {r["page_id"]: r for r in warc.read_archives(spark, f"file://{tmp_path}/a").collect()}
    for i, url, html in rows:
        r, body = got[i], (html or "").encode()
        assert r["url"] == url and r["payload_bytes"] == len(body) and r["payload_digest"] == warc.digest_of(body)
        assert r["payload"] == (body if r["record_type"] == "response" else None)
    assert {i: r["refers_to"] for i, r in got.items() if r["record_type"] == "revisit"} == {2: 1, None: 1, 4: 3}
    some = warc.read_archives(spark, f"file://{tmp_path}/a", "page_id long, record_type string").where("record_type = 'revisit' and page_id is not null")
    assert sorted(r["page_id"] for r in some.collect()) == [2, 4] and "Filter" not in some._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r[0] for r in warc.read_archives(spark, f"file://{tmp_path}/a").where("page_id in (1, 9) or payload_bytes > 1000").select("page_id").collect()) == [1, 6]


def test_foreign_archives(spark, tmp_path):
    import gzip

    rec = [warc.record("response", i, "http://x/", None, len(b), warc.digest_of(b), b) for i, b in enumerate((b"one", b"two" * 9999))]
    info = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    (tmp_path / "plain.warc").write_bytes(info + b"".join(rec))
    (tmp_path / "members.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in (info, *rec)))
    (tmp_path / "whole.warc.gz").write_bytes(gzip.compress(info + b"".join(rec)))
    out = warc.read_archives(spark, str(tmp_path)).collect()
    assert sorted((r["page_id"], bytes(r["payload"])) for r in out) == sorted([(0, b"one"), (1, b"two" * 9999)] * 3)


def test_gzip_members_are_plain_gzip():
    import gzip

    assert gzip.decompress(warc.member(b"abc" * 1000) + warc.member(b"")) == b"abc" * 1000


def test_no_pages(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), f"file://{tmp_path}/e")
    assert warc.read_archives(spark, f"file://{tmp_path}/e").count() == 0


# neighbours


def exact(rows, k=5):
    fine = [(i, np.array(v, float)) for i, v in rows if v is not None and len(v) == 8 and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for q, x in fine:
        if q % 50 == 0:
            best = sorted((-float(x @ y / np.linalg.norm(x) / np.linalg.norm(y)), i) for i, y in fine if i != q)[:k]
            out[q] = [i for _, i in best]
    return out


def test_neighbours_with_odd_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000 + i, [1.0] * 8) for i in range(30)] + [(2000, None), (2050, [0.0] * 8), (2100, [None] * 8), (2150, [float("nan")] * 8), (2200, [float("inf")] + [0.0] * 7), (2250, [1.0, 2.0]), (2300, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1))
    got: dict = {}
    for r in sorted(ann.nearest(df, "vec_id % 50 = 0").collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    want = exact(rows)
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.9 * sum(map(len, want.values()))
    assert got[1000] == [1001, 1002, 1003, 1004, 1005]
    assert ann.nearest(df.limit(0), "true").count() == 0
    few = ann.nearest(spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>"), "true")
    assert few.groupBy("query_id").count().collect() and {r["count"] for r in few.groupBy("query_id").count().collect()} == {2}


def test_recall_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "LEAF", 64)
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding").collect()
    x = np.array([r[1] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.array([r[0] for r in rows])
    hit = total = 0
    got: dict = {}
    for r in ann.nearest(spark.read.parquet(f"{DATA}/embeddings.parquet"), "vec_id % 50 = 0").collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    for q in np.flatnonzero(ids % 50 == 0):
        s = x @ x[q]
        s[q] = -9
        want = set(ids[np.argsort(-s, kind="stable")[:5]].tolist())
        hit += len(want & got[int(ids[q])])
        total += 5
    assert hit >= 0.9 * total


# classifiers


@pytest.fixture(scope="module")
def labelled():
    con = duckdb.connect()
    return con.sql("SELECT doc_id, text, quality, toxic FROM '/root/testdata/sf0.1/documents.parquet' JOIN '/root/testdata/sf0.1/labels.parquet' USING (doc_id) ORDER BY doc_id").fetchall()


def split(rows, divisor, held, column):
    fold = lambda r: zlib.crc32(str(r[0]).encode()) % divisor == held
    return [(r[1], r[column]) for r in rows if not fold(r)], [(r[1], r[column]) for r in rows if fold(r)]


def test_quality_on_held_out_labels(labelled):
    train, held = split(labelled, 5, 0, 2)
    model = quality.QualityModel().fit([t for t, _ in train[:2500]], [y for _, y in train[:2500]])
    p, y = model.score(pa.array([t for t, _ in held])), np.array([y for _, y in held])
    assert (p >= 0.3)[y == 1].mean() > 0.98 and (p >= 0.3)[y == 0].mean() < 0.1
    assert np.isfinite(model.score(pa.array(["", None, "x", "y " * 50000]))).all()


def test_quality_keeps_the_share_of_labels(spark, docs_of):
    rng = random.Random(8)
    good, bad = "plain calm tidy words".split(), "odd loud messy words".split()
    rows, told = [], []
    for i in range(6000):
        y = int(i % 5 > 0)
        rows.append((i, " ".join(rng.choice(good if (rng.random() < 0.75) == y else bad) for _ in range(8))))
        told.append((i, y))
    labels = spark.createDataFrame(told, "doc_id long, quality int")
    got = [r["score"] for r in quality.quality_scores(docs_of(rows), labels, {0: 800, 1: 800}).where("held_out").collect()]
    assert abs(np.mean(got) - 0.8) < 0.03


def test_toxicity_on_held_out_labels(labelled):
    train, held = split(labelled, 4, 2, 3)
    model = toxicity.ToxicityModel().fit([t for t, _ in train[:2500]], [y for _, y in train[:2500]], 0.1)
    p, y = model.score(pa.array([t for t, _ in held])), np.array([y for _, y in held])
    assert (p >= 0.3)[y == 1].mean() > 0.75 and (p >= 0.3)[y == 0].mean() < 0.05
    assert np.isfinite(model.score(pa.array(["", None, "x", "y " * 50000]))).all()


def test_classifier_rows(spark, docs_of):
    rows = [(i, "good words here " * 5 if i % 2 else "BAD!! | BAD!!") for i in range(60)] + [(None, None), (70, ""), (70, "twice")]
    labels = spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(60)] + [(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for f, divisor, held in ((quality.quality_scores, 5, 0), (toxicity.toxicity_scores, 4, 2)):
        out = f(docs_of(rows), labels).collect()
        assert len(out) == 63
        for r in out:
            assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
            assert r["held_out"] == (None if r["doc_id"] is None else zlib.crc32(str(r["doc_id"]).encode()) % divisor == held)
        assert f(docs_of(rows), labels.limit(0)).count() == 63 and f(docs_of([]), labels).count() == 0
    kept = quality.keep_quality(docs_of(rows), labels)
    assert kept.columns == docs_of([]).columns and kept.where("doc_id % 2 = 1 and doc_id < 60").count() == 30


# queries and the pipeline


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    df = queries.queries()[name](spark, DATA)
    want = con.sql(queries.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    canon = lambda rows, cols: sorted(tuple(str(dict(zip(cols, r, strict=True))[c]) for c in sorted(cols)) for r in rows)
    assert canon([tuple(r) for r in df.collect()], df.columns) == canon(want.fetchall(), want.columns)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    counts, sets = [docs.count()], None
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, BIG)
        if name != "packing":
            assert out.columns == docs.columns
        if name == "near_dedup":
            rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
            keep = {i for i, (_, c) in brute.near(rows).items() if i == c}
            assert {r["doc_id"] for r in out.collect()} == keep
        if name == "decontaminate":
            items = [brute.shingles(r["text"]) for r in spark.read.parquet(f"{BIG}/benchmark.parquet").collect()]
            sets = {r["doc_id"]: brute.shingles(r["text"]) for r in docs.collect()}
            clean = {i for i, s in sets.items() if not any(q and len(s & q) >= 0.75 * len(q) for q in items)}
            assert {r["doc_id"] for r in out.collect()} == clean
        docs = out
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[3] and counts[2] >= counts[3] > 0
