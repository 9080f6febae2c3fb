"""Personal data in texts, in DataFrame functions only.

Regular expressions propose spans, validators confirm them (Luhn for cards, mod 97 for account numbers, ranges for
addresses, digit counts for phones), and words shortly before a span raise its score. What the plain patterns find
and their validators pass is always reported; spans of weaker patterns are reported if the words before them
raise the score to ``LEAST``.

The patterns are written so that Java's matcher neither recurses nor backtracks over long runs: loops are
possessive, and a match may only begin where a run begins or the last match ended (``\\G``). Spans follow from
splitting at the same pattern: a match begins after the gaps and matches before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST = 0.5
#: Running sums over a text's matches go by blocks of so many, so their cost stays near linear.
BLOCK = 256

_CARD = r"[0-9](?:[\x20-]?[0-9])++"
#: kind -> the base pattern
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": _CARD,
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Patterns that the method adds: kind, pattern, score, and whether only words before the span can lift it to LEAST.
ADDED = {
    "local": ("phone", r"(?<![0-9+().-])(?:\([0-9]{3}\)|[0-9]{3})[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])", 0.3),
    "short": ("card", _CARD, 0.35),
    "iban": ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}+|(?:\x20[A-Z0-9]{4}){2,7}+(?:\x20[A-Z0-9]{1,3})?+)(?![A-Za-z0-9])", 0.9),
}
#: What a text must hold for a pattern to be tried at all.
HINT = {"email": "@", "phone": "+"}
KINDS = ["email", "ip", "card", "phone", "iban"]
SCORE = {"email": 0.9, "ip": 0.6, "card": 0.9, "phone": 0.7}
#: Words that speak for a kind, in the last 40 characters before a span.
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|contact|write|kontakt|correo|courriel)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|adresse)\b",
    "card": r"(?i)\b(?:card|credit|visa|mastercard|amex|karte|carte|tarjeta)\b",
    "phone": r"(?i)\b(?:phone|tel|telephone|telefon|call|fax|mobile|cell|handy)\b",
    "iban": r"(?i)\b(?:iban|account|bank|konto|compte|cuenta)\b",
}
_OCTET = "^0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _mod97(m: Column) -> Column:
    plain = F.regexp_replace(m, " ", "")
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))

    def step(acc: Column, c: Column) -> Column:
        n = F.ascii(c)
        return F.when(n < 58, (acc * 10 + n - 48) % 97).otherwise((acc * 100 + n - 55) % 97)

    return F.aggregate(F.split(turned, "(?!^)(?!$)"), F.lit(0), step) == 1


def _passes(name: str, m: Column) -> Column:
    if name == "ip":
        return F.forall(F.split(m, r"\."), lambda p: p.rlike(_OCTET))
    if name == "card":
        return F.length(_digits(m)).between(16, 19) & F.call_function("luhn_check", _digits(m))
    if name == "short":
        return F.length(_digits(m)).between(13, 15) & F.call_function("luhn_check", _digits(m))
    if name == "phone":
        return F.length(_digits(m)).between(8, 15)
    if name == "iban":
        return _mod97(m)
    return F.lit(True)


def _spans(df: DataFrame, name: str, kind: str, pattern: str, score: float) -> DataFrame:
    """df with a column ``name``: the spans of one pattern in _text, as structs of kind, start, end and score."""
    hint = F.contains(F.col("_text"), F.lit(HINT[name])) if name in HINT else F.col("_text").rlike("[0-9]")
    proposed = F.when(hint, F.regexp_extract_all("_text", F.lit(pattern), F.lit(0)))
    df = df.withColumn("_m", F.coalesce(proposed, F.array().cast("array<string>")))
    df = df.withColumn("_g", F.when(F.size("_m") > 0, F.split("_text", pattern, -1)))
    step = F.transform("_m", lambda m, i: F.char_length(m) + F.char_length(F.get("_g", i)))
    df = df.withColumn("_s", F.when(F.size("_m") > 0, step))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    blocks = F.sequence(F.lit(0), F.floor((F.size("_s") - 1) / BLOCK).cast("int"))
    sums = F.transform(blocks, lambda b: total(F.slice("_s", b * BLOCK + 1, F.lit(BLOCK))))
    running = F.aggregate(sums, F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    df = df.withColumn("_b", F.when(F.size("_m") > 0, running))

    def span(m: Column, i: Column) -> Column:
        block = F.floor(i / BLOCK).cast("int")
        before = F.get("_b", block) + total(F.slice("_s", block * BLOCK + 1, i - block * BLOCK))
        gap = F.get("_g", i)
        near = F.when(F.substring(gap, -40, 40).rlike(CONTEXT[kind]), 0.25).otherwise(0.0)
        start = before + F.char_length(gap)
        return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.char_length(m)).alias("end"), F.least(F.lit(1.0), score + near).alias("score"), _passes(name, m).alias("ok"))

    held = F.filter(F.transform("_m", span), lambda s: s["ok"] & (s["score"] >= LEAST))
    plain = F.transform(held, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score")))
    # each of the helpers is read more than once, so they are computed once a row and not once a match
    guard = (F.size("_m") > 0) & (F.size("_b") > 0) & (F.size("_g") > 0) & (F.size("_s") > 0)
    empty = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,score:double>>")
    return df.withColumn(name, F.when(guard, plain).otherwise(empty)).drop("_m", "_g", "_s", "_b")


def find_pii(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with base and spans: arrays of (kind, start, end, score), in code points, end exclusive.

    base has what the plain patterns of each kind find and their validators pass, leftmost and non-overlapping
    within a kind; spans has those and what the method adds, ordered by kind, then start, without repeats. A null
    or empty text has none. Null and repeated ids are rows like others. Further columns are not read.
    """
    out = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    for kind, pattern in BASE.items():
        out = _spans(out, kind, kind, pattern, SCORE[kind])
    for name, (kind, pattern, score) in ADDED.items():
        out = _spans(out, name, kind, pattern, score)
    key = lambda s: F.struct(s["start"], s["end"])
    spans = []
    for kind in KINDS:
        plain = [F.col(kind)] if kind in BASE else []
        more = [F.col(n) for n, (k, _, _) in ADDED.items() if k == kind]
        fresh = [_outside(c, F.col(kind)) if kind in BASE else c for c in more]
        spans.append(F.array_sort(F.concat(*plain, *fresh), lambda a, b: F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0)))
    return out.select("doc_id", F.concat(*[F.col(k) for k in BASE]).alias("base"), F.concat(*spans).alias("spans"))


def _outside(added: Column, base: Column) -> Column:
    """The added spans that don't overlap a base span of their kind."""
    return F.filter(added, lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = [F.size(F.filter("base", _is(kind))).cast("long").alias(f"n_{kind}") for kind in BASE]
    return found.select("doc_id", *count, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def _is(kind: str):
    return lambda s: s["kind"] == kind
