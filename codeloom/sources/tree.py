"""Project trees: supported files, ignore layers, and links that lead in circles or out of the project."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.operators.resolve import SUPPORTED

# Folders that are never indexed.
EXCLUDED = [".git", "node_modules", "dist", ".claude"]


def read_tree(spark: SparkSession, root: str, extensions: list[str] | None = None) -> DataFrame:
    """(filePath, mtime, length, content) of the supported files below a root; content is read only if it is used."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    below = F.regexp_replace("path", "^(?:[a-z0-9]+:)?/*" + re.escape(re.sub("^(?:[a-z0-9]+:)?/*", "", root).rstrip("/")) + "/", "")
    rows = files.select(below.alias("filePath"), F.unix_millis("modificationTime").alias("mtime"), "length", "content")
    return rows.where(supported(F.col("filePath"), extensions) & ~excluded(F.col("filePath")))


def supported(path: Column, extensions: list[str] | None = None) -> Column:
    ext = [re.escape(e) for e in extensions or SUPPORTED]
    return F.lower(path).rlike("(?:" + "|".join(ext) + ")$")


def excluded(path: Column) -> Column:
    return path.rlike("(?:^|/)(?:" + "|".join(map(re.escape, EXCLUDED)) + ")(?:/|$)")


def ignore_rule(line: str, folder: str = "") -> tuple[bool, str] | None:
    """(ignored, regular expression) of one line of an ignore file in a folder; None for blanks and comments."""
    text = line.rstrip("\n").rstrip()
    if not text or text.startswith("#"):
        return None
    negated, text = text.startswith("!"), text.removeprefix("!").removeprefix("\\")
    only_dirs, text = text.endswith("/"), text.rstrip("/")
    anchored, text = "/" in text, text.lstrip("/")
    out, i = "", 0
    while i < len(text):
        if text.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif text.startswith("**", i):
            out, i = out + ".*", i + 2
        elif text[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif text[i] == "?":
            out, i = out + "[^/]", i + 1
        elif text[i] == "[" and "]" in text[i + 2 :]:
            end = text.index("]", i + 2)
            out, i = out + "[" + text[i + 1 : end].replace("!", "^", 1).replace("\\", "\\\\") + "]", end + 1
        else:
            out, i = out + re.escape(text[i]), i + 1
    base = re.escape(folder.strip("/")) + "/" if folder.strip("/") else ""
    return not negated, "^" + base + ("" if anchored else "(?:.*/)?") + out + ("/" if only_dirs else "(?:/|$)")


def ignored(path: Column, layers: dict[str, str]) -> Column:
    """Whether ignore files (folder -> text) exclude a path: layers from the root down, the last line that fits wins."""
    out = F.lit(False)
    for folder in sorted(layers, key=lambda f: (f.strip("/").count("/") if f.strip("/") else -1, f)):
        for line in layers[folder].split("\n"):
            rule = ignore_rule(line, folder)
            if rule is not None:
                out = F.when(path.rlike(rule[1]), rule[0]).otherwise(out)
    return excluded(path) | out


def one_of_each(files: DataFrame, root: str) -> DataFrame:
    """files (filePath, realPath) without those that lead out of the root or nowhere; of several paths to one file the first."""
    inside = F.col("realPath").startswith(root.rstrip("/") + "/")
    ranked = files.where(F.col("realPath").isNotNull() & inside).withColumn("_r", F.row_number().over(W.partitionBy("realPath").orderBy("filePath")))
    return ranked.where("_r = 1").drop("_r")
