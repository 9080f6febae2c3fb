"""Point and prefix lookups over nodes, and the small projections of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.model import visible


def by_id(df: DataFrame, value: str) -> DataFrame:
    """A node or an edge by its primary key."""
    return df.where(F.col("id") == value).limit(1)


def by_name(nodes: DataFrame, name: str, file_path: str | None = None) -> DataFrame:
    found = nodes.where((F.col("name") == name) & visible())
    return found if file_path is None else found.where(F.col("filePath") == file_path)


def by_qualified_name(nodes: DataFrame, name: str, file_path: str | None = None) -> DataFrame:
    found = nodes.where((F.col("qualifiedName") == name) & visible())
    return found if file_path is None else found.where(F.col("filePath") == file_path)


def file_node(nodes: DataFrame, file_path: str) -> DataFrame:
    return nodes.where((F.col("kind") == "File") & (F.col("filePath") == file_path))


def _holds(line: Column, col: Column) -> Column:
    """Whether a node's range holds a position, both ends included."""
    after_start = (F.col("startLine") < line) | ((F.col("startLine") == line) & (F.col("startCol") <= col))
    before_end = (F.col("endLine") > line) | ((F.col("endLine") == line) & (F.col("endCol") >= col))
    return after_start & before_end


def by_position(nodes: DataFrame, file_path: str, line: int, col: int) -> DataFrame:
    """The innermost node around a position; the file itself if nothing smaller holds it."""
    found = nodes.where((F.col("filePath") == file_path) & visible() & _holds(F.lit(line), F.lit(col)))
    return found.orderBy(F.col("endLine") - F.col("startLine"), F.col("endCol") - F.col("startCol"), "id").limit(1)


def at_positions(nodes: DataFrame, positions: DataFrame) -> DataFrame:
    """The innermost node for each of many (filePath, line, col): one join on the file, ranges as its condition.

    Of equal ranges the one with the smaller id wins. Positions in no node return nothing.
    """
    asked = positions.select(F.col("filePath").alias("_file"), "line", "col").distinct()
    met = nodes.where(visible()).join(asked, (F.col("filePath") == F.col("_file")) & _holds(F.col("line"), F.col("col")))
    tight = W.partitionBy("_file", "line", "col").orderBy(F.col("endLine") - F.col("startLine"), F.col("endCol") - F.col("startCol"), "id")
    return met.withColumn("_r", F.row_number().over(tight)).where("_r = 1").drop("_r", "_file")


def stem_like(stem: str) -> list[str]:
    return [f"%/{stem}.%", f"{stem}.%", f"%/{stem}/index.%", f"{stem}/index.%"]


def in_file_named(nodes: DataFrame, stem: str, limit: int = 5) -> DataFrame:
    """Symbols of files with a given stem, letter case ignored; nothing for names that hold path signs."""
    if not stem or any(c in stem for c in "/\\."):
        return nodes.where(F.lit(False))
    like = F.lit(False)
    for pattern in stem_like(stem):
        like = like | F.col("filePath").ilike(pattern)
    return nodes.where(like & ~F.col("kind").isin("File", "Module") & visible()).orderBy(F.col("exported").cast("int").desc(), "startLine", "id").limit(limit)


def files_under(nodes: DataFrame, prefix: str, limit: int = 5) -> DataFrame:
    """Files below a folder: index files first, then the shortest paths."""
    index = F.col("filePath").ilike("%/index.%").cast("int").desc()
    return nodes.where((F.col("kind") == "File") & F.col("filePath").ilike(prefix.rstrip("/") + "/%")).orderBy(index, F.length("filePath"), "filePath").limit(limit)


def files_in_dir(nodes: DataFrame, segment: str, limit: int = 5) -> DataFrame:
    """Files with a folder of this name anywhere on their path."""
    like = F.col("filePath").ilike(f"{segment}/%") | F.col("filePath").ilike(f"%/{segment}/%")
    index = F.col("filePath").ilike("%/index.%").cast("int").desc()
    return nodes.where((F.col("kind") == "File") & like).orderBy(index, F.length("filePath"), "filePath").limit(limit)


def within(df: DataFrame, column: str, values: list[str] | None) -> DataFrame:
    """Rows whose column is among the values; no values mean no restriction."""
    return df.where(F.col(column).isin(values)) if values else df


def published(nodes: DataFrame, for_dependency: bool = False) -> DataFrame:
    """Result columns: a file has no qualified name and position, and a module in dependency rows has no path."""
    own = F.col("kind") != "File"
    path = F.when(F.col("kind") != "Module", F.col("filePath")) if for_dependency else F.col("filePath")
    return nodes.select("id", "kind", "name", F.when(own, F.col("qualifiedName")).alias("qualifiedName"), path.alias("filePath"), F.when(own, F.col("startLine")).alias("startLine"), preview().alias("preview"))


def preview() -> Column:
    return F.coalesce("signature", "docComment")


def text_to_embed() -> Column:
    """Comment and signature, trimmed of all white space, parted by an empty line; null if there is nothing."""
    trimmed = [F.nullif(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), F.lit("")) for c in ("docComment", "signature")]
    return F.nullif(F.concat_ws("\n\n", *trimmed), F.lit(""))


def syntax_error_files(nodes: DataFrame) -> DataFrame:
    return nodes.where("hasSyntaxErrors").select("filePath").distinct().orderBy("filePath")


def flag_syntax_errors(nodes: DataFrame, broken_files: DataFrame) -> DataFrame:
    """Every node of a file that has an error anywhere is flagged."""
    bad = broken_files.select(F.col("filePath").alias("_f")).distinct().withColumn("_bad", F.lit(True))
    return nodes.join(bad, F.col("filePath") == F.col("_f"), "left").withColumn("hasSyntaxErrors", F.col("hasSyntaxErrors") | F.coalesce("_bad", F.lit(False))).drop("_f", "_bad")
