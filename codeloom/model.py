"""The property graph: schemas, allowed values, ids and checks at ingest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODE_KINDS = ["File", "Module", "Type", "Function", "Variable"]
EDGE_KINDS = ["DEFINES", "IMPORTS", "CALLS", "SUPERTYPE_OF", "REFERENCES", "EXPORTS"]
EDGE_SOURCES = ["tree-sitter", "ts-compiler"]

EXTERNAL_MODULE, RESOLVED_MODULE, PENDING_SYMBOL, REEXPORT = "external_module", "resolved_module", "pending_symbol", "reexport"
#: Modules of these native kinds stand for names and are never answers to a lookup.
HIDDEN = [PENDING_SYMBOL, REEXPORT]
EXPORT_ALL, DEFAULT = "*", "default"


def _fields(spec: str) -> T.StructType:
    return T._parse_datatype_string(spec)


NODES = "id string, kind string, name string, qualifiedName string, filePath string, startLine int, startCol int, endLine int, endCol int, signature string, exported boolean, docComment string, language string, nativeKind string, hasSyntaxErrors boolean"
EDGES = "id string, fromId string, toId string, kind string, source string, resolved boolean, toDeclaration int"
DECLARATIONS = "nodeId string, ordinal int, startLine int, startCol int, endLine int, endCol int, signature string, hasBody boolean"
VECTORS = "nodeId string, embedding array<float>, embeddingVersion string"
INDEXED_FILES = "filePath string, mtime long, contentHash string"
META = "schemaVersion string, indexerVersion string, bulkIndexedAt string, semanticPassAt string, embeddingModel string"

NODE_COLUMNS = [c.split()[0] for c in NODES.split(", ")]
EDGE_COLUMNS = [c.split()[0] for c in EDGES.split(", ")]


def node_id(file_path: Column, kind: Column, qualified_name: Column, native_kind: Column) -> Column:
    """Position-free, so an edit elsewhere in a file keeps it."""
    parts = F.concat_ws("\u0000", F.lit("node"), file_path, kind, qualified_name, F.coalesce(native_kind, F.lit("")))
    return F.substring(F.sha2(parts, 256), 1, 32)


def edge_id(from_id: Column, kind: Column, to_id: Column, ordinal: Column | None = None) -> Column:
    """An edge bound to one declaration of its target has an id of its own."""
    parts = [F.lit("edge"), from_id, kind, to_id]
    plain = F.concat_ws("\u0000", *parts)
    bound = plain if ordinal is None else F.concat_ws("\u0000", *parts, ordinal.cast("string"))  # a null ordinal adds nothing
    return F.substring(F.sha2(bound, 256), 1, 32)


def conform(df: DataFrame, schema: str) -> DataFrame:
    """df in the columns and types of a schema; missing columns are null."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in _fields(schema)])


def valid_nodes(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that keep the rules, rows that don't)."""
    ok = F.coalesce(F.col("kind").isin(NODE_KINDS) & F.col("id").isNotNull() & F.col("name").isNotNull(), F.lit(False))
    return nodes.where(ok), nodes.where(~ok)


def valid_edges(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    ok = F.col("kind").isin(EDGE_KINDS) & F.col("source").isin(EDGE_SOURCES) & F.col("fromId").isNotNull() & F.col("toId").isNotNull()
    ok = F.coalesce(ok, F.lit(False))
    return edges.where(ok), edges.where(~ok)


def visible() -> Column:
    """Not a stand-in for a name; true for nodes without a native kind."""
    out = F.lit(True)
    for kind in HIDDEN:
        out = out & ~F.col("nativeKind").eqNullSafe(kind)
    return out
