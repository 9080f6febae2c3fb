"""Linking across files: stand-in nodes are resolved to the symbols they name, by joins and bounded loops."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom import model
from codeloom.storage import cut

#: Re-exports are followed over at most so many files.
MAX_HOPS = 8


def link_imports(nodes: DataFrame, edges: DataFrame, only: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Imports of modules whose path is an indexed file lead to that file and are resolved.

    A stand-in that no edge touches any more is dropped. ``only`` (id) restricts which stand-ins are linked.
    """
    standing = nodes.where((F.col("kind") == "Module") & (F.col("nativeKind") == model.RESOLVED_MODULE)).select(F.col("id").alias("_m"), "qualifiedName")
    if only is not None:
        standing = standing.join(only.select(F.col("id").alias("_m")), "_m", "left_semi")
    files = nodes.where("kind = 'File'").groupBy("filePath").agg(F.min("id").alias("_f"))
    found = standing.join(files, F.col("qualifiedName") == F.col("filePath")).select("_m", "_f")
    met = edges.join(found, (F.col("toId") == F.col("_m")) & (F.col("kind") == "IMPORTS"), "left")
    hit = F.col("_f").isNotNull()
    linked = met.withColumn("toId", F.coalesce("_f", "toId")).withColumn("resolved", F.col("resolved") | hit).drop("_m", "_f")
    touched = linked.select(F.col("fromId").alias("_m")).unionByName(linked.select(F.col("toId").alias("_m")))
    gone = found.select("_m").join(touched, "_m", "left_anti")
    return nodes.join(gone, nodes["id"] == gone["_m"], "left_anti"), linked


def imports_in_diff(nodes: DataFrame, diff_nodes: DataFrame) -> DataFrame:
    """The stand-ins that a diff can affect: its own, and those that wait for a file that it adds."""
    standing = nodes.where((F.col("kind") == "Module") & (F.col("nativeKind") == model.RESOLVED_MODULE)).select("id", "qualifiedName")
    own = standing.join(diff_nodes.select("id"), "id", "left_semi").select("id")
    files = diff_nodes.where("kind = 'File'").select(F.col("filePath").alias("qualifiedName"))
    return own.unionByName(standing.join(files, "qualifiedName", "left_semi").select("id")).distinct()


def address_file(qualified: Column, name: Column) -> Column:
    """The file of ``<file>#<name>``, parted at the last sign; null if it isn't of that form."""
    file = F.substring(qualified, F.lit(1), F.length(qualified) - F.length(name) - 1)
    return F.when(qualified.endswith(F.concat(F.lit("#"), name)) & (F.length(file) > 0), file)


def reexports(nodes: DataFrame) -> DataFrame:
    """(file, published, next_file, next_name): what barrels forward; published ``*`` forwards every name but default."""
    rows = nodes.where((F.col("kind") == "Module") & (F.col("nativeKind") == model.REEXPORT))
    last = F.substring_index("qualifiedName", "#", -1)
    return rows.select(F.col("filePath").alias("file"), F.col("name").alias("published"), address_file(F.col("qualifiedName"), last).alias("next_file"), last.alias("next_name")).where("next_file is not null")


def pending(nodes: DataFrame) -> DataFrame:
    """(id, file, name): names that files use of other files."""
    rows = nodes.where((F.col("kind") == "Module") & (F.col("nativeKind") == model.PENDING_SYMBOL))
    return rows.select("id", address_file(F.col("qualifiedName"), F.col("name")).alias("file"), "name").where("file is not null")


def exported_symbols(nodes: DataFrame) -> DataFrame:
    shown = nodes.where(model.visible() & F.col("exported") & ~F.col("kind").isin("File", "Module"))
    return shown.select(F.col("filePath").alias("file"), "name", F.col("id").alias("target"), F.col("kind").alias("target_kind"))


def _hop(at: DataFrame, forwards: DataFrame) -> DataFrame:
    """One step through re-exports, from (o_file, o_name, file, name)."""
    same = (at["file"] == forwards["file"]) & ((forwards["published"] == at["name"]) | ((forwards["published"] == model.EXPORT_ALL) & (at["name"] != model.DEFAULT)))
    name = F.when(forwards["published"] == model.EXPORT_ALL, at["name"]).otherwise(forwards["next_name"])
    return at.join(forwards, same).select("o_file", "o_name", forwards["next_file"].alias("file"), name.alias("name")).distinct()


def resolve_addresses(addresses: DataFrame, nodes: DataFrame) -> DataFrame:
    """(o_file, o_name, target_kind, target, last, hops): the least and the greatest of what each (file, name) names, by kind.

    These are equal if it names one symbol, and a row stays a row however many symbols share an address.
    An address is looked up before its re-exports are followed, and stops at the least depth where anything exported
    answers. Distinct addresses walk together, each hop is cut, and an address never returns to where it was.
    """
    ends = [F.min("target").alias("target"), F.max("last").alias("last")]
    forwards, symbols = cut(reexports(nodes)), cut(exported_symbols(nodes).withColumn("last", F.col("target")).groupBy("file", "name", "target_kind").agg(*ends))
    at = cut(addresses.select(F.col("file").alias("o_file"), F.col("name").alias("o_name"), "file", "name").distinct())
    seen, found = at, None
    for hops in range(MAX_HOPS + 1):
        hit = cut(at.join(symbols, ["file", "name"]).groupBy("o_file", "o_name", "target_kind").agg(*ends).withColumn("hops", F.lit(hops)))
        found = hit if found is None else found.unionByName(hit)
        still = at.join(hit.select("o_file", "o_name"), ["o_file", "o_name"], "left_anti")
        at = cut(_hop(still, forwards).join(seen, ["o_file", "o_name", "file", "name"], "left_anti"))
        if at.isEmpty():
            break
        seen = seen.unionByName(at)
    return found


def _fits(edge_kind: Column, target_kind: Column) -> Column:
    return F.when(edge_kind == "CALLS", target_kind == "Function").when(edge_kind == "SUPERTYPE_OF", target_kind == "Type").when(edge_kind == "REFERENCES", F.lit(True)).otherwise(False)


def link_symbols(nodes: DataFrame, edges: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """Uses of pending names lead to the one symbol that fits the edge's kind; with none or several they stay.

    ``only`` (id) restricts which stand-ins are linked; they are kept as nodes in any case.
    """
    waiting = pending(nodes)
    if only is not None:
        waiting = waiting.join(only.select("id").distinct(), "id", "left_semi")
    found = resolve_addresses(waiting, nodes)
    named = waiting.join(found, (waiting["file"] == found["o_file"]) & (waiting["name"] == found["o_name"])).select("id", "target", "last", "target_kind")
    kinds = edges.select(F.col("toId").alias("id"), F.col("kind").alias("edge_kind")).join(waiting.select("id"), "id", "left_semi").distinct()
    one = kinds.join(named, "id").where(_fits(F.col("edge_kind"), F.col("target_kind")))
    one = one.groupBy("id", "edge_kind").agg(F.min("target").alias("target"), F.max("last").alias("last")).where("target = last")
    one = one.select(F.col("id").alias("_p"), F.col("edge_kind").alias("_k"), F.col("target").alias("_t"))
    met = edges.join(one, (F.col("toId") == F.col("_p")) & (F.col("kind") == F.col("_k")), "left")
    return met.withColumn("toId", F.coalesce("_t", "toId")).withColumn("resolved", F.col("resolved") | F.col("_t").isNotNull()).drop("_p", "_k", "_t")


def republished(addresses: DataFrame, nodes: DataFrame) -> DataFrame:
    """(file, name): the addresses under which others may know the given ones, themselves included. A name ``*`` is any name."""
    forwards = cut(reexports(nodes))
    at = cut(addresses.select("file", "name").distinct())
    seen = at
    for _ in range(MAX_HOPS):
        any_name = (at["name"] == model.EXPORT_ALL) | (forwards["next_name"] == at["name"])
        met = at.join(forwards, (forwards["next_file"] == at["file"]) & ((forwards["published"] == model.EXPORT_ALL) & (at["name"] != model.DEFAULT) | (forwards["published"] != model.EXPORT_ALL) & any_name))
        name = F.when(forwards["published"] == model.EXPORT_ALL, at["name"]).otherwise(forwards["published"])
        at = cut(met.select(forwards["file"].alias("file"), name.alias("name")).distinct().join(seen, ["file", "name"], "left_anti"))
        if at.isEmpty():
            break
        seen = seen.unionByName(at)
    return seen


def waiting_under(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Pending names of some files, as a range of qualified names, so that sorted files are read by prefix."""
    f = files.select(F.col("file").alias("_f")).distinct()
    rows = nodes.where(F.col("nativeKind") == model.PENDING_SYMBOL)
    return rows.join(f, (F.col("qualifiedName") >= F.concat("_f", F.lit("#"))) & (F.col("qualifiedName") < F.concat("_f", F.lit("$")))).drop("_f")


def symbols_in_diff(nodes: DataFrame, diff_nodes: DataFrame, diff_edges: DataFrame) -> DataFrame:
    """The pending names that a diff can affect: its own, those its edges point at, and those that wait for a name
    which it exports or forwards, under whatever address others know that."""
    waiting = pending(nodes)
    own = waiting.join(diff_nodes.select("id"), "id", "left_semi").select("id")
    aimed = waiting.join(diff_edges.select(F.col("toId").alias("id")), "id", "left_semi").select("id")
    fresh = exported_symbols(diff_nodes).select("file", "name").unionByName(reexports(diff_nodes).select("file", F.col("published").alias("name")))
    known = republished(fresh, nodes)
    some = waiting.join(known, ["file", "name"], "left_semi").select("id")
    every = waiting.join(known.where(F.col("name") == model.EXPORT_ALL).select("file"), "file", "left_semi").select("id")
    return reduce(DataFrame.unionByName, [own, aimed, some, every]).distinct()


def upgrade_edges(edges: DataFrame, answers: DataFrame) -> DataFrame:
    """Unresolved edges with exactly one answer (id, target) get it, under their own id, as the checker's."""
    one = answers.groupBy("id").agg(F.count_distinct("target").alias("n"), F.min("target").alias("_t")).where("n = 1").select("id", "_t")
    met = edges.join(one, "id", "left")
    hit = F.col("_t").isNotNull() & ~F.col("resolved")
    out = met.withColumn("toId", F.when(hit, F.col("_t")).otherwise(F.col("toId"))).withColumn("source", F.when(hit, "ts-compiler").otherwise(F.col("source")))
    return out.withColumn("resolved", F.col("resolved") | hit).drop("_t").select(*edges.columns)


def first_forward(candidates: DataFrame) -> DataFrame:
    """Without a checker: of several ``export *`` answers (id, target, statement) the first statement's."""
    return candidates.groupBy("id").agg(F.min_by("target", F.struct("statement", "target")).alias("target"))


def namespace_members(uses: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stand-ins and edges for ``ns.member`` sites: ``uses`` (fromId, filePath, target_file, member, edge_kind)."""
    qualified = F.concat_ws("#", "target_file", "member")
    pid = model.node_id(F.col("filePath"), F.lit("Module"), qualified, F.lit(model.PENDING_SYMBOL))
    known = uses.join(found.select(F.col("o_file").alias("target_file"), F.col("o_name").alias("member")).distinct(), ["target_file", "member"], "left_semi").withColumn("id", pid)
    nodes = known.select("id", F.lit("Module").alias("kind"), F.col("member").alias("name"), qualified.alias("qualifiedName"), "filePath", F.lit(model.PENDING_SYMBOL).alias("nativeKind"), F.lit(False).alias("exported"), F.lit(False).alias("hasSyntaxErrors")).distinct()
    edges = known.select(model.edge_id(F.col("fromId"), F.col("edge_kind"), F.col("id")).alias("id"), "fromId", F.col("id").alias("toId"), F.col("edge_kind").alias("kind"), F.lit("tree-sitter").alias("source"), F.lit(False).alias("resolved")).distinct()
    return model.conform(nodes, model.NODES), model.conform(edges, model.EDGES)


def bind_overloads(edges: DataFrame, sites: DataFrame, declarations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Calls of overloaded symbols, one edge for each declaration that they meet.

    ``sites`` (edgeId, filePath, line, col): where the checker sends each call of an edge; a null path is a call
    without an answer. An edge is bound only if all of its sites lead into declarations of one node, the tightest
    range around each; then the edge itself goes.
    """
    ranged = declarations.join(nodes.select(F.col("id").alias("nodeId"), F.col("filePath").alias("_file")), "nodeId")
    inside = (F.col("filePath") == F.col("_file")) & (F.struct("startLine", "startCol") <= F.struct("line", "col")) & (F.struct("line", "col") <= F.struct("endLine", "endCol"))
    met = sites.join(ranged.drop("signature", "hasBody"), inside, "left")
    tight = F.min_by(F.struct("nodeId", "ordinal"), F.struct(F.col("endLine") - F.col("startLine"), F.col("endCol") - F.col("startCol"), F.col("ordinal"))).alias("hit")
    each = met.groupBy("edgeId", "filePath", "line", "col").agg(tight)
    all_of = each.groupBy("edgeId").agg(F.bool_and(F.col("hit").isNotNull() & F.col("hit.nodeId").isNotNull()).alias("ok"), F.count_distinct("hit.nodeId").alias("n"), F.collect_set("hit.ordinal").alias("ordinals"), F.min("hit.nodeId").alias("_to"))
    bound = all_of.where("ok and n = 1").select(F.col("edgeId").alias("_e"), F.explode("ordinals").alias("_o"), "_to")
    rest = edges.join(bound.select("_e").distinct(), edges["id"] == F.col("_e"), "left_anti")
    new = edges.join(bound, edges["id"] == F.col("_e")).withColumn("toId", F.col("_to")).withColumn("toDeclaration", F.col("_o"))
    new = new.withColumn("id", model.edge_id(F.col("fromId"), F.col("kind"), F.col("toId"), F.col("toDeclaration"))).withColumn("source", F.lit("ts-compiler")).withColumn("resolved", F.lit(True))
    return rest.unionByName(new.select(*edges.columns))


def retracted(previous: DataFrame, current: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Ids (filePath, id) that were emitted for a file in scope and aren't any more."""
    scope = previous if files is None else previous.join(files.select("filePath").distinct(), "filePath", "left_semi")
    return scope.join(current.select("filePath", "id"), ["filePath", "id"], "left_anti")
