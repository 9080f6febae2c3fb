"""The eight questions about a code graph, over DataFrames of nodes and edges."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row

from codeloom.operators import lookup, neighbors, similarity, walk
from codeloom.operators.paging import OUTLINE, RESPONSE_BYTES, SCORE, STRUCTURAL, TALLY_FILES, TALLY_RESERVE, Page, paginate

COLUMNS = ["id", "edgeKind", "resolved", "nodeId", "nodeKind", "name", "qualifiedName", "filePath", "startLine"]


class NotFound(LookupError):
    """No node answers; ``hints`` are near misses."""

    def __init__(self, what: str, hints: list[str] | None = None):
        super().__init__(what)
        self.hints = hints or []


@dataclass
class Definition:
    """One node, or candidates by how often they are used."""

    node: Row | None = None
    candidates: Page | None = None

    @property
    def ambiguous(self) -> bool:
        return self.candidates is not None


@dataclass
class References:
    page: Page
    files: list[Row] = field(default_factory=list)


class Engine:
    def __init__(self, nodes: DataFrame, edges: DataFrame, vectors: DataFrame | None = None, embed: Callable[[str], list[float]] | None = None):
        self.nodes, self.edges, self.vectors, self.embed = nodes, edges, vectors, embed

    def find_definition(self, symbol_name: str | None = None, file_path: str | None = None, position: tuple[int, int] | None = None, cursor: str | None = None) -> Definition:
        """By position if one is given, else by qualified name if exactly one has it, else by name."""
        if position is not None and file_path is not None:
            row = lookup.by_position(self.nodes, file_path, *position).first()
            if row is None:
                raise NotFound(f"nothing at {file_path}:{position[0]}:{position[1]}")
            return Definition(row)
        if symbol_name is None:
            raise ValueError("a symbol name, or a file and a position")
        exact = lookup.by_qualified_name(self.nodes, symbol_name, file_path).limit(2).collect()
        if len(exact) == 1:
            return Definition(exact[0])
        named = lookup.by_name(self.nodes, symbol_name, file_path)
        some = named.limit(2).collect()
        if not some:
            raise NotFound(f"no symbol {symbol_name}", [r["name"] for r in lookup.in_file_named(self.nodes, symbol_name).collect()])
        if len(some) == 1:
            return Definition(some[0])
        ranked = neighbors.with_popularity(named, self.edges)
        return Definition(None, paginate(ranked, SCORE, 20, cursor))

    def anchor(self, symbol_id: str | None = None, symbol_name: str | None = None) -> Row | Page:
        """The node that a question is about, or candidates for it. A file isn't a symbol."""
        if (symbol_id is None) == (symbol_name is None):
            raise ValueError("exactly one of symbol_id and symbol_name")
        if symbol_id is not None:
            row = lookup.by_id(self.nodes, symbol_id).first()
            if row is None:
                raise NotFound(f"no node {symbol_id}")
        else:
            found = self.find_definition(symbol_name)
            if found.ambiguous:
                return found.candidates
            row = found.node
        if row["kind"] == "File":
            raise ValueError(f"{row['filePath']} is a file: ask for its outline or dependencies")
        return row

    def _page(self, direction: str, kinds: list[str], with_tally: bool, symbol_id: str | None, symbol_name: str | None, cursor: str | None, limit: int | None, file_paths: list[str] | None) -> References:
        at = self.anchor(symbol_id, symbol_name)
        if isinstance(at, Page):
            return References(at)
        found = neighbors.neighbors(self.nodes, self.edges, at["id"], at["filePath"], direction, kinds, file_paths)
        page = paginate(found, STRUCTURAL, limit, cursor, COLUMNS, RESPONSE_BYTES - TALLY_RESERVE * with_tally)
        files = neighbors.tally(found, TALLY_FILES).collect() if with_tally and page.results else []
        return References(page, files if neighbors.tally_wanted(page.has_more, len(page.results), len(files)) else [])

    def find_references(self, symbol_id=None, symbol_name=None, cursor=None, limit=None, file_paths=None) -> References:
        return self._page(neighbors.INCOMING, neighbors.REFERENCE_KINDS, True, symbol_id, symbol_name, cursor, limit, file_paths)

    def find_callers(self, symbol_id=None, symbol_name=None, cursor=None, limit=None, file_paths=None) -> References:
        return self._page(neighbors.INCOMING, ["CALLS"], True, symbol_id, symbol_name, cursor, limit, file_paths)

    def find_callees(self, symbol_id=None, symbol_name=None, cursor=None, limit=None, file_paths=None) -> References:
        return self._page(neighbors.OUTGOING, ["CALLS"], False, symbol_id, symbol_name, cursor, limit, file_paths)

    def find_implementations(self, symbol_id=None, symbol_name=None, cursor=None, limit=None, transitive=False, max_depth=walk.MAX_DEPTH, resume_token=None) -> References | tuple[list[dict], walk.Walk]:
        """Direct subtypes as a page, or all below as a walk that can be resumed."""
        if resume_token is not None:
            if symbol_id or symbol_name or transitive:
                raise ValueError("a resume token stands alone")
            return self._walked(walk.resume_walk(self.edges, resume_token), walk.State.read(resume_token), False)
        if not transitive:
            return self._page(neighbors.INCOMING, ["SUPERTYPE_OF"], False, symbol_id, symbol_name, cursor, limit, None)
        at = self.anchor(symbol_id, symbol_name)
        if isinstance(at, Page):
            return References(at)
        state = walk.State(neighbors.INCOMING, "SUPERTYPE_OF", max_depth, walk.MAX_FANOUT, {at["id"]: 0}, [])
        return self._walked(walk.path_walk(self.edges, at["id"], state.direction, state.kind, max_depth), state, False)

    def get_file_outline(self, file_path: str, cursor: str | None = None, limit: int | None = None) -> Page:
        file = lookup.file_node(self.nodes, file_path).first()
        if file is None:
            raise NotFound(f"no file {file_path}")
        return paginate(neighbors.outline(self.nodes, self.edges, file["id"]), OUTLINE, limit, cursor)

    def get_dependencies(self, file_path: str | None = None, module_id: str | None = None, direction: str = neighbors.OUTGOING, max_depth: int = 2, max_fanout: int = walk.MAX_FANOUT, resume_token: str | None = None) -> tuple[list[dict], walk.Walk]:
        """Files and modules over imports; a module id may be a node's or a path."""
        if resume_token is not None:
            return self._walked(walk.resume_walk(self.edges, resume_token), walk.State.read(resume_token), True)
        name = file_path if file_path is not None else module_id
        if name is None:
            raise ValueError("a file path, a module id or a resume token")
        at = lookup.by_id(self.nodes, name).first() if module_id is not None else None
        at = at or lookup.file_node(self.nodes, name).first()
        if at is None:
            near = lookup.files_under(self.nodes, name).collect() or lookup.files_in_dir(self.nodes, name.rstrip("/").rpartition("/")[2]).collect()
            raise NotFound(f"no file or module {name}", [r["filePath"] for r in near])
        state = walk.State(direction, "IMPORTS", max_depth, max_fanout, {at["id"]: 0}, [])
        return self._walked(walk.path_walk(self.edges, at["id"], direction, "IMPORTS", max_depth, max_fanout), state, True)

    def _walked(self, found: walk.Walk, state: walk.State, dependency: bool) -> tuple[list[dict], walk.Walk]:
        """The walk's nodes but its start, within the bytes of a response."""
        depth = {i: d for i, d in found.nodes if d > 0}
        if not depth:
            return [], found
        rows = lookup.published(self.nodes.where(self.nodes["id"].isin(list(depth))), dependency).collect()  # a budget of ids
        out = sorted((r.asDict() | {"depth": depth[r["id"]]} for r in rows), key=lambda r: (r["depth"], r["id"]))
        return walk.cut_to_bytes(found, out, state, RESPONSE_BYTES)

    def search_code(self, query: str | list[float], cursor: str | None = None, limit: int | None = None) -> Page:
        if self.vectors is None:
            raise ValueError("no vectors")
        vector = self.embed(query) if isinstance(query, str) else query
        return paginate(similarity.scored_nodes(self.nodes, self.vectors, vector), SCORE, limit, cursor)
