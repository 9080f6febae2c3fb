"""The scalar functions of the engine in one place, as Column expressions."""

from codeloom.model import edge_id, node_id, visible
from codeloom.operators.lookup import preview, text_to_embed
from codeloom.operators.resolve import candidates, dirname, extension, is_relative, normalize
from codeloom.operators.similarity import cosine, dot
from codeloom.operators.status import humanize
from codeloom.sources.tree import excluded, ignored, supported

__all__ = ["candidates", "cosine", "dirname", "dot", "edge_id", "excluded", "extension", "humanize", "ignored", "is_relative", "node_id", "normalize", "preview", "supported", "text_to_embed", "visible"]
