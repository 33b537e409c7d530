"""Enterprise-architecture graph analytics on Spark DataFrames."""

from estatemap.graph import Graph, GraphStore
from estatemap.session import build_session, cut_lineage

__all__ = ["Graph", "GraphStore", "build_session", "cut_lineage"]
