"""Registered queries: importing the package fills registry.QUERIES and registry.ORACLE_SQL."""

from loomgraph.plans import assessment, knowledge, registry

__all__ = ["assessment", "knowledge", "registry"]
