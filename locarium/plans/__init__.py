"""Queries over the directory operators, each with the SQL that must give the same rows."""

from . import decisions, directory, files, merging, normalising, pages, spatial
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "decisions", "directory", "files", "merging", "normalising", "pages", "spatial"]
