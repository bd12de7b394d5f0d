"""A Spark-native engine for indexing, searching, auditing and evaluating collections of text documents."""

__version__ = "0.2.0"

from .config import Settings, capabilities, load_settings
from .operators.store import IndexResult, IndexStore
from .plans.search import Index, build_index, search

__all__ = ["Index", "IndexResult", "IndexStore", "Settings", "build_index", "capabilities", "load_settings", "search"]
