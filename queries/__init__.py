"""Every registered query; importing the modules fills the registry."""

from . import lines, ordered, counts, texts, live, jobs, files  # noqa: F401
from .registry import QUERIES, SQL
