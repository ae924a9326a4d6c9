"""Registered queries, each next to the SQL that checks it."""

from textloom.catalog.base import CATALOG  # noqa: F401
from textloom.catalog import (  # noqa: F401
    files,
    flows,
    generation,
    inference,
    labels,
    sampling,
    text,
    vectors,
)
