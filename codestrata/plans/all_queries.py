"""Imports every module that registers queries."""

from codestrata.plans import catalogue, corpus, graphs, reviews  # noqa: F401
