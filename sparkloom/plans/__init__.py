"""Queries of the library."""

from sparkloom.plans import catalog, code, contains, extended, files, knowledge, learning, more, pipelines, real, search, source, stored, streams, texts  # noqa: F401
