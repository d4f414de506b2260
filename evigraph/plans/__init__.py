"""Importing this package registers every query of the library."""

from evigraph.plans import basics, critic, dialectic, evaluation, evidence, fibers, ingest, reasoning, storage  # noqa: F401
