"""The registered queries of the engine: importing this package registers all."""

from . import catalogue, documents, operations, sources, stores, streams  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
