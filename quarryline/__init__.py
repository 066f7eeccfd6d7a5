"""Document analytics on Spark."""

from .plans.index import manifest as build_manifest
from .session import local_session

__all__ = ["build_manifest", "local_session"]
