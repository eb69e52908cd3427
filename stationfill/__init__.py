"""DataFrame operators for incomplete station time series."""

from .session import checkpointed, tune

__all__ = ["checkpointed", "tune"]
