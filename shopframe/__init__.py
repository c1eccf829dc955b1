"""shopframe - the data work of an online shop as Spark DataFrame jobs."""

from .session import build_session, checkpoint_root

__all__ = ["build_session", "checkpoint_root"]
