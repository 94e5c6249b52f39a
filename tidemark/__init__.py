"""Session-window volume analytics expressed as Spark DataFrame plans."""

from tidemark.settings import COTTON, Market

__all__ = ["COTTON", "Market"]
