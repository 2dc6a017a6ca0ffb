"""Connected components, as the rest of the library finds them."""

from tracemill.operators.components import components

__all__ = ["components"]
