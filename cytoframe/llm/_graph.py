"""Connected components, as the base operators find them."""

from cytoframe.operators.graph import components, least_reached

__all__ = ["components", "least_reached"]
