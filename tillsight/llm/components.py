"""Connected components, as all operators share them."""

from tillsight.operators.components import components, fewer_edges, forest

__all__ = ["components", "fewer_edges", "forest"]
