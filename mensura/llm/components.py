"""Connected components and joins with hot keys, as the library has them."""

from mensura.operators.components import connected_components
from mensura.operators.joins import joined_unskewed

__all__ = ["connected_components", "joined_unskewed"]
