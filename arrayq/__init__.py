"""Array and collection comprehensions, tensor algebra and loop programs as Spark plans."""

from arrayq.functions.monoids import Monoid
from arrayq.session import q
from arrayq.tensor import Tensor

__all__ = ["Monoid", "Tensor", "q"]
