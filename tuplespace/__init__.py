"""tuplespace: item-tuple assembly and scoring as Spark DataFrame plans."""

from tuplespace.config import TupleConfig

__all__ = ["TupleConfig"]
__version__ = "0.1.0"
