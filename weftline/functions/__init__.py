"""Column functions of the dialect and the registry of user functions."""

from .columns import *  # noqa: F403
from .registry import FunctionRegistry  # noqa: F401
