"""Tables in the shared folder that are deleted as soon as nothing needs them."""

from ..session import Scratch

__all__ = ["Scratch"]
