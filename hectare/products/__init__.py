"""User-facing table products."""

from . import incremental  # noqa: F401
