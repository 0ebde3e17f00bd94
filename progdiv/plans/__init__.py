"""The query catalogue on the standard tables."""

from progdiv.plans import catalogue, programs  # noqa: F401  (programs adds to the catalogue)
