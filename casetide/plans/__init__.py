"""Registered queries; importing the modules fills the registry."""

from . import events, formats, inference, spatial, tables, temporal, text  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
