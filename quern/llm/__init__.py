"""Operators for large training corpora; nothing else in the package imports this subpackage."""

from quern import ship_by_value

ship_by_value()
