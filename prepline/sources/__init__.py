"""Readers and writers."""

from prepline.sources.files import DataCube, release, scan, write
from prepline.sources.tables import table

__all__ = ["DataCube", "release", "scan", "table", "write"]
