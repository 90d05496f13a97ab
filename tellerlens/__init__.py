"""Compliance analytics over core-banking tables, written as Spark DataFrame plans."""

from tellerlens.params import RunParams
from tellerlens.sources.bank import Bank

__all__ = ["Bank", "RunParams"]
