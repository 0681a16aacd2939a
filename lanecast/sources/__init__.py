from .marketplace import (
    Sources,
    land,
    land_bucketed,
    read_bucketed,
    read_landed,
    read_marketplace_csv,
)
from .schemas import SCHEMAS, conform
from .tpch import TpchSources

__all__ = [
    "SCHEMAS",
    "Sources",
    "TpchSources",
    "conform",
    "land",
    "land_bucketed",
    "read_bucketed",
    "read_landed",
    "read_marketplace_csv",
]
