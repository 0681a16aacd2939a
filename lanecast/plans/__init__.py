from .marts import Marts
from .reports import DERIVED, REPORTS

__all__ = ["DERIVED", "Marts", "REPORTS"]
