"""Find, report and remove duplicate rows in large text collections and tables with Spark."""

from samerow.plans import Cleaned, Found, Options, clean, find_duplicates, find_in_rows
from samerow.session import configure, save

__all__ = ["Cleaned", "Found", "Options", "clean", "configure", "find_duplicates", "find_in_rows", "save"]
