from samerow.plans.jobs import Cleaned, Found, Options, clean, find_duplicates, find_in_rows

__all__ = ["Cleaned", "Found", "Options", "clean", "find_duplicates", "find_in_rows"]
