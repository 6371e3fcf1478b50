from .files import Loaded, load, read_table

__all__ = ["Loaded", "load", "read_table"]
