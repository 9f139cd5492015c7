from .live import auth_chains, histogram, table_stream

__all__ = ["auth_chains", "histogram", "table_stream"]
