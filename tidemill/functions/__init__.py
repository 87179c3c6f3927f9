"""Row-level functions: native Column expressions, and the Python behind the Arrow UDFs."""
