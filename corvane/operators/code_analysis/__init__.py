"""Static analysis of source files into grouped object lifecycles. Plain Python, no Spark."""
