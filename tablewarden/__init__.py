"""PySpark-native library for looking after large tables.

Sub-packages: ``sources`` (readers and writers), ``functions`` (column expressions), ``operators`` (DataFrame
operators: quality checks, partitions, lineage, ledgers, observability), ``plans`` (the registered queries and
their SQL) and ``streaming`` (Structured Streaming forms).
"""

__version__ = "0.1.0"
