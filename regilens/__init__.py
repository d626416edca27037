"""regilens: registry compliance analytics on Spark DataFrames.

Staging tables -> clean star schema (dog dimension, registration and
transaction facts) -> data-quality audit -> compliance analytics and
dashboard marts. Everything is built-in Spark SQL; see README.md."""

__version__ = "0.1.0"
