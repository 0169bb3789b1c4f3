"""Cross-source evidence analytics on Spark DataFrames.

The public surface: ``functions`` (columns), ``operators`` (DataFrame to
DataFrame), ``sources`` (readers) and ``streaming``. ``plans`` holds the
registered queries and ``llm`` the training-data operators.
"""

__all__ = ["functions", "operators", "plans", "sources", "streaming"]
