"""flowmill: a Spark-first engine for timestamped flow and event records.

Everything is expressed as DataFrames; nothing is executed until an action.
Sub-packages: ``functions`` (Column builders), ``operators`` (DataFrame to
DataFrame), ``sources`` (scans and sinks), ``plans`` (registered queries and
their SQL), ``streaming`` (Structured Streaming), and the optional ``llm``
(training-data operators), which nothing outside it imports.
"""

__version__ = "0.1.0"
