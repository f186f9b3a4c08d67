"""Season-contest analytics as Spark DataFrame operators.

Layout: ``sources`` (scans and sinks), ``functions`` (column expressions),
``operators`` (DataFrame in, DataFrame out), ``plans`` (the four pipelines made
of them), ``catalog`` (the operators bound to the test tables, with SQL checks).
"""
