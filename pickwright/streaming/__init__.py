"""Empty on purpose: the reference has no streaming job, so none is built.

Every job reads its whole input and writes its whole output; rows after the as-of date
are excluded in batch (``pickwright.sources.sinks.run_as_of``).
"""
