"""corpusfold: corpus routing, code-quality evaluation and update-log folds as Spark DataFrame operators.

Subpackages: ``functions`` (column builders, rule tables, regex dialects), ``sources`` (readers,
sinks), ``operators`` (classify, report, evaluate, updates, prepare), ``streaming`` (the
continuous fold) and ``plans`` (fixtures, the query catalogue and the split job). The optional ``llm`` holds the
training-data operators; nothing else imports it.
"""

__version__ = "0.1.0"
