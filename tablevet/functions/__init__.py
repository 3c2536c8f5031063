"""SQL fragments shared by every operator.

A fragment is Spark SQL text over a column reference, so that a scan of hundreds of
measurements is one ``selectExpr``.  All of them run inside the JVM.
"""
