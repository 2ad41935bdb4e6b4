"""cairn: session and text analytics as PySpark DataFrame operators.

Every operator is a function DataFrame -> DataFrame built from native Spark
expressions; Python runs inside tasks only where an operator is an ordered
fold that SQL cannot express (near-duplicate suppression, stateful streams).
"""

__version__ = "0.1.0"
