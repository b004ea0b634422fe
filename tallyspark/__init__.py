"""tallyspark: multi-tenant entity sync with an external accounting system, as Spark jobs.

Every operator takes and returns DataFrames, keeps no global session and uses
no Python UDFs.  See README.md for the operator map.
"""

__version__ = "0.1.0"
