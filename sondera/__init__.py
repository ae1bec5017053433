"""sondera: sensor series and incubation readings to annual budgets, on Spark.

Every public function takes and returns DataFrames (or Columns), starts no job
and reads no global state.  See README.md for the operator list.
"""

__version__ = "0.1.0"
