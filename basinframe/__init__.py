"""basinframe: market, well-outcome and block-screening analytics as Spark jobs.

Every public function takes and returns DataFrames (or builds a Column); Spark
plans the work, nothing holds a table on the driver.
"""

__version__ = "0.1.0"
