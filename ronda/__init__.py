"""ronda: guard-coverage, survey and message analytics as Spark DataFrame jobs.

Every operator takes DataFrames and returns a lazy DataFrame.  The person who
asks is a column (``email_login``), so one job answers for everybody and a
filter on that column gives a single person's report.
"""

from ronda.settings import Settings

__all__ = ["Settings"]
