"""Crawl-to-search analytics on PySpark DataFrames.

The package turns stored web pages into a searchable corpus and answers batches of
queries over it.  Every public function takes and returns DataFrames (or Columns), so
plans stay lazy and Catalyst decides how to run them.
"""

from quarrylamp.session import build_session

__all__ = ["build_session"]
