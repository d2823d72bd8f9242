"""Support-knowledge analytics on Spark: ingest, link, extract, search, govern.

Every public function takes DataFrames or Columns and returns DataFrames or Columns; nothing is
collected and no session state is kept, so the same plan serves a laptop fixture and a cluster.
"""
