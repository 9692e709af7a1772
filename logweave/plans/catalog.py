"""All registered queries of the analytics engine: name -> callable(spark, sf_dir), and name -> SQL."""

from . import chunking, runs, text, vectors

QUERIES = chunking.QUERIES | text.QUERIES | vectors.QUERIES | runs.QUERIES
SQL = chunking.SQL | text.SQL | vectors.SQL | runs.SQL
