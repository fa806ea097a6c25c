"""catwarden — schema-catalog governance and table transfer as Spark jobs.

Every operator takes and returns DataFrames. A "catalog" is a set of
normalised tables keyed by ``db_id`` so that one job audits, diffs or
summarises a whole fleet of databases at once.
"""

__version__ = "0.1.0"
