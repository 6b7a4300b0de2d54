"""linkloom: crawl analytics on Spark.

Stored web pages in, link graph and crawl frontier out.  Every operator is a
DataFrame -> DataFrame transformation built from Spark SQL expressions, joins
and aggregates; column helpers are Column -> Column.  The same functions run
in batch and in Structured Streaming.
"""

from linkloom.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
