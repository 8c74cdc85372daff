"""ledgerlens: Spark-native transaction analytics.

Bank alert messages and extracted statement rows become typed debit and
credit tables; merchant rules, reports, search and question answering run
as DataFrame jobs so that Catalyst plans them and the work scales out.
"""

from ledgerlens.session import get_session, checkpoint_dir  # noqa: F401

__all__ = ["get_session", "checkpoint_dir"]
