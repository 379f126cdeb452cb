"""docloom: nested-document analytics, Spark first."""
