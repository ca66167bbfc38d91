"""auditloom: data quality and group fairness audits as Spark jobs."""

__version__ = "0.1.0"
