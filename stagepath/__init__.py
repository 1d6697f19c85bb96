"""Ordered-funnel analytics over clickstream logs, as Spark DataFrame operators."""
