"""logloom: build-log and source-tree analytics on the Spark DataFrame API."""
