"""tidemark: fair-scheduling and workflow-history analytics on Spark."""
