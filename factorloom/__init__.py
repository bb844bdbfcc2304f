"""factorloom: factor-risk analytics as composable Spark DataFrame operators."""
