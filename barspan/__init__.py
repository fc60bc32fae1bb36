"""Bar, portfolio and corpus analytics as Spark DataFrame operators."""
