"""Knowledge-corpus analytics as composable PySpark DataFrame transforms."""
