"""Bank-statement analytics and bookkeeping preparation on Spark."""
