"""Network-flow analytics and threat scoring as PySpark DataFrame jobs."""
