"""Link-health analytics and corpus preparation on PySpark DataFrames."""
