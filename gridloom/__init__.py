"""gridloom: column representation analytics and corpus preparation on PySpark."""
