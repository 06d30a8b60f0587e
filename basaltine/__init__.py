"""Columnar and row-batch tables, SQL semantics and a query registry on PySpark."""
