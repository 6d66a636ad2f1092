"""quernlab: preparing and measuring code-generation training sets with PySpark."""
