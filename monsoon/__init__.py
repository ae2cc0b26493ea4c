"""Climate-table analytics as Spark DataFrame plans and MLlib pipelines."""
