"""Archives of transcribed proceedings as Spark tables, and queries over them."""
