"""Text and media analytics expressed as Spark DataFrame transformations."""
