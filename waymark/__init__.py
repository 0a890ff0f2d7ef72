"""Spark jobs over typed specification graphs: what files declare against what they show."""
