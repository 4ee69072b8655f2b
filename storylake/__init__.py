"""storylake: Spark jobs over nested text corpora."""
