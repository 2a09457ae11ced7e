"""Training-data operators: thirteen Spark jobs over text corpora. Nothing outside this subpackage imports it."""
