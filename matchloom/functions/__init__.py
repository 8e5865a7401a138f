"""Column functions: text normalisation and similarity, all JVM-side."""
