"""Column functions over text, and the vocabularies that they use."""
