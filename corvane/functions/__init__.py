"""Column functions over text, URLs and contracts; all of them stay in the JVM."""
