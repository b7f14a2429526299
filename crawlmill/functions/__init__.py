"""Column functions: URL algebra, text measures and the predicates of a page record. All of them stay in the JVM."""
