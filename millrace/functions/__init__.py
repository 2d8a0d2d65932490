"""Column functions: scalars and scores. All of them stay in the JVM."""
