"""Column expressions: text, labels, vectors, citations, templates. All run inside the JVM."""
