"""Column functions: text, hashes, sections, labels. All run inside the JVM."""
