"""The query language: parser, compiler, and the registered queries."""
