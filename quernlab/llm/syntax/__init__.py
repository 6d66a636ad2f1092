"""Syntax checks of whole source files: lexers with a pushdown stack, then the grammar of each language."""
