"""Readers and writers: parsers of file formats, Python data sources for listings and chat exports, keyed sinks."""
