"""Column-level building blocks: field paths, typed accessors, codecs of single values."""
