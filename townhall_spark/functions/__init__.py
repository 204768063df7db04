"""Column builders: text, field specs, ids, regions, lexicon, domains."""
