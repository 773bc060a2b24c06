"""Tables, listings, ignore rules, configuration and map codecs."""
