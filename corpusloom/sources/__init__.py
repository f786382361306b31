"""Reading file corpora and writing documents."""
