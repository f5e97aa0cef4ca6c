"""Training-data operators: cleaning, scoring, deduplication, decontamination and tokenisation of text corpora.

Each module holds one operator with a general DataFrame interface. ``registry`` holds the thin ``opN_<name>`` queries over
the test tables. Nothing outside this subpackage imports it.
"""
