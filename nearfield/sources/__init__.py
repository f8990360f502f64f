"""Readers and writers: vector tables, text corpora, manifests, result files, prices."""
