"""Spark jobs that prepare controllable-video training sets and large text corpora."""
