"""Spark-first processing of conversation corpora, image geometry, edit parameters and worker events."""
