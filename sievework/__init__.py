"""Evaluation data at scale: manifests, gates, curated splits, probes and classifier metrics as Spark plans."""
