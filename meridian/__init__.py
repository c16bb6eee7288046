"""Meridian: entity linkage, point-in-time features, exact metrics and prioritised queues as Spark plans."""
